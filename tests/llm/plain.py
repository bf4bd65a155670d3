"""Plain Python counterparts of the operators, written for themselves: no function of the package is used."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^ \t-\r]+")


# --- toxicity ----------------------------------------------------------------------------------------


def marks(text):
    """The features of a text: words without marks around them, and their beginnings of 3 to 8 letters."""
    out = set()
    for word in (text or "").split():
        w = word.lower()
        while w and w[0] in ".,;:!?\"'()[]{}«»“”„…-_*":
            w = w[1:]
        while w and w[-1] in ".,;:!?\"'()[]{}«»“”„…-_*":
            w = w[:-1]
        if w:
            out.add(w)
            out |= {w[:n] + "~" for n in range(3, 9) if len(w) >= n}
    return out


def severity(weights, thresholds, reject, text):
    """(expected severity, median grade, rejected)"""
    score = sum(weights.get(f, 0.0) for f in marks(text))
    p = [1 / (1 + math.exp(t - score)) if t - score < 700 else 0.0 for t in thresholds]
    return sum(p), sum(x >= 0.5 for x in p), p[0] >= reject


def toxic_terms(rows, most=512):
    """The terms that a model of rows (toxic, text) looks at, best first."""
    n = Counter(y for y, _ in rows)
    seen = {0: Counter(), 1: Counter()}
    for y, t in rows:
        seen[y].update(marks(t))
    out = []
    for f, t in seen[1].items():
        c = seen[0][f]
        rate = (t / n[1]) / (t / n[1] + c / n[0])
        if rate > 0.95 and t >= max(2, n[1] / 200):
            out.append((-t * math.log(t / n[1] / ((t + c) / (n[1] + n[0]))), f))
    return [f for _, f in sorted(out)[:most]]


def log_likelihood(weights, thresholds, xs, ys):
    """Of a cumulative-link model; xs: lists of feature numbers, ys: grades."""
    total = 0.0
    for x, y in zip(xs, ys):
        s = sum(weights[i] for i in x)
        above = [1.0, *[1 / (1 + math.exp(t - s)) for t in thresholds], 0.0]
        total += math.log(max(above[y] - above[y + 1], 1e-300))
    return total / len(ys)


# --- near copies ---------------------------------------------------------------------------------------


def least_of_groups(texts, n=5, similarity=0.8):
    """For each text the place of the first one of its group: Jaccard of word shingles, in lower case."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(n, len(w))
        sets.append({" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else {None})
    at = list(range(len(texts)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = len(sets[i]), len(sets[j])
            if min(a, b) >= similarity * max(a, b) and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                at[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


# --- secrets ---------------------------------------------------------------------------------------------

KINDS = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), lambda m: True),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), lambda m: True),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), lambda m: True),
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"), lambda m: True),
)


def secret_spans(text, kinds=KINDS):
    found = [(m.start(), i, kind, m.end()) for i, (kind, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def masked(text, mask="[REDACTED]"):
    hidden = [False] * len(text)
    for _, s, e in secret_spans(text):
        hidden[s:e] = [True] * (e - s)
    out = []
    for i, c in enumerate(text):
        if not hidden[i]:
            out.append(c)
        elif i == 0 or not hidden[i - 1]:
            out.append(mask)
    return "".join(out)


# --- mixing ----------------------------------------------------------------------------------------------


def goals(sizes, weights=(3, 1, 2)):
    """sizes: {source: words} -> {source: target}; shares of one and a half times all words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def mix(rows, block=512, seed=17):
    """rows (key, text, source) -> the mix as (slot, key, pass, words) by first slot, and the slots of each
    (key, pass)."""
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = {s: math.floor(t) for s, t in goals(sizes).items() if math.floor(t) > 0}
    order = sorted(want, key=lambda s: (s is None, s or ""))
    total = sum(want.values())
    quota = {s: -(-w // block) for s, w in want.items()}
    slots = {s: [] for s in want}
    n = total // block + 1 if total else 0
    for slot in range(n):
        u = slot * 0.6180339887498949
        x, s = math.floor((u - math.floor(u)) * float(total)), 0
        while x >= want[order[s]]:
            x -= want[order[s]]
            s += 1
        slots[order[s]].append(slot)
    for s in want:
        slots[s] = slots[s][: quota[s]] + [n + k for k in range(len(slots[s]), quota[s])]
    out = []
    for s in want:
        mine = sorted(((hashlib.md5(f"{seed}:{'' if k is None else k}:{s or ''}".encode()).hexdigest(), k, t) for k, t, source in rows if source == s), key=lambda r: (r[0], r[1]))
        at = 0
        for turn in range(2):
            for _, k, t in mine:
                words = min(size(t), want[s] - at)
                if words > 0:
                    held = [slots[s][b] for b in range(at // block, (at + words - 1) // block + 1)]
                    out.append((held[0], k, turn, words, len(held)))
                at += size(t)
    return sorted(out)


def first_words(text, n):
    parts = list(WORD.finditer(text))
    return text if n >= len(parts) else text[: parts[n - 1].end()]
