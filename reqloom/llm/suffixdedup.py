"""Repeated-passage removal by suffix sorting.

Every byte goes that is covered by a string of LENGTH bytes which also starts in a document of smaller
id. Suffixes are compared to that depth only. A sliding minimum over GRAM-byte hashes gives each
position its anchor; equal strings have equal anchors at equal distance, so the suffixes can be dealt by
anchor and only anchors that several documents share go on:

1. anchors: texts -> (hash, document, position), packed; what a batch of texts shares within itself is
   settled there, and one row stands for it. Dealt by hash, an anchor of two documents is shared.
2. contexts: the bytes around shared anchors. Equal contexts within a bucket of documents are settled
   there, the least document stands for them.
3. suffix sort: dealt by anchor, all suffixes that start in a context are ordered by deep-shallow
   sorting: multikey quicksort on 8-byte symbols to a shallow depth, then blind tries for the groups
   that are still equal. Neighbours equal to LENGTH bytes are repeats; the least document keeps them.
4. cut: the ranges meet their documents.

Each phase ends in a table in the shared folder; the anchors' goes once the contexts stand. A task holds a bucket; of an
anchor it holds the different contexts that are left when each bucket of documents has settled its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, partitions, prepare, text_or_empty

LENGTH, GRAM, SHALLOW = 50, 24, 16
WINDOW = LENGTH - GRAM + 1
#: Bytes of text in a task's bucket, in a batch that settles its own repeats, and hashed at once.
BUCKET_BYTES, BATCH_BYTES, CHUNK_BYTES = 4 << 20, 12 << 20, 1 << 17
LAST = (1 << 63) - 1
#: h: hash; d, f: a row's id and, where ids repeat, its text's hash (rows equal in both are one text); p: position; a, z: from the first and
#: last start to the anchor; e: end of a range.
FIELDS = {"h": "<u8", "d": "<i8", "f": "<i8", "p": "<u4", "a": "u1", "z": "u1", "e": "<u4"}


def text_hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def no_hash(raw: bytes) -> int:
    """Where no id repeats the id alone tells the rows apart."""
    return 0


# --- packing ---------------------------------------------------------------------------------------


def pack(**columns: np.ndarray) -> bytes:
    """Columns as byte planes, which compress well; ids as differences."""
    n = len(next(iter(columns.values())))
    out = [np.int64(n).tobytes()]
    for k, v in columns.items():
        v = np.asarray(v).astype(FIELDS[k])
        if k in "df":
            v = np.diff(v, prepend=v.dtype.type(0))
        out.append(np.ascontiguousarray(v.view(np.uint8).reshape(n, -1).T).tobytes())
    return b"".join(out)


def unpack(blobs: list[bytes], names: str) -> dict[str, np.ndarray]:
    cols: dict[str, list] = {k: [] for k in names}
    for b in blobs:
        n, at = int(np.frombuffer(b, np.int64, 1)[0]), 8
        for k in names:
            t = np.dtype(FIELDS[k])
            raw = np.frombuffer(b, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
            at += n * t.itemsize
            v = np.ascontiguousarray(raw.T).view(t).reshape(n)
            cols[k].append(np.cumsum(v, dtype=v.dtype) if k in "df" else v)
    return {k: np.concatenate(v) if v else np.zeros(0, FIELDS[k]) for k, v in cols.items()}


# --- anchors ---------------------------------------------------------------------------------------


def gram_hashes(buf: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of the k bytes from each position on, for all that have them."""
    m = 0x9E3779B97F4A7C15
    at, n, power, out, done, total = buf.astype(np.uint64) + np.uint64(1), 1, m, None, 0, k
    while total:  # binary decomposition of k
        if total & 1:
            size = len(buf) - done - n + 1
            if size <= 0:
                return np.zeros(0, np.uint64)
            tail = at[done : done + size]
            out = tail.copy() if out is None else out[:size] * np.uint64(power) + tail
            done += n
        total >>= 1
        if total:
            if len(at) <= n:
                return np.zeros(0, np.uint64)
            at = at[:-n] * np.uint64(power) + at[n:]
            power = power * power & 0xFFFFFFFFFFFFFFFF
            n *= 2
    return mix64(out)


def anchors(buf: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, owner, position, first, last) of the anchors of texts that stand one after another in buf.

    An anchor is the leftmost least gram of some LENGTH-byte string; first and last are the starts of
    the strings that have it. ends: the texts' ends in buf, owner: their numbers.
    """
    h = gram_hashes(buf)
    none = np.zeros(0, np.int64)
    if len(h) < WINDOW:
        return none.astype(np.uint64), none, none, none, none
    # the high half of the hash, then the position: the least one is the leftmost of the least
    key, n = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
    while n < WINDOW:
        step = min(n, WINDOW - n)
        key = np.minimum(key[:-step], key[step:])
        n += step
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), size)[: len(at)]
    start = np.flatnonzero(np.arange(LENGTH, len(at) + LENGTH) <= ends[text])
    if not len(start):
        return none.astype(np.uint64), none, none, none, none
    p = at[start]
    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1])])
    stop = np.r_[new[1:], len(p)] - 1
    return h[p[new]], owner[text[start[new]]], p[new], start[new], start[stop]


# --- deep-shallow sorting --------------------------------------------------------------------------


def _words(padded: np.ndarray, starts: np.ndarray, at: int, length: int) -> np.ndarray:
    """The 8 bytes from starts + at on as big-endian numbers, with zeros from `length` on."""
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)[starts + at]
    out = np.ascontiguousarray(view).view(">u8").reshape(-1).astype(np.uint64)
    left = length - at
    return out if left >= 8 else out & np.uint64((0xFFFFFFFFFFFFFFFF << (8 * (8 - left))) & 0xFFFFFFFFFFFFFFFF)


def deep_shallow_sort(buf: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): positions in `starts` in the order of their strings buf[s : s + length], and for
    each place in that order the number of its class of equal strings."""
    n = len(starts)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    order, group = np.arange(n), np.zeros(n, np.int64)
    for at in range(0, min(shallow, length), 8):  # multikey quicksort: only what is still equal is touched
        live = _live(group)
        if not len(live):
            return order, group
        key = _words(padded, starts[order[live]], at, length)
        by = np.lexsort((key, group[live])) if at else np.argsort(key)
        order[live] = order[live][by]
        group = _split(group, live, key[by])
    depth = shallow
    while True:  # blind tries, one branching level of all groups a round
        live = _live(group)
        if not len(live) or depth >= length:
            break
        first = np.searchsorted(group, group[live], side="left")
        s, r = starts[order[live]], starts[order[first]]
        lcp = np.full(len(live), length, np.int64)
        todo = np.arange(len(live))
        for at in range(shallow, length, 8):  # how far each string follows the first one of its trie
            x = _words(padded, s[todo], at, length) ^ _words(padded, r[todo], at, length)
            differ = x != 0
            lcp[todo[differ]] = at + _leading_zeros(x[differ]) // 8
            todo = todo[~differ]
            if not len(todo):
                break
        head = np.flatnonzero(np.r_[True, group[live][1:] != group[live][:-1]])
        branch = np.repeat(np.minimum.reduceat(lcp, head), np.diff(np.r_[head, len(live)]))
        open_ = branch < length
        if not open_.any():
            break
        live, branch, s = live[open_], branch[open_], s[open_]
        key = padded[s + branch].astype(np.uint64)  # the one byte by which the trie branches
        by = np.lexsort((key, group[live]))
        order[live] = order[live][by]
        group = _split(group, live, key[by])
    return order, group


def _live(group: np.ndarray) -> np.ndarray:
    same = group[1:] == group[:-1]
    return np.flatnonzero(np.r_[False, same] | np.r_[same, False])


def _split(group: np.ndarray, live: np.ndarray, key: np.ndarray) -> np.ndarray:
    cut = np.r_[True, group[1:] != group[:-1]]
    near = live[1:] == live[:-1] + 1
    cut[live[1:][near & (key[1:] != key[:-1])]] = True
    return np.cumsum(cut) - 1


def _leading_zeros(x: np.ndarray) -> np.ndarray:
    high = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    top = np.where(high > 0, high, low)
    return np.where(high > 0, 31, 63) - np.floor(np.log2(np.maximum(top, 1))).astype(np.int64)


# --- phases ----------------------------------------------------------------------------------------


def _deal(n: int, values: np.ndarray) -> np.ndarray:
    return (mix64(values.astype(np.uint64) + np.uint64(0x51ED270B)) % np.uint64(n)).astype(np.int64)


def deal_ids(n: int, ids: np.ndarray) -> np.ndarray:
    """pmod(xxhash64(id), n), as the engine computes it for a long."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.uint64(42) + p5 + np.uint64(8)
        h = h ^ (turn(ids.view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64) % n


def _by(bucket: np.ndarray, names: str, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed rows) for each bucket; rows keep their order."""
    order = np.argsort(bucket.astype(np.int16) if len(bucket) and bucket.max() < 1 << 15 else bucket, kind="stable")
    edge = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(order) else []
    for i, j in zip(edge, np.r_[edge[1:], len(order)] if len(order) else [], strict=True):
        at = order[i:j]
        yield int(bucket[at[0]]), pack(**{k: columns[k][at] for k in names})


ROWS = "bucket int, kind int, blob binary"


def _table(rows: list[tuple[int, int, bytes]]):
    names = ["bucket", "kind", "blob"]
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names


def _several(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order by hash, first place and size of each run of a hash, whether several documents have it)."""
    order = np.argsort(h)
    hs, ds = h[order], d[order]
    head = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
    return order, head, np.diff(np.r_[head, len(hs)]), np.minimum.reduceat(ds, head) != np.maximum.reduceat(ds, head)


def shared_anchors(docs: DataFrame, buckets: int, check_of=text_hash) -> DataFrame:
    """docs (d long, t string) -> rows (bucket of documents, 0, packed d f p a z) of the shared anchors."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def settle() -> pa.RecordBatch:
            h, d, f, p, a, z = (np.concatenate(x) for x in zip(*held, strict=True))
            order, head, count, several = _several(h, d)
            mine = np.zeros(len(h), bool)
            mine[order] = np.repeat(several, count)
            cols = {"h": h, "d": d, "f": f, "p": p, "a": a, "z": z}
            rows = [(b, 0, x) for b, x in _by(_deal(buckets, h[~mine]), "hdfpaz", {k: v[~mine] for k, v in cols.items()})]
            rows += [(b, 1, x) for b, x in _by(deal_ids(buckets, d[mine]), "dfpaz", {k: v[mine] for k, v in cols.items()})]
            known = h[order[head[several]]]
            rows += [(b, 2, x) for b, x in _by(_deal(buckets, known), "h", {"h": known})]
            held.clear()
            return pa.RecordBatch.from_arrays(*_table(rows))

        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), [x.encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            i = 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK_BYTES):
                    n += len(texts[j])
                    j += 1
                own = [k for k in range(i, j) if len(texts[k]) >= LENGTH]
                if own:
                    ends = np.cumsum([len(texts[k]) for k in own])
                    h, k, p, first, last = anchors(np.frombuffer(b"".join(texts[x] for x in own), np.uint8), ends, np.arange(len(own)))
                    base = np.r_[0, ends[:-1]][k]
                    check = np.array([check_of(texts[x]) for x in own], np.int64)
                    held.append((h, ids[np.array(own)][k], check[k], p - base, (p - first).astype(np.uint8), (p - last).astype(np.uint8)))
                    size += n
                i = j
                if size > BATCH_BYTES:
                    yield settle()
                    size = 0
        if held:
            yield settle()

    def meet(table: pa.Table) -> pa.Table:
        kind, blobs = table["kind"].to_numpy(), table["blob"].to_pylist()
        rows = [(b, 0, x) for b, k, x in zip(table["to"].to_pylist(), kind, blobs, strict=True) if k == 1]
        c = unpack([x for k, x in zip(kind, blobs, strict=True) if k == 0], "hdfpaz")
        known = np.unique(unpack([x for k, x in zip(kind, blobs, strict=True) if k == 2], "h")["h"])
        if len(c["h"]):
            order, head, count, several = _several(c["h"], c["d"])
            several |= np.isin(c["h"][order[head]], known)
            at = np.sort(order[np.repeat(several, count)])
            rows += [(b, 0, x) for b, x in _by(deal_ids(buckets, c["d"][at]), "dfpaz", {k: v[at] for k, v in c.items()})]
        return pa.Table.from_arrays(*_table(rows))

    parts = docs.mapInArrow(collect, ROWS).withColumn("to", F.col("bucket"))
    return parts.groupBy("bucket").applyInArrow(meet, ROWS)


CONTEXTS = "bucket int, kind int, blob binary, contexts array<binary>, counts binary"


def contexts(docs: DataFrame, shared: DataFrame, buckets: int, check_of=text_hash) -> DataFrame:
    """Kind 0: (bucket of anchors, ids and positions d p a z, the contexts' bytes, how many positions
    each has); kind 1: (bucket of documents, ranges d f p e) that are settled."""

    def go(texts: pa.Table, replies: pa.Table) -> pa.Table:
        c = unpack(replies["blob"].to_pylist(), "dfpaz")
        order = np.lexsort((c["p"], c["f"], c["d"]))
        wanted = set(c["d"].tolist())
        raws = {}
        for d, t in zip(texts["d"].to_pylist(), texts["t"].to_pylist(), strict=True):
            if d in wanted:
                raw = t.encode("utf-8", "surrogatepass")
                raws[d, check_of(raw)] = raw
        #: context -> [document, a, z, its checks, its positions]; ids ascend, so the first has the least
        seen: dict[bytes, list] = {}
        settled: list[tuple[int, int, int, int]] = []
        last, raw = None, b""
        for d, f, p, a, z in zip(*[c[k][order].tolist() for k in "dfpaz"], strict=True):
            if (d, f) != last:
                last = d, f
                raw = raws[last]
            context = raw[p - a : p - z + LENGTH]
            got = seen.get(context)
            if got is None:
                seen[context] = [d, a, z, [f], [p]]
            elif got[0] == d:
                got[3].append(f)
                got[4].append(p)
            else:
                settled.append((d, f, p - a, p - z + LENGTH))
        rows: list[tuple] = []
        keys, values = list(seen), list(seen.values())
        if keys:
            to = _deal(buckets, _gram_of(keys, [v[1] for v in values]))
            order = np.argsort(to, kind="stable")
            edge = np.flatnonzero(np.r_[True, to[order][1:] != to[order][:-1]])
            for i, j in zip(edge, np.r_[edge[1:], len(order)], strict=True):
                own = [values[k] for k in order[i:j]]
                n = np.array([len(v[4]) for v in own], np.int32)
                blob = pack(
                    d=np.repeat([v[0] for v in own], n), f=np.array([x for v in own for x in v[3]]), p=np.array([x for v in own for x in v[4]]),
                    a=np.repeat([v[1] for v in own], n), z=np.repeat([v[2] for v in own], n),
                )
                rows.append((int(to[order[i]]), 0, blob, [keys[k] for k in order[i:j]], n.tobytes()))
        if settled:
            d, f, s, e = (np.array(x, np.int64) for x in zip(*settled, strict=True))
            rows += [(b, 1, x, [], b"") for b, x in _by(deal_ids(buckets, d), "dfpe", {"d": d, "f": f, "p": s, "e": e})]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.binary()]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["bucket", "kind", "blob", "contexts", "counts"])

    return docs.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(go, CONTEXTS)


def _gram_of(keys: list[bytes], at: list[int]) -> np.ndarray:
    """The anchor's hash in each context."""
    flat = np.frombuffer(b"".join(k[a : a + GRAM] for k, a in zip(keys, at, strict=True)), np.uint8)
    return gram_hashes(flat)[::GRAM]


def repeats(parts: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket of documents, 1, ranges d f p e) from the sorted suffixes of the contexts."""

    def go(table: pa.Table) -> pa.Table:
        c = unpack(table["blob"].to_pylist(), "dfpaz")
        n = np.concatenate([np.frombuffer(x, np.int32) for x in table["counts"].to_pylist()] or [np.zeros(0, np.int32)])
        keys = [k for ks in table["contexts"].to_pylist() for k in ks]
        head = np.r_[0, np.cumsum(n)[:-1]].astype(np.int64) if len(n) else np.zeros(0, np.int64)
        doc, a, z = c["d"][head], c["a"][head].astype(np.int64), c["z"][head].astype(np.int64)
        number: dict[bytes, int] = {}
        same = np.array([number.setdefault(k, len(number)) for k in keys], np.int64)
        least = np.full(len(number), LAST, np.int64)
        np.minimum.at(least, same, doc)
        whole = least[same] < doc  # another bucket's document has all of it
        first = np.full(len(number), -1, np.int64)
        first[same[::-1]] = np.arange(len(keys))[::-1]
        gram = _gram_of(keys, a.tolist()) if keys else np.zeros(0, np.uint64)
        g = gram[first]
        order = np.argsort(g, kind="stable")
        alone = np.ones(len(g), bool)
        if len(g) > 1:
            eq = g[order][1:] == g[order][:-1]
            alone[order] = ~(np.r_[False, eq] | np.r_[eq, False])
        pick = np.flatnonzero(~alone)
        out_d, out_f, out_s, out_e = [], [], [], []

        def add(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            """Strings lo..hi of the contexts `rows` go, at all their positions."""
            k = n[rows]
            at = np.repeat(head[rows], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            start = c["p"][at].astype(np.int64) - c["a"][at]
            out_d.append(c["d"][at])
            out_f.append(c["f"][at])
            out_s.append(start + np.repeat(lo, k))
            out_e.append(start + np.repeat(hi, k) + LENGTH)

        covered = np.flatnonzero(whole)
        add(covered, np.zeros(len(covered), np.int64), (a - z)[covered])
        for part in _slices(pick, order, g):
            buf = np.frombuffer(b"".join(keys[first[i]] for i in part), np.uint8)
            size = (a - z)[first[part]] + LENGTH
            base = np.cumsum(size) - size
            many = size - LENGTH + 1
            ctx = np.repeat(np.arange(len(part)), many)
            offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            by, group = deep_shallow_sort(buf, base[ctx] + offset)
            mine = least[part][ctx[by]]
            edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            low = np.repeat(np.minimum.reduceat(mine, edge), np.diff(np.r_[edge, len(group)]))
            gone = np.zeros(len(by), bool)
            gone[by] = low < mine
            on = gone & ~np.r_[False, gone[:-1] & (ctx[1:] == ctx[:-1])]
            off = gone & ~np.r_[gone[1:] & (ctx[1:] == ctx[:-1]), False]
            lo, hi, of = offset[on], offset[off], part[ctx[on]]
            # the rows whose document is the least one of the context; all others are covered above
            keep = np.flatnonzero(~whole)
            keep = keep[np.argsort(same[keep], kind="stable")]
            i, j = np.searchsorted(same[keep], of, "left"), np.searchsorted(same[keep], of, "right")
            k = j - i
            at = np.repeat(i, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            add(keep[at], np.repeat(lo, k), np.repeat(hi, k))
        d, f, s, e = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (out_d, out_f, out_s, out_e))
        by = np.lexsort((s, f, d))
        rows = [(b, 1, x) for b, x in _by(deal_ids(buckets, d[by]), "dfpe", {"d": d[by], "f": f[by], "p": s[by], "e": e[by]})]
        return pa.Table.from_arrays(*_table(rows))

    return parts.where("kind = 0").groupBy("bucket").applyInArrow(go, ROWS)


def _slices(pick: np.ndarray, order: np.ndarray, g: np.ndarray, most: int = 200_000) -> Iterator[np.ndarray]:
    """The contexts `pick` in pieces of about `most`, anchors kept whole."""
    chosen = np.zeros(len(g), bool)
    chosen[pick] = True
    line = order[chosen[order]]
    i = 0
    while i < len(line):
        j = min(i + most, len(line))
        while j < len(line) and g[line[j]] == g[line[j - 1]]:
            j += 1
        yield line[i:j]
        i = j


def cut(docs: DataFrame, ranges: DataFrame, check_of=text_hash) -> DataFrame:
    """(d, n_bytes, n_removed, n_spans, kept) of every document; ranges: (bucket, packed d f p e)."""

    def go(texts: pa.Table, found: pa.Table) -> pa.Table:
        c = unpack(found["blob"].to_pylist(), "dfpe")
        order = np.lexsort((c["f"], c["d"]))
        ds, fs, s, e = c["d"][order], c["f"][order], c["p"][order].astype(np.int64), c["e"][order].astype(np.int64)
        out = []
        for d, t in zip(texts["d"].to_pylist(), texts["t"].to_pylist(), strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            i, j = np.searchsorted(ds, d, "left"), np.searchsorted(ds, d, "right")
            if i < j:
                check = check_of(raw)
                i, j = i + np.searchsorted(fs[i:j], check, "left"), i + np.searchsorted(fs[i:j], check, "right")
            if i == j:
                out.append((d, len(raw), 0, 0, raw))
                continue
            step = np.zeros(len(raw) + 1, np.int32)
            np.add.at(step, s[i:j], 1)
            np.add.at(step, e[i:j], -1)
            gone = np.cumsum(step[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((d, len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["d", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.groupBy("bucket").cogroup(ranges.groupBy("bucket")).applyInArrow(go, "d long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) for every row of df; kept: the remaining bytes.

    A null text is empty; texts under LENGTH bytes never lose anything. A null key counts as larger than
    all others. Rows of equal keys do not remove each other's bytes, and each loses what a smaller key
    has. Repeats within one document stay, unless a smaller one has them too.
    """
    spark = prepare(df.sparkSession)
    held = df.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("d"), text_or_empty(text).alias("t"))
    size = held.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = partitions(spark, -(-size // bucket_bytes))
    dealt = held.select(F.pmod(F.xxhash64("d"), F.lit(buckets)).cast("int").alias("bucket"), "d", "t")
    # 8 bytes an anchor that are only needed to tell texts of one id apart
    check_of = no_hash if held.groupBy("d").count().where("count > 1").isEmpty() else text_hash
    shared = materialize(shared_anchors(held, buckets, check_of), "anchors")
    parts = materialize(contexts(dealt, shared, buckets, check_of), "contexts")
    discard(shared)
    sorted_ = materialize(repeats(parts, buckets), "ranges")
    ranges = parts.where("kind = 1").select("bucket", "kind", "blob").unionByName(sorted_)
    done = cut(dealt, ranges, check_of)
    return done.select(F.when(F.col("d") != LAST, F.col("d")).alias(key), "n_bytes", "n_removed", "n_spans", "kept")


def op9_suffixdedup(spark, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
