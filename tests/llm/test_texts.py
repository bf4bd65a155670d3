"""Secrets, suffixes, toxicity, mixing, URLs and WARC on small cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from reqloom.llm import mixing, secrets, suffixdedup, toxicity, urlfilter, warc
import plain
from llm_checks import AWKWARD

KEY = "AKIA" + "Q" * 16
SECRETS = ["", None, f"password = hunter2x and {KEY}", 'API_KEY: "abc+/=_.-9" token=short', "é😀 secret:" + "f" * 30, "0123456789abcdef" * 3, "x" * 5000 + " passwd='longer-one'", "token: token=abcdef12 secret = = no", "ghp_" + "A" * 36]


def base_spans(t):
    t, out = t or "", []
    for i, (kind, p, g, least) in enumerate((("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        out += [(m.start(), i, kind, m.end()) for m in re.finditer(p, t) if len(m[g]) >= least]
    return sorted(out)


def test_secrets_of_the_base(spark, docs):
    texts = [*SECRETS, *AWKWARD, *[r["text"] for r in docs.select("text").collect()]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.report(df, secrets.scan(df)[0]).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (i, text, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[2] == k for x in want) for k in ("assign", "access", "hex")]
    assert "github:0:40" in got[len(SECRETS) - 1]["spans"]


def test_secret_ledger(spark):
    df = spark.createDataFrame([(1, f"{KEY}A"), (2, f"{KEY}A"), (3, "clean")], "doc_id long, text string")
    found, ledger = secrets.scan(df)
    assert (found.count(), ledger.count()) == (1, 2)
    again = spark.createDataFrame([(1, f"{KEY}A"), (4, "ghp_" + "B" * 36)], "doc_id long, text string")
    found2, ledger2 = secrets.scan(again, ledger)
    assert ledger2.count() == 1 and [s["kind"] for s in found2.first()["spans"]] == ["github"]
    newer = (*secrets.RULES[:-1], secrets.Rule("pem", secrets.RULES[-1].pattern, version=2))
    assert {tuple(r["rules"]) for r in secrets.scan(df, ledger, newer)[1].collect()} == {("pem@2",)}
    both = secrets.findings_by_path(again, found.unionByName(found2))
    assert {r["doc_id"]: len(r["spans"]) for r in both.collect()} == {1: 1, 4: 1}
    red = both.select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {r["t"] for r in red} == {"[REDACTED]"}


def test_secrets_awkward(awkward, nothing):
    got = [(r["doc_id"], r["spans"]) for r in secrets.report(awkward, secrets.scan(awkward)[0]).collect()]
    want = [(r["doc_id"], ",".join(f"{k}:{s}:{e}" for k, s, e in plain.secret_spans(r["text"]))) for r in awkward.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert secrets.report(nothing, secrets.scan(nothing)[0]).count() == 0


def test_secrets_one_scan_after_another(spark, docs):
    """The second scan takes the pairs only that the first had not, and both together find all."""
    texts = [*SECRETS, *[r["text"] for r in docs.limit(60).collect()], "x ghp_" + "A" * 40 + f" y {KEY}" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    findings, ledger = secrets.follow(df, (secrets.BASE, secrets.RULES))
    scanned = [tuple(r["rules"]) for r in ledger.collect()]
    blobs = len({t or "" for t in texts})
    assert sorted(scanned) == sorted([tuple(sorted(r.key for r in secrets.BASE))] * blobs + [tuple(sorted(r.key for r in secrets.MORE))] * blobs)
    assert secrets.scan(df, ledger)[1].count() == 0
    got = {r["doc_id"]: r["spans"] for r in secrets.report(df, findings).collect()}
    assert got == {i: ",".join(f"{k}:{s}:{e}" for k, s, e in plain.secret_spans(t)) for i, t in enumerate(texts)}


def test_redaction(spark):
    texts = [*SECRETS, f"{KEY}{KEY} password={KEY} x", f"a {KEY}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = secrets.findings_by_path(df, secrets.scan(df)[0])
    got = {r["doc_id"]: r["t"] for r in held.select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {i: None if t is None else plain.masked(t) for i, t in enumerate(texts)}


def brute_removal(rows, n=50):
    raws = [(k, (t or "").encode()) for k, t in rows]
    first = {}
    for k, b in raws:
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            first[s] = min(first.get(s, k), k)
    out = []
    for k, b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < k:
                gone[i : i + n] = b"\x01" * n
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bucket", [2_000, 1 << 22])
def test_suffix_removal(spark, docs, words, bucket):
    r = random.Random(4)
    passages = [words(30) for _ in range(4)]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    n = max(k for k, _ in rows) + 1
    for i in range(40):
        rows.append((n + i, words(r.randrange(40)) + " " + r.choice(passages) + " " + words(r.randrange(20))))
    rows += [(n + 50, "ab" * 200), (n + 51, "ba" * 300), (n + 52, "é" * 100), (n + 53, "éa" * 60), (n + 54, None), (n + 55, ""), (n + 56, "x" * 49), (n + 57, "x" * 50), (n + 58, "x" * 51), (n + 59, "y" * 20_000), (n + 60, "y" * 50)]
    got = suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), bucket_bytes=bucket)
    have = sorted(tuple(x) for x in got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())
    assert have == brute_removal(rows)


def test_suffix_awkward(spark, awkward, nothing, words):
    a, b = words(30), words(30)
    own = [(500, f"{a} {b}", "one"), (500, f"{b} only", "two"), (500, f"{a} {b}", "one"), (501, f"{b} x", ""), (None, f"{a} y", ""), (None, f"y {a}", ""), (499, f"z {b}", "")]
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()] + [r[:2] for r in own]
    df = awkward.select("doc_id", "text", "t").unionByName(spark.createDataFrame(own, "doc_id long, text string, t string"))
    got = suffixdedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    want = brute_removal([(1 << 62 if k is None else k, t) for k, t in rows])
    assert sorted(map(tuple, [(1 << 62 if r[0] is None else r[0], *r[1:]) for r in got])) == want
    assert suffixdedup.remove_repeats(nothing).count() == 0


def test_deep_shallow_order():
    import numpy as np

    r = np.random.Generator(np.random.PCG64(1))
    buf = r.integers(97, 99, 3000).astype(np.uint8)
    buf[1000:1400] = buf[0:400]
    starts = np.arange(2900)
    order, group = suffixdedup.deep_shallow_sort(buf, starts)
    s = [bytes(buf[i : i + 50]) for i in starts[order]]
    assert s == sorted(s) and [a == b for a, b in zip(s, s[1:])] == (group[1:] == group[:-1]).tolist()


def test_toxicity_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = toxicity.train(d, labels.where(fold == 0))
    got = toxicity.predict(d, model).join(labels.where(fold == 1).withColumnRenamed("toxic", "y"), "doc_id").selectExpr("toxic", "y = 1 AS y", "expected_severity AS e").collect()
    right = sum(r["toxic"] == r["y"] for r in got) / len(got)
    assert right >= 0.97
    assert sum(r["toxic"] for r in got if r["y"]) >= 0.85 * sum(r["y"] for r in got)
    assert all(0 <= r["e"] <= toxicity.GRADES for r in got) and list(model.thresholds) == sorted(model.thresholds)


def test_toxicity_against_plain_python(spark, docs, small):
    """Terms, scores, grades and verdicts of the whole table; the fit has no better neighbour."""
    import numpy as np

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = toxicity.train(d, labels)
    text = {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
    known = [(r["toxic"], text[r["doc_id"]]) for r in labels.collect() if r["doc_id"] in text]
    assert set(m.weights) == set(plain.toxic_terms(known)) and len(m.weights) > 5
    for r in toxicity.predict(d, m).collect():
        e, grade, toxic = plain.severity(m.weights, m.thresholds, m.reject, r["text"])
        assert (r["grade"], r["toxic"]) == (grade, toxic) and abs(r["expected_severity"] - e) < 1e-6

    rng = random.Random(5)
    xs = [sorted(rng.sample(range(6), rng.randrange(4))) for _ in range(300)]
    ys = [min(3, max(0, sum((1.5, 0.8, 0.3, -0.5, 1.0, 0.1)[i] for i in x) + rng.gauss(0, 1) > 0) + (len(x) > 2) + (rng.random() < 0.3)) for x in xs]
    x = np.zeros((300, 6))
    for i, at in enumerate(xs):
        x[i, at] = 1
    w, t = toxicity.fit_ordinal(x, np.array(ys), 3, l2=0.0, steps=3000, rate=0.05)
    best = plain.log_likelihood(w, t, xs, ys)
    assert list(t) == sorted(t)
    for i in range(9):
        for step in (0.05, -0.05):
            p = np.r_[w, t]
            p[i] += step
            if list(p[6:]) == sorted(p[6:]):
                assert plain.log_likelihood(p[:6], p[6:], xs, ys) <= best + 1e-9


def test_toxicity_sample_is_bounded(spark, tmp_path):
    """Repeated documents do not make the sample larger; the model of one text an id is the same."""
    rows = [(i, ("bad stuff here" if i % 4 == 0 else "fine text") + f" {i}") for i in range(80)]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    once = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    again = toxicity.train(spark.createDataFrame(rows * 3 + [(4, "zzz")], "doc_id long, text string"), labels)
    assert once == again and {"bad", "stuff"} & set(once.weights)


def test_toxicity_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(5, 0, 1), (6, 1, 0), (None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(awkward, labels)
    got = [(r["doc_id"], r["grade"], r["toxic"], round(r["expected_severity"], 6)) for r in toxicity.predict(awkward, model).collect()]
    want = [(r["doc_id"], *[f(x) for f, x in zip((int, bool, lambda x: round(x, 6)), [plain.severity(model.weights, model.thresholds, model.reject, r["text"])[i] for i in (1, 2, 0)])]) for r in awkward.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and toxicity.predict(nothing, model).count() == 0
    none = toxicity.train(awkward, labels.limit(0))
    assert not any(r["toxic"] for r in toxicity.predict(awkward, none).collect())


def test_mixing(spark, awkward, nothing, words):
    sizes = {"a": 30, "b": 300, None: 40, "c": 5}
    rows = [(i * 1000 + j, words(40 + j), s) for i, (s, n) in enumerate(sizes.items()) for j in range(n // 5)] + [(999, None, "a"), (999, "", "a")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=16).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"]) <= 2 * mine[0]["source_size"] == 2 * sum(r["size"] for r in mine)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - 1.5 * total) < 1e-6 * total
    want = {}
    for slot, k, _, n, slots in plain.mix(rows, block=16):
        first, taken, held = want.get(k, (slot, 0, 0))
        want[k] = (min(first, slot), taken + n, held + slots)
    assert {r["doc_id"]: (r["first_slot"], r["taken"], r["n_slots"]) for r in got if r["taken"]} == want
    assert all((r["first_slot"], r["n_slots"]) == (None, 0) for r in got if not r["taken"])
    assert mixing.mix(nothing).count() == 0


def test_mixing_awkward_and_again(awkward):
    got = sorted(map(repr, mixing.mix(awkward).collect()))
    assert got == sorted(map(repr, mixing.mix(awkward.repartition(5)).collect()))  # reruns agree
    rows = [(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(plain.WORD.findall(t or ""))
    target = plain.goals(sizes)
    out = mixing.mix(awkward).collect()
    assert sorted((repr(r["doc_id"]), r["size"], r["source_size"], r["target"]) for r in out) == sorted((repr(k), len(plain.WORD.findall(t or "")), sizes[s], target[s]) for k, t, s in rows)
    for s in sizes:
        assert sum(r["taken"] for r in out if r["source"] == s) == int(target[s])


def test_schedule_is_even(spark):
    goals = spark.createDataFrame([("a", 10_000, 6000.0), ("b", 10_000, 3000.0), (None, 10_000, 1000.0)], "source string, source_size long, target double")
    rows = sorted((r["slot"], r["source"], r["k"], r["words"]) for r in mixing.schedule(goals, block=10).collect())
    for s, share in (("a", 0.6), ("b", 0.3), (None, 0.1)):
        mine = [r for r in rows if r[1] == s]
        assert [r[2] for r in mine] == list(range(len(mine))) and sum(r[3] for r in mine) == share * 10_000
        head = sum(r[1] == s for r in rows[:200])
        assert abs(head - 200 * share) <= 4


URLS = [
    ("http://A.Example.ORG/es/x", "a.example.org", "/es/x", "example.org/es/", "block"), ("https://example.org/en/12?q", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://badexample.org/en/1", "badexample.org", "/en/1", "org/", "allow"), ("http://x.com/fr/porn", "x.com", "/fr/porn", "com/fr/", "allow"), ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://x.net/porn", "x.net", "/porn", None, "block"), ("http://x.net/pornography", "x.net", "/pornography", None, "allow"), ("http://x.net/free-casino", "x.net", "/free-casino", None, "block"),
    ("http://x.net/free/free", "x.net", "/free/free", None, "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("://", "", "", None, "allow"), ("http://org", "org", "", None, "allow"), ("http://H#f/x", "h", "", None, "allow"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urlfilter.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), URLS[i]
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_warc_audit(spark):
    rows = [("f1", i * 1000, 900, f"d{i}") for i in range(500)] + [("f2", 0, 5, "e")]
    schema = "file_id string, at long, length long, digest string"
    a = spark.createDataFrame(rows, schema)
    roots, faults = warc.audit(a, a)
    assert faults.count() == 0 and all(r["root"] == r["replica_root"] for r in roots.collect())
    other = [r for r in rows if r[1] != 7000 and r[0] == "f1"]
    other[100] = (*other[100][:3], "bad")
    other.append(("f1", 600_000, 3, "new"))
    roots, faults = warc.audit(a, spark.createDataFrame(other, schema))
    assert sorted(tuple(r) for r in faults.collect()) == sorted([("f1", 7000, "missing"), ("f1", other[100][1], "corrupt"), ("f1", 600_000, "extra"), ("f2", 0, "missing")])
    assert {r["file_id"]: (r["root"] is None, r["replica_root"] is None) for r in roots.collect()} == {"f1": (False, False), "f2": (False, True)}
    empty = spark.createDataFrame([], schema)
    assert warc.audit(empty, empty)[1].count() == 0


def plain_root(records, height, range_bytes, fanout):
    sha = lambda lines: hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()
    level = {}
    for at, n, d in records:
        level.setdefault(at // range_bytes, []).append(f"{at:020d}:{n}:{n}:{d}")
    level = {k: sha(v) for k, v in level.items()}
    for _ in range(height):
        up = {}
        for k, h in level.items():
            up.setdefault(k // fanout, []).append(f"{k:020d}:{h}")
        level = {k: sha(v) for k, v in up.items()}
    assert len(level) == 1
    return level[0]


def test_warc_root_is_the_files_own(spark):
    """A file's root does not depend on which other files there are, nor on the other replica."""
    schema = "file_id string, at long, length long, digest string"
    small = [("s", i * 100, 100, f"d{i}") for i in range(30)]
    large = [("l", i * 100, 100, f"e{i}") for i in range(700)]
    a = spark.createDataFrame(small + large, schema)
    b = spark.createDataFrame(small + large[:-1] + [("l", 69_900, 90, "zz")], schema)
    roots, faults = warc.audit(a, b, range_bytes=100, fanout=4)
    got = {r["file_id"]: (r["root"], r["replica_root"]) for r in roots.collect()}
    assert got["s"] == (plain_root([r[1:] for r in small], 3, 100, 4),) * 2 and got["l"][0] == plain_root([r[1:] for r in large], 5, 100, 4) != got["l"][1]
    assert [tuple(r) for r in faults.collect()] == [("l", 69_900, "corrupt")]
    alone = warc.audit(spark.createDataFrame(small, schema), spark.createDataFrame(small[:5], schema), range_bytes=100, fanout=4)[0].first()
    assert alone["root"] == got["s"][0] and alone["replica_root"] == plain_root([r[1:] for r in small[:5]], 3, 100, 4)


def test_warc_layout_awkward(spark):
    pages = [(1, None, None), (1, None, None), (1, "a", "b" * 300), (None, "u", "h"), (None, "u", "h"), (None, "v", "h" * 70_000), (2, "u", "é" * 1000), (700, "", "")]
    df = spark.createDataFrame([(*p, "x", 0) for p in pages], "page_id long, url string, html string, digest_of string, n int")
    got = warc.layout(df).collect()
    record = lambda p: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if p[0] is None else p[0]}>\r\nWARC-Target-URI: {p[1] or ''}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len((p[2] or '').encode())}\r\n\r\n{p[2] or ''}\r\n\r\n".encode()
    assert sorted((repr(r["page_id"]), r["length"], r["digest"]) for r in got) == sorted((repr(p[0]), len(record(p)), hashlib.sha256(record(p)).hexdigest()) for p in pages)
    for f in {r["file_id"] for r in got}:
        mine = sorted((r for r in got if r["file_id"] == f), key=lambda r: r["at"])
        assert [r["at"] for r in mine] == [sum(x["length"] for x in mine[:i]) for i in range(len(mine))]
        assert [(r["page_id"] or 0, r["digest"]) for r in mine] == sorted((r["page_id"] or 0, r["digest"]) for r in mine)
    assert {r["file_id"] for r in got} == {-1, 0, 1} and warc.layout(df.limit(0)).count() == 0
    many = warc.layout(df, file_records=1).collect()
    assert sum(r["file_id"] < 0 for r in many) == 3 and min(r["file_id"] for r in many) < -1


def test_warc_files_of_two_replicas(spark, tmp_path):
    """Bytes on disk: a changed byte, a lost tail and a file that one replica lacks are located."""
    def record(i, body):
        return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    files = {"a.warc": [record(i, b"x" * (i * 37 % 900)) for i in range(60)], "b.warc": [record(i, b"y" * 50) for i in range(9)], "c.warc": [record(0, b"")]}
    for side in "pq":
        (tmp_path / side).mkdir()
        for name, parts in files.items():
            (tmp_path / side / name).write_bytes(b"".join(parts))
    (tmp_path / "p" / "empty.warc").write_bytes(b"")
    a, b = (warc.read_files(spark, str(tmp_path / side)) for side in "pq")
    assert sorted((r["file_id"], r["at"], r["length"]) for r in a.collect()) == sorted((n, sum(map(len, parts[:i])), len(parts[i])) for n, parts in files.items() for i in range(len(parts)))
    assert warc.audit(a, b)[1].count() == 0
    start = [sum(map(len, files["a.warc"][:i])) for i in range(61)]
    raw = bytearray(b"".join(files["a.warc"]))
    raw[start[31] - 6] ^= 1
    (tmp_path / "q" / "a.warc").write_bytes(bytes(raw))
    (tmp_path / "q" / "b.warc").write_bytes(b"".join(files["b.warc"][:7]))
    (tmp_path / "q" / "c.warc").unlink()
    tail = [sum(map(len, files["b.warc"][:i])) for i in (7, 8)]
    want = {("a.warc", start[30], "corrupt"), ("b.warc", tail[0], "missing"), ("b.warc", tail[1], "missing"), ("c.warc", 0, "missing")}
    roots, faults = warc.audit(a, warc.read_files(spark, str(tmp_path / "q")), range_bytes=1000, fanout=2)
    assert {tuple(r) for r in faults.collect()} == want
    assert {r["file_id"]: r["root"] == r["replica_root"] for r in roots.collect()} == {"a.warc": False, "b.warc": False, "c.warc": False}
    assert [x[:2] for x in warc.records_in(files["b.warc"][0] + b"broken")] == [(0, len(files["b.warc"][0])), (len(files["b.warc"][0]), 6)]
