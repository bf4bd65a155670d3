"""MinHash, SimHash and embeddings against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash

import plain
from reqloom.llm import components, embeddings, minhash, simhash
from llm_checks import groups_of


def brute_fingerprint(text, n=4):
    table = {i: i + 32 for i in range(65, 91)}
    words, word = [], ""
    for c in (text or "").translate(table) + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = (words + [word] if word else words), ""
        else:
            word += c
    if not words:
        return 0
    n = min(n, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), seed=42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(keys, fps, distance=4):
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance]
    at = groups_of(len(fps), pairs)
    least = {}
    for i, g in enumerate(at):
        if keys[i] is not None:
            least[g] = min(least.get(g, keys[i]), keys[i])
    return [least.get(g) for g in at]


def test_simhash_on_documents(docs):
    rows = [r for r in docs.select("doc_id", "text").collect()]
    fps = [brute_fingerprint(r["text"]) for r in rows]
    want = {r["doc_id"]: (f, g) for r, f, g in zip(rows, fps, brute_groups([r["doc_id"] for r in rows], fps))}
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component"]) for r in simhash.groups(docs).collect()}
    assert got == want


def test_simhash_awkward(awkward, nothing):
    rows = awkward.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    want = sorted(map(repr, zip([r["doc_id"] for r in rows], fps, brute_groups([r["doc_id"] for r in rows], fps))))
    assert sorted(repr((r["doc_id"], r["fp"] % (1 << 64), r["component"])) for r in simhash.groups(awkward).collect()) == want
    assert simhash.groups(nothing).count() == 0


@pytest.mark.parametrize("group", [8, 65536])
def test_simhash_links_of_planted_neighbours(spark, group):
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for d in (1, 2, 3, 4, 5):
            x = f
            for b in r.sample(range(64), d):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = [(x["a"] % (1 << 64), x["b"] % (1 << 64)) for x in simhash.links(df, group=group).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    at = {f: i for i, f in enumerate(fps)}
    true = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert groups_of(len(fps), [(at[a], at[b]) for a, b in got]) == groups_of(len(fps), true)


def test_simhash_near_groups(spark, words):
    """Against all pairs: short and long texts, chains, a family of many, equal sets, no words, null keys."""
    r, texts = random.Random(4), []
    for size, copies in ((9, 1), (9, 1), (12, 2), (40, 3), (300, 4), (900, 2), (150, 40), (2000, 1)) * 3:
        base = words(size, 10**6).split()
        texts.append(" ".join(base))
        for i in range(copies):
            base = texts[-1].split() if i % 2 else list(base)
            for _ in range(0 if size < 10 else r.randrange(1 + size // 45)):
                base[r.randrange(size)] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(base[: size - (i == 0 and size < 15)]))
    texts += [texts[0].upper(), "", None, " \n", "one two", "one  TWO", "one two three"]
    df = spark.createDataFrame([(i, t, 0, "w") for i, t in enumerate(texts)] + [(None, texts[5], 0, "w"), (None, "lone", 0, "w")], "doc_id long, text string, n int, id string")
    got = {(x["doc_id"], x["component"]) for x in simhash.near_groups(df).collect()}
    least = plain.least_of_groups(texts)
    assert got == {*enumerate(least), (None, least[5]), (None, None)}
    assert simhash.near_groups(df.limit(0)).count() == 0


def test_simhash_near_groups_link_a_family_once(spark, words, monkeypatch):
    """Links of a large group follow its rows and the first segment's wildcards, not all variants."""
    r, texts, seen = random.Random(6), [], []
    base = words(120, 10**6).split()
    for _ in range(600):
        edited = list(base)
        for _ in range(r.randrange(1, 4)):
            edited[r.randrange(120)] = f"e{r.randrange(10**7)}"
        texts.append(" ".join(edited))
    real = simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda links: (seen.append(links.count()), real(links))[1])
    got = {(x["doc_id"], x["component"]) for x in simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {*enumerate(plain.least_of_groups(texts))}
    _, wildcards, parts = simhash.index_size(len(texts))
    assert sum(seen) <= (wildcards + 4) * len(texts) < wildcards * parts * len(texts) / 4


@pytest.mark.parametrize("n", [2, 60, 500, 700])
@pytest.mark.parametrize("labels", [1, 5, 10**6])
@pytest.mark.parametrize("flips", [6, 60])
def test_simhash_near_pairs_span_what_labels_leave(n, labels, flips):
    r = np.random.Generator(np.random.PCG64(n + flips))
    bits = np.repeat(r.integers(0, 2, (max(1, n // 100), 256), dtype=np.uint8), 100, axis=0)[:n]
    bits = np.resize(bits, (n, 256)) ^ (r.random((n, 256)) < flips / 256)
    fp = np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)
    label = r.integers(0, labels, n) * 7
    got = simhash.near_pairs(fp, 73, label)
    far = np.bitwise_count(fp[:, None] ^ fp).sum(axis=2, dtype=np.int32)
    alike = [(i, j) for v in np.unique(label) for i, j in zip(np.flatnonzero(label == v)[:-1].tolist(), np.flatnonzero(label == v)[1:].tolist(), strict=True)]
    assert all(far[a, b] <= 73 and label[a] != label[b] for a, b in got) and len(got) < len(np.unique(label))
    assert groups_of(n, got + alike) == groups_of(n, [*alike, *zip(*(x.tolist() for x in np.nonzero(far <= 73)), strict=True)])


def test_simhash_rounds_cover_all_segments():
    for parts in (1, 2, 9, 10, 18, 24, 70):
        cut = simhash.rounds(parts)
        assert cut[0] == (0, 1) and [x for a, b in cut for x in range(a, b)] == list(range(parts))
        assert all(0 < b - a <= simhash.ROUND for a, b in cut)


@pytest.mark.parametrize("n", [1000, 230_000])
@pytest.mark.parametrize("sizes", [(4, 1, 0), (9, 1, 1), (80, 20, 0), (90, 10, 10), (900, 110, 110)])
def test_simhash_index_finds_links(n, sizes):
    """Pairs of Jaccard 0.8 share a variant and lie within reach; unrelated ones lie outside."""
    bits, wildcards, parts = simhash.index_size(n)
    r, reach, before = np.random.Generator(np.random.PCG64(7)), None, None
    for _ in range(200):
        both, left, right = (r.integers(0, 1 << 32, k, dtype=np.uint64) for k in sizes)
        signs = [simhash.wide(np.r_[both, x], bits, wildcards, parts) for x in (left, right)]
        keys = [set(simhash.variants(f[None], m[None], bits, 0, parts)[1].tolist()) for f, m in signs]
        assert len(keys[0]) == wildcards * parts and keys[0] & keys[1]
        fps = [f.view(np.uint64)[: simhash.WIDTH // 64] for f, _ in signs]
        reach = simhash.reach()
        assert np.bitwise_count(fps[0] ^ fps[1]).sum() <= reach
        assert before is None or np.bitwise_count(before ^ fps[0]).sum() > reach
        before = fps[0]


def test_simhash_index_grows_with_the_table():
    for n in (1000, 10**6, 10**9):
        bits, wildcards, parts = simhash.index_size(n)
        assert n / 2 ** (bits - 1) <= 256 and parts * wildcards <= 2.5 * n**0.4 + 100 and bits <= 44


def test_minhash_compares_with_the_next(docs, awkward, nothing):
    for df in (docs, awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()))
        got = {r["doc_id"]: r for r in minhash.compare_next(df).collect()}
        assert len(got) == len(rows)
        a, b = minhash.family()
        s = minhash.Shingler()
        sign = lambda t: minhash.minima(s.shingles(s.words(t)), a, b)
        for i, (k, t) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            cut = len(t) // 4
            e = t[: len(t) - cut] + after[:cut]
            r = got[k]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
            assert r["fingerprint"] == minhash.hexed(sign(t)) and r["edited_fingerprint"] == minhash.hexed(sign(e))
            assert math.isclose(r["near_next"], minhash.likeness(sign(t), sign(after))) and math.isclose(r["near_edited"], minhash.likeness(sign(t), sign(e)))
    assert minhash.compare_next(awkward).count() == awkward.count() and minhash.compare_next(nothing).count() == 0


def test_minhash_estimates_jaccard(words):
    s, (a, b) = minhash.Shingler(), minhash.family()
    for share in (0, 20, 60, 100):
        base = words(300, 10**6).split()
        other = base[:]
        for i in range(0, share):
            other[i * 3 % 300] = f"new{i}"
        x, y = (set(s.shingles(s.words(" ".join(t))).tolist()) for t in (base, other))
        true = len(x & y) / len(x | y)
        near = minhash.likeness(*(minhash.minima(s.shingles(s.words(" ".join(t))), a, b) for t in (base, other)))
        assert abs(true - near) < 0.16


def test_minhash_near_duplicates(spark, words):
    texts, r = [], random.Random(1)
    for _ in range(25):
        t = words(120, 10**6).split()
        texts.append(" ".join(t))
        for edits in (1, 3, 9):
            u = t[:]
            for _ in range(edits):
                u[r.randrange(120)] = "edited"
            texts.append(" ".join(u))
    texts += [texts[0], None, "", "a b", "A b"]
    sh = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (texts[i] or "") == (texts[j] or "") or (sh[i] and sh[j] and len(sh[i] & sh[j]) >= 0.8 * len(sh[i] | sh[j]))]
    df = spark.createDataFrame([(i, t, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, set string, k int")
    got = {r["doc_id"]: r["component"] for r in minhash.groups(df, lower=False).collect()}
    assert [got[i] for i in range(len(texts))] == groups_of(len(texts), pairs)
    # a family larger than a band that is compared as pairs
    base = words(200, 10**6).split()
    family = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(0, 200, 5)]
    got = minhash.groups(spark.createDataFrame(list(enumerate(family)), "doc_id long, text string")).collect()
    assert len(got) == len(family) > minhash.PAIRED and {r["component"] for r in got} == {0}


def test_op2_hashes_each_text_once(spark, small, docs, awkward, nothing, monkeypatch):
    """Classes are cut from the fingerprints' table, without a second pass of signatures, and are those of all pairs."""
    whole = {repr((r["k"], r["class_id"])) for r in (lambda signed, names: signed.join(names, "id"))(*minhash.classes(awkward)).collect()}
    out = minhash.compared(awkward)
    names = minhash.compared_classes(awkward, out)
    assert {repr((r["doc_id"], r["class_id"])) for r in out.join(names, out["set_id"] == names["id"]).collect()} == whole and whole
    assert minhash.compared_classes(nothing, minhash.compared(nothing)).count() == 0

    def again(*args, **more):
        raise AssertionError("signed again")

    monkeypatch.setattr(minhash, "classes", again)
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    sh = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else {None} for _, t in texts]
    pairs = [(i, j) for i in range(len(sh)) for j in range(i) if len(sh[i] & sh[j]) >= 0.8 * len(sh[i] | sh[j])]
    got = {r["doc_id"]: r["class_id"] for r in minhash.op2_minhash(spark, small).collect()}
    assert pairs and [got[k] for k, _ in texts] == [texts[g][0] for g in groups_of(len(texts), pairs)]


def test_components_of_long_chains(spark):
    r = random.Random(2)
    names = r.sample(range(10_000), 900)
    pairs = [(names[i], names[i + 1]) for i in range(599)] + [(names[i], names[600 + (i * 7) % 300]) for i in range(600, 900)] + [(5, 5), (None, 3)]
    got = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted(got)
    at = {n: i for i, n in enumerate(nodes)}
    want = groups_of(len(nodes), [(at[a], at[b]) for a, b in pairs if a is not None and a != b])
    assert [got[n] for n in nodes] == [nodes[g] for g in want]


def vectors(spark, small):
    return spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")


def brute_links(rows):
    ok = {k: np.array(v, float) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    u = np.array([ok[k] / np.linalg.norm(ok[k]) for k in ids])
    near = u @ u.T >= 0.9
    return ids, near


@pytest.mark.parametrize("block", [32, 1024])
def test_embeddings_against_brute_force(spark, small, block):
    rows = [(r["vec_id"], list(r["embedding"])) for r in vectors(spark, small).collect()]
    r = random.Random(9)
    n = max(k for k, _ in rows) + 1
    for k, v in rows[:40]:
        rows.append((n, [x + r.gauss(0, 0.01) for x in v]))
        rows.append((n + 1, list(v)))
        n += 2
    rows += [(n, None), (n + 1, [0.0] * 64), (n + 2, [float("nan")] + [1.0] * 63), (n + 3, [None] + [1.0] * 63), (n + 4, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x["vec_id"]: x for x in embeddings.groups(df, block=block).collect()}
    ids, near = brute_links(rows)
    np.fill_diagonal(near, False)
    found = sum(got[k]["n_links"] for k in ids)
    assert 0.99 * near.sum() <= found <= near.sum()
    comp = groups_of(len(ids), list(zip(*np.nonzero(near))))
    assert np.mean([got[k]["component_id"] == ids[g] for k, g in zip(ids, comp)]) >= 0.99
    for k in range(n, n + 5):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert all(x["kept"] == (x["component_id"] == x["vec_id"]) for x in got.values())


def test_embeddings_awkward(spark):
    """Repeated rows, null ids and clashing columns; vectors of several lengths."""
    v, w = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0]
    rows = [(1, v), (1, v), (2, w), (None, v), (3, [0.0, 1.0]), (4, [0.0, 2.0]), (5, [1e-300, 1e300]), (6, [float("inf"), 1.0]), (7, None)]
    df = spark.createDataFrame([(k, x, "n", "b", "c") for k, x in rows], "vec_id long, embedding array<double>, node string, bucket string, code string")
    got = sorted(map(repr, [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.groups(df).collect()]))
    assert got == sorted(map(repr, [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, None), (3, 2, 3, True), (4, 2, 3, False), (5, 2, 3, False), (6, 0, 6, True), (7, 0, 7, True)]))


def test_embeddings_index_grows_with_the_table():
    assert embeddings.size_of_index(50_000) == (8, 20)
    for n in (10**5, 10**7, 10**9):
        bits, tables = embeddings.size_of_index(n)
        assert n / 2**bits <= embeddings.BLOCK / 4
        agree = (1 - math.acos(0.9) / math.pi) ** bits
        assert (1 - agree) ** tables <= embeddings.MISSED


def test_embeddings_empty(spark):
    assert embeddings.groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
