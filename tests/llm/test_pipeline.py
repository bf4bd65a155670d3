"""Each stage of the corpus pipeline against plain Python on its own input."""

import hashlib
import random

import plain
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from reqloom.llm import simhash, toxicity
from reqloom.llm.common import materialize


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs]
    for name, f in P.STAGES:
        docs = materialize(f(spark, docs, small), name)
        seen.append(docs)
    return seen


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxic_documents_go(spark, small, stages):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    m = toxicity.train(stages[0], labels)
    want = [r for r in rows(stages[0]) if not plain.severity(m.weights, m.thresholds, m.reject, r[1])[2]]
    assert rows(stages[1]) == want
    have, clean = {r[0] for r in want}, {r["doc_id"] for r in labels.where("toxic = 0").collect()} & {r[0] for r in rows(stages[0])}
    assert len(clean - have) <= 0.02 * len(clean)


def test_one_of_each_group(stages):
    before = sorted(rows(stages[1]), key=lambda r: r[0])
    least = plain.least_of_groups([r[1] for r in before])
    assert rows(stages[2]) == sorted((r for i, r in enumerate(before) if least[i] == i), key=repr)


def test_secrets_are_masked(stages):
    want = [(*r[:1], plain.masked(r[1]), *r[2:4], len(plain.masked(r[1]))) for r in rows(stages[2])]
    assert rows(stages[3]) == sorted(want, key=repr)


def test_planted_secrets_are_masked(spark, small):
    texts = ["password = hunter2x end", "AKIA" + "Q" * 18, "é token: abcdef1 and " + "0f" * 16, "clean", "ghp_" + "a" * 40, None, "password = hunter2x end"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.redact_secrets(spark, df, small).collect()}
    want = {i: (t, 0) if t is None else (plain.masked(t), len(plain.masked(t))) for i, t in enumerate(texts)}
    assert got == want and sum("[REDACTED]" in (t or "") for t, _ in got.values()) == 5


def test_mix_takes_whole_documents_up_to_the_targets(stages):
    before = {r[0]: r for r in rows(stages[3])}
    got = stages[4].collect()
    sizes, taken = {}, {}
    for r in before.values():
        sizes[r[3]] = sizes.get(r[3], 0) + len(plain.WORD.findall(r[1]))
    for r in got:
        n = len(plain.WORD.findall(r["text"]))
        assert n and r["text"] == plain.first_words(before[r["doc_id"]][1], n) and r["n_chars"] == len(r["text"])
        taken.setdefault(r["source"], []).append((r["doc_id"], n))
    for s, target in plain.goals(sizes).items():
        assert sum(n for _, n in taken.get(s, [])) == int(target)
        parts = [(k, n) for k, n in taken.get(s, []) if n < len(plain.WORD.findall(before[k][1]))]
        assert len(parts) <= 1  # a source is cut at its target, nowhere else
        assert max((sum(x == k for x, _ in taken.get(s, [])) for k, _ in taken.get(s, [])), default=0) <= 2


def test_mix_follows_the_schedule(spark, small):
    """Files hold the documents by slot; a schedule of another kind gives another order."""
    r = random.Random(8)
    docs = [(i, " ".join(f"w{r.randrange(99)}" for _ in range(300 + 11 * i)), "en", "abc"[i % 3], 0) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    keyed = df.withColumn("__key", P._row_key(df))
    from pyspark.sql import functions as F

    names = {x["doc_id"]: x["k"] for x in keyed.select("doc_id", F.col("__key").cast("string").alias("k")).collect()}
    want = plain.mix([(names[d[0]], d[1], d[3]) for d in docs])
    back = {v: k for k, v in names.items()}
    got = [(x["doc_id"], len(plain.WORD.findall(x["text"]))) for x in P.mix_sources(spark, df, small).collect()]
    slots = {}
    for slot, k, _, words, _ in want:
        slots.setdefault(slot, []).append((back[k], words))
    at = 0
    for slot in sorted(slots):
        n = len(slots[slot])
        assert sorted(got[at : at + n]) == sorted(slots[slot])
        at += n
    assert at == len(got)


def test_tokens(stages):
    from reqloom.llm import bpe

    whole = Tokenizer.from_file(bpe.default_vocabulary())
    whole.no_padding()
    whole.no_truncation()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in stages[4].collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, stages[5].collect())) == sorted(want)


def test_awkward_stages(spark, awkward, nothing, small):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    tox = P.drop_toxic(spark, docs, small)
    assert rows(tox) == rows(docs)  # nothing in it is toxic; null texts stay
    kept = P.drop_near_copies(spark, tox, small)
    by_id = sorted({(r[0] is None, r[0] or 0, r) for r in rows(tox)}, key=repr)
    by_id = [r for _, _, r in sorted(by_id, key=lambda x: x[:2])]
    groups = plain.least_of_groups([r[1] for r in by_id])
    assert {r[1] and r[1].lower().split()[:3] and tuple(r[1].lower().split()[:3]) for r in rows(kept)} == {by_id[g][1] and by_id[g][1].lower().split()[:3] and tuple(by_id[g][1].lower().split()[:3]) for g in groups}
    assert kept.count() == len(set(groups))
    red = P.redact_secrets(spark, docs, small)
    assert rows(red) == rows(docs)  # no secrets; nulls stay nulls
    mixed = P.mix_sources(spark, docs, small)
    sizes = {}
    for r in rows(docs):
        sizes[r[3]] = sizes.get(r[3], 0) + len(plain.WORD.findall(r[1] or ""))
    got = {}
    for r in rows(mixed):
        got[r[3]] = got.get(r[3], 0) + len(plain.WORD.findall(r[1]))
    assert got == {s: int(t) for s, t in plain.goals(sizes).items() if int(t)}
    assert P.encode_tokens(spark, docs, small).count() == docs.count()
    df = nothing.select(docs.columns)
    for _, f in P.STAGES:
        assert f(spark, df, small).count() == 0


def test_edited_copies_go(spark, small, words):
    """Texts of Jaccard 0.8 and over go (chains and large groups too), less alike ones stay."""
    r, texts = random.Random(3), []
    for size, copies in ((200, 3), (300, 4), (60, 14), (400, 2)):
        base = words(size, 5000).split()
        texts.append(" ".join(base))
        for i in range(copies):
            base = list(base) if i % 2 else texts[-1].split()
            for _ in range(1 + (i % 3) * size // 120):
                base[r.randrange(size)] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(base))
    texts += [texts[0].upper(), "", None, " \n", "one two", "one two three"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(set(plain.least_of_groups(texts)))
    assert sorted(x["doc_id"] for x in P.drop_near_copies(spark, df, small).collect()) == want


def test_near_copies_come_from_the_simhash_index(spark, small, words, monkeypatch):
    """An index that can't bring edited copies together leaves them: the stage has no other way to them."""
    base = words(60, 5000).split()
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(base)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [x["doc_id"] for x in P.drop_near_copies(spark, df, small).collect()] == [0]
    monkeypatch.setattr(simhash, "reach", lambda width: 0)
    assert sorted(x["doc_id"] for x in P.drop_near_copies(spark, df, small).collect()) == [0, 1]
