import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from reqloom.llm import bpe


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


def held(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def check(df, library, leaf, spread):
    got = bpe.decode(bpe.encode(df, leaf=leaf, spread=spread)).collect()
    assert len(got) == df.count()
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("leaf, spread", [(3, 40), (16, 16), (4096, 32768)])
def test_awkward_texts(awkward, library, leaf, spread):
    check(awkward, library, leaf, spread)


UNSPLIT = ["ab" * 3000, "the" * 999, "aaaa" * 500 + "<|endoftext|>" + "b" * 700, "x" * 65 + "!" * 300 + "1" * 200, "É" * 500, "日本語" * 200, "<|startoftext|>", "a<|endoftext|>b c", "é" * 400, "one " + "y" * 900 + " two three " + "z" * 90]


@pytest.mark.parametrize("leaf, spread", [(7, 50), (64, 300), (64, 100_000)])
def test_unsplit_texts(spark, library, leaf, spread):
    r = random.Random(leaf)
    texts = ["".join(r.choice("abcdeth") for _ in range(r.randrange(1, 2000))) for _ in range(60)]
    texts += ["".join(r.choice("abcdeth ") for _ in range(r.randrange(1, 2000))) for _ in range(60)]
    check(held(spark, texts + UNSPLIT), library, leaf, spread)


def test_documents(docs, library):
    check(docs, library, 256, 2000)


def test_documents_go_through_the_tree(spark):
    """With the parameters of op1 long documents are joined, within a task and across tasks."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 4096").limit(200).collect()]
    c = bpe.Codec(bpe.default_vocabulary())
    assert all(c.packed(t) == np.array(c.ids(t), np.int32).tobytes() for t in texts)
    assert c.at_space and c.joins >= len(texts)
    long = max(texts, key=len) * 3
    parts = bpe.parts_of(c, long, bpe.SPREAD)
    assert len(parts) > 1 and {p[1] for p in parts} == {bpe.TEXT}
    before = c.joins
    assert bpe.joined(c, [p[0] for p in parts], [p[1] for p in parts], [p[3] for p in parts], [c.packed(p[3]) for p in parts]) == np.array(c.ids(long), np.int32).tobytes()
    assert c.joins >= before + len(parts) - 1


def test_window_grows(library):
    c = bpe.Codec(bpe.default_vocabulary())
    t = "start " + "ab" * 200 + " end"
    assert c.packed(t, 100) == np.array(library.encode(t, add_special_tokens=False).ids, np.int32).tobytes() and c.grown > 0


def test_vocabulary_whose_tokens_span_blanks(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    assert not bpe.codec(path).at_space
    rows = bpe.decode(bpe.encode(docs.limit(50), vocabulary=path, leaf=64, spread=500), vocabulary=path).collect()
    for r in rows:
        want = whole.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == whole.decode(want, skip_special_tokens=False)


def test_halves():
    cut = bpe.halves(1000, 64)
    assert cut[0][0] == 0 and cut[-1][1] == 1000 and all(a[1] == b[0] for a, b in zip(cut, cut[1:])) and all(0 < b - a <= 64 for a, b in cut)


def test_empty_table_and_digest(nothing, spark, awkward, library):
    assert bpe.encode(nothing).count() == 0 and bpe.digests(nothing).count() == 0
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in awkward.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(repr, map(tuple, bpe.digests(awkward).collect()))) == sorted(map(repr, want))


def test_clashing_names(spark):
    df = spark.createDataFrame([("a b", 1, [7], "k", 2)], "text string, ids long, n_tokens array<int>, key string, seq int")
    r = bpe.encode(df, spread=1).first()
    assert set(r.asDict()) == {"text", "ids", "n_tokens", "key", "seq"} and (r["n_tokens"], r["key"], r["seq"]) == ([7], "k", 2) and len(r["ids"]) == 2
