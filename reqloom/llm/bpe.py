"""BPE encoding and decoding by tree concatenation.

A vocabulary file of the `tokenizers` library gives normaliser, pre-tokeniser and merges. A text over
LEAF code points is halved until the parts fit; the parts are encoded each for itself, and a tree of
joins puts them together. At each join a window over the seam is encoded again and grows on both sides
until it agrees with the left side's last tokens and the right side's first ones. A text over SPREAD
code points is dealt to parallel tasks, part by part, and joined where its parts meet.

Where a join's two sides may be cut: no token spans white space, so a window that begins and ends at
white space and whose ends repeat what both sides have there is exact. A stretch without white space
that is too long for such windows is *unsplit text*: its pre-tokens are halved as symbols, and a window
is exact as soon as its first token equals the left side's token at that place and its last one the
right side's. Every neighbouring pair of the joined sequence then stands in some exact encoding, and as
each token has one merge only, a sequence whose neighbouring pairs are all stable is the encoding of its
text. A vocabulary whose tokens may span white space is found out when it is loaded; its texts are
encoded whole by the library.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, prepare

#: ASCII white space, as a character class; all of it is white space to the tokenisers too.
SPACE = " \t\n\r"
#: Code points of a leaf of the tree; of a part that is a row of its own; of a join's first window.
LEAF, SPREAD, WINDOW = 4096, 32768, 32
#: Words of at most WORD code points that a worker keeps (some 200 bytes each).
CACHE_WORDS, WORD = 300_000, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """One vocabulary file: exact whole-text coding, and the parts that the tree needs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = spec.get("added_tokens", [])
        self.specials = [x["content"] for x in self.added]
        merges = [tuple(x.split(" ", 1)) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        made = {"".join(x) for x in merges}
        #: The proof of the joins within unsplit text needs one merge for each token.
        self.joinable = len(made) == len(merges) and not model.get("continuing_subword_prefix") and not model.get("dropout")
        self.path, self.models = path, None
        self.token = tokens(path)[0]
        #: Words used since the cache was last half full, and before.
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.room = CACHE_WORDS // 2
        #: Joins that were made, and those whose window had to grow.
        self.joins = self.grown = 0
        self.at_space = self._cuts_at_space(spec)

    def _cuts_at_space(self, spec: dict) -> bool:
        """Is a text's encoding that of its words, one after another? Tried on all pairs of kinds of
        characters around each kind of white space."""
        if any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in self.added):
            return False
        kinds = ["a", "B", "7", "-", "'", "'s", "é", "é", "ß", "日", "😀", "_", "\x00", *self.specials]
        gaps = [*SPACE, "  ", " \n", "\r\n"]
        alone = {k: self.ids(k) for k in kinds}
        return all(self.ids(x + g + y) == alone[x] + alone[y] for x in kinds for y in kinds for g in gaps) and all(not self.ids(g) for g in gaps)

    def ids(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def part(self, symbols: str, last: bool) -> list[int]:
        """The encoding of a part of a pre-token; only the last part has the word's end."""
        if self.models is None:  # two further copies of the vocabulary, for long stretches only
            self.models = _part_models(self.path)
        return [t.id for t in self.models[last].tokenize(symbols)]

    def pretokens(self, stretch: str) -> list[tuple[str, list[int] | None]]:
        """(symbols, None) for pre-tokens, ("", ids) for added tokens, in order."""
        out: list[tuple[str, list[int] | None]] = []
        while stretch:
            at = min(((i, s) for s in self.specials if (i := stretch.find(s)) >= 0), default=(len(stretch), ""), key=lambda x: (x[0], -len(x[1])))
            if at[0]:
                plain = self.whole.normalizer.normalize_str(stretch[: at[0]]) if self.whole.normalizer else stretch[: at[0]]
                out += [(s, None) for s, _ in self.whole.pre_tokenizer.pre_tokenize_str(plain)]
            if at[1]:
                out.append(("", [self.whole.token_to_id(at[1])]))
            stretch = stretch[at[0] + len(at[1]) :]
        return out

    def leaf(self, text: str) -> bytes:
        """int32 ids of a text that is encoded at once; short words are remembered."""
        for c in SPACE[1:]:
            text = text.replace(c, " ")
        words = text.split(" ")
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        new, older = [], self.older
        for w in set(words):
            if w not in known:
                ids = older.get(w)
                if ids is None:
                    new.append(w)
                else:
                    known[w] = ids
                    self.room -= 1
        self.room -= len(new)
        long = []
        for w, e in zip(new, self.whole.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[w] = array("i", e.ids).tobytes()
            if len(w) > WORD:
                long.append(w)
        out = b"".join(map(known.__getitem__, words))
        for w in long:
            del known[w]
        if self.room < 0:  # what was not used since the last time goes
            self.older, self.known, self.room = known, {"": b""}, CACHE_WORDS // 2
        return out

    def packed(self, text: str, leaf: int = LEAF) -> bytes:
        """int32 ids of a whole text, by the tree if it is longer than a leaf."""
        if not self.at_space:
            return np.array(self.ids(text), np.int32).tobytes()
        if len(text) <= leaf:
            return self.leaf(text)
        cut = halves(len(text), leaf)
        return join_texts(self, text, [(a, b, self.leaf(text[a:b])) for a, b in cut])


@lru_cache(maxsize=2)
def tokens(path: str) -> tuple[list[str], bool]:
    """(tokens by id, whether the file has a decoder)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    by_id = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec.get("added_tokens", [])}
    return [by_id.get(i, "") for i in range(max(by_id) + 1)], spec.get("decoder") is not None


def _part_models(path: str) -> tuple:
    """(model of inner parts, model of a word's last part)."""
    from tokenizers.models import BPE

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(x.split(" ", 1)) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    suffix = model.get("end_of_word_suffix") or ""
    inner = BPE(model["vocab"], merges)
    return inner, BPE(model["vocab"], merges, end_of_word_suffix=suffix) if suffix else inner


def decoder(path: str) -> Callable[[list[int]], str]:
    """The library's decode(ids, skip_special_tokens=False)."""
    table, has_decoder = tokens(path)
    if has_decoder:
        whole = codec(path).whole
        return lambda ids: whole.decode(ids, skip_special_tokens=False)
    return lambda ids: " ".join(map(table.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def halves(n: int, leaf: int) -> list[tuple[int, int]]:
    """The leaves of the halving tree over n symbols, in order."""
    if n <= leaf:
        return [(0, n)]
    m = n // 2
    return halves(m, leaf) + [(a + m, b + m) for a, b in halves(n - m, leaf)]


# --- joins of texts --------------------------------------------------------------------------------


def _first_space(text: str, a: int, b: int) -> int:
    return min((i for c in SPACE if (i := text.find(c, a, b)) >= 0), default=-1)


def _last_space(text: str, a: int, b: int) -> int:
    return max(text.rfind(c, a, b) for c in SPACE)


def join_text(c: Codec, text: str, left: tuple[int, int, bytes], right: tuple[int, int, bytes]) -> tuple[int, int, bytes]:
    """The exact encoding of text[lo:hi] from those of text[lo:m] and text[m:hi] (start, end, ids).

    The window takes 32, 64, 128, ... code points of each side. Its ends move in to white space (or are
    the sides' own ends); what each side has between there and the seam, encoded for itself, must be the
    side's last or first tokens.
    """
    lo, m, hi, n = left[0], left[1], right[1], WINDOW
    while True:
        a, b = max(lo, m - n), min(hi, m + n)
        i = a if a == lo else _first_space(text, a, m)
        j = b if b == hi else _last_space(text, m, b)
        c.joins += 1
        if i >= 0 and j >= 0:
            tail, head = c.leaf(text[i:m]), c.leaf(text[m:j])
            if left[2].endswith(tail) and right[2].startswith(head):
                return lo, hi, left[2][: len(left[2]) - len(tail)] + c.leaf(text[i:j]) + right[2][len(head) :]
        c.grown += 1
        n *= 2


def join_texts(c: Codec, text: str, parts: list[tuple[int, int, bytes]]) -> bytes:
    """Joins the leaves' encodings pairwise, level by level."""
    while len(parts) > 1:
        ends = len(parts) - 1
        parts = [join_text(c, text, parts[i], parts[i + 1]) if i < ends else parts[i] for i in range(0, len(parts), 2)]
    return parts[0][2] if parts else b""


# --- joins of symbols ------------------------------------------------------------------------------


def join(left: list[int], right: list[int], spell: Callable[[int], str], encode: Callable[[str, bool], list[int]], last: bool) -> list[int]:
    """The exact encoding of left's and right's symbols together, both parts of one pre-token.

    `spell` gives a token's symbols, `encode` a part's tokens; `last`: right ends the word. The window
    takes 4, 8, 16, ... tokens of each side until it agrees with both sides at its ends.
    """
    if not left or not right:
        return left + right
    n = 4
    while True:
        a, b = min(n, len(left)), min(n, len(right))
        ends = last and b == len(right)
        window = encode("".join(map(spell, left[-a:])) + "".join(map(spell, right[:b])), ends)
        fits_left = a == len(left) or window[0] == left[-a]
        fits_right = b == len(right) or window[-1] == right[b - 1]
        if fits_left and fits_right:
            return left[: len(left) - a] + window + right[b:]
        n *= 2


def join_tree(parts: list[list[int]], spell, encode) -> list[int]:
    """Joins the leaves' encodings pairwise, level by level."""
    while len(parts) > 1:
        ends = len(parts) - 1
        parts = [join(parts[i], parts[i + 1], spell, encode, i + 1 == ends) if i < ends else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def speller(c: Codec) -> Callable[[int], str]:
    return lambda i: c.token[i].removesuffix(c.suffix) if c.suffix else c.token[i]


# --- rows ------------------------------------------------------------------------------------------

OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
}


def _list_array(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) // 4 for x in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _outputs(path: str, packed: list[bytes], want: tuple[str, ...]) -> list[pa.Array]:
    """The wanted columns from the texts' ids; what is decoded is decoded from the ids."""
    cols: dict[str, pa.Array] = {}
    if "ids" in want:
        cols["ids"] = _list_array(packed)
    lists = [np.frombuffer(x, np.int32).tolist() for x in packed]
    if "n_tokens" in want:
        cols["n_tokens"] = pa.array([len(x) // 4 for x in packed], pa.int64())
    if "ids_sha256" in want:
        number = numbers(path)
        cols["ids_sha256"] = pa.array([hashlib.sha256(" ".join(map(number.__getitem__, x)).encode()).hexdigest() for x in lists])
    if {"decoded", "decoded_sha256"} & set(want):
        decoded = list(map(decoder(path), lists))
        if "decoded" in want:
            cols["decoded"] = pa.array(decoded, pa.string())
        if "decoded_sha256" in want:
            cols["decoded_sha256"] = pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded])
    return [cols[x] for x in want]


@lru_cache(maxsize=2)
def numbers(path: str) -> list[str]:
    return list(map(str, range(len(tokens(path)[0]))))


PARTS = "key long, seq int, tree int, kind int, last boolean, part string, packed binary"
#: Kinds of parts: ids that are done, a part of a text, a part of a pre-token.
DONE, TEXT, SYMBOLS = 0, 1, 2


def parts_of(c: Codec, t: str, spread: int) -> list[tuple[int, int, bool, str, bytes]]:
    """(tree, kind, last, part, packed) of a long text, in order; parts of one tree are joined later.

    Stretches without white space over `spread` are cut as symbols, what lies between them as text.
    """
    out: list[tuple[int, int, bool, str, bytes]] = []
    if not c.at_space:
        return [(0, DONE, False, "", c.packed(t))]

    def text(a: int, b: int) -> None:
        tree = len(out)
        out.extend((tree, TEXT, False, t[a + x : a + y], b"") for x, y in halves(b - a, spread))

    begin = at = 0
    while at < len(t):
        end = _first_space(t, at, min(len(t), at + spread + 1))
        if end < 0 and len(t) - at > spread:  # a long stretch
            end = _first_space(t, at, len(t))
            end = len(t) if end < 0 else end
            if at > begin:
                text(begin, at)
            for symbols, own in c.pretokens(t[at:end]):
                if own is not None or len(symbols) <= spread or not c.joinable:
                    out.append((len(out), DONE, False, "", np.array(own if own is not None else c.part(symbols, True), np.int32).tobytes()))
                    continue
                tree = len(out)
                out.extend((tree, SYMBOLS, y == len(symbols), symbols[x:y], b"") for x, y in halves(len(symbols), spread))
            begin = at = end
        else:
            at = len(t) if end < 0 else end + 1
    if at > begin:
        text(begin, at)
    return out


def joined(c: Codec, tree: list[int], kind: list[int], part: list[str], packed: list[bytes]) -> bytes:
    """A text's ids from those of its parts, in order."""
    done, i = [], 0
    while i < len(tree):
        j = i + 1
        while j < len(tree) and tree[j] == tree[i]:
            j += 1
        if kind[i] == DONE:
            done += packed[i:j]
        elif kind[i] == TEXT:
            ends = np.cumsum([0, *map(len, part[i:j])]).tolist()
            done.append(join_texts(c, "".join(part[i:j]), list(zip(ends, ends[1:], packed[i:j], strict=False))))
        else:
            got = join_tree([np.frombuffer(x, np.int32).tolist() for x in packed[i:j]], speller(c), c.part)
            done.append(np.array(got, np.int32).tobytes())
        i = j
    return b"".join(done)


def code(df: DataFrame, text: str = "text", want: tuple[str, ...] = ("ids",), vocabulary: str | None = None, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """df with the columns `want` of OUTPUTS for each whole text: ids (array<int>, the exact encoding),
    decoded (the ids as the library decodes them), n_tokens, and the digests ids_sha256 (decimal ids,
    joined by blanks) and decoded_sha256. One pass of a Python worker encodes, decodes and digests.

    A null or empty text has no ids. Repeated rows stay repeated; other columns pass through, whatever
    their names, except that older columns of the wanted names are replaced. Texts over `spread` code
    points go through the tree in parallel, one row per part.
    """
    path = vocabulary or default_vocabulary()
    spark = prepare(df.sparkSession)
    at = df.columns.index(text)
    names = [f"c{i}" for i in range(len(df.columns))]
    held = df.toDF(*names)
    made = T.StructType([T.StructField(f"o{i}", OUTPUTS[x]) for i, x in enumerate(want)])
    t = F.col(names[at])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            packed = [c.packed(x or "", leaf) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *_outputs(path, packed, want)], [*names, *made.names])

    is_long = F.coalesce(F.length(t) > spread, F.lit(False))
    short = held.where(~is_long).mapInArrow(plain, T.StructType([*held.schema.fields, *made.fields]))

    whole = T.StructField("row", T.StructType(held.schema.fields))
    pieces = T.StructType([whole, *T._parse_datatype_string(PARTS).fields])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The row itself goes with its first part."""
        c = codec(path)
        for b in batches:
            for i, (key, x) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                cols = list(zip(*parts_of(c, x, spread), strict=True))
                n = len(cols[0])
                row = pa.concat_arrays([b.column(0).slice(i, 1), pa.nulls(n - 1, b.column(0).type)])
                rest = [pa.array([key] * n, pa.int64()), pa.array(range(n), pa.int32())]
                rest += [pa.array(v, k) for v, k in zip(cols, (pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([row, *rest], pieces.names)

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            done = []
            for kind, last, x, ids in zip(*[b.column(pieces.names.index(k)).to_pylist() for k in ("kind", "last", "part", "packed")], strict=True):
                done.append(ids if kind == DONE else c.packed(x, leaf) if kind == TEXT else np.array(c.part(x, last), np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(done, pa.binary())], pieces.names)

    def assemble(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        packed = joined(codec(path), *[table[k].to_pylist() for k in ("tree", "kind", "part", "packed")])
        return pa.Table.from_arrays([table["row"].combine_chunks().slice(0, 1), *_outputs(path, [packed], want)], ["row", *made.names])

    tall = (
        held.where(is_long).select(F.struct(*names).alias("row"), F.monotonically_increasing_id().alias("key"), t.alias("t"))
        .mapInArrow(deal, pieces)
        .repartition(partitions(spark), "key", "seq")
        .mapInArrow(encode_parts, pieces)
        .groupBy("key")
        .applyInArrow(assemble, T.StructType([whole, *made.fields]))
        .select("row.*", *made.names)
    )
    keep = [F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True) if c not in want]
    return short.unionByName(tall).select(*keep, *[F.col(o).alias(x) for o, x in zip(made.names, want, strict=True)])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """df with the column `ids` (array<int>), the exact encoding of each whole text; see `code`."""
    out = code(df.drop(ids) if ids != text else df, text, ("ids",), vocabulary, leaf, spread)
    return out if ids == "ids" else out.withColumnRenamed("ids", ids)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """df with the column `text`: each row's ids as the library decodes them, special tokens kept.

    Null ids count as none. The library joins the tokens of a vocabulary without a decoder by blanks.
    """
    path = vocabulary or default_vocabulary()
    prepare(df.sparkSession)
    df = df.drop(text) if text in df.columns else df
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])
    at = df.columns.index(ids)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = decoder(path)
        for b in batches:
            texts = [decoded(x or []) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], schema.names)

    return df.mapInArrow(go, schema)


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def digests(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text, coded and decoded."""
    return code(df.select("doc_id", "text"), want=DIGESTS, vocabulary=vocabulary).drop("text")


def op1_bpe(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return digests(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"), vocabulary)
