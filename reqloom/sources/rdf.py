"""RDF texts: Turtle and RDF/XML to triple rows and back.

A small parser for what requirement graphs use: prefixes, base, prefixed names, IRIs, blank nodes with
property lists, collections, literals with language or type, `a`, `;` and `,`. Files are graphs of one
record each, so a text is one row and is parsed in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.vocab import RDF, TYPE, XSD

SCHEMA = "graph_id long, s string, p string, o string, o_kind string, o_datatype string, o_lang string, error string"
_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*(?:\\.[^<>"{}|^`\s]*)*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<type>\^\^)|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<number>[-+]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][-+]?\d+)?)
    |(?P<blank>_:[\w.-]*\w)|(?P<name>[^\s<>"'{}|^`\;,.()\[\]#@:]*:(?:[\w\-%~!$&*+=:/]|\.(?=[\w\-:]))*|[A-Za-z]+)|(?P<mark>[.;,()\[\]])""",
    re.VERBOSE,
)
_IRI = r"""<([^<>"{}|^`\\\s]*)>"""
#: A line that is a statement by itself, without escapes, or a prefix; as `to_lines` writes them.
_LINE = re.compile(rf"""(?:{_IRI}|(_:[\w.-]*\w)) {_IRI} (?:{_IRI}|(_:[\w.-]*\w)|"([^"\\\n\r]*)") \.|@prefix [\w-]*: {_IRI} \.""")
_ESCAPE = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(t: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPE.get(m[1], m[1]), t)


class TurtleError(ValueError):
    pass


def _parse_lines(text: str) -> list[tuple] | None:
    """The rows of a text that is nothing but plain lines, else None; nothing else of it is held."""
    out = []
    for line in text.split("\n"):
        m = _LINE.fullmatch(line)
        if m is None:
            if line.strip(" \t\r"):
                return None
            continue
        s, blank, p, o, o_blank, value, _ = m.groups()
        if p is not None:
            o, kind = (o, "iri") if o is not None else (o_blank, "bnode") if o_blank is not None else (value, "literal")
            out.append((blank if s is None else s, p, o, kind, None, None))
    return out


def parse_turtle(text: str) -> list[tuple[str, str, str, str, str | None, str | None]]:
    """(s, p, o, o_kind, datatype, language) rows of a Turtle text; TurtleError where it isn't one."""
    if (plain := _parse_lines(text)) is not None:
        return plain
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"unexpected {text[at : at + 20]!r} at {at}")
        at = m.end()
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0]))
    prefixes, base, out, i, fresh = {}, "", [], 0, 0

    def peek():
        return tokens[i] if i < len(tokens) else ("end", "")

    def take(mark: str | None = None):
        nonlocal i
        got = peek()
        if got[0] == "end" or (mark and got[1] != mark):
            raise TurtleError(f"expected {mark or 'a term'}, found {got[1]!r}")
        i += 1
        return got

    def blank() -> str:
        nonlocal fresh
        fresh += 1
        return f"_:b{fresh}"

    def iri(kind: str, raw: str) -> str:
        if kind == "iri":
            return urljoin(base, unescape(raw[1:-1])) if base else unescape(raw[1:-1])
        head, _, tail = raw.partition(":")
        if kind != "name" or ":" not in raw or head not in prefixes:
            raise TurtleError(f"unknown name {raw!r}")
        return prefixes[head] + re.sub(r"\\(.)", r"\1", tail)

    def node(kind: str, raw: str):
        """A subject or object that isn't a literal: (value, kind)."""
        if kind == "blank":
            return raw, "bnode"
        if raw == "[":
            b = blank()
            if peek()[1] != "]":
                properties(b)
            take("]")
            return b, "bnode"
        if raw == "(":
            items = []
            while peek()[1] != ")":
                items.append(term())
            take(")")
            heads = [blank() for _ in items] + [RDF + "nil"]
            for h, item, rest in zip(heads, items, heads[1:], strict=False):
                out.append((h, RDF + "first", *item))
                out.append((h, RDF + "rest", rest, "iri" if rest == RDF + "nil" else "bnode", None, None))
            return heads[0], "bnode" if items else "iri"
        return iri(kind, raw), "iri"

    def term():
        kind, raw = take()
        if kind in ("text", "long"):
            value = unescape(raw[3:-3] if kind == "long" else raw[1:-1])
            if peek()[0] == "at":
                return value, "literal", None, take()[1][1:]
            if peek()[0] == "type":
                take()
                return value, "literal", iri(*take()), None
            return value, "literal", None, None
        if kind == "number":
            return raw, "literal", XSD + ("double" if "e" in raw.lower() else "decimal" if "." in raw else "integer"), None
        if kind == "name" and raw in ("true", "false"):
            return raw, "literal", XSD + "boolean", None
        return *node(kind, raw), None, None

    def properties(s: str) -> None:
        while True:
            kind, raw = take()
            p = TYPE if (kind, raw) == ("name", "a") else iri(kind, raw)
            while True:
                out.append((s, p, *term()))
                if peek()[1] != ",":
                    break
                take()
            if peek()[1] != ";":
                return
            while peek()[1] == ";":
                take()
            if peek()[1] in (".", "]"):
                return

    while peek()[0] != "end":
        kind, raw = take()
        word = raw.lstrip("@").lower()
        if word in ("prefix", "base") and (kind == "at" or ":" not in raw):
            name = take()[1] if word == "prefix" else ":"
            target = take()
            if target[0] != "iri" or not name.endswith(":"):
                raise TurtleError(f"expected an IRI, found {target[1]!r}")
            if word == "prefix":
                prefixes[name[:-1]] = iri(*target)
            else:
                base = iri(*target)
            if kind == "at":
                take(".")
            continue
        s = node(kind, raw)[0]
        if not (raw == "[" and peek()[1] == "."):
            properties(s)
        take(".")
    return out


def parse_xml(text: str) -> list[tuple[str, str, str, str, str | None, str | None]]:
    """The rows of an RDF/XML text, node elements and property elements nested at will."""
    from xml.etree import ElementTree

    lang_key, base_key = "{http://www.w3.org/XML/1998/namespace}lang", "{http://www.w3.org/XML/1998/namespace}base"
    root, out, count = ElementTree.fromstring(text), [], 0
    base = root.get(base_key, "")
    rdf = lambda name: f"{{{RDF}}}{name}"
    full = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:x{count}"

    def subject(e) -> tuple[str, str]:
        if (a := e.get(rdf("about"))) is not None:
            return urljoin(base, a) if base else a, "iri"
        if (a := e.get(rdf("ID"))) is not None:
            return f"{base}#{a}", "iri"
        return (f"_:{a}" if (a := e.get(rdf("nodeID"))) else fresh()), "bnode"

    def described(e) -> tuple[str, str]:
        s, kind = subject(e)
        if e.tag != rdf("Description"):
            out.append((s, TYPE, full(e.tag), "iri", None, None))
        for k, v in e.attrib.items():
            if k not in (rdf("about"), rdf("ID"), rdf("nodeID"), lang_key, base_key):
                out.append((s, full(k), v, "iri" if full(k) == TYPE else "literal", None, None))
        for c in e:
            p = full(c.tag)
            if (r := c.get(rdf("resource"))) is not None:
                out.append((s, p, urljoin(base, r) if base else r, "iri", None, None))
            elif (r := c.get(rdf("nodeID"))) is not None:
                out.append((s, p, f"_:{r}", "bnode", None, None))
            elif c.get(rdf("parseType")) == "Collection":
                items = [described(x) for x in c]
                heads = [fresh() for _ in items] + [RDF + "nil"]
                out.append((s, p, heads[0], "bnode" if items else "iri", None, None))
                for h, item, rest in zip(heads, items, heads[1:], strict=False):
                    out.append((h, RDF + "first", *item, None, None))
                    out.append((h, RDF + "rest", rest, "iri" if rest == RDF + "nil" else "bnode", None, None))
            elif len(c):
                for x in c:
                    out.append((s, p, *described(x), None, None))
            else:
                out.append((s, p, c.text or "", "literal", c.get(rdf("datatype")), c.get(lang_key)))
        return s, kind

    for e in root if root.tag == rdf("RDF") else [root]:
        described(e)
    return out


def repair_paths(text: str) -> str:
    """IRIs that are paths of a Windows machine, as file IRIs."""
    return re.sub(r"<([A-Za-z]:\\[^<>]*)>", lambda m: "<file:///" + m[1].replace("\\", "/").replace(" ", "%20") + ">", text)


def looks_like_xml(text: str) -> bool:
    return bool(re.match(r"\s*(?:<\?xml|<rdf:RDF)", text))


def parse_any(text: str) -> list[tuple]:
    """By the head of the text XML or Turtle; the other one where that fails."""
    order = [parse_xml, parse_turtle] if looks_like_xml(text) else [parse_turtle, parse_xml]
    first = None
    for f in order:
        try:
            return f(text if f is parse_xml else repair_paths(text))
        except Exception as e:  # a bad file is a row with an error, not a failed job
            first = first or e
    raise TurtleError(str(first))


def parse(df: DataFrame, graph_id: str = "graph_id", text: str = "text") -> DataFrame:
    """Triple rows (SCHEMA) of RDF texts; a text that can't be parsed gives one row with its error.
    A null text is empty."""

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64()] + [pa.string()] * (len(names) - 1)
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)
        for b in batches:
            rows = []
            for g, t in zip(b["g"].to_pylist(), b["t"], strict=True):
                try:
                    rows += [(g, *r, None) for r in parse_any(t.as_py())]
                except TurtleError as e:
                    rows.append((g, None, None, None, None, None, None, str(e)))
                if len(rows) > 20_000:
                    for i in range(0, len(rows), 20_000):
                        yield table(rows[i : i + 20_000])
                    rows = []
            if rows:
                yield table(rows)

    return df.select(F.col(graph_id).cast("long").alias("g"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(go, SCHEMA)


def _quoted(c: Column) -> Column:
    for raw, esc in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return F.concat(F.lit('"'), c, F.lit('"'))


def to_lines(t: DataFrame, once: bool = False) -> DataFrame:
    """(graph_id, line): a statement a line, which every Turtle reader takes. once: t is a set, so nothing is
    grouped."""
    iri = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    literal = _quoted(F.col("o"))
    if "o_lang" in t.columns:
        tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise("")
        literal = F.concat(literal, tail)
    o = F.when(F.col("o_kind") == "literal", literal).otherwise(iri("o"))
    out = t.select("graph_id", F.concat(iri("s"), F.lit(" "), iri("p"), F.lit(" "), o, F.lit(" .")).alias("line"))
    return out if once else out.distinct()


def to_text(t: DataFrame) -> DataFrame:
    """(graph_id, text): each graph, which is one record's, as sorted lines."""
    return to_lines(t).groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))


def pieces(lines: DataFrame, size: int = 8192) -> DataFrame:
    """(graph_id, text): all lines (graph_id, line), each in one text of a graph; a text has `size` characters
    and a line at most, so a graph of any length is many texts. Each is Turtle by itself, in no order."""

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.int64()), pa.array(["\n".join(x) for _, x in found], pa.string())], ["graph_id", "text"])

        held: dict = {}
        for b in batches:
            full = []
            for g, line in zip(b["graph_id"].to_pylist(), b["line"].to_pylist(), strict=True):
                if line is None:
                    continue
                x = held.setdefault(g, [0, []])
                x[0] += len(line) + 1
                x[1].append(line)
                if x[0] >= size:
                    full.append((g, held.pop(g)[1]))
            if len(held) > 4096:
                full += [(g, x) for g, (_, x) in held.items()]
                held = {}
            if full:
                yield batch(full)
        if held:
            yield batch([(g, x) for g, (_, x) in held.items()])

    return lines.select(F.col("graph_id").cast("long"), "line").mapInArrow(go, "graph_id long, text string")


def digests(lines: DataFrame) -> DataFrame:
    """(graph_id, n_lines, md5) of the text that `to_text` makes of each graph, whose sorted lines are read as
    a stream, so that no text is held."""

    def go(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        def row(g, n, md5):
            return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([n], pa.int64()), pa.array([md5.hexdigest()], pa.string())], ["graph_id", "n_lines", "md5"])

        now, n, md5, last = None, 0, None, None
        for b in batches:
            for g, line in zip(b["graph_id"].to_pylist(), b["line"].to_pylist(), strict=True):
                if md5 is None or g != now:
                    if md5 is not None:
                        yield row(now, n, md5)
                    now, n, md5, last = g, 0, hashlib.md5(), None
                if line is not None and line != last:
                    md5.update((("\n" if n else "") + line).encode())
                    n, last = n + 1, line
        if md5 is not None:
            yield row(now, n, md5)

    dealt = lines.select(F.col("graph_id").cast("long"), "line").repartition("graph_id").sortWithinPartitions("graph_id", "line")
    return dealt.mapInArrow(go, "graph_id long, n_lines long, md5 string")


def write(t: DataFrame, path: str) -> None:
    """One folder graph_id=<id> of text files for each graph."""
    to_text(t).write.partitionBy("graph_id").mode("overwrite").text(path)


def read(spark: SparkSession, path: str, pattern: str = "*", without: str | None = None) -> DataFrame:
    """(path, text) of all files below a folder, names with `without` left out."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    df = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return df.where(~F.col("name").contains(without)) if without else df


def strip_imports(text: Column) -> Column:
    """A schema text without its owl:imports, of either syntax."""
    xml = F.regexp_replace(text, r"<owl:imports\b[^>]*(?:/>|>[^<]*</owl:imports>)", "")
    return F.regexp_replace(xml, r"(?m)^\s*owl:imports\s+<[^>]*>\s*;\s*$", "")
