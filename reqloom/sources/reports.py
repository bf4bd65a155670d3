"""Markdown reports from aggregated tables; only tables of a few rows come here."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: More rows than a report shows; a larger table is an error, not a cut.
MOST = 1000


def rows_of(df: DataFrame) -> list[dict]:
    got = df.limit(MOST + 1).collect()
    if len(got) > MOST:
        raise ValueError("too many rows for a report")
    return [r.asDict(recursive=True) for r in got]


def shown(x) -> str:
    return "n/a" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")


def table(df: DataFrame, order: list[str] | None = None) -> str:
    rows = rows_of(df.orderBy(*order) if order else df)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(shown(r[c]) for c in df.columns) + " |" for r in rows])


def markdown(title: str, sections: dict[str, DataFrame]) -> str:
    return "\n\n".join([f"# {title}"] + [f"## {name}\n\n{table(df)}" for name, df in sections.items()]) + "\n"


def pretty_json(df: DataFrame) -> str:
    """A report of one row as an indented object, of more as an array."""
    rows = rows_of(df)
    return json.dumps(rows[0] if len(rows) == 1 else rows, indent=2, ensure_ascii=False, default=str)


def save(spark: SparkSession, text: str, path: str) -> None:
    """A report as one file, in any store that the engine writes; parent folders are made."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
