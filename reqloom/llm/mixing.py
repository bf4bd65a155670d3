"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Slot n of the mix stands at frac(n * golden ratio); the cumulative target shares map that point to a
source, and the k-th slot of a source takes the k-th block of its words. A source's words stand in a
stream of its shuffled documents that starts again once it has ended. Each source takes slots until its
target is reached, the last block being cut there; what the schedule leaves open at its end is added.

Which words a source gives follows from its target; where in the mix they stand follows from the
schedule: each document has the slots of its blocks, and a mix is written in slot order.

No step orders a whole source in one task: documents are dealt to buckets by the hash that shuffles
them, slots to stretches, and sums over these give every bucket and stretch its first position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare

WEIGHTS = (3, 1, 2)
#: Share of all words to mix, times a source's words that it may give, words in a block.
BUDGET, REPEATS, BLOCK = (3, 2), 2, 512
SEED = 17
#: Documents in a bucket (about, of the largest source), slots in a stretch and in a cell of the unit interval.
BUCKET_ROWS, STRETCH, CELL_SLOTS = 65536, 4096, 65536
GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size), one row a source -> with weight, target (double).

    Sources in code point order, null last, take the weights in turn. They share budget of all words by
    weight; a target stops at `repeats` times its source's words, and the excess goes to the others by
    weight until none is above: sorted by cap over weight, the first k sources are capped for the least
    k at which the level of the rest fits. One row a source is ordered in one task here, no more.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    held = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * repeats)
    held = held.withColumn("total", F.sum("source_size").over(everything) * budget[0] / F.lit(budget[1]).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    upto = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumn("capped", F.sum("cap").over(upto) - F.col("cap")).withColumn("rest", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))
    # the level if all before this source are capped and neither it nor any later one is
    level = (F.col("total") - F.col("capped")) / F.col("rest")
    held = held.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    held = held.withColumn("level", F.first("level", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return held.select("source", "source_size", "weight", target.alias("target"))


def shuffled_key(key: str, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce("source", F.lit(""))))


def bucket_digits(rows: int) -> int:
    """Hex digits of the shuffle hash that name a bucket. The order does not depend on them."""
    digits = 2
    while rows > BUCKET_ROWS << (4 * digits):
        digits += 1
    return digits


def positions(docs: DataFrame, key: str = "doc_id", seed: int = SEED, digits: int = 2) -> DataFrame:
    """docs (key, source, size) -> with `at`: the words of its source before it, in shuffled order."""
    held = docs.withColumn("h", shuffled_key(key, seed)).withColumn("bucket", F.substring("h", 1, digits))
    per = held.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", key, "size").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("in_bucket", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return held.join(per, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2"))).withColumn("at", F.col("base") + F.col("in_bucket")).drop("h", "bucket", "s2", "b2", "base", "in_bucket")


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """goals (source, source_size, target) -> (slot, source, k, first, words): the slots of the mix.

    Slot by slot the source takes its k-th block, words [first, first + words) of its endless stream.
    Slot n belongs to the source in whose range of all wanted words the point frac(n * golden ratio)
    falls; the ranges are whole numbers, so that each engine finds the same source. Points meet the
    ranges in cells of the unit interval, in each of which a range stands once.
    """
    spark = goals.sparkSession
    want = F.floor("target").cast("long")
    goals = goals.select("source", want.alias("want"), F.ceil(want / block).cast("long").alias("quota")).where("want > 0")
    total = goals.agg(F.sum("want")).first()[0] or 0
    n = total // block + 1 if total else 0
    cells = max(1, n // CELL_SLOTS)
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranges = goals.withColumn("hi", F.sum("want").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("lo", F.col("hi") - F.col("want"))
    cell = lambda x: F.floor(x / F.lit(total / cells if total else 1.0)).cast("long")
    # the range's first point in each of its cells
    ranges = ranges.select("source", "lo", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"))
    u = F.col("slot") * GOLDEN
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("x", F.floor((u - F.floor(u)) * F.lit(float(total))).cast("long")).withColumn("cell", cell(F.col("x")))
    marks = ranges.select("cell", F.col("lo").alias("x"), F.lit(0).alias("kind"), F.struct("source").alias("of"), F.lit(None).cast("long").alias("slot"))
    points = slots.select("cell", "x", F.lit(1).alias("kind"), F.lit(None).cast("struct<source:string>").alias("of"), "slot")
    along = Window.partitionBy("cell").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = marks.unionByName(points).withColumn("of", F.last("of", ignorenulls=True).over(along)).where("kind = 1")
    taken = met.select("slot", F.col("of.source").alias("source"), F.floor(F.col("slot") / STRETCH).alias("stretch"))
    per = taken.groupBy("source", "stretch").count()
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("source").alias("s2"), F.col("stretch").alias("t2"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "stretch").orderBy("slot")
    ranked = taken.withColumn("r", F.row_number().over(inside) - 1)
    ranked = ranked.join(per, F.col("source").eqNullSafe(F.col("s2")) & (F.col("stretch") == F.col("t2"))).select("slot", "source", (F.col("base") + F.col("r")).alias("k"))
    got = taken.groupBy("source").agg(F.count("*").alias("got")).withColumnRenamed("source", "s3")
    quota = goals.select(F.col("source").alias("s4"), "quota", "want")
    main = ranked.join(quota, F.col("source").eqNullSafe(F.col("s4"))).where("k < quota").select("slot", "source", "k", "want")
    late = (
        quota.join(got, F.col("s4").eqNullSafe(F.col("s3")), "left")
        .where("quota > coalesce(got, 0)")
        .select(F.col("s4").alias("source"), F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("quota") - 1)).alias("k"), "want")
        .select((F.lit(n) + F.col("k")).alias("slot"), "source", "k", "want")
    )
    first = F.col("k") * block
    return main.unionByName(late).select("slot", "source", "k", first.alias("first"), F.least(F.lit(block).cast("long"), F.col("want") - first).alias("words"))


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, taken): rows (key as k0, source, size, at, source_size, target), one for each row of docs;
    taken (k0, source, at, size, pass, words, first_slot, n_slots), one for each time that the mix takes
    words of a row, whole or its first ones."""
    prepare(docs.sparkSession)
    held = docs.select(F.col(key).alias("k0"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    held = materialize(held, "sizes")
    per = held.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goals = materialize(targets(per.select("source", "source_size")), "targets")
    rows = per.agg(F.max("rows")).first()[0] or 0
    placed = materialize(positions(held, "k0", digits=bucket_digits(rows)), "placed")
    met = pieces(placed, goals, block)
    taken = met.groupBy("k0", "source", "at", "size", "pass").agg(F.sum("words").alias("words"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    g = goals.select(F.col("source").alias("s5"), "source_size", "target")
    return placed.join(g, F.col("source").eqNullSafe(F.col("s5"))).drop("s5"), taken


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """(key, source, size, source_size, target, taken, first_slot, n_slots) for each row of docs, all of
    `taken` and the slots from the schedule's pieces.

    taken: words that the mix takes of the row, repeats counted, at most twice its size; first_slot: the
    first slot of the mix that has some of them (null: none has); n_slots: the pieces in which they come.
    A null text has size 0, a null source is a source of its own and comes last. Rows of equal keys count
    each for itself; rows of size 0 take nothing. An empty table gives an empty result.
    """
    out, taken = occurrences(docs, key, text, source, block)
    t = taken.groupBy("k0", "source", "at", "size").agg(F.sum("words").alias("taken"), F.min("first_slot").alias("first_slot"), F.sum("n_slots").alias("n_slots"))
    t = t.select(F.col("k0").alias("tk"), F.col("source").alias("ts"), F.col("at").alias("ta"), F.col("size").alias("tz"), "taken", "first_slot", "n_slots")
    out = out.join(t, F.col("k0").eqNullSafe(F.col("tk")) & F.col("source").eqNullSafe(F.col("ts")) & (F.col("at") == F.col("ta")) & (F.col("size") == F.col("tz")) & (F.col("size") > 0), "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("k0").alias(key), "source", "size", "source_size", "target", none("taken"), "first_slot", none("n_slots"))


def pieces(placed: DataFrame, goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself: (slot, k0, source, at, size, pass, first, words), `first` counted in the document.

    A document's stretch of its source's stream is cut at block ends, in each pass over the source, and
    the pieces meet their slots by source and block. What no slot takes is not in the mix.
    """
    g = goals.select(F.col("source").alias("g_source"), "source_size", "target")
    held = placed.where("size > 0").join(g, F.col("source").eqNullSafe(F.col("g_source"))).withColumn("want", F.floor("target").cast("long"))
    held = held.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))).withColumn("from", F.col("at") + F.col("pass") * F.col("source_size")).where("from < want")
    held = held.withColumn("until", F.least(F.col("from") + F.col("size"), F.col("want")))
    cut = held.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("until") - 1) / block))))
    slots = schedule(goals, block).select(F.col("source").alias("s6"), "slot", F.col("k").alias("b6"), F.col("first").alias("f6"), F.col("words").alias("w6"))
    met = cut.join(slots, F.col("source").eqNullSafe(F.col("s6")) & (F.col("block") == F.col("b6")))
    lo, hi = F.greatest("from", "f6"), F.least(F.col("until"), F.col("f6") + F.col("w6"))
    return met.select("slot", "k0", "source", "at", "size", "pass", (lo - F.col("from")).alias("first"), (hi - lo).alias("words"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def sql(docs: str = "SELECT doc_id, text, source FROM documents") -> str:
    order = "source IS NULL, encode(coalesce(source, ''))"
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return f"""
    WITH held AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM ({docs})),
    src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM held GROUP BY source),
    weighed AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY {order}) - 1) % {len(WEIGHTS)} {weights} END AS BIGINT) AS weight, source_size * {REPEATS} AS cap,
        CAST(CAST(sum(source_size) OVER () AS BIGINT) * {BUDGET[0]} AS DOUBLE) / CAST({BUDGET[1]} AS DOUBLE) AS total FROM src),
    upto AS (SELECT *, CAST(sum(cap) OVER w AS BIGINT) - cap AS capped, CAST(sum(weight) OVER () - sum(weight) OVER w AS BIGINT) + weight AS rest
        FROM weighed WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    levels AS (SELECT *, (total - CAST(capped AS DOUBLE)) / CAST(rest AS DOUBLE) AS l FROM upto),
    one AS (SELECT l FROM levels WHERE l * CAST(weight AS DOUBLE) <= CAST(cap AS DOUBLE) ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {order} LIMIT 1),
    goals AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT l FROM one) * CAST(weight AS DOUBLE), CAST(cap AS DOUBLE))) AS target FROM levels),
    placed AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(source, '')), doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_word FROM held),
    wanted AS (SELECT source, CAST(floor(target) AS BIGINT) AS want FROM goals WHERE floor(target) > 0),
    ranges AS (SELECT *, CAST(sum(want) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hi, CAST(sum(want) OVER () AS BIGINT) AS total FROM wanted),
    points AS (SELECT slot, CAST(floor((slot * {GOLDEN!r}::DOUBLE - floor(slot * {GOLDEN!r}::DOUBLE)) * CAST(total AS DOUBLE)) AS BIGINT) AS x
        FROM (SELECT CAST(unnest(range(total // {BLOCK} + 1)) AS DOUBLE) AS slot, total FROM (SELECT max(total) AS total FROM ranges))),
    taking AS (SELECT CAST(slot AS BIGINT) AS slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM points JOIN ranges ON x >= hi - want AND x < hi),
    open_slots AS (SELECT count(*) AS n FROM points),
    got AS (SELECT source, count(*) AS got FROM taking GROUP BY source),
    cut AS (SELECT doc_id, p.source, size, source_size, target, at_word, greatest(0, least(size, want - at_word)) AS w0, greatest(0, least(size, want - at_word - source_size)) AS w1
        FROM placed p JOIN (SELECT *, CAST(floor(target) AS BIGINT) AS want FROM goals) g ON p.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, size, source_size, target, CAST(w0 + w1 AS BIGINT) AS taken,
        CASE WHEN w0 > 0 THEN coalesce(t.slot, CAST((SELECT n FROM open_slots) + at_word // {BLOCK} AS BIGINT)) END AS first_slot,
        CAST(CASE WHEN w0 > 0 THEN (at_word + w0 - 1) // {BLOCK} - at_word // {BLOCK} + 1 ELSE 0 END
           + CASE WHEN w1 > 0 THEN (at_word + source_size + w1 - 1) // {BLOCK} - (at_word + source_size) // {BLOCK} + 1 ELSE 0 END AS BIGINT) AS n_slots
    FROM cut LEFT JOIN taking t ON t.source IS NOT DISTINCT FROM cut.source AND t.k = at_word // {BLOCK}"""
