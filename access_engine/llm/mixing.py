"""Mixing sources to target weights: whole copies first, then a Pareto order sample of whole documents.

Everything is DataFrame operations. A source whose target is e times its size gives every document floor(e) certain
copies. The words that are still wanted are sampled with unequal chances: a document's chance is in proportion to its
size, and one that would come to 1 or more is certain. Documents are ranked by their random odds over the odds of their
chance and taken in that order until the words are there. Where a source's order is cut is found on ranges of the rank,
refined twice, so that no task orders more than a sliver of a source; after that every document is decided by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from access_engine.llm.text import WORD
from access_engine.storage import stored

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
MOST = 2.0
SEED = 11
#: The rank is cut into so many ranges, the one that holds the cut again, and so on; single rows are ordered only in the
#: last of these, one of 2^24.
RANGES = 1 << 8
LEVELS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], total: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources share ``total`` of all sizes by weight; none gets more than ``most`` times its size, and what is over is
    shared anew by weight. That is a common level times the weight, cut at the limit: sources in the order of limit
    over weight are cut as long as their limit lies below the level of all that follow.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    rank = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), rank + 1).alias("w"))
    limit = most * F.col("source_size")
    every = Window.partitionBy()
    fill = Window.orderBy(limit / F.col("w"), F.col("source").isNull(), "source")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    over = most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = (total * F.sum("source_size").over(every) - over) / F.sum("w").over(after)
    at = weighed.withColumn("level", level).withColumn("cut", limit <= F.col("level") * F.col("w"))
    common = F.first(F.when(~F.col("cut"), F.col("level")), ignorenulls=True).over(
        Window.orderBy(limit / F.col("w"), F.col("source").isNull(), "source").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
    )
    target = F.when(F.col("cut"), limit).otherwise(F.least(limit, common * F.col("w"))).cast("double")
    return at.select("source", "source_size", target.alias("target"))


def _drawn(docs: DataFrame, seed: int) -> DataFrame:
    """``row`` with all columns, and the document's source, size, random number in (0, 1) and its tie-break."""
    base = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))
    return base.select(
        "row",
        F.col("row.source").alias("source"),
        words(F.col("row.text").cast("string")).alias("size"),
        ((F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)).alias("u"),
        digest.alias("tie"),
    )


def chances(histogram: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, per_word) from (source, size, n) and (s, rest): a document's chance is its size times ``per_word``, 1 at most,
    so that the expected words are ``rest``.

    Sizes are certain, the largest first, as long as their share of what is left then comes to 1. A window holds the
    different sizes of a source.
    """
    counted = histogram.join(wanted.select("s", "rest"), histogram.source.eqNullSafe(F.col("s"))).where("size > 0")
    whole = F.col("size") * F.col("n")
    square = (F.col("size").cast("decimal(19,0)") * whole).cast("decimal(38,0)")
    larger = Window.partitionBy("s").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("s").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("rest") - F.coalesce(F.sum(whole).over(larger), F.lit(0))
    counted = counted.withColumn("left", left).withColumn("squares", F.sum(square).over(upto).cast("double"))
    open_ = counted.where(~(F.col("size") * F.col("left") >= F.col("squares")))
    largest = open_.groupBy("s").agg(F.max_by(F.struct("left", "squares"), "size").alias("m"))
    return largest.select("s", (F.greatest("m.left", F.lit(0.0)) / F.col("m.squares")).alias("per_word"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds the rank ``q``, random odds over the odds of the chance, and its place ``v`` between 0 and 1."""
    chance = F.col("size") * F.col("per_word")
    odds, own = F.col("u") / (1 - F.col("u")), chance / (1 - chance)
    q = (
        F.when((F.col("rest") <= 0) | (F.col("size") == 0), float("inf"))
        .when(F.coalesce(chance >= 1, F.lit(True)), 0.0)  # without an open size all are certain
        .when(chance <= 0, float("inf"))
        .otherwise(odds / own)
    )
    rows = rows.withColumn("q", q)
    return rows.withColumn("v", F.when(F.col("q") == float("inf"), 1.0).otherwise(F.col("q") / (1 + F.col("q"))))


def _range(level: int) -> Column:
    """Number of the range of ``v``, ranges of all levels before it included."""
    finest = F.least(F.floor(F.col("v") * RANGES**LEVELS), F.lit(RANGES**LEVELS - 1))
    return F.floor(finest / RANGES ** (LEVELS - 1 - level))


def _cut(rows: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """``plan`` with the range in which a source's words reach what it wants, and the words before that range."""
    sums = rows.groupBy("s", _range(level).alias("range")).agg(F.sum("size").alias("range_size"))
    running = Window.partitionBy("s").orderBy("range")  # RANGES rows a source
    sums = sums.withColumn("upto", F.sum("range_size").over(running))
    sums = sums.join(plan.select(F.col("s").alias("t"), "rest", "before"), F.col("s").eqNullSafe(F.col("t")))
    found = sums.where((F.col("rest") > 0) & (F.col("before") + F.col("upto") >= F.col("rest")))
    start = F.col("before") + F.col("upto") - F.col("range_size")
    first = found.groupBy(F.col("s").alias("t")).agg(F.min("range").alias("cut"), F.min_by(start, "range").alias("start"))
    joined = plan.drop("cut").join(first, F.col("s").eqNullSafe(F.col("t")), "left").drop("t")
    return stored(joined.withColumn("before", F.coalesce("start", "before")).drop("start"), "plan")


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    total: float = TOTAL,
    most: float = MOST,
    seed: int = SEED,
    columns: list[str] | None = None,
) -> DataFrame:
    """(row, size, source_size, target, copies) of every document; ``row`` holds ``columns`` (all).

    The size is the number of words, 0 for a null text. Sources stand in code point order, null last, and take the
    weights in turn; a source without words has target 0. Documents get whole copies only, so a source's words miss its
    target by half a document at most. The draw depends on seed, doc_id and text alone, so reruns agree; repeated
    rows are drawn alike, and their order among themselves changes nothing. A document without words is in no sample and
    has its source's whole copies alone. The number of sources is small: their targets are one window.
    """
    drawn = _drawn(docs, seed)
    draws = stored(drawn.drop("row"), "draws")
    histogram = stored(draws.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = stored(targets(sizes, weights, total, most), "targets").select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("expected"),
    )
    wanted = wanted.withColumn("whole", F.floor("expected")).select(
        "s", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")
    )
    found = chances(histogram, wanted).withColumnRenamed("s", "t")
    plan = wanted.join(found, F.col("s").eqNullSafe(F.col("t")), "left").drop("t").withColumn("before", F.lit(0).cast("long"))
    plan = stored(plan, "plan")

    def ranked(rows: DataFrame, known: DataFrame) -> DataFrame:
        return _ranked(rows.join(known, rows.source.eqNullSafe(known.s)).drop("source"))

    plan = _cut(ranked(draws, plan.drop("before")), plan, 0)
    for level in range(1, LEVELS):
        plan = _cut(ranked(draws, plan.drop("before")).where(_range(level - 1) == F.col("cut")), plan, level)
    inside = ranked(draws, plan).where(_range(LEVELS - 1) == F.col("cut"))
    order = Window.partitionBy("s").orderBy("q", "tie").rowsBetween(Window.unboundedPreceding, 0)
    after = F.col("before") + F.sum("size").over(order)
    # The last document is taken if that brings the words nearer to the target.
    more = (after - F.col("size") < F.col("rest")) & (after - F.col("rest") <= F.col("rest") - (after - F.col("size")))
    alike = inside.withColumn("more", more).groupBy("s", "q", "tie").agg(
        F.count("*").alias("alike"), F.sum(F.col("more").cast("long")).alias("alike_taken")
    )
    last = alike.where("alike_taken > 0").groupBy(F.col("s").alias("t")).agg(
        F.max(F.struct("q", "tie", "alike", "alike_taken")).alias("last")
    )
    final = stored(plan.join(last, F.col("s").eqNullSafe(F.col("t")), "left").drop("t", "before"), "plan")

    kept = F.struct(*(F.col(f"row.`{c}`") for c in columns or docs.columns)).alias("row")
    rows = ranked(drawn, final)
    point, end = F.struct("q", "tie"), F.struct(F.col("last.q").alias("q"), F.col("last.tie").alias("tie"))
    equal = F.coalesce(point == end, F.lit(False))
    here = _range(LEVELS - 1)
    taken_too = (here < F.col("cut")) | ((here == F.col("cut")) & F.coalesce(point <= end, F.lit(False)))
    copies = F.col("whole") + F.coalesce(taken_too, F.lit(False)).cast("long")
    out = ("size", "source_size", "target")
    if final.where("last.alike_taken < last.alike").isEmpty():
        return rows.select(kept, *out, copies.alias("copies"))
    # Rows that are alike in all that decides, some of which are taken: any of them may be.
    split = equal & (F.col("last.alike_taken") < F.col("last.alike"))
    number = F.row_number().over(Window.partitionBy("s").orderBy("tie"))
    some = rows.where(split).withColumn("number", number)
    some = some.select(kept, *out, (F.col("whole") + (F.col("number") <= F.col("last.alike_taken")).cast("long")).alias("copies"))
    return rows.where(~split).select(kept, *out, copies.alias("copies")).unionByName(some)


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``."""
    return mixed(docs, columns=["doc_id"]).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def copied(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs``, all columns, as often as it is taken."""
    return mixed(docs).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


SQL = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    md5('{SEED}|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) AS tie,
    (('0x' || tie[1:13])::bigint + 0.5::double) / 4503599627370496::double AS u
  FROM documents
), sizes AS (
  SELECT source, sum(size)::bigint AS s,
    [3.0::double, 1.0::double, 2.0::double][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM docs GROUP BY source
), levels AS (
  SELECT *, {MOST}::double * s AS top,
    ({TOTAL}::double * sum(s) OVER () - {MOST}::double * coalesce(sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sizes WINDOW o AS (ORDER BY {MOST}::double * s / w, source NULLS LAST)
), wanted AS (
  SELECT source, s, CASE WHEN top <= level * w THEN top
    ELSE least(top, w * (SELECT min_by(l.level, l.top / l.w) FROM levels l WHERE l.top > l.level * l.w)) END AS target
  FROM levels
), split AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS whole, target - whole * s AS rest FROM wanted
), counted AS (
  SELECT d.source, size, count(*) AS n FROM docs d WHERE size > 0 GROUP BY ALL
), chances AS (
  SELECT c.source, size, rest - coalesce(sum(size * n) OVER (PARTITION BY c.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double AS room,
    (sum(size::hugeint * size * n) OVER (PARTITION BY c.source ORDER BY size))::double AS squares
  FROM counted c JOIN split ON c.source IS NOT DISTINCT FROM split.source
), per AS (
  SELECT source, greatest(max_by(room, size), 0) / max_by(squares, size) AS per_word FROM chances WHERE NOT size * room >= squares GROUP BY source
), odds AS (
  SELECT d.*, s, target, whole, rest, size * per_word AS chance,
    CASE WHEN rest <= 0 OR size = 0 THEN 'inf'::double WHEN coalesce(chance >= 1, true) THEN 0 WHEN chance <= 0 THEN 'inf'::double
      ELSE (u / (1 - u)) / (chance / (1 - chance)) END AS q
  FROM docs d JOIN split ON d.source IS NOT DISTINCT FROM split.source LEFT JOIN per ON d.source IS NOT DISTINCT FROM per.source
), ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, tie ROWS UNBOUNDED PRECEDING) AS upto FROM odds
)
SELECT doc_id, size::bigint AS size, s AS source_size, target, (size * (whole + CASE
    WHEN rest > 0 AND upto - size < rest AND upto - rest <= rest - (upto - size) THEN 1 ELSE 0 END))::bigint AS taken
FROM ranked
"""


def query(spark: SparkSession, folder: str) -> DataFrame:
    return taken(spark.read.parquet(f"{folder}/documents.parquet"))
