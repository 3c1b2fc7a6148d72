"""Sharding: shards of nearly equal bytes from ranges between sampled splitters.

Everything is DataFrame operations. Records stand in the order of a key; a sample of keys, drawn by size, gives the
boundaries of many ranges, and overfull ranges are subdivided in the same way, between splitters of their own; the exact bytes of
each say which shards it belongs to, and one that more than one shard shares is divided record by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from access_engine.llm.text import crc32_sql
from access_engine.storage import stored

SHARDS = 16
#: Ranges between splitters; a parameter of the method, results are the same laws for any number.
RANGES = 4096
#: A range of more rows is overfull, and cut into so many pieces. As before, results are the same for any numbers.
MOST_ROWS = 1 << 17
PIECES = 256
SEED = 5


def _records(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("key"),
    )


def _place() -> Column:
    """A record's place in the order of (key, doc_id), null first."""
    return F.struct(F.col("key").alias("key"), F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"))


def _draw() -> Column:
    """A random number that is small with chances that grow with the record's size."""
    random = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "key"), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(random) / F.col("size")


def _splitters(records: DataFrame, ranges: int) -> DataFrame:
    """(fine): one row, the places in order of up to ``ranges`` - 1 records drawn by size."""
    sample = records.orderBy(_draw(), "key", "doc_id").limit(ranges - 1)
    return sample.agg(F.array_sort(F.collect_list(_place())).alias("fine"))  # `ranges` at most


def _inner_splitters(ranged: DataFrame, overfull: DataFrame, pieces: int) -> DataFrame:
    """(at, fine): the same for each overfull range, ``pieces`` - 1 records of it."""
    rows = ranged.join(F.broadcast(overfull), F.col("range") == F.col("at"), "left_semi")  # a row per range at most
    order = Window.partitionBy("range").orderBy(_draw(), "key", "doc_id")
    sample = rows.withColumn("nr", F.row_number().over(order)).where(F.col("nr") < pieces)
    return sample.groupBy(F.col("range").alias("at")).agg(F.array_sort(F.collect_list(_place())).alias("fine"))


def _with_coarse(splitters: DataFrame, many: int, step: int) -> DataFrame:
    coarse = F.expr(f"transform(sequence(0, {(many - 1) // step}), i -> get(fine, i * {step}))")
    return splitters.withColumn("coarse", coarse)


def _below(rows: DataFrame, step: int, name: str) -> DataFrame:
    """Adds ``name``, the number of splitters in ``fine`` up to the record's place; 0 where there are none.

    A record is compared with every ``step``-th of them, then with the ``step`` that follow.
    """
    block = rows.withColumn("place", _place()).withColumn("block", F.expr("size(filter(coarse, s -> s <= place))"))
    inner = f"size(filter(slice(fine, (block - 1) * {step} + 1, {step}), s -> s <= place))"
    number = F.expr(f"CASE WHEN fine IS NULL OR block = 0 THEN 0 ELSE (block - 1) * {step} + {inner} END")
    return block.withColumn(name, number).drop("place", "fine", "coarse", "block")


def _in_range(records: DataFrame, ranges: int, most: int, pieces: int) -> DataFrame:
    """Adds ``range`` and ``piece``; the records of a pair stand together, and pairs in order."""
    table = _with_coarse(_splitters(records, ranges), ranges, 64).select(F.struct("fine", "coarse").alias("table")).scalar()
    ranged = _below(records.withColumn("table", table).select("*", "table.*").drop("table"), 64, "range")
    counted = stored(ranged.groupBy(F.col("range").alias("at")).count(), "ranges")
    overfull = counted.where(F.col("count") > most)
    if overfull.isEmpty():
        return ranged.withColumn("piece", F.lit(0))
    inner = _with_coarse(stored(_inner_splitters(ranged, overfull, pieces), "splitters"), pieces, 16)
    # `ranges` x `pieces` places at most
    return _below(ranged.join(F.broadcast(inner), F.col("range") == F.col("at"), "left").drop("at"), 16, "piece")


def sharded(
    docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, most: int = MOST_ROWS, pieces: int = PIECES
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    Sizes are UTF-8 bytes plus one; a null text has none and the checksum 0. Records stand in the order of a hash of
    the text, then doc_id (null first), so copies stand together; the shard is where the middle of a record lies
    among the bytes of all, so shards differ by less than the largest record. Slots count each shard's records from
    0 in that order. Repeated rows take adjoining slots. Which rows share a shard follows from their ids and texts.
    """
    records = stored(_records(docs), "records")
    ranged = _in_range(records, ranges, most, pieces)
    cut = ["range", "piece"]
    per_range = stored(ranged.groupBy(*cut).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "pieces")
    upto = Window.orderBy(*cut).rowsBetween(Window.unboundedPreceding, -1)  # over `ranges` x `pieces` rows at most
    every = Window.partitionBy()
    offsets = per_range.select(
        *cut,
        F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("total"),
    )
    within = Window.partitionBy(*cut).orderBy("key", F.col("doc_id").asc_nulls_first())
    sums = within.rowsBetween(Window.unboundedPreceding, 0)
    numbered = ranged.withColumn("upto", F.sum("size").over(sums)).withColumn("nr", F.row_number().over(within))
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    placed = numbered.join(F.broadcast(offsets), cut).select(
        "doc_id", "size", "text_crc32",
        F.least(F.floor(middle * shards / (2 * F.col("total"))), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nr") - 1).alias("place"),
    )
    placed = stored(placed, "placed")
    start = placed.groupBy("shard").agg(F.min("place").alias("start")).select(F.col("shard").alias("s"), "start")
    return placed.join(F.broadcast(start), F.col("shard") == F.col("s")).select(  # one row per shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


SQL = f"""
WITH docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
    ('0x' || md5(coalesce(text, ''))[1:15])::bigint AS key
  FROM documents
), placed AS (
  SELECT *, row_number() OVER o AS place, 2 * sum(size) OVER (o ROWS UNBOUNDED PRECEDING) - size AS middle, sum(size) OVER () AS total
  FROM docs WINDOW o AS (ORDER BY key, doc_id NULLS FIRST)
), dealt AS (
  SELECT *, least(middle * {SHARDS} // (2 * total), {SHARDS - 1})::int AS shard FROM placed
)
SELECT doc_id, size::bigint AS size, text_crc32::bigint AS text_crc32, 'bytes' AS law, shard,
  (place - min(place) OVER (PARTITION BY shard))::bigint AS slot, NULL::int AS grown_shard
FROM dealt
"""


def query(spark: SparkSession, folder: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{folder}/documents.parquet"))
