"""Prefix trie of conversations, kept as a z-fast trie in tables.

A compacted node is an edge (low, high] of the trie: the turns from its parent to its own end. It is hashed at its handle,
the depth in (low, high] that is divisible by the highest power of two. A conversation's exit node is found by fat binary
search: look up its prefix at the handle depth of the interval that is left, go below the node found or above the depth
missed; each step is one join of all conversations with the handles. Conversations are inserted in batches. Of all that
leave the trie at one place with the same next turn, one becomes a new edge and the others, which can only meet that
edge, are located again; which one is chosen by digest, so that a group is expected to halve each time. Sums over
subtrees follow by doubling the distance to the ancestor they are passed to, then edges are expanded to nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from access_engine.llm.text import WORD, crc32_sql
from access_engine.storage import drop, store, stored

#: Parts of all conversations that are in the trie after each batch, of as many parts as after the last.
BATCHES = (1, 16)
#: Tasks that share the rows of one key in a join.
SALT = 8
#: Members whose numbers are joined to one string before a node's members meet.
PIECE = 4096

_ROOT = b""
_EDGE = (
    "name binary, parent binary, low int, high int, first binary, handle binary, path array<binary>, totals array<long>,"
    " before long"
)


def gathered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (key, words): a digest of role and text, the text's words.

    Turns are sorted by turn, null first, and by key where that ties; null roles and texts are empty; repeated rows are
    repeated turns. Rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.md5(role.cast("binary")), text).cast("binary")))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.struct(F.col("turn"), key.alias("key"), words.alias("words")).alias("said")
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"], t["words"])).alias("turns"))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of all prefixes of each conversation, the last of which names its turns, and words up to each turn."""
    for batch in batches:
        names, paths, totals = [], [], []
        for turns in batch.column("turns").to_pylist():
            now, path = b"", []
            for turn in turns:
                now = hashlib.md5(now + turn["key"]).digest()
                path.append(now)
            names.append(now)
            paths.append(path)
            totals.append(np.cumsum([t["words"] for t in turns], dtype=np.int64).tolist())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                pa.array(names, pa.binary()),
                pa.array(paths, pa.list_(pa.binary())),
                pa.array(totals, pa.list_(pa.int64())),
            ],
            ["conv_id", "name", "path", "totals"],
        )


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that is divisible by the highest power of two."""
    free = (F.length(F.bin(low.bitwiseXOR(high).cast("long"))) - 1).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", high, free), free)


def _looked_up(rows: DataFrame, key: Column, table: DataFrame, on: str, columns: dict[str, str]) -> DataFrame:
    """``rows`` with columns of the row of ``table`` whose ``on`` is ``key``, null where none is.

    ``on`` is unique in the table; any number of rows may share a key, so they are dealt to ``SALT`` tasks.
    """
    salt = F.pmod(F.xxhash64("name"), F.lit(SALT)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt")
    found = table.select(F.col(on).alias("_key"), *(F.col(c).alias(a) for c, a in columns.items()), every)
    return rows.withColumn("_key", key).withColumn("_salt", salt).join(found, ["_key", "_salt"], "left").drop("_key", "_salt")


def _deepest(rows: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """``rows`` with ``at``, the depth of the last node on their path: a fat binary search from their ``at``."""
    handles = {"name": "_name", "low": "_low", "high": "_high"}
    rows = rows.withColumn("_to", F.col("size"))
    for _ in range(steps):
        rows = rows.withColumn("_try", F.when(F.col("at") < F.col("_to"), two_fattest(F.col("at"), F.col("_to"))))
        key = F.coalesce(F.get("path", F.col("_try") - 1), "name")
        rows = _looked_up(rows, key, nodes, "handle", handles)
        open_, met = F.col("_try").isNotNull(), F.col("_name").isNotNull()
        passed = F.get("path", F.col("_high") - 1) == F.col("_name")  # the node's end lies on the path too
        at = F.when(open_ & met, F.when(passed, F.col("_high")).otherwise(F.col("_low"))).otherwise(F.col("at"))
        to = F.when(open_ & ~met, F.col("_try") - 1).when(open_ & ~F.coalesce(passed, F.lit(False)), at).otherwise(F.col("_to"))
        rows = rows.select(*(c for c in rows.columns if c[0] != "_" and c != "at"), at.alias("at"), to.alias("_to"))
    return rows.drop("_to")


def _exits(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where rows leave the trie below the node at depth ``at``: ``edge`` they are on, if any, and the new ``at``."""
    edge = {"name": "edge", "low": "edge_low", "high": "edge_high", "path": "_path"}
    found = _looked_up(rows, F.coalesce(F.get("path", F.col("at")), "name"), nodes, "first", edge)
    found = found.withColumn("edge", F.when(F.col("at") < F.col("size"), F.col("edge")))
    rest = F.slice("path", F.col("at") + 1, F.greatest(F.col("size") - F.col("at"), F.lit(0)))
    common = F.when(F.col("edge").isNotNull(), F.size(F.array_intersect("_path", rest))).otherwise(0)
    return found.withColumn("at", F.col("at") + common).drop("_path")


def _edges(rows: DataFrame, low: Column, high: Column, base: Column, parent: Column, before: Column) -> DataFrame:
    """Compacted nodes from depth ``low`` to ``high`` of paths that start after depth ``base``."""
    rows = rows.select("path", "totals", low.alias("low"), high.alias("high"), base.alias("_base"), parent.alias("_p"), before.alias("_b"))
    from_, size = F.col("low") - F.col("_base"), F.col("high") - F.col("low")

    def at(column: str, depth: Column) -> Column:
        return F.get(column, depth - F.col("_base") - 1)

    return rows.select(
        at("path", F.col("high")).alias("name"),
        F.coalesce(at("path", F.col("low")), "_p").alias("parent"),
        "low",
        "high",
        at("path", F.col("low") + 1).alias("first"),
        at("path", two_fattest(F.col("low"), F.col("high"))).alias("handle"),
        F.slice("path", from_ + 1, size).alias("path"),
        F.slice("totals", from_ + 1, size).alias("totals"),
        F.coalesce(at("totals", F.col("low")), "_b").alias("before"),
    )


def _cut(nodes: DataFrame, located: DataFrame) -> DataFrame:
    """``nodes`` parted at the places on their edges where rows leave or end."""
    inside = located.where("edge IS NOT NULL AND edge_low < at AND at < edge_high")
    cuts = inside.groupBy("edge").agg(F.array_sort(F.collect_set("at")).alias("cuts")).withColumnRenamed("edge", "name")
    parted = nodes.join(cuts, "name", "left").withColumnsRenamed({"low": "l", "high": "h"})
    lows = F.concat(F.array("l"), F.coalesce("cuts", F.array().cast("array<int>")))
    highs = F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("h"))
    parted = parted.select("*", F.inline(F.arrays_zip(lows.alias("from"), highs.alias("to"))))
    return _edges(parted, F.col("from"), F.col("to"), F.col("l"), F.col("parent"), F.col("before"))


def _batch(pending: DataFrame, nodes: DataFrame | None, steps: int) -> DataFrame:
    """The compacted nodes after all ``pending`` sequences went in; ``nodes`` None is the bare root.

    Every round is a written table. Its new edges are all that rows still pending can meet, so after the first round
    only they are searched, and what was cut by then is final.
    """
    spark = pending.sparkSession
    pending = pending.withColumn("at", F.lit(0))
    fresh = nodes if nodes is not None else spark.createDataFrame([], _EDGE)
    if nodes is not None:
        pending = _deepest(pending, nodes, steps)
    done, held = [], None
    while True:
        located, path = store(_exits(pending, fresh), "located")
        done.append(stored(_cut(fresh, located), "edges"))
        leaving = located.where("at < size").withColumn("branch", F.get("path", F.col("at")))
        chosen = leaving.groupBy("branch").agg(F.min("name").alias("chosen"))
        flagged = _looked_up(leaving, F.col("branch"), chosen, "branch", {"chosen": "_chosen"})
        columns = ("name", "path", "totals", "size", "at")
        now, now_path = store(flagged.select(*columns, (F.col("name") == F.col("_chosen")).alias("is_edge")), "pending")
        for old in filter(None, (path, held)):
            drop(spark, old)
        held = now_path
        rows = now.where("is_edge")
        fresh = _edges(rows, F.col("at"), F.col("size"), F.lit(0), F.lit(_ROOT), F.lit(0).cast("long"))
        pending = now.where("NOT is_edge").drop("is_edge")
        if pending.isEmpty():
            break
    whole = fresh
    for part in done:
        whole = whole.unionByName(part)
    return whole


def compacted(sequences: DataFrame, batches: Sequence[int] = BATCHES) -> DataFrame:
    """The compacted nodes of a trie of (name, path, totals, size), different sequences; the root is not among them."""
    steps = (sequences.agg(F.max("size")).first()[0] or 0).bit_length()
    part = F.pmod(F.xxhash64("name"), F.lit(batches[-1]))
    nodes, low = None, 0
    for high in batches:
        nodes = stored(_batch(sequences.where((part >= low) & (part < high)), nodes, steps), "trie")
        low = high
    return nodes


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """(name, parent, n_convs, n_leaves, total, own, least) summed over each node's subtree.

    After k rounds a node holds the sums of all less than 2^k below it, and passes them to the node 2^k above.
    """
    spark = nodes.sparkSession
    sums = [F.sum(c).alias(f"_{c}") for c in ("n_convs", "n_leaves", "total", "own")]
    now, path = store(nodes.withColumn("up", F.col("parent")), "sums")
    while not now.where("up IS NOT NULL").isEmpty():
        passed = now.where("up IS NOT NULL").groupBy("up").agg(*sums, F.min("least").alias("_least"))
        further = _looked_up(now, F.coalesce("up", "name"), now, "name", {"up": "_up"})
        further = further.withColumn("up", F.when(F.col("up").isNotNull(), F.col("_up"))).drop("_up")
        new = further.join(passed.withColumnRenamed("up", "name"), "name", "left")
        added = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("n_convs", "n_leaves", "total", "own")]
        new = new.select("name", "parent", "up", *added, F.least("least", "_least").alias("least"))
        now, new_path = store(new, "sums")
        drop(spark, path)
        path = new_path
    return now.drop("up")


def _member_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each name's pieces, which come one after the other."""
    name, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], ["name", "ends"])

    for batch in batches:
        for one, piece in zip(batch.column("name").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if one != name:
                if name is not None:
                    yield row()
                name, digest = one, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
    if name is not None:
        yield row()


def _ends(named: DataFrame) -> DataFrame:
    """(name, ends): the digest of the members that end there, joined in pieces of neighbouring numbers first."""
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = named.groupBy("name", F.floor(F.col("conv_id") / PIECE).alias("part")).agg(piece.alias("piece"))
    rows = pieces.repartition("name").sortWithinPartitions("name", "part").select("name", "piece")
    return rows.mapInArrow(_member_hashes, "name binary, ends string")


def prefix_trie(gathered: DataFrame, batches: Sequence[int] = BATCHES) -> DataFrame:
    """One row per node of the trie of all turn sequences (conv_id, turns), as :func:`gathered` gives them.

    Columns: conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; null at the root), n_convs
    (members), n_children, n_leaves, saved_tokens (over the subtree, (members - 1) times the words of the node's last
    text), ends_sha256 (of the conv_ids that end at the node, ascending, comma-joined). Conversations without turns are
    members of the root alone. Equal turns in equal order are one sequence, however many conversations share it. An
    empty table has no nodes. conv_id is unique. ``batches`` are cumulative parts of all sequences, the last all of them. A conversation is one value, whatever its length. Turns are told apart
    by 128-bit digests.
    """
    spark = gathered.sparkSession
    rows = gathered.mapInArrow(_prefixes, "conv_id long, name binary, path array<binary>, totals array<long>")
    rows = stored(rows.withColumn("size", F.size("path")), "conversations")
    named = rows.groupBy("name").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least"))
    different = rows.join(named.select(F.col("least").alias("conv_id")), "conv_id", "left_semi").where("size > 0")
    edges = compacted(stored(different.drop("conv_id"), "sequences"), batches)
    root = spark.sql("SELECT X'' AS name, CAST(NULL AS BINARY) AS parent, -1 AS low, 0 AS high, X'' AS first, X'' AS handle")
    root = root.select("*", F.array("name").alias("path"), F.array(F.lit(0).cast("long")).alias("totals"), F.lit(0).cast("long").alias("before"))
    nodes = edges.unionByName(root)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, "name", "left").join(named, "name", "left")
    known = stored(known.fillna(0, ["n_children", "n_convs"]), "nodes")
    last = F.element_at("totals", -1)
    sums = _subtree_sums(
        known.select(
            "name",
            "parent",
            "n_convs",
            (F.col("n_children") == 0).cast("long").alias("n_leaves"),
            (F.col("n_convs") * last).alias("total"),
            (last - F.col("before")).alias("own"),
            "least",
        )
    )
    above = _looked_up(sums, F.coalesce("parent", "name"), sums, "name", {"least": "_least"})
    above = above.withColumn("above", F.when(F.col("parent").isNotNull(), F.col("_least"))).drop("_least", "parent")
    whole = known.select("name", "low", "path", "totals", "before", "n_children").join(above, "name").join(_ends(rows.select("conv_id", "name")), "name", "left")
    # Words above the node at each place of an edge: what its members' paths and its subtree's nodes hold besides.
    place = whole.where("n_convs > 0").select("*", F.posexplode("path").alias("at", "_"))
    first, end = F.col("at") == 0, F.col("at") == F.size("path") - 1
    upper = F.when(first, F.col("before")).otherwise(F.get("totals", F.col("at") - 1))
    none = hashlib.sha256(b"").hexdigest()
    return place.select(
        F.col("least").alias("conv_id"),
        (F.col("low") + 1 + F.col("at")).cast("long").alias("depth"),
        F.when(first, F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"),
        "n_convs",
        F.when(end, F.col("n_children")).otherwise(1).alias("n_children"),
        "n_leaves",
        (F.col("total") - F.col("n_convs") * upper - F.col("own") + upper - F.col("before")).alias("saved_tokens"),
        F.when(end, F.coalesce("ends", F.lit(none))).otherwise(none).alias("ends_sha256"),
    )


def grafted(turns: DataFrame) -> DataFrame:
    """Conversations whose first turns, none to three by crc32 of conv_id, are those of the one at the twenty's start."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    heads = turns.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    rows = turns.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(20))).withColumn("h", h).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), own).alias("turns"))


# A node's name is the string of the digests of its turns, 64 characters a turn.
SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || coalesce(text, ''))) AS d
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, n, conv_id - (conv_id % 20 + 20) % 20 AS base, {crc32_sql("conv_id::varchar")} % 4 AS h
  FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id)
), heads AS (
  SELECT i.*, coalesce(least(h, b.n), 0) AS taken FROM ids i LEFT JOIN (SELECT conv_id AS base, n FROM ids) b USING (base)
), rebuilt AS (
  SELECT i.conv_id, t.d, role, text FROM heads i JOIN turns t ON t.conv_id = i.base AND t.d <= i.h
  UNION ALL
  SELECT i.conv_id, taken + t.d - h AS d, role, text FROM heads i JOIN turns t ON t.conv_id = i.conv_id AND t.d > i.h
), members AS (
  SELECT conv_id, d, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d) AS path,
    len(regexp_extract_all(text, '{WORD}')) AS words
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids
), nodes AS (
  SELECT path, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(words) AS words FROM members GROUP BY path
), children AS (
  SELECT path[:-65] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), known AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)
), above AS (
  SELECT path[:64 * unnest(range(depth + 1))] AS path, n_children = 0 AS leaf, (n_convs - 1) * words AS saved FROM known
), sums AS (
  SELECT path, count_if(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path
), ends AS (
  SELECT path, string_agg(conv_id::varchar, ',' ORDER BY conv_id) AS ends
  FROM (SELECT conv_id, arg_max(path, d) AS path FROM members GROUP BY conv_id) GROUP BY path
)
SELECT k.conv_id, k.depth::bigint AS depth, p.conv_id AS parent_conv_id, k.n_convs::bigint AS n_convs, k.n_children::bigint AS n_children,
  n_leaves::bigint AS n_leaves, saved_tokens::bigint AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM known k JOIN sums USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON k.depth > 0 AND p.path = k.path[:-65]
"""


def query(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(grafted(gathered(spark.read.parquet(f"{folder}/conversations.parquet"))))
