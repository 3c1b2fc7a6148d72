"""Quality classifier: additive lookup tables for single features and for pairs of features.

Cyclic boosting visits the features in turn; each visit fits a shallow tree of one feature (later of two) to the
residuals and adds a small part of it to that feature's table. Scoring a text looks up one number per feature and
pair and adds them. Features come from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from access_engine.llm.text import GAP, LOWER, span_hashes, text_blocks, word_bounds

#: Labelled rows that the classifier is fitted on at most, chosen by a hash of the document id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5

_SETS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "bang": b"!?",
    "stop": b".,;:",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "quote": b"\"'()-",
    "line": b"\n",
}
FEATURES = (
    "log_bytes log_words word_bytes longest_word short_words distinct_words repeated_words "
    "distinct_pairs mixed_words space wide "
).split() + list(_SETS)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text; all are 0 for an empty text."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out = np.zeros((rows, len(FEATURES)))
    starts, ends, first = word_bounds(data, offsets)
    count = np.diff(first).astype(float)
    some, words = np.maximum(size, 1), np.maximum(count, 1)
    owner = np.repeat(np.arange(rows), np.diff(first))
    length = ends - starts

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=flags, minlength=rows)

    def per_byte(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(total[offsets]) / some

    def distinct(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        seen = np.unique(keys ^ (of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)[1]
        return np.bincount(of[seen], minlength=rows)

    lower = LOWER[data]
    keys = span_hashes(lower, starts, ends)
    same_text = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    pairs = (keys[1:] * np.uint64(3) + keys[:-1])[same_text]
    letters = ((lower >= 97) & (lower <= 122)) | (lower >= 128)
    ended = np.concatenate([[0], np.cumsum(~letters, dtype=np.int64)])
    out[:, 0] = np.log1p(size)
    out[:, 1] = np.log1p(count)
    out[:, 2] = per_text(length) / words
    np.maximum.at(out[:, 3], owner, length)
    out[:, 4] = per_text(length <= 3) / words
    out[:, 5] = distinct(keys, owner) / words
    out[:, 6] = np.bincount(owner[1:][same_text], weights=(keys[1:] == keys[:-1])[same_text], minlength=rows) / words
    out[:, 7] = distinct(pairs, owner[1:][same_text]) / words
    out[:, 8] = per_text((ended[ends] - ended[starts]) > 1) / words
    out[:, 9] = per_byte(GAP[data])
    out[:, 10] = per_byte(data >= 128)
    for k, members in enumerate(_SETS.values(), 11):
        table = np.zeros(256, bool)
        table[list(members)] = True
        out[:, k] = per_byte(table[data])
    return out


@dataclass
class Model:
    """Bin edges per feature, a table per feature, and a table per chosen pair of features."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k])]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[np.searchsorted(self.coarse[a], x[:, a]), np.searchsorted(self.coarse[b], x[:, b])]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _cut(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Best gain of cutting a row of bins in two, and where."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - all_g**2 / (all_h + 1)
    gain[(left_h < least) | (right_h < least)] = 0
    if not len(gain):
        return 0.0, 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Leaf values over the bins of one feature."""
    if depth:
        gain, k = _split(g, h, least)
        if gain > 0:
            return np.concatenate([_tree(g[:k], h[:k], depth - 1, least), _tree(g[k:], h[k:], depth - 1, least)])
    return np.full(len(g), g.sum() / (h.sum() + 1))


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree that cuts one feature, then the other in each part."""
    best, out = 0.0, np.zeros_like(g)
    base = g.sum() ** 2 / (h.sum() + 1)
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        for k in range(1, len(gg)):
            gain, leaves = -base, []
            for part in (slice(0, k), slice(k, None)):
                row_g, row_h = gg[part].sum(0), hh[part].sum(0)
                more, at = _split(row_g, row_h, least)
                gain += row_g.sum() ** 2 / (row_h.sum() + 1) + more
                leaves.append((part, at if more > 0 else 0, row_g, row_h))
            if gain > best:
                best, grid = gain, np.zeros_like(gg)
                for part, at, row_g, row_h in leaves:
                    for side in (slice(0, at), slice(at, None)):
                        grid[part, side] = row_g[side].sum() / (row_h[side].sum() + 1)
                out = grid.T if turn else grid
    return best, out


def fit(
    x: np.ndarray,
    y: np.ndarray,
    bins: int = 48,
    pair_bins: int = 8,
    cycles: int = 80,
    pairs: int = 6,
    pair_cycles: int = 30,
    rate: float = 0.15,
    least: float = 2.0,
) -> Model:
    """Learn the tables. Without labels of both kinds the score is the constant share of label 1 (0.5 if none)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(intercept=float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [_cut(c, bins) for c in x.T]
    model.coarse = [_cut(c, pair_bins) for c in x.T]
    binned = [np.searchsorted(e, c) for e, c in zip(model.edges, x.T, strict=True)]
    rough = [np.searchsorted(e, c) for e, c in zip(model.coarse, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(cycles):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            bits = len(table)
            step = rate * _tree(
                np.bincount(binned[k], g, minlength=bits), np.bincount(binned[k], h, minlength=bits), 2, least
            )
            table += step
            total += step[binned[k]]

    def grid_of(a: int, b: int, values: np.ndarray) -> np.ndarray:
        wide, high = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        return np.bincount(rough[a] * high + rough[b], values, minlength=wide * high).reshape(wide, high)

    g, h = slopes()
    gains = [
        (_pair_tree(grid_of(a, b, g), grid_of(a, b, h), least)[0], a, b)
        for a in range(x.shape[1])
        for b in range(a + 1, x.shape[1])
    ]
    model.pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:pairs] if gain > 0]
    model.grids = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_cycles):
        for (a, b), grid in zip(model.pairs, model.grids, strict=True):
            g, h = slopes()
            step = rate * _pair_tree(grid_of(a, b, g), grid_of(a, b, h), least)[1]
            grid += step
            total += step[rough[a], rough[b]]
    return model


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learnt from; a document without an id belongs to it."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _measured(texts: DataFrame) -> DataFrame:
    """Feature rows of (label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch.column("text")):
                found = features(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(low, high - low), batch.column("order").slice(low, high - low),
                     pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))],
                    ["label", "order", "x"],
                )

    return texts.mapInArrow(run, "label int, order long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, the same ones in every run."""
    order = F.xxhash64("doc_id")
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(order, "doc_id")
        .limit(rows)
    )
    joined = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")  # `rows` at most
    sample = _measured(joined.select("label", order.alias("order"), "text")).orderBy("order", "label", "x").limit(rows)
    found = sample.select("label", "x").toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(found.num_rows, -1)
    return fit(x, found.column("label").to_numpy().astype(float))


def scored(docs: DataFrame, model: Model, back: bool = True) -> DataFrame:
    """(row, text, score): ``row`` holds the other columns of ``docs``. A null text scores as an empty one.

    Without ``back`` the texts don't return from the Python workers.
    """
    others = [c for c in docs.columns if c != "text"]
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col("text").cast("string"))
    out = given.withColumn("score", F.lit(0.0))
    schema = out.schema if back else out.drop("text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(features(data, offsets)) for _, _, data, offsets in text_blocks(batch.column("text"))]
            score = pa.array(np.concatenate(scores or [np.zeros(0)]))
            kept = batch.columns if back else [batch.column("row")]
            yield pa.RecordBatch.from_arrays([*kept, score], schema.names)

    return given.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts get the score of an all-zero feature row; rows without id are scored and count as held
    out; repeated rows are each scored; without usable labels every score is 0.5.
    """
    model = train(docs, labels, rows)
    doc_id = F.col("row.doc_id")
    return scored(docs.select("doc_id", "text"), model, back=False).select(
        doc_id.alias("doc_id"),
        held_out(doc_id).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    columns = [F.col("text" if c == "text" else f"row.`{c}`") for c in docs.columns]
    return scored(docs, train(docs, labels)).where(F.col("score") >= threshold).select(*columns)


def query(spark: SparkSession, folder: str) -> DataFrame:
    read = spark.read.parquet
    return score_documents(read(f"{folder}/documents.parquet"), read(f"{folder}/labels.parquet"))
