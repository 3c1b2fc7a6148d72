"""Token counts of whole texts: batches of bounded bytes go through the tokenizer, only their lengths come back."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from access_engine.llm.text import blocks, byte_view

LIMIT = 4096
#: Bytes of text per call of the tokenizer.
BATCH = 1 << 19
#: Longer texts are cut, where no token can reach over the cut.
PIECE = 1 << 16
#: The vocabulary's mark for a space.
SPACE = "▁"


@cache
def _tokenizer(model: str | None):
    """The tokenizer, and whether a cut before a space is safe: no token has a space mark after another character."""
    import sentencepiece

    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    loaded = sentencepiece.SentencePieceProcessor(model_file=model)
    tokens = (loaded.id_to_piece(k) for k in range(loaded.get_piece_size()))
    return loaded, all(SPACE not in t.lstrip(SPACE) for t in tokens)


def pieces(text: str, limit: int = PIECE) -> list[str]:
    """``text`` in parts whose tokens together are the text's.

    A cut is a space after a character that is none and before more text. The space goes, for the tokenizer puts
    one before each part. A stretch without such a space stays whole.
    """
    out, start = [], 0
    while len(text) - start > limit:
        cut = text.find(" ", start + limit)
        while cut != -1 and text[cut - 1] in (" ", SPACE):
            cut = text.find(" ", cut + 1)
        if cut == -1 or cut + 1 == len(text):
            break
        out.append(text[start:cut])
        start = cut + 1
    return [*out, text[start:]]


def token_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    Counts are those of the model's library without begin and end tokens; a null or empty text has none. Repeated
    rows are each counted. ``model`` is a file that every executor reaches, by default the installed public one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, safe = _tokenizer(model)
        for batch in batches:
            _, offsets = byte_view(batch.column("text"))
            texts, counts = batch.column("text"), np.zeros(batch.num_rows, np.int64)
            for low, high in blocks(offsets, BATCH):
                parts, owner = [], []
                for k, text in enumerate(texts.slice(low, high - low).to_pylist(), low):
                    cut = pieces(text or "") if safe else [text or ""]
                    parts += cut
                    owner += [k] * len(cut)
                for at in range(0, len(parts), 64):
                    found = loaded.encode(parts[at : at + 64], num_threads=1)
                    np.add.at(counts, owner[at : at + 64], [len(ids) for ids in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"]
            )

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{folder}/documents.parquet"))
