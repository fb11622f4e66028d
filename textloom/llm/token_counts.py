"""Token counts without ids: pieces are counted once per distinct pre-token of the
corpus and joined to each text's pre-token frequencies.

The distinct pre-tokens come from one grouped sum over all texts; their piece
counts are a table in the shared folder, next to how frequent each one is. The
most frequent ones, a bounded number, are looked up where the texts are, the
others are joined by pre-token (see frequent.py).

Defined cases: a null text counts as empty (no bytes, no tokens); repeated rows
are counted one by one; an empty table gives an empty result; a very long text is
one step of its own, a very long pre-token is told by its digest; an input column
with the name of an added one is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import blocks, frequent, vocab


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    codes, distinct, ends = vocab.pre_tokens(texts)
    return codes, frequent.short(distinct)[0], ends


def piece_table(docs: DataFrame, text: str, path: str) -> DataFrame:
    """(token, n, pieces) of every distinct pre-token of the texts."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.steps(batch, text, 2 * blocks.STEP_BYTES):
                codes, values, _ = vocab.pre_tokens(part.column(text))
                tokens, long = frequent.short(values)
                whole = pa.nulls(len(values), pa.binary()) if not long.any() else pa.array([v if x else None for v, x in zip(values.to_pylist(), long.tolist())], pa.binary())
                n = np.bincount(codes, minlength=len(values))
                for lo in range(0, len(n), 1 << 16):
                    yield pa.RecordBatch.from_arrays([tokens.slice(lo, 1 << 16).cast(pa.binary()), whole.slice(lo, 1 << 16), pa.array(n[lo : lo + (1 << 16)])], ["token", "whole", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [w if w is not None else t for t, w in zip(batch.column("token").to_pylist(), batch.column("whole").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("n"), pa.array(vocab.pieces_of(texts, path))], ["token", "n", "pieces"])

    found = docs.select(text).mapInArrow(blocks.frugal(distinct), "token binary, whole binary, n long")
    # few tokens are long; a shorter one is its own whole
    found = found.groupBy("token").agg(F.sum("n").alias("n"), F.max("whole").alias("whole"))
    return blocks.stored(found.select("token", "whole", "n").mapInArrow(blocks.frugal(count), "token binary, n long, pieces long"))


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None, limit: int = 2048) -> DataFrame:
    """All columns but the text, with n_bytes (UTF-8), n_tokens and over_limit."""
    path = path or vocab.vocabulary_path()
    blocks.small_batches(docs.sparkSession)
    rest = blocks.others(docs, text, ("n_bytes", "n_tokens", "over_limit"))
    docs, carried = blocks.renamed(docs, rest, text)

    def sizes(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(np.diff(blocks.raw(texts)[1]))]

    out = frequent.summed(docs, "text__", _tokens, piece_table(docs, "text__", path), {"pieces": "long"}, carried, sizes, "n_bytes long")
    return out.select(*blocks.restored(rest, carried), "n_bytes", F.col("pieces").alias("n_tokens"), (F.col("pieces") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
