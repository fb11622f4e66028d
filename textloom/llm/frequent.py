"""Sums over a text's tokens of a value that each distinct token has.

The values are a table by token that may be as large as the corpus's vocabulary.
Its most frequent rows, a bounded number, are broadcast and looked up where the
text is; the others are joined: a row for each distinct rare token of a text is
dealt by token, so that no key of the join is hot, and summed by text.

Tokens are bytes. A token of more than LONG bytes stands for itself by a digest,
behind a byte that UTF-8 never has, so that a long token can be frequent too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import blocks

#: Tokens that are looked up without a join, and the bytes that one can have.
HEAD, LONG = 1 << 18, 48


def short(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens with long ones replaced by their digests, and which are long."""
    _, ends = blocks.raw(values)
    long = np.diff(ends) > LONG
    if long.any():
        values = values.to_pylist()
        for i in np.flatnonzero(long).tolist():
            values[i] = b"\xff" + hashlib.blake2b(values[i], digest_size=24).digest()
        values = pa.array(values, pa.large_binary())
    return values, long


def head(table: DataFrame, most: int) -> pa.Table:
    """The rows of a table (token, n, ...) with the greatest n, at most `most`: the
    threshold comes from a histogram over a table's rows, with 8 bars a doubling."""
    bar = F.floor(F.log2(F.greatest("n", F.lit(1))) * 8).cast("int")
    bars = table.groupBy(bar.alias("bar")).agg(F.count("*").alias("rows")).collect()  # 64 * 8 rows at most
    total, least = 0, None
    for r in sorted(bars, key=lambda r: -r["bar"]):
        total += r["rows"]
        if total > most:
            break
        least = r["bar"]
    if least is None:
        return table.limit(0).toArrow()
    return table.where(bar >= least).toArrow()


def summed(docs: DataFrame, text: str, tokens: Callable, table: DataFrame, values: dict[str, str], carried: list, per_text: Callable | None = None, extra: str = "", also: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """A row for each text: the carried fields, what per_text tells (with the fields
    of extra), and the sums of the table's value columns (name: SQL type) over the
    text's tokens. tokens(texts) gives the code of each token, the distinct tokens
    and the offsets by text; the table has every token. also(stored rows, sums) joins
    more to the sums by row__."""
    names = list(values)
    top = head(table, HEAD)
    head_tokens = top.column("token").combine_chunks().cast(pa.large_binary())
    columns = [np.append(top.column(c).to_numpy(), 0) for c in names]
    shared = docs.sparkSession.sparkContext.broadcast((head_tokens, columns))
    kinds = ", ".join(f"{c} {t}" for c, t in values.items())
    more = f"{extra}, " if extra else ""
    schema = T.StructType(carried + T.StructType.fromDDL(f"{more}{kinds}, row__ long, rare__ array<struct<token:binary,times:long>>").fields)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        known, columns_ = shared.value
        for batch in batches:
            for part in blocks.steps(batch, text):
                codes, distinct, ends = tokens(part.column(text))
                slot = pc.index_in(distinct, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                found = slot[codes]
                sums = []
                for c in columns_:
                    run = np.zeros(len(found) + 1, c.dtype)
                    np.cumsum(c[found], out=run[1:])  # -1 finds the 0 at the end
                    sums.append(pa.array(run[ends[1:]] - run[ends[:-1]]))
                # rare tokens: one row for each of a text's distinct ones
                size = max(1, len(distinct))
                of = np.repeat(np.arange(part.num_rows), np.diff(ends))[found < 0]
                pairs, times = np.unique(of * size + codes[found < 0], return_counts=True)
                rare = pa.StructArray.from_arrays([distinct.take(pa.array(pairs % size)).cast(pa.binary()), pa.array(times.astype(np.int64))], ["token", "times"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs // size, np.arange(part.num_rows + 1)), pa.int32()), rare)
                told = per_text(part.column(text)) if per_text else []
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in carried] + told + sums + [pa.array(row + np.arange(part.num_rows)), lists], schema.names
                )
                row += part.num_rows

    parts = blocks.stored(docs.select(*(f"`{f.name}`" for f in carried), f"`{text}`").mapInArrow(blocks.frugal(look_up), schema))
    rare = parts.select("row__", F.explode("rare__").alias("r")).select("row__", "r.token", "r.times")
    tail = rare.join(table.select("token", *names), "token").groupBy("row__").agg(*(F.sum(F.col(c) * F.col("times")).alias(f"{c}__") for c in names))
    out = parts.drop("rare__").join(tail, "row__", "left")
    if also:
        out = also(parts, out)
    return out.withColumns({c: (F.col(c) + F.coalesce(f"{c}__", F.lit(0))).cast(t) for c, t in values.items()}).drop("row__", *(f"{c}__" for c in names))
