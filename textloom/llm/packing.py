"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition packs its pieces best-fit decreasing and closes the bins that are
nearly full. The underfull ones go on as items of their own: groups of them are
packed best-fit again, a level of the tree at a time, until one group is left or
a level merges next to nothing. Only (bin, fill) rows move between levels; the
pieces learn their last bin in one join.

Defined cases: a null text counts as empty and is one piece with the end token
only; repeated rows are packed one by one; a text longer than a sequence is cut,
others never; an empty table gives an empty result; an input column with the
name of an added one is replaced by it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import blocks, vocab

CAPACITY = 2048
#: A bin with at most this much room is nearly full.
SLACK = 8
#: Pieces that a task packs at once, and underfull bins that a group takes.
PIECES = 200_000
GROUP = 50_000


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest first, each into the fullest bin with room.
    Bins wait in stacks by their room; the least room that suffices is the lowest
    set bit of a mask, so an item takes constant time."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    out = np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        out[i] = b
        room -= size
        if not rooms[room]:
            mask |= 1 << room
        rooms[room].append(b)
    return out


def pack(docs: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, slack: int = SLACK) -> DataFrame:
    """A row per piece: all columns but the text, with piece, start, length,
    ids_crc32, sequence_id and offset."""
    path = path or vocab.vocabulary_path()
    spark = docs.sparkSession
    blocks.small_batches(spark)
    added = T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long")
    docs, back, _ = blocks.apart(docs, text, (*added.names, "sequence_id", "offset"), keep_text=False)
    text = "text__"
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType(rest + added.fields + T.StructType.fromDDL("bin__ long, open__ boolean").fields)

    def cut_up(part: pa.RecordBatch) -> pa.Table:
        ids, ends = vocab.piece_ids(part.column(text), path)
        rows, pieces, starts, lengths, sums = [], [], [], [], []
        for row in range(part.num_rows):
            own = np.append(ids[ends[row] : ends[row + 1]], np.uint32(end_id)).astype("<u4")
            for piece, start in enumerate(range(0, len(own), capacity)):
                now = own[start : start + capacity]
                rows.append(row)
                pieces.append(piece)
                starts.append(start)
                lengths.append(len(now))
                sums.append(zlib.crc32(now.tobytes()))
        taken = [part.column(f.name).take(pa.array(rows, pa.int64())) for f in rest]
        made = [pa.array(pieces, pa.int32()), *(pa.array(c, pa.int64()) for c in (starts, lengths, sums))]
        return pa.Table.from_arrays(taken + made, [f.name for f in rest] + added.names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = TaskContext.get().partitionId() << 33
        held: list[pa.Table] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal bins, held
            table = pa.concat_tables(held).combine_chunks()
            sizes = table.column("length").to_numpy()
            found = best_fit(sizes, capacity)
            fill = np.bincount(found, weights=sizes)
            table = table.append_column("bin__", pa.array(found + bins)).append_column("open__", pa.array((fill < capacity - slack)[found]))
            bins += len(fill)
            held = []
            yield from table.to_batches(blocks.BATCH_ROWS * 16)

        for batch in batches:
            for part in blocks.steps(batch, text, blocks.STEP_BYTES // 2):
                held.append(cut_up(part))
                if sum(map(len, held)) >= PIECES:
                    yield from close()
        if held:
            yield from close()

    pieces = blocks.cut(docs.select(*(f.name for f in rest), text).mapInArrow(blocks.frugal(local), schema))
    open_bins = blocks.cut(pieces.where("open__").groupBy("bin__").agg(F.sum("length").alias("fill")).withColumn("now", F.col("bin__")))
    n = open_bins.count()
    while n > 1:
        groups = math.ceil(n / GROUP)
        level = blocks.cut(_level(open_bins.groupBy("now").agg(F.first("fill").alias("fill")), groups, capacity))
        open_bins = blocks.cut(
            open_bins.select("bin__", "now").join(level, "now").select("bin__", F.col("into").alias("now"), F.col("filled").alias("fill"))
        )
        before, n = n, open_bins.where(F.col("fill") < capacity - slack).select("now").distinct().count()
        if groups == 1 or n > 0.99 * before:
            break
    final = open_bins.select("bin__", F.col("now").alias("sequence_id"))
    out = pieces.join(final, "bin__", "left").withColumn("sequence_id", F.coalesce("sequence_id", "bin__"))
    inside = Window.partitionBy("sequence_id").orderBy("piece", "start", "length", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
    return back(out, *added.names, "sequence_id", "offset")


def _level(bins: DataFrame, groups: int, capacity: int) -> DataFrame:
    """One level of the tree: (now, into, filled) of underfull bins."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        ids, sizes = table.column("now").to_numpy(), table.column("fill").to_numpy()
        found = best_fit(sizes, capacity)
        least = np.full(int(found.max()) + 1 if len(found) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, found, ids)
        filled = np.bincount(found, weights=sizes).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least[found]), pa.array(filled[found])], ["now", "into", "filled"])

    return bins.select("now", "fill").repartition(groups, "now").mapInArrow(blocks.frugal(merge), "now long, into long, filled long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
