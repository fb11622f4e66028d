"""Bit-sliced comparison of fingerprints.

In a bucket the fingerprints' bits stand vertically: one 64-bit word holds the same
bit of 64 fingerprints, so one pass over the bit planes updates 64 distances at once
with carry-save counters, and words whose distances all exceed the radius are
abandoned on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import blocks

#: Fingerprints of a bucket that are compared as one block; larger buckets are split.
BLOCK = 4096
#: Planes between two looks for words to abandon.
LOOK = 8
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def majority(h: np.ndarray, per: np.ndarray, lanes: int) -> np.ndarray:
    """(rows, lanes) of uint64 from hashes, `per` of them a row: a bit is 1 if set in
    over half of the row's. Lane 0 has the hashes, further ones finishers of them."""
    ends = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros((len(per), lanes), np.uint64)
    full = np.flatnonzero(per)
    for lane in range(lanes):
        x = h if lane == 0 else blocks.mix(h + np.uint64(int(blocks.BASES[0]) * lane % (1 << 64)))
        set_ = np.zeros((len(full), 64), np.int64)
        row = 0
        while row < len(full):  # about 64k shingles at a time, one row at least
            to = max(row + 1, int(np.searchsorted(ends[full], ends[full[row]] + 65536)))
            to = min(to, len(full))
            lo, hi = ends[full[row]], ends[full[to - 1] + 1]
            cuts = (ends[full[row:to]] - lo).astype(np.int64)
            for part in range(lo, hi, 1 << 20):  # a single text may have many more
                sub = np.unpackbits(x[part : min(hi, part + (1 << 20))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                if to - row == 1:
                    set_[row] += sub.sum(0, dtype=np.int64)
                else:
                    set_[row:to] = np.add.reduceat(sub, cuts, axis=0, dtype=np.int32)
            row = to
        more = (2 * set_ > per[full, None]).astype(np.uint8)
        out[full, lane] = np.packbits(more, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def planes(fps: np.ndarray) -> np.ndarray:
    """(bits, words): bit planes of (n, lanes) fingerprints, 64 of them to a word."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    wide = np.zeros((bits.shape[1], -(-len(fps) // 64) * 64), np.uint8)
    wide[:, : len(fps)] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def lanes_of(words: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of word, lane) of the bits set."""
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
    at, lane = np.nonzero(bits)
    return index[at], lane


def close(diff, valid: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and lanes whose distance is at most the radius. diff(p, words) gives
    plane p's differences at some words; valid has the lanes to look at."""
    active = np.flatnonzero(valid)
    alive = valid[active]
    counter = [np.zeros(len(active), np.uint64) for _ in range((radius + LOOK).bit_length())]
    for p in range(bits):
        if not len(active):
            break
        carry = diff(p, active)
        for i, c in enumerate(counter):  # add one bit to 64 counters a word
            counter[i], carry = c ^ carry, c & carry
        if p % LOOK == LOOK - 1 or p == bits - 1:
            over, same = np.zeros(len(active), np.uint64), np.full(len(active), _ALL)
            for i in reversed(range(len(counter))):
                if radius >> i & 1:
                    same &= counter[i]
                else:
                    over |= same & counter[i]
                    same &= ~counter[i]
            alive &= ~over
            left = alive != 0
            if not left.all():
                active, alive = active[left], alive[left]
                counter = [c[left] for c in counter]
    # a counter holds radius + LOOK at least before a lane is looked at, so none wraps unseen
    return lanes_of(alive, active)


class Forest:
    """Union-find over positions; its links are what a task emits."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[np.ndarray] = []

    def labels(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            label = self.labels()
            cross = label[a] != label[b]
            a, b = a[cross], b[cross]
            # each root hooks under one smaller root at a time, so no cycle comes up
            high, one = np.unique(np.maximum(label[a], label[b]), return_index=True)
            self.up[high] = np.minimum(label[a], label[b])[one]
            self.links.append(np.stack([a[one], b[one]], axis=1))

    def found(self) -> np.ndarray:
        return np.concatenate(self.links) if self.links else np.zeros((0, 2), np.int64)


def link_near(bucket: np.ndarray, fps: np.ndarray, radius: int, small: int = 64) -> np.ndarray:
    """Links that connect all fingerprints of one bucket whose distance is at most
    the radius, for rows sorted by bucket. Runs of up to `small` rows are compared
    with shifted planes, all runs at once; longer ones query by query."""
    n, bits = len(fps), fps.shape[1] * 64
    forest = Forest(n)
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    sizes = np.diff(np.append(starts, n))
    pick = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= small), sizes))
    if len(pick):
        p, own = planes(fps[pick]), bucket[pick]
        for s in range(1, small):
            same = np.zeros(p.shape[1] * 64, np.uint8)
            same[: len(own) - s] = own[:-s] == own[s:] if s < len(own) else 0
            if not same.any():
                break
            valid = np.packbits(same, bitorder="little").view(np.uint64)
            lo, hi = np.uint64(s), np.uint64(64 - s)

            def shifted(k, at, p=p, lo=lo, hi=hi):
                after = np.where(at + 1 < p.shape[1], p[k][np.minimum(at + 1, p.shape[1] - 1)], 0)
                return p[k][at] ^ ((p[k][at] >> lo) | (after << hi))

            word, lane = close(shifted, valid, bits, radius)
            i = word * 64 + lane
            forest.join(pick[i], pick[i + s])
    for start, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        p = planes(fps[start : start + size])
        words, step = p.shape[1], max(1, (1 << 15) // p.shape[1])
        group = Forest(size)
        for q in range(0, size, step):
            rows = np.arange(q, min(size, q + step))
            now = group.labels()
            asked = np.unpackbits(fps[start + rows].view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little").T
            asked = np.where(asked, _ALL, np.uint64(0))
            # lanes of later rows that aren't connected with the query yet
            apart = np.zeros((len(rows), words * 64), np.uint8)
            apart[:, :size] = (now != now[rows, None]) & (np.arange(size) > rows[:, None])
            valid = np.packbits(apart, axis=1, bitorder="little").view(np.uint64).ravel()

            def against(k, at, p=p, asked=asked, words=words):
                return p[k][at % words] ^ asked[k][at // words]

            word, lane = close(against, valid, bits, radius)
            group.join(rows[word // words], word % words * 64 + lane)
        forest.links.append(start + group.found())
    return forest.found()


def meet(dealt: DataFrame, lanes: int, radius: int) -> DataFrame:
    """(a, b) that connect the nodes of rows (bucket long, node long, fp binary) that
    meet in a bucket and lie within the radius: a bucket's least connected node, and
    another one. So buckets with the same nodes say the same."""
    block = BLOCK

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def run(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            bucket = table.column("cell").combine_chunks().to_numpy(zero_copy_only=False)
            node = table.column("node").to_numpy()
            data, _ = blocks.raw(table.column("fp").combine_chunks())
            fps = data.view(">u8").astype(np.uint64).reshape(len(node), lanes)
            found = link_near(bucket, fps, radius)
            group = Forest(len(node))
            group.join(found[:, 0], found[:, 1])
            label = group.labels()
            least = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(least, label, node)
            root = least[label]
            own = np.flatnonzero(node != root)
            return pa.RecordBatch.from_arrays([pa.array(root[own]), pa.array(node[own])], ["a", "b"])

        for batch in batches:  # sorted by cell: whole cells are compared together
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 16:
                table = pa.Table.from_batches(held)
                cell = table.column("cell").to_numpy()
                to = int(np.searchsorted(cell, cell[-1]))
                if to:
                    yield run(table.slice(0, to))
                    held = table.slice(to).to_batches()
                    rows = table.num_rows - to
        if rows:
            yield run(pa.Table.from_batches(held))

    # A bucket of n blocks becomes n * (n + 1) / 2 cells of two blocks at most: a
    # row is in n of them. Buckets of one block, nearly all, are one cell.
    large = blocks.cut(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block).withColumn("parts", F.ceil(F.col("n") / block).cast("int")))
    found = large.count()
    met = dealt.select(F.col("bucket").alias("cell"), "node", "fp")
    if found:
        # few large buckets are broadcast; else the join is by bucket
        met = dealt.join(F.broadcast(large) if found <= 100_000 else large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cell = F.when(F.col("parts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
        met = met.select(cell.alias("cell"), "node", "fp")
    parts = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return met.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(blocks.frugal(compare), "a long, b long")
