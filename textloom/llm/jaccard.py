"""Near-duplicates by the Jaccard similarity of word shingles, with SimHash
fingerprints to tell which texts to compare.

A text is the set of its lower-cased word n-grams (of all its words, if it has
fewer), as 64-bit hashes; equal texts are one node. In one order of all shingles,
rare ones first, two sets of a similarity of at least p / q share a shingle among
the first size - ceil(size * p / q) + 1 of each (prefix filter). These shingles are
the buckets in which fingerprints meet. How rare one is comes from SLOTS counters
over all texts, and of a shingle whose bucket is larger than a block from that
bucket's own size: it counts as frequent, and the prefixes are taken again as long as
that makes large buckets smaller. The order only decides how large buckets are.

Fingerprints are SimHashes of LANES * 64 bits over the set. The radius is such that
two sets of the similarity lie beyond it with a chance below LOSS. In each bucket
fingerprints are compared bit plane by bit plane (see bits.py), and what connects
those within the radius makes families; a link is always inside a family. Sets of
fewer than SMALL shingles, whose fingerprints tell less, are a family where they
share a bucket with another small one.

In a family the whole sets are compared, and linked if they have the similarity,
decided in integers. Of large families, blocks are compared with blocks. Sets are
told by their differences from what most of them have, so near copies cost what
differs; a task sends enough links to connect what is linked, never all pairs.
Texts without words are alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import bits, blocks, frequent
from textloom.llm.components import components

#: Counters that shingles share to be ordered by frequency.
SLOTS = 1 << 16
#: Nodes of a bucket that make its shingle frequent, and such shingles that are known.
BUCKET, HEAVY = bits.BLOCK, 1 << 18
#: Share of the nodes in large buckets that another order must take out of them.
WORTH = 0.1
#: 64-bit parts of a fingerprint.
LANES = 8
#: Chance that two sets of the similarity don't meet in a family.
LOSS = 1e-12
#: Shingles that a set needs to be told by its fingerprint.
SMALL = 24
#: Sets, and shingles in all, of a block of a family.
BLOCK, SHINGLES = 1024, 2_000_000
#: Nodes, at most, that are broadcast to pick their texts.
ASKED = 1_000_000


def radius_of(similarity: Fraction, lanes: int = LANES, loss: float = LOSS) -> int:
    """The least radius that sets of the similarity exceed with a chance below loss.
    A bit differs with the chance that majorities of two random 0-1 columns differ,
    which is greatest for the smallest sets; those have SMALL shingles."""
    p, q = similarity.as_integer_ratio()

    def half(n: int) -> list[float]:
        return [math.comb(n, k) / 2**n for k in range(n + 1)]

    def differ(common: int, x: int, y: int) -> float:
        total = 0.0
        for k, chance in enumerate(half(common)):
            one = sum(c for i, c in enumerate(half(x)) if 2 * (k + i) > common + x)
            other = sum(c for i, c in enumerate(half(y)) if 2 * (k + i) > common + y)
            total += chance * (one * (1 - other) + other * (1 - one))
        return total

    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi  # of large sets
    for common in range(-(-SMALL * p // q), 2 * SMALL):
        for rest in range(common * (q - p) // p + 1):
            chance = max(chance, max(differ(common, x, rest - x) for x in range(rest + 1)))
    n, tail = 64 * lanes, 0.0
    for k in range(n, 0, -1):
        tail += math.comb(n, k) * chance**k * (1 - chance) ** (n - k)
        if tail >= loss:
            return k
    return 0


class Once:
    """Rows of a task whose node it has not met yet, for as many as it remembers."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, part: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        if len(self.seen) > 1 << 20:
            self.seen.clear()
        for node in part.column("node").to_pylist():
            keep.append(node not in self.seen)
            self.seen.add(node)
        return part if all(keep) else part.filter(pa.array(keep))


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's n-word shingles, and offsets by text."""
    w = blocks.words(texts, lower=True)
    per = np.where(w.counts > 0, np.maximum(w.counts - n + 1, 1), 0)
    row = np.repeat(np.arange(len(per)), per)
    ends = np.concatenate([[0], np.cumsum(per)])
    at = np.repeat(w.ends[:-1] - ends[:-1], per) + np.arange(ends[-1])
    h = blocks.Rolling(blocks.word_hashes(w), 1).of(at, np.minimum(at + n, np.repeat(w.ends[1:], per))).view(np.int64)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(per) + 1))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


def rarity(texts: DataFrame, n: int) -> np.ndarray:
    """How often shingles come, by slot: SLOTS numbers at any corpus size."""
    slots = SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, once = np.zeros(slots, np.int64), Once()
        for batch in batches:
            for part in blocks.steps(once(batch)):
                seen += np.bincount(_slot(shingles(part.column("text"), n)[0]), minlength=slots)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["slot", "n"])

    counted = texts.mapInArrow(blocks.frugal(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(slots, np.int64)
    table[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    return table


def prefixes(texts: DataFrame, similarity: Fraction, n: int, slots: np.ndarray, heavy: np.ndarray, times: np.ndarray) -> DataFrame:
    """(shingle, node, size) of texts (node, text): the rarest shingles of every node,
    as many as any two nodes of the similarity must share one of. heavy are frequent
    shingles, sorted, and times how frequent they are; all others are rarer."""
    p, q = similarity.as_integer_ratio()
    often = texts.sparkSession.sparkContext.broadcast((slots, np.append(heavy, np.int64(0)), np.append(times, np.int64(0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Once()
        in_slot, known, known_times = often.value
        for batch in batches:
            for part in blocks.steps(once(batch)):
                h, ends = shingles(part.column("text"), n)
                size = np.diff(ends)
                row = np.repeat(np.arange(len(size)), size)
                at = np.searchsorted(known[:-1], h)  # behind all: the entry of none
                frequent_ = np.where(known[at] == h, known_times[at], 0)
                order = np.lexsort((h, in_slot[_slot(h)], frequent_, row))
                first = np.arange(len(h)) - np.repeat(ends[:-1], size) < np.repeat(size + (-size * p // q) + 1, size)
                none = np.flatnonzero(size == 0)  # meet at a value of their own
                rarest, row = np.concatenate([h[order][first], np.zeros(len(none), np.int64)]), np.concatenate([row[first], none])
                for lo in range(0, len(row), 1 << 16):
                    at = row[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(rarest[lo : lo + (1 << 16)]), part.column("node").take(pa.array(at)), pa.array(size[at], pa.int32())], ["shingle", "node", "size"])

    return texts.mapInArrow(blocks.frugal(run), "shingle long, node long, size int")


def fingerprints(texts: DataFrame, n: int) -> DataFrame:
    """(node, fp) of every node of texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Once()
        for batch in batches:
            for part in blocks.steps(once(batch)):
                h, ends = shingles(part.column("text"), n)
                fps = bits.majority(blocks.mix(h.view(np.uint64)), np.diff(ends), LANES)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * LANES), len(fps), [None, pa.py_buffer(fps.astype(">u8"))])
                yield pa.RecordBatch.from_arrays([part.column("node"), raw.cast(pa.binary())], ["node", "fp"])

    return blocks.stored(texts.mapInArrow(blocks.frugal(run), "node long, fp binary").dropDuplicates(["node"]))


def together(h: np.ndarray, ends: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Links that connect the sets h[ends[i]:ends[i + 1]] that have the similarity."""
    p, q = similarity.as_integer_ratio()
    size = np.diff(ends)
    n = len(size)
    row = np.repeat(np.arange(n), size)
    token, found = blocks.grouped(h)
    often = np.bincount(token, minlength=found)
    if n * found <= 1 << 22:
        has = np.zeros((n, found), np.float32)
        has[row, token] = 1
        common = (has @ has.T).astype(np.int64)
    else:
        # |A & B| by what A and B lack of the tokens that most sets have, and share of others
        most = np.flatnonzero(2 * often > n)
        place = np.full(found, -1)
        place[most] = np.arange(len(most))
        lacks = np.ones((n, len(most)), bool)
        usual = place[token] >= 0
        lacks[row[usual], place[token[usual]]] = False
        without = lacks.sum(1)
        common = len(most) - without[:, None] - without[None, :]
        shared = np.flatnonzero(~usual & (often[token] > 1))
        shared = shared[np.argsort(token[shared], kind="stable")]
        by, of = np.nonzero(lacks.T)
        for key, members in ((token[shared], row[shared]), (by, of)):
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            many = np.diff(np.append(starts, len(key)))
            for k in np.unique(many):
                lists = members[starts[many == k][:, None] + np.arange(k)]
                if k > 32:
                    for x in lists:
                        common[np.ix_(x, x)] += 1
                    continue
                for lo in range(0, len(lists), max(1, (1 << 20) // int(k * k))):
                    x = lists[lo : lo + max(1, (1 << 20) // int(k * k))]
                    common += np.bincount((x[:, :, None] * n + x[:, None, :]).ravel(), minlength=n * n).reshape(n, n)
    # one row of pairs at a time, and only those that aren't connected yet
    forest = bits.Forest(n)
    for i in range(n - 1):
        j = np.flatnonzero(q * common[i, i + 1 :] >= p * (size[i] + size[i + 1 :] - common[i, i + 1 :])) + i + 1
        if len(j):
            forest.join(np.full(len(j), i), j)
    return forest.found()


def linked(cells: DataFrame, similarity: Fraction, n: int) -> DataFrame:
    """(a, b): links between the nodes of each cell of rows (cell, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def compare(table: pa.Table) -> pa.RecordBatch:
            cell, node = table.column("cell").to_numpy(), table.column("node").to_numpy()
            parts = [shingles(part.column("text"), n) for batch in table.to_batches() for part in blocks.steps(batch)]
            h = np.concatenate([x for x, _ in parts])
            ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(e) for _, e in parts]))])
            at = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
            found = [together(h[ends[x] : ends[y]], ends[x : y + 1] - ends[x], similarity) + x for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            found = np.concatenate(found)
            return pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], ["a", "b"])

        for batch in batches:  # sorted by cell: whole cells are compared together
            held.append(batch)
            size += batch.nbytes
            if size >= 1 << 23:
                table = pa.Table.from_batches(held)
                cell = table.column("cell").to_numpy()
                to = int(np.searchsorted(cell, cell[-1]))
                if to:
                    yield compare(table.slice(0, to))
                    held = [table.slice(to).combine_chunks().to_batches()[0]]
                    size = held[0].nbytes
        if held and sum(b.num_rows for b in held):
            yield compare(pa.Table.from_batches(held))

    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(blocks.frugal(run), "a long, b long")


def meeting(texts: DataFrame, similarity: Fraction, n: int) -> DataFrame:
    """(shingle, node, size): buckets of two nodes or more such that any two nodes of
    the similarity share one."""
    slots, group = rarity(texts, n), Window.partitionBy("shingle")
    heavy, times, before = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    while True:
        met = prefixes(texts, similarity, n, slots, heavy, times).withColumns({"lo": F.min("node").over(group), "hi": F.max("node").over(group)})
        met = blocks.stored(met.where("lo < hi").select("shingle", "node", F.col("size").cast("long").alias("size")).distinct())
        large = blocks.cut(met.groupBy(F.col("shingle").alias("token")).agg(F.count("*").alias("n")).where(F.col("n") > BUCKET))
        nodes = large.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not nodes or before is not None and nodes > (1 - WORTH) * before:
            return met
        before = nodes
        found = frequent.head(large, HEAVY)
        both = np.concatenate([heavy, found.column("token").to_numpy()])
        counts = np.concatenate([times, found.column("n").to_numpy()])
        heavy, at = np.unique(both, return_inverse=True)
        times = np.zeros(len(heavy), np.int64)
        np.maximum.at(times, at, counts)


def links(texts: DataFrame, similarity: Fraction, n: int) -> DataFrame:
    """(a, b): links between nodes of texts (node, text) that have the similarity
    or more; enough of them to connect whatever is linked."""
    p, q = similarity.as_integer_ratio()
    zero = F.lit(bytearray(8 * LANES))
    met = meeting(texts, similarity, n)
    fps = fingerprints(texts, n)
    large = met.where(F.col("size") >= SMALL).join(fps, "node").select(F.col("shingle").alias("bucket"), "node", "fp")
    # where one of two linked sets is small, the other isn't much larger
    small = met.where(F.col("size") * p < SMALL * q).select(F.xxhash64("shingle").alias("bucket"), "node", zero.alias("fp"))
    near = blocks.cut(bits.meet(blocks.stored(large.unionByName(small)), LANES, radius_of(similarity)).distinct())
    sizes = met.groupBy("node").agg(F.first("size").alias("size"))
    roots = components(near)  # without the roots themselves
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    family = blocks.cut(roots.join(sizes, "node").select("node", "root", "size"))
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / SHINGLES)).cast("int")
    split = blocks.cut(family.groupBy("root").agg(parts.alias("parts")).where("parts > 1"))
    found = split.count()
    family = family.drop("size")
    cells = family.withColumn("cell", F.col("root"))
    if found:
        # a family of k blocks becomes k * (k + 1) / 2 cells of two blocks at most
        k = F.coalesce("parts", F.lit(1))
        dealt = family.join(F.broadcast(split) if found <= ASKED // 10 else split, "root", "left").withColumn("parts", k)
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cells = dealt.withColumn("cell", F.when(F.col("parts") == 1, F.col("root")).otherwise(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))))
    cells = blocks.cut(cells.select("cell", "node"))
    asked = family.select("node")
    asked = F.broadcast(asked) if asked.count() <= ASKED else asked
    whole = blocks.stored(texts.join(asked, "node", "left_semi").dropDuplicates(["node"]))
    return blocks.cut(linked(cells.join(whole, "node").select("cell", "node", "text"), similarity, n))
