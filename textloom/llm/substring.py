"""Exact substring dedup by Relative Lempel-Ziv factors.

The reference is the corpus itself, cut into blocks around content-chosen anchors:
of the 28 eight-word grams in a window of 35 words, the one with the least hash.
A block is a run of windows with one anchor, so equal windows lie in blocks with
equal anchors, and the anchor indexes every reference block that a block can be
factored against.

A block that the corpus has elsewhere as a whole is one factor, told by its words'
keyed BLAKE2b digest next to the anchor's hash; such factors of neighbouring blocks
run on into each other. Where the blocks under an anchor differ, each is factored
against all others by their words: matches grow from the anchor to the left and to
the right in tries, and a match of 35 words or more is a factor. A factor may end
inside a block, so each window that begins in the block is tried: no duplicate
window across a factor's boundary is missed. Words in a factor are duplicate.

Hot grams (one in HOT_SHARE of all) are found first, counted over all texts, and
windows choose another one where they have it. What is left of hot anchors lies
in passages that many texts share as a whole, or that repeat a few words; blocks
of it that are hot themselves are known to recur, and each task sends one row for
all of its copies. Anchors that
still have more than GROUP different blocks are decided window by window, grouped
by the window's words, and not in one task.

Defined cases: null and empty texts have no words and stay as they are; a
window may recur in the same text, also overlapping itself; repeated rows are
copies of each other, so all their windows recur; an empty table gives an empty
result; rows without an id are handled like others; a very long text is one step
of its own and is held whole; an input column with the name of an added one is
replaced by it, other columns are carried whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import blocks

WINDOW = 35
GRAM = 8
#: Windows of one block, at most.
MOST = WINDOW - GRAM + 1
#: A gram's slot is hot with one in so many of all grams, and a block of a hot gram
#: with one in so many of all blocks. So there are never more hot ones than this.
HOT_SHARE = 1 << 16
#: Occurrences that are needed to be hot, in all and in a task that tells of them.
HOT_LEAST, HOT_TOLD = 64, 8
#: Slots that grams are counted in.
SLOTS = 1 << 22
#: Different blocks of one anchor that a task takes at once.
GROUP = 50_000
#: Bits of a rank that tell the place; a column of texts has fewer bytes.
_PLACE = 31
_WHOLE, _EDGE, _SHIP, _BIG = 1, 2, 4, 8  # what is known about a block


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of `width` values, by block-wise prefix and suffix minima."""
    n = len(values)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    table = full.reshape(-1, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def _in(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which values are among sorted ones; most are told apart by a small table."""
    out = np.zeros(len(values), bool)
    if len(sorted_):
        table = np.zeros(1 << 20, bool)
        table[(sorted_ >> np.uint64(44)).astype(np.int64)] = True
        some = np.flatnonzero(table[(values >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(sorted_, values[some]), len(sorted_) - 1)
        out[some] = sorted_[at] == values[some]
    return out


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


class Runs:
    """Blocks of a column of texts: for each, its row, the first and the last
    window (word positions of the whole column), its anchor's place and hash, and
    whether that is hot. hot tells by slot which grams to avoid."""

    def __init__(self, w: blocks.Words, hot: np.ndarray):
        self.words = w
        hashes = blocks.word_hashes(w)
        at = w.windows(WINDOW)
        if not len(at):
            self.first = self.last = self.row = self.place = at
            self.anchor, self.hot = at.astype(np.uint64), at.astype(bool)
            return
        gram = np.arange(len(hashes) - GRAM + 1)
        grams = blocks.Rolling(hashes, 0).of(gram, gram + GRAM)
        avoid = hot[_slot(grams)]
        # the same bits rank a gram in every batch, and of equals the first one counts
        rank = grams >> np.uint64(_PLACE + 1) << np.uint64(_PLACE) | gram.astype(np.uint64)
        rank |= avoid.astype(np.uint64) << np.uint64(63)
        least = _least(rank, MOST)[at]
        place = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
        self.first, self.last = at[new], at[np.append(new[1:] - 1, len(at) - 1)]
        self.place, self.row = place[new], w.row[at[new]]
        self.hot = avoid[self.place]
        self.anchor = grams[self.place]

    def texts(self, of: np.ndarray) -> list[bytes]:
        """The words of some blocks, joined by one blank."""
        data, starts = self.words.joined
        return [data[a:b] for a, b in zip(starts[self.first[of]].tolist(), (starts[self.last[of] + WINDOW] - 1).tolist())]

    def digests(self, of: np.ndarray) -> np.ndarray:
        blake = hashlib.blake2b
        made = b"".join([blake(t, digest_size=8).digest() for t in self.texts(of)])
        return np.frombuffer(made, np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _hot_grams(docs: DataFrame, text: str) -> np.ndarray:
    """Which of SLOTS slots of gram hashes are hot, counted over all grams. A task
    sends the slots that are frequent in it."""
    least = HOT_TOLD

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in blocks.steps(batch, text):
                hashes = blocks.word_hashes(blocks.words(part.column(text)))
                at = np.arange(max(0, len(hashes) - GRAM + 1))
                n += np.bincount(_slot(blocks.Rolling(hashes, 0).of(at, at + GRAM)), minlength=SLOTS)
        total = int(n.sum())
        some = np.flatnonzero(n >= max(least, total // (2 * HOT_SHARE)))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(n[some], total))], ["k", "n"])

    sums = docs.select(text).mapInArrow(blocks.frugal(count), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return _frequent(sums, "k < 0", np.zeros(SLOTS, bool))


def _hot_blocks(docs: DataFrame, text: str, hot) -> np.ndarray:
    """Sorted digests of the hot blocks among those with a hot anchor."""
    least = HOT_TOLD

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, keys, n = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []

        def fold() -> None:
            nonlocal keys, n, fresh
            group, found = pd.factorize(np.concatenate([keys, *fresh]))
            weights = np.concatenate([n, np.ones(len(group) - len(keys), np.int64)])
            n = np.bincount(group, weights=weights, minlength=len(found)).astype(np.int64)
            keys, fresh = found, []

        for batch in batches:
            for part in blocks.steps(batch, text):
                r = Runs(blocks.words(part.column(text)), hot.value)
                total += len(r.first)
                fresh.append(r.digests(np.flatnonzero(r.hot)))
                if sum(map(len, fresh)) > 1 << 20:
                    fold()
                    keep = n > 1 + total // (4 * HOT_SHARE)
                    keys, n = keys[keep], n[keep]
        fold()
        keep = n >= max(least, total // (2 * HOT_SHARE))
        whole = np.append(np.zeros(keep.sum(), bool), True)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[keep], 0)), pa.array(np.append(n[keep], total)), pa.array(whole)], ["k", "n", "whole"])

    sums = docs.select(text).mapInArrow(blocks.frugal(count), "k long, n long, whole boolean").groupBy("k", "whole").agg(F.sum("n").alias("n"))
    return _frequent(sums, "whole", None)


def _frequent(sums: DataFrame, whole: str, table: np.ndarray | None) -> np.ndarray:
    """Of counts (k, n) next to the row of their total: the frequent k, at most
    HOT_SHARE or so, sorted or as marks in a table."""
    sums = blocks.cut(sums)
    total = sums.where(whole).agg(F.max("n")).first()[0] or 0
    found = sums.where(f"NOT ({whole})").where(F.col("n") >= max(HOT_LEAST, total // HOT_SHARE)).select("k").toArrow()
    found = found.column("k").to_numpy()
    if table is None:
        return np.sort(found.view(np.uint64))
    table[found] = True
    return table


def _known(docs: DataFrame, text: str, key: str, hot, copies) -> DataFrame:
    """(key, at, digest, kind) of the blocks that recur or share their anchor with
    others: _WHOLE, _EDGE (once there, next to different ones), _SHIP (the one of
    its copies that goes to the reference), _BIG (of an anchor with too many)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            for part in blocks.steps(batch, text):
                r = Runs(blocks.words(part.column(text)), hot.value)
                digest = r.digests(np.arange(len(r.first)))
                many = np.zeros(len(r.first), bool)
                some = np.flatnonzero(r.hot)
                many[some] = _in(digest[some].view(np.uint64), copies.value)
                keep = ~many
                for i in np.flatnonzero(many).tolist():
                    if digest[i] not in told:
                        told.add(int(digest[i]))
                        keep[i] = True
                at = np.flatnonzero(keep)
                keys = part.column(key).to_numpy(zero_copy_only=False)[r.row[at]]
                place = r.first[at] - r.words.ends[r.row[at]]
                yield pa.RecordBatch.from_arrays(
                    [_signed(r.anchor[at]), pa.array(digest[at]), pa.array(keys), pa.array(place, pa.int32()), pa.array(many[at])],
                    ["anchor", "digest", "key", "at", "many"],
                )

    rows = docs.select(text, key).mapInArrow(blocks.frugal(found), "anchor long, digest long, key long, at int, many boolean")
    group = Window.partitionBy("anchor")
    order = group.orderBy("digest", "key", "at")
    rows = rows.withColumns({
        "first": ~F.coalesce(F.lag("digest").over(order) == F.col("digest"), F.lit(False)),
        "next": F.coalesce(F.lead("digest").over(order) == F.col("digest"), F.lit(False)),
    })
    rows = rows.withColumn("blocks", F.sum(F.col("first").cast("int")).over(group))
    again = F.col("many") | F.col("next") | ~F.col("first")
    differ = F.col("blocks") > 1
    rows = rows.where(again | differ).where(~F.col("many") | F.col("first") & differ)
    kind = F.when(again, _WHOLE).otherwise(_EDGE) + F.when(F.col("first") & differ, _SHIP).otherwise(0) + F.when(F.col("blocks") > GROUP, _BIG).otherwise(0)
    return rows.select("key", "at", "digest", kind.cast("int").alias("kind"))


def factors(anchor: np.ndarray, lead: np.ndarray, words: pa.Array) -> np.ndarray:
    """For different blocks, given by anchor, words before the anchor and words
    joined by blanks: a mask of the windows (bit 0: the block's first) that lie in
    a factor, which is a match of WINDOW words or more with another block of the
    anchor."""
    w = blocks.words(words)
    codes, _ = w.codes
    size = np.int64(len(codes) + 1)
    root, _ = blocks.grouped(anchor)
    middle = w.ends[:-1] + lead

    def grow(node: np.ndarray, at: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """The tries' nodes one word on; -1 where the block ends."""
        ok = np.flatnonzero((node >= 0) & ok)
        out = np.full(len(node), -1, np.int64)
        out[ok] = blocks.grouped(node[ok] * size + codes[at[ok]])[0]
        return out

    right = [root]
    for k in range(WINDOW):
        right.append(grow(right[-1], middle + k, middle + k < w.ends[1:]))
    left, mask = root, np.zeros(len(anchor), np.int64)
    for k in range(MOST):  # windows that begin k words before the anchor
        if k:
            left = grow(left, middle - k, middle - k >= w.ends[:-1])
        end = right[WINDOW - k]
        both = np.flatnonzero((left >= 0) & (end >= 0))
        if len(both):
            match, found = blocks.grouped(left[both] * size + end[both])
            hit = both[np.bincount(match, minlength=found)[match] > 1]
            mask[hit] |= np.int64(1) << (lead[hit] - k)
    return mask


def _factored(refs: DataFrame) -> DataFrame:
    """(key, at, digest, mask) of the blocks to factor (edge) of refs (anchor,
    digest, key, at, edge, lead, words): anchors are dealt out, and a task reads
    them in order, a few whole ones at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def parse(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            anchor, digest = table.column("anchor").to_numpy(), table.column("digest").to_numpy()
            new = np.ones(len(anchor), bool)  # repeated rows bring a block more than once
            new[1:] = (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])
            table = table.filter(pa.array(new))
            words = table.column("words").combine_chunks()
            mask = factors(anchor[new], table.column("lead").to_numpy().astype(np.int64), words)
            out = table.append_column("mask", pa.array(mask)).select(["key", "at", "digest", "mask"])
            some = table.column("edge").to_numpy() & (mask != 0)
            return out.filter(pa.array(some)).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 14:
                table = pa.Table.from_batches(held)
                anchor = table.column("anchor").to_numpy()
                to = int(np.searchsorted(anchor, anchor[-1]))
                if to:
                    yield from parse(table.slice(0, to))
                    held = table.slice(to).to_batches()
                    size = table.num_rows - to
        if size:
            yield from parse(pa.Table.from_batches(held))

    parts = max(int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = refs.repartition(parts, "anchor").sortWithinPartitions("anchor", "digest")
    return dealt.mapInArrow(blocks.frugal(run), "key long, at int, digest long, mask long")


def _by_window(refs: DataFrame) -> DataFrame:
    """The same for anchors with more than GROUP blocks: windows are counted by
    their words' digest, with partial sums, so that no anchor is one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = blocks.words(batch.column("words").cast(pa.binary()))
            data, starts = w.joined
            windows = w.windows(WINDOW)
            row = w.row[windows]
            made = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(starts[windows].tolist(), (starts[windows + WINDOW] - 1).tolist())]
            taken = [batch.column(c).take(pa.array(row)) for c in ("anchor", "digest", "key", "at", "edge")]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(windows - w.ends[row], pa.int32()), pa.array(made, pa.binary())], ["anchor", "digest", "key", "at", "edge", "j", "window"])

    refs = refs.dropDuplicates(["anchor", "digest"]).drop("lead")
    windows = refs.mapInArrow(blocks.frugal(run), "anchor long, digest long, key long, at int, edge boolean, j int, window binary")
    again = blocks.cut(windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    hits = windows.where("edge").join(again, ["anchor", "window"], "left_semi")
    return hits.groupBy("key", "at", "digest").agg(F.expr("bit_or(shiftleft(1L, j))").alias("mask"))


def _gone(w: blocks.Words, rows: np.ndarray, first: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which words are inside a duplicate window, of those that masks tell for
    blocks by their row and first window in it."""
    on = (masks[:, None] >> np.arange(MOST)) & 1
    at = (first[:, None] + w.ends[rows][:, None] + np.arange(MOST))[on == 1]
    mark = np.bincount(at, minlength=len(w.starts) + 1)[: len(w.starts) + 1]
    mark = mark - np.bincount(at + WINDOW, minlength=len(w.starts) + 1)[: len(w.starts) + 1]
    return np.cumsum(mark[:-1]) > 0


def _kept_digests(w: blocks.Words, gone: np.ndarray) -> list[str]:
    data, starts = w.joined
    left = np.repeat(~gone, np.diff(starts))
    kept = np.frombuffer(data, np.uint8)[left].tobytes()
    ends = np.concatenate([[0], np.cumsum(left)])[starts[w.ends]].tolist()
    return [hashlib.sha256(kept[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]


def _without(w: blocks.Words, gone: np.ndarray, null: np.ndarray) -> pa.Array:
    """Texts without some words; a word takes the bytes up to the next word of its
    row along."""
    nxt = np.append(w.starts[1:], len(w.data))
    stop = np.minimum(nxt, w.offsets[1:][w.row]) if len(w.row) else nxt[:0]
    cut = np.zeros(len(w.data) + 1, np.int64)
    np.add.at(cut, w.starts[gone], 1)
    np.add.at(cut, stop[gone], -1)
    left = np.cumsum(cut[:-1]) == 0
    made = blocks.binary(w.data[left], np.concatenate([[0], np.cumsum(left)])[w.offsets]).cast(pa.large_string())
    return pa.array([None if n else t for t, n in zip(made.to_pylist(), null.tolist())], pa.string())


_DIGESTS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
_REFS = "array<struct<anchor:long,digest:long,at:int,edge:boolean,big:boolean,lead:int,words:binary>>"
_OPEN = f"key__ long, z__ binary, whole__ array<struct<at:int,mask:long>>, refs__ {_REFS}"


def substring_dedup(docs: DataFrame, text: str = "text", counts: bool = False) -> DataFrame:
    """The rows with every word cut out that a duplicate window covers; bytes around
    the words that stay are kept, but for the blanks that follow a word cut out.
    counts adds n_words, n_removed and kept_sha256 (of the kept words, joined by one
    blank) instead of the text."""
    spark = docs.sparkSession
    blocks.small_batches(spark)
    order = docs.columns
    added = _DIGESTS if counts else T.StructType([T.StructField(text, T.StringType())])
    rest = blocks.others(docs, text, added.names)
    docs, carried = blocks.renamed(docs, rest, text)
    docs = docs.withColumn("key__", F.xxhash64(*blocks.hashable(docs)))

    sc = spark.sparkContext
    grams = _hot_grams(docs, "text__")
    hot = sc.broadcast(grams)  # SLOTS marks at any corpus size
    copies = sc.broadcast(_hot_blocks(docs, "text__", hot) if grams.any() else np.zeros(0, np.uint64))
    known = _known(docs, "text__", "key__", hot, copies)
    lists = known.groupBy("key").agg(F.collect_set(F.struct("at", "digest", "kind")).alias("known__")).withColumnRenamed("key", "key__")
    made = T.StructType([T.StructField("m__", T.StructType(added.fields))])
    schema = T.StructType(carried + made.fields + T.StructType.fromDDL(_OPEN).fields)
    inner = pa.struct([(f.name, pa.int64() if f.dataType == T.LongType() else pa.string()) for f in added.fields])

    def outcome(w: blocks.Words, texts: pa.Array, gone: np.ndarray) -> pa.StructArray:
        if counts:
            columns = [pa.array(w.counts, pa.int64()), pa.array(blocks.per_row(gone, w.ends), pa.int64()), pa.array(_kept_digests(w, gone), pa.string())]
        else:
            columns = [_without(w, gone, texts.is_null().to_numpy(zero_copy_only=False))]
        return pa.StructArray.from_arrays(columns, fields=list(inner))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finishes the texts whose blocks are all known, and takes the others
        apart: their text, the windows known, and what goes to the reference."""
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for part in blocks.steps(batch, "text__"):
                texts, n = part.column("text__"), part.num_rows
                r = Runs(blocks.words(texts), hot.value)
                w = r.words
                asked = part.column("known__")
                per = asked.value_lengths().fill_null(0).to_numpy()
                flat = asked.flatten()
                place = np.repeat(np.arange(n), per) << 32 | flat.field("at").to_numpy().astype(np.int64)
                own = r.row << 32 | r.first - w.ends[r.row]  # ascending
                of = np.minimum(np.searchsorted(own, place), max(0, len(own) - 1))
                kind = np.zeros(len(own), np.int64)
                if len(own) and len(place):
                    there = np.flatnonzero(own[of] == place)
                    same = there[r.digests(of[there]) == flat.field("digest").to_numpy()[there]]
                    np.bitwise_or.at(kind, of[same], flat.field("kind").to_numpy()[same].astype(np.int64))
                some = np.flatnonzero(r.hot)
                kind[some[_in(r.digests(some).view(np.uint64), copies.value)]] |= _WHOLE
                mask = np.where(kind & _WHOLE, (np.int64(1) << (r.last - r.first + 1)) - 1, 0)
                whole = np.flatnonzero(mask)
                done = outcome(w, texts, _gone(w, r.row[whole], r.first[whole] - w.ends[r.row[whole]], mask[whole]))
                # rows with a block to factor stay open
                open_ = np.zeros(n, bool)
                open_[r.row[(kind & _EDGE) > 0]] = True
                ship = np.flatnonzero(kind & (_SHIP | _EDGE))
                refs = pa.StructArray.from_arrays(
                    [_signed(r.anchor[ship]), pa.array(r.digests(ship)), pa.array(own[ship] & 0xFFFFFFFF, pa.int32()), pa.array((kind[ship] & _EDGE) > 0),
                     pa.array((kind[ship] & _BIG) > 0), pa.array(r.place[ship] - r.first[ship], pa.int32()), pa.array(r.texts(ship), pa.binary())],
                    ["anchor", "digest", "at", "edge", "big", "lead", "words"],
                )
                shown = np.flatnonzero((mask != 0) & open_[r.row])
                spans = pa.StructArray.from_arrays([pa.array(own[shown] & 0xFFFFFFFF, pa.int32()), pa.array(mask[shown])], ["at", "mask"])
                z = [None] * n
                for i in np.flatnonzero(open_).tolist():
                    raw = texts[i].as_py().encode()
                    z[i] = len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True)
                by = np.arange(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c.name) for c in carried]
                    + [pa.StructArray.from_arrays(done.flatten(), fields=list(inner), mask=pa.array(open_)), part.column("key__"), pa.array(z, pa.binary()),
                       pa.ListArray.from_arrays(pa.array(np.searchsorted(r.row[shown], by), pa.int32()), spans),
                       pa.ListArray.from_arrays(pa.array(np.searchsorted(r.row[ship], by), pa.int32()), refs)],
                    schema.names,
                )

    settled = blocks.stored(docs.join(lists, "key__", "left").mapInArrow(blocks.frugal(settle), schema))
    refs = settled.select(F.col("key__").alias("key"), F.explode("refs__").alias("r")).select("key", "r.*")
    masks = _factored(refs.where("NOT big").drop("big"))
    if not refs.where("big").isEmpty():
        masks = masks.unionByName(_by_window(refs.where("big").drop("big")))
    masks = masks.groupBy("key").agg(F.collect_set(F.struct("at", "digest", "mask")).alias("masks__")).withColumnRenamed("key", "key__")
    closed = T.StructType(carried + made.fields)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for part in blocks.steps(batch, "z__", blocks.STEP_BYTES // 4):
                raw = [codec.decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True) for z in part.column("z__").to_pylist()]
                texts = pa.array(raw, pa.binary())
                w = blocks.words(texts)
                rows, first, mask = [], [], []
                for i, (whole, edges, found) in enumerate(zip(part.column("whole__").to_pylist(), part.column("edges__").to_pylist(), part.column("masks__").to_pylist())):
                    own = {(e["at"], e["digest"]) for e in edges}
                    # another row may have the same key: only this one's own blocks count
                    for h in whole + [h for h in found or () if (h["at"], h["digest"]) in own]:
                        rows.append(i)
                        first.append(h["at"])
                        mask.append(h["mask"])
                gone = _gone(w, np.array(rows, np.int64), np.array(first, np.int64), np.array(mask, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(c.name) for c in carried] + [outcome(w, texts, gone)], closed.names)

    names = [c.name for c in carried]
    edges = F.transform(F.filter("refs__", lambda x: x["edge"]), lambda x: F.struct(x["at"].alias("at"), x["digest"].alias("digest")))
    left = settled.where("z__ IS NOT NULL").select(*names, "key__", "z__", "whole__", edges.alias("edges__"))
    late = left.join(masks, "key__", "left").select(*names, "z__", "whole__", "edges__", "masks__").mapInArrow(blocks.frugal(finish), closed)
    out = settled.where("z__ IS NULL").select(*names, "m__").unionByName(late)
    out = out.select(*blocks.restored(rest, carried), *(F.col(f"m__.`{n}`").alias(n) for n in added.names))
    return out if counts else out.select(*(f"`{c}`" for c in order))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs, counts=True)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i + 1 : i + 35], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 34)) AS i FROM d WHERE len(ws) >= 35)
), hit AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i + 1, i + 36)) AS p FROM hit
), w AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
