"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of ten words. Each window's three-word
shingles are ordered by rarity in the whole corpus, and the rarest one is its
prefix: a text that holds the window must hold that shingle, and one shingle is
enough, since containment asks for all of them. Shingles of a document that are
some window's prefix give candidates at one place each (positional bound), the
place must have room for the window (length bound), and its words are compared
one by one (verification).

Defined cases: null and empty texts have no words and no hits; items without
words have no windows; repeated item ids are one item; an item without an id
counts as the empty id; repeated documents are judged one by one; a very long text
is one step of its own; an empty benchmark hits nothing; an empty table gives an
empty result; an input column with the name of an added one is replaced by it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import blocks

WINDOW = 10
SHINGLE = 3
#: Benchmark words that one index block holds. Blocks are broadcast one by one,
#: and the documents pass through as many narrow steps as there are blocks.
BLOCK_WORDS = 2_000_000


@dataclass
class Index:
    """Windows of one block of items, over the small integers of its words."""

    words: pa.Array
    windows: np.ndarray  # (n, WINDOW), -1 behind the end
    lengths: np.ndarray
    owner: np.ndarray  # position in items
    items: list[str]
    shingles: np.ndarray  # sorted distinct keys of all windows' shingles
    of: np.ndarray  # (n, WINDOW - SHINGLE + 1): positions in shingles, -1 behind the end
    heads: np.ndarray  # sorted distinct keys of all shingles' first two words
    prefix: np.ndarray | None = None  # window's offset of its rarest shingle

    def pairs(self, codes: np.ndarray) -> np.ndarray:
        """One key for the first two of each SHINGLE codes; -1 is no word."""
        return (codes[..., 0].astype(np.int64) + 1) * np.int64(len(self.words) + 1) + codes[..., 1] + 1

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """One key for each SHINGLE codes, or -1 where no shingle of the index has
        the first two. Places among the heads keep a key below 2 ** 62 for any block."""
        pairs = self.pairs(codes)
        if not len(self.heads):
            return np.full(pairs.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.heads, pairs), len(self.heads) - 1)
        return np.where(self.heads[at] == pairs, at * np.int64(len(self.words) + 1) + codes[..., 2] + 1, -1)


def build(items: list[tuple[str, pa.Scalar]]) -> Index:
    """The index of items given as (id, text)."""
    w = blocks.words(pa.array([t for _, t in items], pa.string()), blocks.ALNUM, lower=True)
    codes, distinct = w.codes
    windows, lengths, owner = [], [], []
    for i in range(len(items)):
        own = codes[w.ends[i] : w.ends[i + 1]]
        n = min(len(own), WINDOW)
        for at in range(len(own) - n + 1 if n else 0):
            row = np.full(WINDOW, -1, np.int64)
            row[:n] = own[at : at + n]
            windows.append(row)
            lengths.append(n)
            owner.append(i)
    windows = np.array(windows, np.int64).reshape(-1, WINDOW)
    lengths = np.array(lengths, np.int64)
    index = Index(distinct, windows, lengths, np.array(owner, np.int64), [i for i, _ in items], np.zeros(0, np.int64), np.zeros((0, 0), np.int64), np.zeros(0, np.int64))
    runs = np.stack([windows[:, k : k + SHINGLE] for k in range(WINDOW - SHINGLE + 1)], axis=1)
    index.heads = np.unique(index.pairs(runs))
    keys = index.keys(runs)
    # a run is the window's own where it ends inside; a window shorter than a
    # shingle has its only run at 0, padded alike on both sides
    valid = np.arange(WINDOW - SHINGLE + 1)[None] <= np.maximum(lengths - SHINGLE, 0)[:, None]
    index.shingles = np.unique(keys[valid & (lengths >= SHINGLE)[:, None]])
    at = np.searchsorted(index.shingles, keys)
    index.of = np.where(valid & (lengths >= SHINGLE)[:, None], at, -1)
    return index


def _places(w: blocks.Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index's code of each word (-1: not in it); positions whose shingle is
    one of the index's, and which one."""
    codes, distinct = w.codes
    known = pc.index_in(distinct, value_set=index.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    code = known[codes] if len(codes) else codes
    at = w.windows(SHINGLE)
    for k in range(SHINGLE):
        at = at[code[at + k] >= 0]
    if not len(at) or not len(index.shingles):
        return code, at[:0], at[:0]
    key = index.keys(np.stack([code[at + k] for k in range(SHINGLE)], axis=1))
    slot = np.minimum(np.searchsorted(index.shingles, key), len(index.shingles) - 1)
    same = index.shingles[slot] == key
    return code, at[same], slot[same]


def _occurrences(w: blocks.Words, index: Index, by_prefix: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of every occurrence of a window of the index."""
    order, starts = by_prefix
    code, at, slot = _places(w, index)
    left = np.repeat(w.ends[1:], w.counts) - np.arange(len(code))
    begun = np.arange(len(code)) - np.repeat(w.ends[:-1], w.counts)
    many = starts[slot + 1] - starts[slot] if len(slot) else slot
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def verify(window: np.ndarray, place: np.ndarray) -> None:
        ok = np.ones(len(window), bool)
        for k in range(WINDOW):
            live = np.flatnonzero(ok & (index.lengths[window] > k))
            ok[live] = code[place[live] + k] == index.windows[window[live], k]
        found.append((window[ok], place[ok]))

    lo = 0
    total = np.cumsum(many)
    while lo < len(at):  # about a million candidates at a time
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 20))))
        m = many[lo:hi]
        ends = np.cumsum(m)
        which = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - m, m) + np.repeat(starts[slot[lo:hi]], m)
        window = order[which]
        offset = index.prefix[window]
        place = np.repeat(at[lo:hi], m) - offset
        ok = offset <= np.repeat(begun[at[lo:hi]], m)  # positional bound
        window, place = window[ok], place[ok]
        ok = index.lengths[window] <= left[place]  # length bound
        verify(window[ok], place[ok])
        lo = hi
    short = np.flatnonzero(index.lengths < SHINGLE)
    if len(short):  # items of one or two words have no shingle: their first word is the prefix
        order_w = np.argsort(index.windows[short, 0], kind="stable")
        heads = index.windows[short, 0][order_w]
        place = np.flatnonzero((code >= 0) & np.isin(code, heads))
        lo_, hi_ = np.searchsorted(heads, code[place]), np.searchsorted(heads, code[place], "right")
        m = hi_ - lo_
        ends = np.cumsum(m)
        which = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - m, m) + np.repeat(lo_, m)
        window, place = short[order_w[which]], np.repeat(place, m)
        ok = index.lengths[window] <= left[place]
        verify(window[ok], place[ok])
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (at[:0], at[:0])


def _by_prefix(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Windows by their prefix shingle: their order, and each shingle's first."""
    has = np.flatnonzero(index.lengths >= SHINGLE)
    slot = index.of[has, index.prefix[has]]
    order = has[np.argsort(slot, kind="stable")]
    return order, np.searchsorted(np.sort(slot), np.arange(len(index.shingles) + 1))


def _rank(docs: DataFrame, text: str, shared) -> Counter:
    """How often each shingle of the index is in the corpus: one partial count a
    task, summed by shingle. As many sums as the block has shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        total = np.zeros(len(index.shingles), np.int64)
        for batch in batches:
            for part in blocks.steps(batch, text):
                _, _, slot = _places(blocks.words(part.column(text), blocks.ALNUM, lower=True), index)
                total += np.bincount(slot, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["shingle", "n"])

    sums = docs.select(text).mapInArrow(blocks.frugal(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return Counter({r.shingle: r.n for r in sums.toLocalIterator()})


def indexes(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, block_words: int = BLOCK_WORDS) -> list:
    """Broadcast indexes, each of items with at most block_words characters' worth
    of words (one item at least), with every window's prefix chosen by rarity."""
    out = []

    def add(items):
        index = build(items)
        shared = docs.sparkSession.sparkContext.broadcast(index)
        if len(index.windows):
            seen = _rank(docs, text, shared)
            rarity = np.array([seen.get(i, 0) for i in range(len(index.shingles))] + [0], np.int64)
            cost = np.where(index.of >= 0, rarity[index.of], np.iinfo(np.int64).max)
            index.prefix = cost.argmin(axis=1)
            shared.unpersist()
            out.append(docs.sparkSession.sparkContext.broadcast((index, _by_prefix(index))))

    held, size = [], 0
    rows = benchmark.select(F.coalesce(blocks.quoted(item).cast("string"), F.lit("")), blocks.quoted(item_text).alias("text__")).where("text__ IS NOT NULL")
    for i, t in rows.toLocalIterator():  # one block of items is on the driver at a time
        if held and size + len(t) // 2 > block_words:
            add(held)
            held, size = [], 0
        held.append((i, t))
        size += len(t) // 2 + 1
    if held:
        add(held)
    return out


def contaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows and columns of docs, with n_words, n_hit (words inside any
    occurrence of a window), items (ids found, as sorted strings) and
    contaminated. An input column of such a name is replaced."""
    blocks.small_batches(docs.sparkSession)
    added = T.StructType.fromDDL("n_words long, n_hit long, items array<string>, contaminated boolean")
    docs, back, _ = blocks.apart(docs, text, added.names)
    rest, text = docs.schema.fields, "text__"
    shared = indexes(docs, benchmark, text, item, item_text, block_words)
    carried = T.StructType(rest + T.StructType.fromDDL("hits__ array<int>, items__ array<string>").fields)

    def step(block, last: bool):
        """Adds one block's finds to what the rows carry; the last step closes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in blocks.steps(batch, text):
                    w = blocks.words(part.column(text), blocks.ALNUM, lower=True)
                    hits, items = part.column("hits__").to_pylist(), part.column("items__").to_pylist()
                    if block is not None:
                        index, by_prefix = block.value
                        window, place = _occurrences(w, index, by_prefix)
                        hit = np.zeros(len(w.starts) + 1, np.int64)
                        np.add.at(hit, place, 1)
                        np.add.at(hit, place + index.lengths[window], -1)
                        at = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
                        for own in np.split(at, np.flatnonzero(np.diff(w.row[at])) + 1) if len(at) else []:
                            r = int(w.row[own[0]])
                            hits[r] = hits[r] + (own - w.ends[r]).tolist()
                        pairs = np.unique(w.row[place] * len(index.items) + index.owner[window])
                        for p in pairs.tolist():
                            items[p // len(index.items)].append(index.items[p % len(index.items)])
                    if last:
                        n_hit = [len(set(h)) for h in hits]
                        made = [pa.array(w.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(set(i)) for i in items], pa.list_(pa.string())), pa.array([n > 0 for n in n_hit], pa.bool_())]
                    else:
                        made = [pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                    names = (closed if last else carried).names
                    yield pa.RecordBatch.from_arrays([part.column(f.name) for f in rest] + made, names)

        return run

    closed = T.StructType(rest + added.fields)
    out = docs.withColumns({"hits__": F.array().cast("array<int>"), "items__": F.array().cast("array<string>")})
    chain = shared or [None]
    for i, block in enumerate(chain):
        last = i == len(chain) - 1
        out = out.mapInArrow(blocks.frugal(step(block, last)), closed if last else carried)
    return back(out, *added.names)


def digest(found: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort("items"), ",")
    return found.withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(ids, 256))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = digest(contaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i + 1 : i + least(len(ws), 10)], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(0, len(ws) - least(len(ws), 10) + 1)) AS i FROM b WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM win
), dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM d, lens WHERE len(ws) >= n)
), hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k
), hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""
