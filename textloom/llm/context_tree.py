"""Language-model scores by context-tree weighting over the bytes of whole texts.

A text, lower-cased (A to Z) and closed by END, is one sequence of bytes; each byte
is eight binary decisions, and each decision has a context tree of depth DEPTH: a
byte's contexts are none, the byte before it, the last two, and so on to the last
DEPTH, whatever they are, blanks and other words included; before a text's first byte
stand START bytes. Every context that the corpus has is a node, at every depth. A node
keeps a Krichevsky-Trofimov estimate; its weighted probability is half its own estimate
and half the product of its children's (a deepest node's is its own estimate), and
predictions mix all depths by the weights. DEPTH is the method's one parameter and the
same for any corpus; bytes further back are not seen.

A byte behind its DEPTH last ones is a gram, and all that training texts tell the
tree are counts of grams. They come from one grouped sum over all texts, with grams that
only other texts have (0 times). Grams are dealt by their last SPLIT bytes of context,
so that whole subtrees meet in a task, which sends the sums that the nodes above need.
Those are summed and weighted level by level in tables by (context, decision), and the
mixtures come down the same way by joins. Then each distinct gram gets its log
probability, and a text's score is the sum over its bytes: the HEAD most frequent grams
are looked up where the text is, the others are joined.

Beside it stands an add-one word model (frequent.py).

Defined cases: a null text counts as empty (one end token); a null id counts as an
empty id; repeated rows train and are scored one by one; a very long text is one step
of its own; an empty table gives an empty result; without training texts all bits are
even and no word is known; an input column with the name of an added one is replaced,
others are carried whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import blocks, frequent, lm

#: Bytes that no UTF-8 has: the end of a text, and what is before it.
END, START = 0xFF, 0xFE
#: Bytes of context, 6 at most (a gram is an integer), and those that subtrees are dealt by.
DEPTH, SPLIT = 6, 3
#: Grams that are looked up without a join.
HEAD = 1 << 21
#: Distinct grams that a counting task holds, and those that a step works on.
HELD, CHUNK = 1 << 22, 1 << 17
_HALF = np.log(0.5)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each byte of each text and its end, and offsets by text. From the
    highest byte on: the byte before, the one before that, ..., and the byte itself."""
    data, offsets = blocks.raw(texts)
    n = len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    sizes = np.diff(offsets)
    full = np.full(len(data) + 8 * n, START, np.uint8)
    own = np.ones(len(full), bool)  # but the seven bytes before a text
    begins = offsets[:-1] + 8 * np.arange(n)
    own[(begins[:, None] + np.arange(7)).ravel()] = False
    ends = begins + 7 + sizes
    own[ends] = False
    full[own] = blocks.LOWER[data]
    full[ends] = END
    own[ends] = True
    last = np.ndarray((len(full) - 7,), "<u8", full, 0, (1,))[own[7:]]  # eight bytes up to each
    context = (last << np.uint64(8)) >> np.uint64(64 - 8 * DEPTH)
    return (context << np.uint64(8) | last >> np.uint64(56)).astype(np.int64), np.concatenate([[0], np.cumsum(sizes + 1)])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of sorted keys, and sums of n."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _counted(docs: DataFrame) -> DataFrame:
    """(gram, n, trained) of every distinct gram of docs (text__, held_out)."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in held])
        order = np.argsort(keys, kind="stable")
        return _summed(keys[order], np.concatenate([n for _, n in held])[order])

    def rows(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, total = _summed(pairs >> 1, n)
        _, trained = _summed(pairs >> 1, n * (pairs & 1))
        for lo in range(0, len(found), 1 << 16):
            own = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(found[own]), pa.array(total[own]), pa.array(trained[own])], ["gram", "n", "trained"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in blocks.steps(batch, "text__", 2 * blocks.STEP_BYTES):
                keys, ends = grams(part.column("text__"))
                train = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                pairs = keys << 1 | np.repeat(train, np.diff(ends))
                pairs.sort()
                held.append(_summed(pairs, np.ones(len(pairs), np.int64)))
                if sum(len(k) for k, _ in held) > HELD:
                    held = [merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield from rows(*held.pop())
        if held:
            yield from rows(*merged(held))

    found = docs.select("text__", "held_out").mapInArrow(blocks.frugal(count), "gram long, n long, trained long")
    # a task's rows have few in common: they are dealt as they are
    return found.repartition(_parts(docs.sparkSession), "gram").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def _parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


class Level:
    """The nodes of a depth in one of the eight trees of a byte: keys (context << 8 |
    place), the counts of 0 and 1, log probabilities (the estimate's, the weighted),
    and the place of each one's parent in the level above."""

    def __init__(self, keys: np.ndarray, zero: np.ndarray, one: np.ndarray, below: np.ndarray | None):
        self.keys, self.zero, self.one = keys, zero, one
        self.estimate = lm._estimate(zero, one)
        self.weighted = self.estimate if below is None else np.logaddexp(_HALF + self.estimate, _HALF + below)
        self.stop = np.ones(len(keys)) if below is None else np.exp(_HALF + self.estimate - self.weighted)
        self.parent = np.zeros(0, np.int64)


def subtrees(found: np.ndarray, trained: np.ndarray) -> Iterator[tuple[list[Level], np.ndarray, np.ndarray]]:
    """For each of the eight decisions of some sorted grams, with all of their last
    SPLIT bytes of context: levels from DEPTH to SPLIT, each gram's node of the first,
    and its bit."""
    for k in range(8):
        bit = found >> (7 - k) & 1
        keys = found >> 8 << 8 | 1 << k | (found & 255) >> (8 - k)
        sums: list[np.ndarray] = [trained * (1.0 - bit), trained * (1.0 * bit)]
        levels: list[Level] = []
        for depth in range(DEPTH, SPLIT - 1, -1):
            if levels:
                keys = levels[-1].keys >> 16 << 8 | levels[-1].keys & 255
                sums = [levels[-1].zero, levels[-1].one, levels[-1].weighted]
            nodes, of = np.unique(keys, return_inverse=True)
            added = [np.bincount(of, weights=s, minlength=len(nodes)) for s in sums]
            level = Level(nodes, added[0], added[1], added[2] if levels else None)
            if levels:
                levels[-1].parent = of
            else:
                lowest = of
            levels.append(level)
        yield levels, lowest, bit


def scores(found: np.ndarray, trained: np.ndarray, keys: np.ndarray, mixed: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log10 probability of each gram, given what is mixed above the nodes of SPLIT bytes
    (keys sorted) and the weight that is left for them."""
    out = np.zeros(len(found))
    for levels, lowest, bit in subtrees(found, trained):
        at = np.searchsorted(keys, levels[-1].keys)
        share, rest = mixed[at], left[at]
        for level in reversed(levels):
            if level is not levels[-1]:
                share, rest = share[level.parent], rest[level.parent]
            share = share + rest * level.stop * lm._next(level.zero, level.one)
            rest = rest * (1 - level.stop)
        chance = np.clip(share[lowest], 1e-12, 1 - 1e-12)
        out += np.log10(np.where(bit == 1, chance, 1 - chance))
    return out


def _in_groups(table: DataFrame, order: list[str], work, schema: str) -> DataFrame:
    """work(table) over whole groups of the column `top`, sorted, about CHUNK rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                rows = pa.Table.from_batches(held).combine_chunks()
                top = rows.column("top").to_numpy()
                to = int(np.searchsorted(top, top[-1]))
                if to:
                    yield from work(rows.slice(0, to)).to_batches(1 << 16)
                    held = rows.slice(to).combine_chunks().to_batches()
                    size -= to
        if size:
            yield from work(pa.Table.from_batches(held)).to_batches(1 << 16)

    return table.repartition(_parts(table.sparkSession), "top").sortWithinPartitions("top", *order).mapInArrow(blocks.frugal(run), schema)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _sums(table: pa.Table) -> pa.Table:
    """What the nodes of SPLIT bytes have, a row for each decision."""
    tops = [levels[-1] for levels, _, _ in subtrees(*_columns(table, "gram", "trained"))]
    keys = np.concatenate([t.keys for t in tops])
    rest = (np.concatenate([getattr(t, c) for t in tops]) for c in ("zero", "one", "weighted"))
    return pa.table([pa.array(x) for x in (keys >> 8, keys & 255, *rest)], ["node", "place", "zero", "one", "weighted"])


def _scored(table: pa.Table) -> pa.Table:
    """(gram, n, score) of a table of what is above (gram null) and grams."""
    above = table.filter(pc.is_null(table.column("gram")))
    own = table.filter(pc.is_valid(table.column("gram")))
    node, place, mixed, left = _columns(above, "top", "place", "mixed", "left")
    keys = node << 8 | place
    order = np.argsort(keys)
    found, trained = _columns(own, "gram", "trained")
    made = scores(found, trained, keys[order], mixed[order], left[order])
    return pa.table([own.column("gram"), own.column("n"), pa.array(made)], ["gram", "n", "score"])


def _log_estimate(zero: pd.Series, one: pd.Series) -> pd.Series:
    return pd.Series(lm._estimate(zero.to_numpy(), one.to_numpy()))


def _above(level: DataFrame) -> DataFrame:
    """The nodes (node, place, zero, one, weighted, stop) one byte above a level's."""
    half = F.lit(float(_HALF))
    up = level.groupBy(F.shiftright("node", 8).alias("node"), "place").agg(*(F.sum(c).alias(c) for c in ("zero", "one")), (F.sum("weighted") + half).alias("below"))
    up = up.withColumn("own", F.pandas_udf(_log_estimate, "double")("zero", "one") + half)
    up = up.withColumn("weighted", F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))))
    return up.select("node", "place", "zero", "one", "weighted", F.exp(F.col("own") - F.col("weighted")).alias("stop"))


def _mixed(levels: list[DataFrame]) -> DataFrame:
    """(top, place, mixed, left) for each node of SPLIT bytes, from levels that go up
    from them to the root: the mixture of all depths above, and the weight left."""
    chance = (F.col("one") + 0.5) / (F.col("zero") + F.col("one") + 1.0)
    down = levels[-1].select("node", "place", (F.col("stop") * chance).alias("mixed"), (1 - F.col("stop")).alias("left"))
    for level in reversed(levels[:-1]):
        above = down.select(F.col("node").alias("up"), F.col("place").alias("of"), "mixed", "left")
        joined = level.join(above, (F.shiftright("node", 8) == F.col("up")) & (F.col("place") == F.col("of")))
        if level is levels[0]:
            return joined.select(F.col("node").alias("top"), "place", "mixed", "left")
        down = joined.select("node", "place", (F.col("mixed") + F.col("left") * F.col("stop") * chance).alias("mixed"), (F.col("left") * (1 - F.col("stop"))).alias("left"))
    return down


def gram_table(docs: DataFrame) -> DataFrame:
    """(gram, n, score) of every gram of docs (text__, held_out)."""
    counts = blocks.stored(_counted(docs)).withColumn("top", F.shiftright("gram", 8 * (DEPTH - SPLIT + 1)))
    sums = _in_groups(counts.select("top", "gram", "trained"), ["gram"], _sums, "node long, place long, zero double, one double, weighted double")
    levels = [blocks.stored(sums)]
    for _ in range(SPLIT):
        levels.append(blocks.stored(_above(levels[-1])))
    none = F.lit(None)
    above = _mixed(levels).select("top", none.cast("long").alias("gram"), none.cast("long").alias("n"), none.cast("long").alias("trained"), "place", "mixed", "left")
    own = counts.select("top", "gram", "n", "trained", none.cast("long").alias("place"), none.cast("double").alias("mixed"), none.cast("double").alias("left"))
    return blocks.stored(_in_groups(above.unionByName(own), ["gram"], _scored, "gram long, n long, score double"))


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    w = blocks.words(texts, lower=True)
    codes, distinct = w.codes
    return codes, frequent.short(distinct)[0], w.ends


def score(docs: DataFrame, training: Column | str, text: str = "text") -> DataFrame:
    """All columns but the text, with held_out (not training), n_tokens, n_known,
    train_tokens, base_score and score (log10 of the lower-cased text's
    probability with its end) and code_length (bits a byte, end included)."""
    spark = docs.sparkSession
    blocks.small_batches(spark)
    added = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "code_length")
    rest = blocks.others(docs, text, added)
    training = F.expr(training) if isinstance(training, str) else training
    marked = docs.withColumn("held__", ~F.coalesce(training, F.lit(False)))
    docs, carried = blocks.renamed(marked, [*rest, marked.schema["held__"]], text)
    held = carried[-1].name
    texts = docs.withColumn("held_out", F.col(held))
    words = blocks.stored(lm._counted(texts, _words))
    total, distinct = words.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count(F.when(F.col("trained") > 0, 1))).first()
    end = texts.where("NOT held_out").count()
    total, distinct = total + end, distinct + bool(end)
    known = words.select("token", "n", F.lit(1).cast("long").alias("words"), F.log10(F.col("trained") + F.lit(1.0)).alias("base"), (F.col("trained") > 0).cast("long").alias("seen"))
    table = gram_table(texts)
    top = frequent.head(table.withColumnRenamed("gram", "token"), HEAD)
    order = np.argsort(top.column("token").to_numpy())
    shared = spark.sparkContext.broadcast((top.column("token").to_numpy()[order], np.append(top.column("score").to_numpy()[order], 0.0)))
    index: list[pd.Index] = []  # made once a task

    def told(part: pa.Array) -> list[pa.Array]:
        keys, ends = grams(part)
        if not index:
            index.append(pd.Index(shared.value[0]))
        slot = index[0].get_indexer(keys)
        run = np.zeros(len(keys) + 1)
        np.cumsum(shared.value[1][slot], out=run[1:])  # -1 finds the 0 at the end
        # other grams: a row for each one's place in a text
        rare = np.flatnonzero(slot < 0)
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, ends), pa.int32()), pa.array(keys[rare]))
        return [pa.array(np.diff(ends)), pa.array(run[ends[1:]] - run[ends[:-1]]), lists]

    def with_rare(parts: DataFrame, out: DataFrame) -> DataFrame:
        tail = parts.select("row__", F.explode("grams__").alias("gram")).join(table.select("gram", "score"), "gram").groupBy("row__").agg(F.sum("score").alias("rare_score__"))
        return out.drop("grams__").join(tail, "row__", "left")

    values = {"words": "long", "base": "double", "seen": "long"}
    out = frequent.summed(docs, "text__", _words, known, values, carried, told, "bytes__ long, score__ double, grams__ array<long>", with_rare)
    base = F.col("base") + F.log10(F.lit(float(end + 1))) - (F.col("words") + 1) * F.log10(F.lit(float(total + distinct + 1)))
    sums = F.col("score__") + F.coalesce("rare_score__", F.lit(0.0))
    return out.select(
        *blocks.restored(rest, carried), F.col(held).alias("held_out"), (F.col("words") + 1).alias("n_tokens"), (F.col("seen") + F.lit(1 if end else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), sums.alias("score"),
        (-sums * F.lit(float(np.log2(10))) / F.col("bytes__")).alias("code_length"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    return score(docs, training)
