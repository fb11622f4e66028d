"""Language-model scores by context-tree weighting over the bytes of single words: a
smaller model than context_tree.py, whose trees are over whole texts.

A text, lower-cased (A to Z) and closed by END, is cut into units: a word's bytes
with the white space byte (or END) behind them, of at most CUT bytes. Each byte is
eight binary decisions, and each decision has a context tree. A byte's context is
the byte before it in the unit, the second one, the third one, and then everything
from the unit's begin on: real bytes, and as many nodes at the last depth as the
corpus has beginnings of units, so the tree grows with it. Every node keeps a
Krichevsky-Trofimov estimate; its weighted probability is half its own estimate and
half the product of its children's, and predictions mix all depths by the weights.

Units come from one grouped sum over all texts. Node statistics are not on the
driver: units are dealt by their first bytes, so that all that begin alike meet in
a task, which counts the deepest nodes and sends, for each node above, the sums that
its weight needs. Only nodes of up to three bytes are joined on the driver and
broadcast: those of two bytes, and of three the KEEP most frequent; a deepest node
hangs under the nearest one that is kept. In a second pass each distinct unit gets
its log probability, and a text's score is the sum over its units (frequent.py).

Where more than GROUP units begin with the same bytes, they are dealt by more of
them, and their deepest nodes begin there.

Beside it stands an add-one word model, whose word counts come from the same sum.

Defined cases: a null text counts as empty (one end token); a null id counts as
an empty id; repeated rows train and are scored one by one; a very long text is one
step of its own, a very long word several units; an empty table gives an empty
result; without training texts all bits are even and no word is known; an input
column with the name of an added one is replaced, others are carried whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import blocks, frequent

#: Bytes that no UTF-8 has: the end of a text, what is before a unit, the first byte
#: of a unit that goes on with a word, and that of a long word's digest.
END, START, ON, DIGEST = 0xFF, 0xFE, 0xFD, 0xFC
#: Bytes of a unit, at most.
CUT = 48
#: Contexts of three bytes that have a node.
KEEP = 1 << 17
#: Units of one task's group, and the bytes that groups are told by.
GROUP, BEGINS = 10_000, (3, 6, 12, 24)
#: Units that a task works on at a time.
CHUNK = 1 << 14
_HALF = np.log(0.5)


def units(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Code of each unit, the distinct units, and offsets by text. A word that is
    cut counts with a digest of it as one more."""
    data, offsets = blocks.raw(texts)
    n = len(offsets) - 1
    bounds = offsets + np.arange(n + 1)
    full = np.full(int(bounds[-1]), END, np.uint8)
    last = np.zeros(len(full), bool)
    last[bounds[1:] - 1] = True
    full[~last] = blocks.LOWER[data]
    stops = np.flatnonzero(last | ~blocks.SPACED[full]) + 1
    starts = np.append(0, stops[:-1])[: len(stops)]
    pieces = -(-(stops - starts) // CUT)
    ends = np.concatenate([[0], np.cumsum(pieces)])
    if len(pieces) and pieces.max() > 1:
        nth = np.arange(ends[-1]) - np.repeat(ends[:-1], pieces)
        begins = np.repeat(starts, pieces) + nth * CUT
        on = begins[nth > 0]
        codes, distinct = blocks.coded(blocks.binary(np.insert(full, on, ON), np.append(begins + np.cumsum(nth > 0) - (nth > 0), len(full) + len(on))))
        long = np.flatnonzero(pieces > 1)
        digests = [bytes([DIGEST]) + hashlib.blake2b(full[starts[i] : stops[i] - 1].tobytes(), digest_size=24).digest() for i in long.tolist()]
        more, words = blocks.coded(pa.array(digests, pa.large_binary()))
        codes = np.insert(codes, ends[long], more + len(distinct))
        distinct = pa.concat_arrays([distinct, words])
        ends = np.concatenate([[0], np.cumsum(pieces + (pieces > 1))])
    else:
        codes, distinct = blocks.coded(blocks.binary(full, np.append(starts, len(full))))
    return codes, distinct, ends[np.searchsorted(starts, bounds)] if n else np.zeros(1, np.int64)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for arguments that are first raised beyond 8."""
    x = np.asarray(x, np.float64)
    low = x < 8
    y = np.where(low, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    if low.any():
        product = np.ones(int(low.sum()))
        for k in range(8):
            product *= x[low] + k
        out[low] -= np.log(product)
    return out


def _estimate(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Log block probability of Krichevsky and Trofimov."""
    zero, one = np.asarray(zero, np.float64), np.asarray(one, np.float64)
    return _log_gamma(zero + 0.5) + _log_gamma(one + 0.5) - 1.1447298858494002 - _log_gamma(zero + one + 1)


def _next(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (one + 0.5) / (zero + one + 1.0)


class Places:
    """The bytes of sorted units: for each, its unit, the byte, the node that its
    deepest one hangs under, and the deepest node (-1: it begins later)."""

    def __init__(self, tokens: pa.Array, begin: np.ndarray, kept: np.ndarray):
        data, offsets = blocks.raw(tokens)
        size = np.diff(offsets)
        n, width = len(size), int(size.max()) if len(size) else 0
        cell = np.arange(width) < size[:, None]
        table = np.zeros((n, width), np.uint8)
        table[cell] = data
        # a beginning of i bytes is the one above it where they have i bytes in common
        same = np.zeros(n, np.int64)
        both = (table[1:] == table[:-1]) & cell[1:] & cell[:-1]
        same[1:] = np.cumprod(both, axis=1).sum(1)
        fresh = np.cumsum(same[:, None] < np.arange(width), axis=0)
        cell[:, :1] &= table[:, :1] != ON
        self.unit, at = np.nonzero(cell)
        self.byte = table[self.unit, at].astype(np.int64)

        def before(k: int) -> np.ndarray:
            return np.where(at >= k, table[self.unit, np.maximum(at - k, 0)], START).astype(np.int64)

        two = before(1) << 8 | before(2)
        three = two << 8 | before(3)
        self.three = three
        self.parent = np.where(np.isin(three, kept), three | 1 << 24, two)
        self.deep = np.where(at >= begin[self.unit], at * (n + 1) + fresh[self.unit, at], -1)

    def decision(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k-th decision about each byte: its place in the byte's tree, the bit."""
        return 1 << k | self.byte >> (8 - k), self.byte >> (7 - k) & 1


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys and the sums of values for each."""
    group, found = pd.factorize(keys)
    return found, [np.bincount(group, weights=v, minlength=len(found)) for v in values]


def statistics(tokens: pa.Array, n: np.ndarray, begin: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each decision of a node above the deepest (node << 8 | place): counts of
    0 and 1, those of bytes without a deeper node, and the log estimates' sum."""
    seen = np.flatnonzero(n > 0)
    p = Places(tokens.take(pa.array(seen)), begin[seen], kept)
    weight = n[seen][p.unit].astype(np.float64)
    keys, parts = [], []
    for k in range(8):
        place, bit = p.decision(k)
        key = p.parent << 8 | place
        deep = np.flatnonzero(p.deep >= 0)
        group, found = pd.factorize(p.deep[deep] << 8 | place[deep])
        zero = np.bincount(group, weights=weight[deep] * (1 - bit[deep]), minlength=len(found))
        one = np.bincount(group, weights=weight[deep] * bit[deep], minlength=len(found))
        above = np.zeros(len(found), np.int64)
        above[group] = key[deep]
        none = np.zeros(len(found))
        ends = np.flatnonzero(p.deep < 0)
        w, b = weight[ends], bit[ends]
        keys += [above, key[ends]]
        parts += [[zero, one, none, none, _estimate(zero, one)], [w * (1 - b), w * b, w * (1 - b), w * b, np.zeros(len(w))]]
    return _sums(np.concatenate(keys), *(np.concatenate([x[i] for x in parts]) for i in range(5)))


class Top:
    """The tree down to three bytes: for each decision of a node, the mixture so
    far, the weight left for what is deeper, and the estimate of bytes that have no
    deeper node."""

    def __init__(self, keys: np.ndarray, zero: np.ndarray, one: np.ndarray, end0: np.ndarray, end1: np.ndarray, logs: np.ndarray):
        order = np.argsort(keys)
        keys, zero, one, end0, end1, logs = (x[order] for x in (keys, zero, one, end0, end1, logs))
        below = logs + _estimate(end0, end1)
        three = keys >= 1 << 32
        levels = [(keys[three] - (1 << 32), zero[three], one[three], below[three])]
        for up in range(3):  # from three bytes to none
            k, z, o, b = levels[-1]
            weighted = np.logaddexp(_HALF + _estimate(z, o), _HALF + b)
            k = k >> 16 << 8 | k & 255
            if not up:  # what hangs under two bytes
                k, z, o, weighted = (np.concatenate(x) for x in ((k, keys[~three]), (z, zero[~three]), (o, one[~three]), (weighted, below[~three])))
            found, sums = _sums(k, z, o, weighted)
            order = np.argsort(found)
            levels.append((found[order], *(x[order] for x in sums)))
        self.keys, self.mixed, self.left = [], [], []
        for depth, (k, z, o, b) in enumerate(reversed(levels)):
            weighted = np.logaddexp(_HALF + _estimate(z, o), _HALF + b)
            own = np.exp(_HALF + _estimate(z, o) - weighted)
            share, left = np.zeros(len(k)), np.ones(len(k))
            if depth:
                above = np.searchsorted(self.keys[-1], k >> 16 << 8 | k & 255)
                share, left = self.mixed[-1][above], self.left[-1][above]
            self.keys.append(k)
            self.mixed.append(share + left * own * _next(z, o))
            self.left.append(left * (1 - own))
        self.ends = np.full(len(self.keys[3]), 0.5), np.full(len(self.keys[2]), 0.5)
        self.ends[0][:] = _next(end0[three], end1[three])
        self.ends[1][np.searchsorted(self.keys[2], keys[~three])] = _next(end0[~three], end1[~three])

    def chance(self, node: np.ndarray, place: np.ndarray, deep: np.ndarray) -> np.ndarray:
        """The chance of a 1, given the deepest nodes' (NaN: none)."""
        out = np.full(len(node), 0.5)
        kept = node >= 1 << 24
        left = np.arange(len(node))
        for depth in (3, 2, 1, 0):
            keys = self.keys[depth]
            at = left if depth < 3 else np.flatnonzero(kept)
            bytes_ = node[at] & 0xFFFFFF
            up = np.where(kept[at], 3, 2) - depth
            key = bytes_ >> (8 * up) << 8 | place[at]
            slot = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            found = keys[slot] == key if len(keys) else np.zeros(len(at), bool)
            of, slot = at[found], slot[found]
            own = np.full(len(of), 0.5)  # an unseen child is even
            if depth > 1:
                lowest = up[found] == 0
                ends = self.ends[3 - depth][slot]
                own = np.where(lowest, np.where(np.isnan(deep[of]), ends, deep[of]), 0.5)
            out[of] = self.mixed[depth][slot] + self.left[depth][slot] * own
            if depth == 3:
                rest = np.ones(len(node), bool)
                rest[of] = False
                left = np.flatnonzero(rest)
            else:
                left = at[~found]
        return np.clip(out, 1e-12, 1 - 1e-12)


def code_lengths(tokens: pa.Array, n: np.ndarray, begin: np.ndarray, kept: np.ndarray, top: Top) -> np.ndarray:
    """log10 probability of each of some sorted units."""
    p = Places(tokens, begin, kept)
    weight = n[p.unit].astype(np.float64)
    out = np.zeros(len(n))
    deep = np.flatnonzero(p.deep >= 0)
    for k in range(8):
        place, bit = p.decision(k)
        group, found = pd.factorize(p.deep[deep] << 8 | place[deep])
        zero = np.bincount(group, weights=weight[deep] * (1 - bit[deep]), minlength=len(found))
        one = np.bincount(group, weights=weight[deep] * bit[deep], minlength=len(found))
        own = np.full(len(p.unit), np.nan)
        own[deep] = _next(zero, one)[group]
        chance = top.chance(p.parent, place, own)
        out += np.bincount(p.unit, weights=np.log10(np.where(bit == 1, chance, 1 - chance)), minlength=len(n))
    return out


def _counted(docs: DataFrame, tokens: Callable = units) -> DataFrame:
    """(token, n, trained) of every distinct unit of docs (text__, held_out)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.steps(batch, "text__", 2 * blocks.STEP_BYTES):
                codes, distinct, ends = tokens(part.column("text__"))
                train = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(ends))
                n = np.bincount(codes, minlength=len(distinct))
                trained = np.bincount(codes[train], minlength=len(distinct))
                for lo in range(0, len(n), 1 << 16):
                    own = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([distinct[own].cast(pa.binary()), pa.array(n[own]), pa.array(trained[own])], ["token", "n", "trained"])

    rows = docs.select("text__", "held_out").mapInArrow(blocks.frugal(count), "token binary, n long, trained long")
    return rows.groupBy("token").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def _words(counts: DataFrame) -> DataFrame:
    """(token, n, trained, known: how often the word is in training texts) of all
    units; known is null where a unit has no whole word."""
    size = F.octet_length("token")
    first, last = F.hex(F.substring("token", 1, 1)), F.hex(F.substring("token", -1, 1))
    closed = last.isin("20", "09", "0A", "0B", "0C", "0D", f"{END:02X}")
    # a unit with a whole word, a long word's digest; others are keys of their own
    word = F.when(first == f"{DIGEST:02X}", F.col("token")).when((size > 1) & closed & (first != f"{ON:02X}"), F.col("token").substr(F.lit(1), size - 1))
    marked = counts.withColumn("word", F.coalesce(word, F.concat(F.unhex(F.lit("00FF")), "token"))).withColumn("whole", word.isNotNull())
    # a word has a unit for each kind of white space behind it
    own = marked.groupBy("word").agg(F.sum("trained").alias("known"), F.first("whole").alias("whole"), F.collect_list(F.struct("token", "n", "trained")).alias("own"))
    return own.select("word", F.when(F.col("whole"), F.col("known")).alias("known"), "own")


def _dealt(table: DataFrame) -> DataFrame:
    """The units with key and begin: those that share their first `begin` bytes have
    one key, and no key has many more than GROUP units, unless BEGINS ends."""
    out = table.withColumn("begin", F.lit(BEGINS[0]))
    for more in BEGINS[1:]:
        keyed = out.withColumn("key", F.expr("substring(token, 1, begin)"))
        full = blocks.cut(keyed.groupBy("key", "begin").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select(F.col("key").alias("full")))
        found = full.count()
        if not found:
            break
        full = F.broadcast(full) if found <= 100_000 else full
        out = keyed.join(full, F.col("key") == F.col("full"), "left")
        out = out.withColumn("begin", F.when(F.col("full").isNotNull(), more).otherwise(F.col("begin"))).drop("key", "full")
    return out.withColumn("key", F.expr("substring(token, 1, begin)"))


def _in_groups(dealt: DataFrame, work, schema: str) -> DataFrame:
    """work(table) over whole groups of units, sorted, about CHUNK units at a time;
    work(None) closes a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, one = 0, work()
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                table = pa.Table.from_batches(held).combine_chunks()
                key = blocks.coded(table.column("key").combine_chunks().cast(pa.large_binary()))[0]
                to = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
                if to:
                    yield from one(table.slice(0, to).combine_chunks())
                    held = [table.slice(to).combine_chunks().to_batches()[0]]
                    size = held[0].num_rows
        if size:
            yield from one(pa.Table.from_batches(held).combine_chunks())
        yield from one(None)

    parts = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return dealt.repartition(parts, "key").sortWithinPartitions("key", "token").mapInArrow(blocks.frugal(run), schema)


def _columns(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    return table.column("token").combine_chunks(), table.column("trained").to_numpy(), table.column("begin").to_numpy().astype(np.int64)


def _kept(table: DataFrame) -> np.ndarray:
    """Contexts of three bytes that have a node: the KEEP most frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("trained").to_numpy()
            seen = np.flatnonzero(n > 0)
            p = Places(batch.column("token").take(pa.array(seen)), np.zeros(len(seen), np.int64), np.arange(0))
            found, (times,) = _sums(p.three, n[seen][p.unit])
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64))], ["token", "n"])

    rows = table.mapInArrow(blocks.frugal(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return np.sort(frequent.head(rows, KEEP).column("token").to_numpy())


def unit_table(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(token, n, words, base, known, score) of every unit of docs (text__, held_out):
    what it adds to a text's sums. Also the training words, and distinct ones."""
    own = blocks.stored(_words(_counted(docs)))
    total, distinct = own.agg(F.coalesce(F.sum("known"), F.lit(0)), F.count(F.when(F.col("known") > 0, 1))).first()
    table = own.select("known", F.explode("own").alias("u")).select("u.*", "known")
    bare = table.where(F.hex(F.substring("token", 1, 1)) != f"{DIGEST:02X}")
    sc = docs.sparkSession.sparkContext
    kept = sc.broadcast(_kept(bare.where("trained > 0").select("token", "trained")))
    dealt = _dealt(bare)

    def gather():
        held: list[tuple] = []

        def one(part: pa.Table | None) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if part is not None:
                held.append(statistics(*_columns(part), kept.value))
            if held and (part is None or sum(len(k) for k, _ in held) > 1 << 19):
                keys, sums = _sums(np.concatenate([k for k, _ in held]), *(np.concatenate([s[i] for _, s in held]) for i in range(5)))
                held = [(keys, sums)]
                if part is None:
                    for lo in range(0, len(keys), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (keys, *sums)], ["k", "n0", "n1", "e0", "e1", "logs"])

        return one

    sums = ("n0", "n1", "e0", "e1", "logs")
    found = _in_groups(dealt.select("token", "trained", "begin", "key"), gather, "k long, " + ", ".join(f"{c} double" for c in sums))
    # a row for each decision of at most 2 ** 16 + KEEP nodes
    found = found.groupBy("k").agg(*(F.sum(c).alias(c) for c in sums)).toArrow()
    top = sc.broadcast(Top(*(found.column(c).to_numpy() for c in ("k", *sums))))

    def score_units():
        def one(part: pa.Table | None) -> Iterator[pa.RecordBatch]:
            if part is not None:
                tokens, trained, begin = _columns(part)
                made = pa.array(code_lengths(tokens, trained, begin, kept.value, top.value))
                table = part.append_column("score", made).select(["token", "n", "known", "score"])
                yield from table.to_batches(1 << 16)

        return one

    scored = _in_groups(dealt.select("token", "trained", "begin", "key", "n", "known"), score_units, "token binary, n long, known long, score double")
    long = table.where(F.hex(F.substring("token", 1, 1)) == f"{DIGEST:02X}").select("token", "n", "known", F.lit(0.0).alias("score"))
    known = F.coalesce("known", F.lit(0))
    return blocks.stored(scored.unionByName(long).select(
        "token", "n", F.col("known").isNotNull().cast("long").alias("words"), F.log10(known + F.lit(1.0)).alias("base"), (known > 0).cast("long").alias("seen"), "score",
    )), int(total), int(distinct)


def score(docs: DataFrame, training: Column | str, text: str = "text") -> DataFrame:
    """All columns but the text, with held_out (not training), n_tokens, n_known,
    train_tokens, base_score and score (log10 of the lower-cased text's
    probability with its end) and code_length (bits a byte, end included)."""
    blocks.small_batches(docs.sparkSession)
    added = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "code_length")
    rest = blocks.others(docs, text, added)
    training = F.expr(training) if isinstance(training, str) else training
    marked = docs.withColumn("held__", ~F.coalesce(training, F.lit(False)))
    docs, carried = blocks.renamed(marked, [*rest, marked.schema["held__"]], text)
    held = carried[-1].name
    texts = docs.withColumn("held_out", F.col(held))
    table, total, distinct = unit_table(texts)
    end = texts.where("NOT held_out").count()
    total, distinct = total + end, distinct + bool(end)

    def sizes(part: pa.Array) -> list[pa.Array]:
        return [pa.array(np.diff(blocks.raw(part)[1]) + 1)]

    values = {"words": "long", "base": "double", "seen": "long", "score": "double"}
    out = frequent.summed(docs, "text__", units, table, values, carried, sizes, "bytes__ long")
    base = F.col("base") + F.log10(F.lit(float(end + 1))) - (F.col("words") + 1) * F.log10(F.lit(float(total + distinct + 1)))
    return out.select(
        *blocks.restored(rest, carried), F.col(held).alias("held_out"), (F.col("words") + 1).alias("n_tokens"), (F.col("seen") + F.lit(1 if end else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("bytes__")).alias("code_length"),
    )
