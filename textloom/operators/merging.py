"""Byte-pair merges of a corpus's distinct words, learnt from all of them.

Words are runs of symbol numbers between borders (0), in numpy blocks, and a merge is a
few array steps. The most frequent words are in one block on the driver, the others in
a stored table. The driver guesses the next merges from its own block and the table's
counts so far; one pass makes them in the table and gives what each changes there, and
guesses hold up to the first that exact counts of all words don't confirm. So the merges
are those of counting anew for each, and no sum comes from a part of the words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources import scratch

#: Words on the driver, about, and their characters at most; symbols of a block of the table.
HEAD, LENGTH, BLOCK = 1 << 18, 64, 1 << 18
#: Guesses of the first pass and of any, and merges after which the table is written anew.
FIRST, MOST, STEPS = 8, 64, 32

Block = tuple[np.ndarray, np.ndarray]  # symbols, from border to border, and each run's weight
Merge = tuple[int, int, int]  # left, right and new symbol
#: By symbol: what left and right neighbours new symbols have, before; and merges that follow another.
Change = tuple[np.ndarray, np.ndarray, int]


def tidy(symbols: np.ndarray, weights: np.ndarray) -> Block:
    """Without the runs that have no pair."""
    lengths = np.diff(np.flatnonzero(symbols == 0))
    kept = lengths > 2
    return symbols[np.append(np.repeat(kept, lengths), True)], weights[kept]


def cut(words: Sequence[str], n: np.ndarray, place: np.ndarray) -> Block:
    """Words, cut at characters that have no symbol."""
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = place[codes]
    word = np.cumsum(codes == 32)[symbols == 0][:-1] - 1
    return tidy(symbols, n[word])


def joined(blocks: Sequence[Block], kind: type) -> Block:
    border = np.zeros(1, kind)
    return np.concatenate([*(s[:-1] for s, _ in blocks), border]), np.concatenate([np.zeros(0, np.int64), *(w for _, w in blocks)])


class State:
    """A block during merges."""

    def __init__(self, symbols: np.ndarray, weights: np.ndarray) -> None:
        self.symbols, self.weights = symbols, weights
        self.run = np.cumsum(symbols == 0, dtype=np.int32) - np.int32(1)

    def copy(self) -> State:
        out = object.__new__(State)
        out.symbols, out.weights, out.run = self.symbols.copy(), self.weights, self.run
        return out

    def pairs(self) -> dict[tuple[int, int], int]:
        s = self.symbols.astype(np.int64)
        size = int(s.max(initial=0)) + 1
        inside = (s[:-1] > 0) & (s[1:] > 0)
        codes, back = np.unique((s[:-1] * size + s[1:])[inside], return_inverse=True)
        n = np.zeros(len(codes), np.int64)
        np.add.at(n, back, self.weights[self.run[:-1][inside]])
        return {divmod(c, size): k for c, k in zip(codes.tolist(), n.tolist())}

    def merge(self, left: int, right: int, new: int, size: int = 0) -> Change | None:
        """Merges a pair wherever it is, from the left; with a size, says what changed."""
        s = self.symbols
        at = np.flatnonzero(s == left)
        at = at[s[at + 1] == right]
        if left == right and len(at) > 1:  # every other one of those that overlap
            i = np.arange(len(at))
            begins = np.append(True, np.diff(at) != 1)
            at = at[(i - np.maximum.accumulate(np.where(begins, i, 0))) % 2 == 0]
        out = None
        if size:
            w = self.weights[self.run[at]]
            follows = np.append(at[1:] == at[:-1] + 2, False)[: len(at)]
            out = total(s[at - 1], w, size), total(s[at + 2][~follows], w[~follows], size), int(w[follows].sum())
        if len(at):
            s[at] = new
            kept = np.ones(len(s), bool)
            kept[at + 1] = False
            self.symbols, self.run = s[kept], self.run[kept]
        return out


def total(symbols: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Sums of weights by symbol, in integers."""
    high, low = np.divmod(weights, 1 << 24)
    out = np.bincount(symbols, low, size).astype(np.int64)
    return out + (np.bincount(symbols, high, size).astype(np.int64) << 24) if high.any() else out


def change(counts: Counter, made: Merge, by: Change) -> None:
    """Pair counts after a merge."""
    (a, b, new), (left, right, chained) = made, by
    counts[a, b] -= left.sum().item()
    for x in np.flatnonzero(left[1:]).tolist():
        n = left[x + 1].item()
        counts[x + 1, a] -= n
        counts[x + 1, new] += n
    if chained:  # their left neighbours have become new symbols, too
        counts[b, new] -= chained
        counts[new, new] += chained
    for y in np.flatnonzero(right[1:]).tolist():
        n = right[y + 1].item()
        counts[b, y + 1] -= n
        counts[new, y + 1] += n


def scaled(made: Merge, by: Change, counts: Counter, head: Counter) -> Change:
    """What a merge may change in all words, from what it changes in the driver's."""
    (a, b, _), (left, right, chained) = made, by
    ratio = lambda p: max(counts[p] / head[p], 1.0) if head[p] > 0 else 1.0
    more = [v.astype(float) for v in (left, right)]
    for x in np.flatnonzero(left[1:]).tolist():
        more[0][x + 1] *= ratio((x + 1, a))
    for y in np.flatnonzero(right[1:]).tolist():
        more[1][y + 1] *= ratio((b, y + 1))
    return more[0], more[1], chained * ratio((b, a))


def best(counts: Counter, names: Sequence[str], known: set[str]) -> tuple[int, int] | None:
    """The most frequent pair, of those the greatest by its strings, that makes a new token."""
    while counts and (n := max(counts.values())) > 0:
        ties = [p for p, k in counts.items() if k == n]
        new = [p for p in ties if names[p[0]] + names[p[1]] not in known]
        if new:
            return max(new, key=lambda p: (names[p[0]], names[p[1]]))
        for p in ties:  # for good: pairs are counted up only by the merge that makes one of them
            del counts[p]
    return None


def in_blocks(words: DataFrame, symbols: dict[str, int], kind: type) -> DataFrame:
    """(symbols, weights) of words (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.zeros(0x110000, kind)
        for c, i in symbols.items():
            place[ord(c)] = i
        place[ord(" ")] = 0  # lies between words
        held: list[Block] = []
        for batch in batches:
            held.append(cut(batch.column("word").to_pylist(), np.append(batch.column("n").to_numpy(), 0), place))
            if sum(len(s) for s, _ in held) >= BLOCK:
                yield stored(joined(held, kind))
                held = []
        if held:
            yield stored(joined(held, kind))

    return words.select("word", "n").mapInArrow(run, "symbols binary, weights binary")


def stored(block: Block) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block[0].tobytes()], pa.binary()), pa.array([block[1].tobytes()], pa.binary())], ["symbols", "weights"])


def loaded(symbols: bytes, weights: bytes, kind: type) -> Block:
    return np.frombuffer(symbols, kind).copy(), np.frombuffer(weights, np.int64)


def states(batch: pa.RecordBatch, kind: type) -> Iterator[State]:
    for s, w in zip(batch.column("symbols"), batch.column("weights")):
        yield State(*loaded(s.as_py(), w.as_py(), kind))


class Table:
    """The words that are not on the driver, in blocks, some merges behind."""

    def __init__(self, rows: DataFrame, kind: type) -> None:
        self.kind, self.at = kind, ""
        self.behind: list[Merge] = []
        self.write(rows)

    def write(self, rows: DataFrame) -> None:
        old, self.at = self.at, scratch.folder(rows.sparkSession)
        rows.write.parquet(self.at)
        self.rows = rows.sparkSession.read.schema(rows.schema).parquet(self.at)
        if old:
            scratch.remove(rows.sparkSession, old)

    def close(self) -> None:
        scratch.remove(self.rows.sparkSession, self.at)

    def pairs(self) -> Counter:
        kind = self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: Counter = Counter()
            for batch in batches:
                for state in states(batch, kind):
                    out.update(state.pairs())
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int32()), pa.array([p[1] for p in out], pa.int32()), pa.array(out.values(), pa.int64())], ["first", "second", "n"])

        sums = self.rows.mapInArrow(run, "first int, second int, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))
        return Counter({(r["first"], r["second"]): r["n"] for r in sums.collect()})

    def tried(self, guesses: list[Merge], size: int) -> list[Change]:
        """What each of the merges would change here, one after another."""
        kind, behind = self.kind, list(self.behind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(guesses), 2 * size + 1), np.int64)
            for batch in batches:
                for state in states(batch, kind):
                    for m in behind:
                        state.merge(*m)
                    for i, m in enumerate(guesses):
                        left, right, chained = state.merge(*m, size)
                        sums[i, :size] += left
                        sums[i, size:-1] += right
                        sums[i, -1] += chained
            step, slot = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(step, pa.int32()), pa.array(slot, pa.int32()), pa.array(sums[step, slot])], ["step", "slot", "n"])

        out = np.zeros((len(guesses), 2 * size + 1), np.int64)
        for r in self.rows.mapInArrow(run, "step int, slot int, n long").groupBy("step", "slot").agg(F.sum("n").alias("n")).collect():
            out[r["step"], r["slot"]] = r["n"]
        return [(v[:size], v[size:-1], v[-1].item()) for v in out]

    def follow(self, merges: list[Merge]) -> None:
        self.behind += merges
        if len(self.behind) < STEPS:
            return
        kind, behind = self.kind, self.behind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for state in states(batch, kind):
                    for m in behind:
                        state.merge(*m)
                    yield stored(tidy(state.symbols, state.weights))

        self.write(self.rows.mapInArrow(run, "symbols binary, weights binary"))
        self.behind = []


def split(words: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent words, about `most` of them and none longer than LENGTH, and the
    others. A histogram with eight bars a doubling says which; the bar that has too many
    is split by a hash."""
    bar = F.floor(F.log2("n") * 8).cast("int")
    own = F.length("word") <= LENGTH
    rows = {r["bar"]: r["rows"] for r in words.groupBy(F.when(own, bar).alias("bar")).agg(F.count("*").alias("rows")).collect()}
    long = rows.pop(None, 0)
    if sum(rows.values()) > most:
        left = most
        for least in sorted(rows, reverse=True):
            if rows[least] > left:
                break
            left -= rows[least]
        own &= (bar > least) | ((bar == least) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < left * (1 << 20) // rows[least]))
    elif not long:
        return words, None
    return words.where(own), words.where(~own)


def learn(words: DataFrame, alphabet: Sequence[str], tokens: int, most: int | None = None) -> list[tuple[str, str]]:
    """Ranked merges from words (word, n), until there are `tokens` tokens with the
    alphabet's, or no pair is left. Words end at characters outside the alphabet."""
    scratch.shipped(words.sparkSession)
    kind = np.uint16 if tokens < 1 << 16 else np.uint32
    names, known, size = ["", *alphabet], set(alphabet), tokens + 1
    merges: list[tuple[str, str]] = []
    symbols = {c: i for i, c in enumerate(names) if c}
    frequent, others = split(words.where(F.length("word") > 1), HEAD if most is None else most)
    rows = in_blocks(frequent, symbols, kind).collect()
    own = State(*joined([loaded(r["symbols"], r["weights"], kind) for r in rows], kind))
    table = None if others is None else Table(in_blocks(others, symbols, kind), kind)
    head = Counter(own.pairs())
    counts = head.copy()
    if table is not None:
        counts.update(table.pairs())
    tries = FIRST if table is not None else tokens
    while len(known) < tokens:
        guesses: list[tuple[Merge, Change]] = []
        state, maybe, its, called, had = own.copy(), counts.copy(), head.copy(), list(names), set(known)
        while len(guesses) < tries and len(had) < tokens and (pair := best(maybe, called, had)):
            made = (*pair, len(called))
            by = state.merge(*made, size)
            change(maybe, made, scaled(made, by, maybe, its))
            change(its, made, by)
            called.append(called[pair[0]] + called[pair[1]])
            had.add(called[-1])
            guesses.append((made, by))
        if not guesses:
            break
        elsewhere = table.tried([m for m, _ in guesses], size) if table is not None else [None] * len(guesses)
        right: list[Merge] = []
        for (made, by), more in zip(guesses, elsewhere):
            if best(counts, names, known) != made[:2]:
                break
            for c, d in ((head, by), (counts, by), (counts, more)):
                if d is not None:
                    change(c, made, d)
            merges.append((names[made[0]], names[made[1]]))
            names.append("".join(merges[-1]))
            known.add(names[-1])
            right.append(made)
        if len(right) == len(guesses):
            own = state
        else:
            for m in right:
                own.merge(*m)
        if table is not None:
            tries = min(MOST, 2 * len(right))
            table.follow(right)
    if table is not None:
        table.close()
    return merges
