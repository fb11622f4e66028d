"""Seeded orders of numbered rows without a sort.

A keyed bijection of 0..n-1 gives each row's place in an epoch from its number
alone, and each place's number: rounds on two digits of a number (its quotient and
remainder by about the root of n) add a keyed function of one digit to the other,
and a result beyond n goes through the rounds again. An epoch, a batch or a stage
is then a filter on a computed place, or a look-up of computed numbers; nothing is
shuffled, and any epoch's any batch costs the same.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.checks import positive
from textloom.functions.text import seeded
from textloom.operators.order import LOOKUP, position
from textloom.sources import scratch

ROUNDS = 6
#: The two greatest primes below 2 ** 32: products with multipliers below 2 ** 31 fit a
#: long, and a product modulo one and then the other is linear in neither.
PRIME, SECOND = 4_294_967_291, 4_294_967_279
#: Times that a number may go through the rounds: of n >= 4096 numbers none needs
#: more but with a chance below 10 ** -100; of fewer, as many as can be out of range.
WALK = 64
#: Numbers that a filter names; more are joined.
NAMED = 4_096


@dataclass(frozen=True)
class Order:
    """The order of 0..n-1 that a seed and an epoch stand for."""

    n: int
    seed: int
    epoch: int = 0

    def __post_init__(self) -> None:
        if self.n < 1 or self.n >= 1 << 52:
            raise ValueError("n must be positive and below 2 ** 52")

    @property
    def sizes(self) -> tuple[int, int]:
        """How many values the two digits have; their product is n or little more."""
        a = math.isqrt(self.n - 1) + 1
        return a, -(-self.n // a)

    @property
    def keys(self) -> list[tuple[int, int, int]]:
        """Multiplier, addend, multiplier of each round."""
        out = []
        for r in range(ROUNDS):
            h = hashlib.sha256(f"{self.seed}-{self.epoch}-{r}".encode()).digest()
            a, b, c = (int.from_bytes(h[i : i + 8], "big") for i in (0, 8, 16))
            out.append((a % ((1 << 31) - 2) + 1, b % PRIME, c % ((1 << 31) - 2) + 1))
        return out

    @property
    def walk(self) -> int:
        a, b = self.sizes
        return min(a * b - self.n + 1, WALK)

    def _mixed(self, x, key: tuple[int, int, int]):
        """A round's function of a digit, for columns and for integers."""
        a, b, c = key
        return (x * a + b) % PRIME * c % SECOND

    def _through(self, x, back: bool):
        """Once through the rounds, forward or back."""
        sizes = self.sizes
        # subtracted first, so that the quotient is whole, and exact as a double too
        rest = x % sizes[1]
        digits = [((x - rest) / sizes[1]).cast("long") if isinstance(x, Column) else x // sizes[1], rest]
        steps = list(enumerate(self.keys))
        for r, key in reversed(steps) if back else steps:
            side = r % 2
            add = self._mixed(digits[1 - side], key) % sizes[side]
            digits[side] = (digits[side] + (sizes[side] - add if back else add)) % sizes[side]
        return digits[0] * sizes[1] + digits[1]

    def _walked(self, x: Column, back: bool) -> Column:
        """Through the rounds until the result is in range again."""
        once = self._through(x.cast("long"), back)
        # rare: one number in about the root of n
        more = F.aggregate(F.sequence(F.lit(1), F.lit(self.walk)), once, lambda v, _: F.when(v < self.n, v).otherwise(self._through(v, back)))
        stuck = F.raise_error(F.lit("the order's walk is too long")).cast("long")
        return F.when(once < self.n, once).otherwise(F.transform(F.array(more), lambda v: F.when(v < self.n, v).otherwise(stuck))[0])

    def place(self, number: Column | str) -> Column:
        """The place of a row's number (0..n-1)."""
        return self._walked(F.col(number) if isinstance(number, str) else number, False)

    def number(self, place: Column | str) -> Column:
        """The number of the row at a place."""
        return self._walked(F.col(place) if isinstance(place, str) else place, True)

    def place_of(self, number: int) -> int:
        while True:
            number = self._through(number, False)
            if number < self.n:
                return number

    def number_at(self, place: int) -> int:
        while True:
            place = self._through(place, True)
            if place < self.n:
                return place


def numbered(df: DataFrame, order: str, name: str = "number") -> tuple[DataFrame, int]:
    """df with its rows' numbers 0..n-1 in the order of a numeric column without ties,
    stored in that order, and n. Made once; every epoch reads it."""
    held = scratch.table(position(df, order, name).repartitionByRange(name).sortWithinPartitions(name))
    return held, held.count()


def epoch_places(rows: DataFrame, order: Order, batch: int, number: str = "number") -> DataFrame:
    """rows with the batch and the place in it that the order's epoch gives them; the
    last batch may be short. No shuffle."""
    positive(batch=batch)
    at = rows.withColumn("at__", order.place(number))
    return at.withColumn("batch", F.floor(F.col("at__") / batch).cast("long")).withColumn("place", F.col("at__") % batch).drop("at__")


def batches(rows: DataFrame, order: Order, batch: int, first: int, count: int = 1, number: str = "number") -> DataFrame:
    """The rows of `count` batches from the first on, with batch and place: their
    numbers are computed from their places. A few are named in a filter that reaches
    the scan; more are looked up."""
    positive(batch=batch, count=count)
    lo, hi = max(0, first) * batch, min((first + count) * batch, order.n)
    if hi - lo <= NAMED:
        kept = rows.where(F.col(number).isin(*(order.number_at(p) for p in range(lo, hi)))) if hi > lo else rows.where("false")
    else:
        wanted = rows.sparkSession.range(lo, hi).select(order.number("id").alias("wanted__"))
        wanted = F.broadcast(wanted) if hi - lo <= LOOKUP else wanted
        kept = rows.join(wanted, F.col(number) == F.col("wanted__"), "left_semi")
    return epoch_places(kept, order, batch, number)


def buffered(df: DataFrame, order: str, key: str, seed: int, buffer: int, name: str = "pos") -> DataFrame:
    """df with its places in a shuffle by buffers: runs of `buffer` rows in the order of
    a numeric column come in a seeded order, and the rows of a run in one of their own.
    No row moves further than its run's shuffle, and nothing is sorted as a whole."""
    positive(buffer=buffer)
    rows, n = numbered(df, order, "number__")
    if not n:
        return df.withColumn(name, F.lit(None).cast("long"))
    runs = -(-n // buffer)
    runs_order = Order(runs, seed)
    run = F.floor(F.col("number__") / buffer).cast("long")
    inside = F.row_number().over(Window.partitionBy("run__").orderBy(seeded(seed, key), "number__")) - 1
    placed = rows.withColumn("run__", run).withColumn("at__", runs_order.place("run__")).withColumn("inside__", inside)
    # the last run may be short: what comes behind it moves up
    last = runs_order.place_of(runs - 1)
    short = F.when(F.col("at__") > last, runs * buffer - n).otherwise(0)
    return placed.withColumn(name, F.col("at__") * buffer + F.col("inside__") - short).drop("number__", "run__", "at__", "inside__")


def stage(rows: DataFrame, order: Order, batch: int, index: int, fraction: float, number: str = "number") -> DataFrame:
    """The rows of one stage of an epoch that runs in stages of a fraction of its batches."""
    positive(batch=batch, fraction=fraction)
    size = max(1, math.ceil(-(-order.n // batch) * fraction))
    return batches(rows, order, batch, index * size, size, number)
