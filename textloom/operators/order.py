"""Running totals and positions over a whole table.

A window without partitions runs in one task. Here a slim table (order, strata,
value) is written once; from it come bounds that deal the order into ranges, the
sums of ranges and, by a small window over those, what lies before each range. The
rows themselves are then read once and shuffled once, by range, where each adds its
range's offset (a broadcast look-up of counted size) to a window inside the range. A
budget needs no shuffle of its rows at all: `Totals.ends` finds the row where a
target is reached, and the rows up to it are a filter. Any bounds give the same
result; they only balance the work.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources import scratch

#: Ranges with bounds of their own; of a larger table each is cut into even parts.
RANGES = 64
#: Rows of a range, and of the task that rows meet in, which may be wide: as many
#: ranges and tasks as the table needs.
ROWS, TASK_ROWS = 2_000, 25_000
#: Rows of offsets or ends that are broadcast; more are joined by a shuffle.
LOOKUP = 1 << 17


@dataclass
class Totals:
    """Sums by range of a table's order, within strata."""

    order: str
    strata: tuple[str, ...]
    value: Column
    part: Column  # a row's range
    slim: DataFrame  # order, strata, value__, part__
    offsets: DataFrame  # strata, part__, total__, offset__
    ranges: int  # rows of offsets
    rows: int = 0

    def _joined(self, df: DataFrame, small: DataFrame, rows: int, keys: Sequence[str], how: str = "inner") -> DataFrame:
        """df with the columns of a small table that has its keys, told from df's own."""
        named = small.select(*(F.col(k).alias(f"{k}__o") for k in keys), *(c for c in small.columns if c not in keys))
        same = [F.col(k).eqNullSafe(F.col(f"{k}__o")) for k in keys]
        return df.join(F.broadcast(named) if rows <= LOOKUP else named, same, how).drop(*(f"{k}__o" for k in keys))

    def attach(self, df: DataFrame, name: str) -> DataFrame:
        """df, of which this was made, with the sum of the rows before each row."""
        keys = [*self.strata, "part__"]
        inside = Window.partitionBy(*keys).orderBy(self.order).rowsBetween(Window.unboundedPreceding, -1)
        rows = df.withColumn("part__", self.part)
        tasks = -(-self.rows // TASK_ROWS)
        if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            rows = rows.repartition(tasks, *keys)
        rows = rows.withColumn("before__", F.coalesce(F.sum(self.value).over(inside), F.lit(0)))
        rows = self._joined(rows, self.offsets.drop("total__"), self.ranges, keys)
        columns = [c for c in df.columns if c != name]
        return rows.select(*(f"`{c}`" for c in columns), (F.col("before__") + F.col("offset__")).cast("long").alias(name))

    def ends(self, target: Column) -> DataFrame:
        """(strata, last__, value__, room__): the row of each stratum at which the
        values, none of them negative, reach a positive target, its value and what is
        left for it. A stratum that doesn't reach the target has no row."""
        keys = [*self.strata, "part__"]
        here = self.offsets.where((F.col("offset__") < target) & (F.col("offset__") + F.col("total__") >= target)).select(*keys, "offset__")
        inside = Window.partitionBy(*keys).orderBy(self.order).rowsBetween(Window.unboundedPreceding, -1)
        rows = self._joined(self.slim, here, self.ranges, keys)
        rows = rows.withColumn("before__", F.col("offset__") + F.coalesce(F.sum("value__").over(inside), F.lit(0)))
        found = rows.where((F.col("before__") < target) & (F.col("before__") + F.col("value__") >= target))
        return scratch.table(found.select(*self.strata, F.col(self.order).alias("last__"), "value__", (target - F.col("before__")).alias("room__")))

    def until(self, df: DataFrame, target: int) -> DataFrame:
        """df's rows (of each stratum) before the target is reached, with room__: what
        is left for the row that reaches it, null for others."""
        ends = self.ends(F.lit(target)).drop("value__")
        if self.strata:
            rows = self._joined(df, ends, ends.count(), self.strata, "left").where(F.col("last__").isNull() | (F.col(self.order) <= F.col("last__")))
            return rows.withColumn("room__", F.when(F.col(self.order) == F.col("last__"), F.col("room__"))).drop("last__")
        end = ends.first()
        if end is None:
            return df.withColumn("room__", F.lit(None).cast("long"))
        last = F.lit(end["last__"])  # a literal, so that the filter reaches the scan
        return df.where(F.col(self.order) <= last).withColumn("room__", F.when(F.col(self.order) == last, F.lit(end["room__"])))

    def sums(self) -> DataFrame:
        """(strata, total__) of all rows."""
        return self.offsets.groupBy(*self.strata).agg(F.sum("total__").alias("total__"))


def totals(df: DataFrame, value: Column | str, order: str, strata: Sequence[str] = (), rows_per_range: int = ROWS) -> Totals:
    """Sums by range of `value` in the order of a numeric column without ties. df is
    read once, for its order, strata and value only."""
    value = F.col(value) if isinstance(value, str) else value
    slim = scratch.table(df.select(order, *strata, value.alias("value__")))
    # one pass for the number of rows and for as many bounds as a range each may need
    bounds = F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 10_000)
    seen = slim.agg(F.count("*").alias("n"), bounds.alias("bounds"), F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    every = max(1, RANGES * rows_per_range // max(1, seen["n"]))
    part, inner = F.lit(0), sorted(set((seen["bounds"] or [])[every - 1 :: every]))
    for b in inner:
        part = part + (F.col(order) > F.lit(b)).cast("int")
    fine = -(-seen["n"] // (RANGES * rows_per_range))
    if fine > 1:  # even parts of each range, in the order of the column
        edges = [float(x) for x in (seen["lo"], *inner, seen["hi"])]
        lows = F.array(*map(F.lit, edges[:-1]))
        steps = F.array(*(F.lit(max(b - a, 1e-300) / fine) for a, b in zip(edges, edges[1:])))
        at = F.floor((F.col(order).cast("double") - F.get(lows, part)) / F.get(steps, part))
        part = part * fine + F.greatest(F.least(at, F.lit(fine - 1)), F.lit(0)).cast("int")
    slim = slim.withColumn("part__", part)
    sums = slim.groupBy(*strata, "part__").agg(F.sum("value__").alias("total__"))
    ahead = Window.partitionBy(*strata).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.table(sums.withColumn("offset__", F.coalesce(F.sum("total__").over(ahead), F.lit(0))))
    return Totals(order, tuple(strata), value, part, slim, offsets, offsets.count(), seen["n"])


def running_total(
    df: DataFrame, value: Column | str, order: str, name: str, strata: Sequence[str] = (), rows_per_range: int = ROWS
) -> DataFrame:
    """df with `name`, the sum of `value` over the rows before each row in the order
    of the numeric column `order` (within strata), which must have no ties."""
    return totals(df, value, order, strata, rows_per_range).attach(df, name)


def position(df: DataFrame, order: str, name: str, strata: Sequence[str] = ()) -> DataFrame:
    """df with `name`, each row's zero-based position in the order (within strata)."""
    return running_total(df, F.lit(1), order, name, strata)


def hash_order(key: Column) -> Column:
    """A number that sorts as an MD5 (lower-case hex) does, but for its tail."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")
