"""Seeded samples, splits, batches and draws.

Orders come from the MD5 of seed and key, so they are the same on any cluster and
in any engine; ties can't occur for distinct keys.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.checks import positive, shares
from textloom.functions.text import seeded, uniform
from textloom.operators.corpus import balanced_quota
from textloom.operators.order import hash_order, position, totals


def shuffled(df: DataFrame, key: str, seed: int, name: str = "pos") -> DataFrame:
    """df with its zero-based position in a seeded order."""
    return position(df.withColumn("order__", hash_order(seeded(seed, key))), "order__", name).drop("order__")


#: Rows of a sample that may pass one task.
TOP = 10_000
#: Bits of a hash that one histogram tells apart.
BAR_BITS = 14


def sample(df: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """`size` rows without replacement: the least in a seeded order. A small sample is
    a top-k; of a larger one the greatest hash is found first, so that it is a filter."""
    if size <= TOP:
        return df.withColumn("order__", seeded(seed, key)).orderBy("order__").limit(size).drop("order__")
    limit = threshold(df.select(seeded(seed, key).alias("hash__")), "hash__", size)
    if limit is None:
        return df
    last, more, ties = limit
    mine = seeded(seed, key)
    if more == ties:
        return df.where(mine <= F.lit(last))
    # rows that share their key: as many as are left
    return df.where(mine < F.lit(last)).unionByName(df.where(mine == F.lit(last)).limit(more))


def threshold(hashes: DataFrame, column: str, size: int) -> tuple[str, int, int] | None:
    """(hash, how many of its rows belong to the sample, how many it has): the hash (hex,
    evenly spread) that the `size`-th least row has; None if there are no more rows than
    that. Histograms of BAR_BITS bits each narrow the range until a top-k of what is in
    it is small; only bars reach the driver."""
    number = F.conv(F.substring(column, 1, 15), 16, 10).cast("long")
    shift, left, rows = 60, size, hashes
    low = 0  # the range is [low, low + 2 ** shift)
    while True:
        step = max(0, shift - BAR_BITS)
        bars = rows.groupBy(F.shiftright(number - F.lit(low), step).alias("bar")).agg(F.count("*").alias("n")).collect()
        if shift == 60 and sum(r["n"] for r in bars) <= size:
            return None
        for r in sorted(bars, key=lambda r: r["bar"]):
            if r["n"] >= left:
                break
            left -= r["n"]
        low, shift = low + (r["bar"] << step), step
        rows = rows.where(number.between(low, low + (1 << shift) - 1))
        if left <= TOP or shift == 0:
            break
    found = rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(column).limit(min(left, TOP)).collect()
    for r in found:  # keys are distinct as a rule: a row each
        if r["n"] >= left:
            return r[column], left, r["n"]
        left -= r["n"]
    raise ValueError("more than TOP hashes share 60 bits")


def least(df: DataFrame, order: str, size: int) -> DataFrame:
    """The `size` rows that come first in a numeric column without ties; no task sees
    more of them than its range's."""
    return totals(df, F.lit(1).cast("long"), order).until(df, size).drop("room__")


def page_sample(df: DataFrame, order: str, seed: int, limit: int, page_rows: int = 100, fewest_pages: int = 20) -> DataFrame:
    """Up to `limit` rows from whole pages taken in a seeded order, of at most
    max(fewest_pages, 5 * ceil(limit / page_rows)) pages."""
    positive(limit=limit, page_rows=page_rows)
    pages = max(fewest_pages, 5 * math.ceil(limit / page_rows))
    paged = position(df, order, "ord__").withColumn("page", F.floor(F.col("ord__") / page_rows).cast("long"))
    ranked = paged.select("page").distinct().withColumn("order__", seeded(seed, "page")).orderBy("order__").limit(pages)
    nth = ranked.withColumn("nth__", F.row_number().over(Window.orderBy("order__")) - 1).drop("order__")  # `pages` rows
    near = paged.join(F.broadcast(nth), "page").withColumn("rank__", F.col("nth__") * page_rows + F.col("ord__") % page_rows)
    return least(near, "rank__", limit).drop("ord__", "nth__", "rank__")


def full_page_sample(df: DataFrame, order: str, seed: int, limit: int, **pages: int) -> DataFrame:
    """page_sample that raises if its pages hold fewer than `limit` rows; adds pos,
    the place of a row in a seeded order."""
    if seed < 0:
        raise ValueError("the seed must not be negative")
    out = page_sample(df, order, seed, limit, **pages)
    found = out.count()
    if found < limit:
        raise ValueError(f"the pages hold {found} rows of {limit}")
    return shuffled(out, order, seed)


def balanced_merge(first: DataFrame, second: DataFrame, key: str, seed: int, limit: int | None = None) -> DataFrame:
    """Rows of both tables with side (0 or 1) and pos, their place in a seeded order:
    all of them, or `limit` of them, half from each; what one lacks the other fills."""
    n = (first.count(), second.count())
    take = n if limit is None or limit >= sum(n) else balanced_quota(*n, limit)
    sides = [sample(df, key, seed, k).withColumn("side", F.lit(i)) if k < m else df.withColumn("side", F.lit(i)) for i, (df, k, m) in enumerate(zip((first, second), take, n))]
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    return shuffled(both.withColumn("key__", F.concat_ws("-", "side", F.col(key).cast("string"))), "key__", seed).drop("key__")


def split(df: DataFrame, key: str, seed: int, share: float, within: str | None = None) -> DataFrame:
    """df with `part`: validation for exactly max(1, floor(rows * share)) rows (of
    each group), train for the rest."""
    shares(share=share)
    group = [within] if within else []
    placed = position(df.withColumn("order__", hash_order(seeded(seed, key))), "order__", "pos__", group)
    sizes = df.groupBy(*group).agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(share))).alias("take__"))
    # without groups there is one row of sizes
    joined = placed.join(sizes, within) if within else placed.crossJoin(F.broadcast(sizes))
    return joined.withColumn("part", F.when(F.col("pos__") < F.col("take__"), "validation").otherwise("train")).drop("order__", "pos__", "take__")


def split_sources(df: DataFrame, key: str, source: str, sources: Sequence[str], seed: int, share: float) -> DataFrame:
    """df with `part`, for rows of the given sources: each source is split by itself,
    in an order seeded with seed + its index. A source without training rows left
    raises."""
    shares(share=share)
    index = F.array_position(F.array(*map(F.lit, sources)), F.col(source)) - 1
    known = df.where(F.col(source).isin(*sources))
    order = hash_order(F.md5(F.concat((F.lit(seed) + index).cast("string"), F.lit("-"), F.col(key).cast("string"))))
    placed = position(known.withColumn("order__", order), "order__", "pos__", [source])
    sizes = known.groupBy(source).agg(F.count("*").alias("n__"))  # a row for each of the sources
    take = F.greatest(F.lit(1), F.floor(F.col("n__") * F.lit(share)))
    left = F.when(F.col("n__") > take, take).otherwise(F.raise_error(F.concat(F.lit("no training rows are left of "), F.col(source))).cast("long"))
    joined = placed.join(F.broadcast(sizes), source)
    return joined.withColumn("part", F.when(F.col("pos__") < left, "validation").otherwise("train")).drop("order__", "pos__", "n__")


def validation_draws(df: DataFrame, key: str, source: str, ratios: Mapping[str, float], seed: int, share: float, draws: int | None = None) -> DataFrame:
    """(draw, columns of df): rows of the sources' validation parts with replacement,
    a source by its ratio; as many as the parts have unless `draws` says so."""
    part = split_sources(df, key, source, list(ratios), seed, share).where("part = 'validation'").drop("part")
    return ratio_draws(part, source, key, ratios, part.count() if draws is None else draws, seed + 1000)


def epoch_batches(df: DataFrame, key: str, seed: int, epoch: int, batch: int) -> DataFrame:
    """df with the epoch's batch number and place in it; the last batch may be short."""
    positive(batch=batch)
    placed = shuffled(df, key, seed + epoch, "pos__")
    return placed.withColumn("batch", F.floor(F.col("pos__") / batch).cast("long")).withColumn("place", (F.col("pos__") % batch).cast("long")).drop("pos__")


def stage_slice(df: DataFrame, total: int, stage: int, fraction: float, batch: str = "batch") -> DataFrame:
    """The batches that one stage of a resumed run works on."""
    positive(fraction=fraction)
    size = max(1, math.ceil(total * fraction))
    return df.where((F.col(batch) >= stage * size) & (F.col(batch) < (stage + 1) * size))


def source_ratios(optional: Mapping[str, float], base: str) -> dict[str, float]:
    """Shares of all sources; the base has what the others leave."""
    left = round(1 - sum(optional.values()), 12)
    if left <= 0:
        raise ValueError("the optional sources' shares must leave some for the base")
    return {base: left, **optional}


def ratio_draws(df: DataFrame, source: str, order: str, ratios: Mapping[str, float], draws: int, seed: int) -> DataFrame:
    """(draw, columns of df): `draws` rows with replacement. A source is drawn by
    its share (a range join on the cumulated shares), a row evenly within it."""
    spark = df.sparkSession
    lo, rows = 0.0, []
    for s, share in ratios.items():
        rows.append((s, lo, lo + share))
        lo += share
    ranges = spark.createDataFrame(rows, "source__ string, lo__ double, hi__ double")
    placed = position(df, order, "nth__", [source])
    sizes = df.where(F.col(source).isin(*ratios)).groupBy(source).agg(F.count("*").alias("size__")).withColumnRenamed(source, "source__")
    # the shares hold a row per source: a nested loop over those is a lookup
    u = spark.range(draws).select(F.col("id").alias("draw"), (uniform(F.lit(str(seed)), F.lit("s"), F.col("id").cast("string")) * F.lit(lo)).alias("u"), uniform(F.lit(str(seed)), F.lit("r"), F.col("id").cast("string")).alias("v"))
    picked = u.join(F.broadcast(ranges), (F.col("u") >= F.col("lo__")) & (F.col("u") < F.col("hi__"))).join(F.broadcast(sizes), "source__")
    picked = picked.withColumn("nth__", F.floor(F.col("v") * F.col("size__")).cast("long"))
    # a row may be drawn often: the draws are the streamed side
    return picked.join(placed.withColumnRenamed(source, "source__"), ["source__", "nth__"]).drop("u", "v", "lo__", "hi__", "size__", "nth__").withColumnRenamed("source__", source)
