"""Accounting: rates, gates, losses, best epochs, counters."""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.checks import positive


def learning_rate(step: Column, base: float, total: int, warmup: float = 0.03, floor: float = 0.1) -> Column:
    """The rate of a step (0..total-1): linear warm-up, then a cosine down to a share of
    the base."""
    if base <= 0 or total < 1 or not 0 <= warmup < 1 or not 0 <= floor <= 1:
        raise ValueError("base and total must be positive, warmup in [0, 1), floor in [0, 1]")
    warm = max(1, int(total * warmup)) if warmup > 0 else 0
    decay = max(1, total - warm)
    progress = F.least(F.lit(1.0), F.greatest(step - warm, F.lit(0)) / F.lit(float(max(1, decay - 1))))
    cosine = F.lit(base) * (F.lit(floor) + F.lit(1 - floor) * F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * progress)))
    return F.lit(float(base)) if total == 1 else F.when(step < warm, F.lit(base) * (step + 1) / F.lit(float(max(warm, 1)))).otherwise(cosine)


def learning_rates(spark: SparkSession, base: float, total: int, warmup: float = 0.03, floor: float = 0.1) -> DataFrame:
    """(step, rate) of all steps."""
    return spark.range(total).select(F.col("id").alias("step"), learning_rate(F.col("id"), base, total, warmup, floor).alias("rate"))


def tokens_per_parameter(windows: Column, length: int, epochs: int, parameters: int) -> Column:
    """Planned training tokens for each parameter."""
    positive(length=length, epochs=epochs, parameters=parameters)
    return windows * F.lit(length) * F.lit(epochs) / F.lit(float(parameters))


def gate(ok: Column, text: str) -> Column:
    """True, or an error that names the gate."""
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(text)).cast("boolean"))


def weighted_loss(batches: DataFrame, loss: str = "loss", tokens: str = "tokens", *keys: str) -> DataFrame:
    """Mean loss by batches and by trained tokens; batches without any don't count."""
    some = batches.where(F.col(tokens) > 0)
    return some.groupBy(*keys).agg(F.avg(loss).alias("batch_mean"), (F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)).alias("token_mean"))


def trained_loss(batches: DataFrame, loss: str = "loss", tokens: str = "tokens") -> DataFrame:
    """(token_mean, tokens) over all batches; without any trained token it raises."""
    total = F.sum(tokens)
    sums = batches.where(F.col(tokens) > 0).agg((F.sum(F.col(loss) * F.col(tokens)) / total).alias("mean"), F.coalesce(total, F.lit(0)).alias("tokens"))
    return sums.select(F.when(F.col("tokens") > 0, F.col("mean")).otherwise(F.raise_error(F.lit("there are no trained tokens")).cast("double")).alias("token_mean"), "tokens")


def cross_entropy(logits: Column, target: Column) -> Column:
    """Log-sum-exp minus the target's logit; null for an ignored target."""
    wide = F.transform(logits, lambda x: x.cast("double"))
    top = F.array_max(wide)
    total = F.aggregate(F.transform(wide, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return F.when(target >= 0, top + F.ln(total) - F.try_element_at(wide, (target + 1).cast("int")))


def best_epoch(losses: DataFrame, run: str, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """(run, best_epoch, best_loss, stale): the earliest least loss and the epochs
    since then that did not beat it."""
    first = F.struct(F.col(loss).alias("loss"), F.col(epoch).alias("epoch"))
    out = losses.groupBy(run).agg(F.min(first).alias("b"), F.max(epoch).alias("last"))
    return out.select(run, F.col("b.epoch").alias("best_epoch"), F.col("b.loss").alias("best_loss"), (F.col("last") - F.col("b.epoch")).alias("stale"))


def first_impatient(losses: DataFrame, run: str, patience: int, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """(run, stop_epoch): the first epoch after `patience` ones in a row that did
    not beat the least loss before them; null if there is none."""
    order = Window.partitionBy(run).orderBy(epoch)
    best = F.min(loss).over(order.rowsBetween(Window.unboundedPreceding, -1))
    better = losses.withColumn("won__", (best.isNull() | (F.col(loss) < best)).cast("int"))
    island = better.withColumn("island__", F.sum("won__").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    since = island.withColumn("since__", F.row_number().over(Window.partitionBy(run, "island__").orderBy(epoch)) - 1)
    return since.groupBy(run).agg(F.min(F.when(F.col("since__") >= patience, F.col(epoch))).alias("stop_epoch"))


def progress(done: Column, target: Column, seconds: Column) -> Column:
    """(percent, rate, eta) of work done in some seconds."""
    rate = F.when(seconds > 0, done / seconds)
    return F.struct((F.lit(100.0) * done / target).alias("percent"), rate.alias("rate"), F.when(rate > 0, F.greatest(target - done, F.lit(0)) / rate).alias("eta"))


def merge_statistics(first: DataFrame, second: DataFrame, selected: DataFrame, digest: Column) -> DataFrame:
    """One row: rows available, duplicates removed, and rows selected of both tables, as
    the merged rows (with their side, 0 or 1) have them."""
    both = first.select(F.lit(0).alias("side"), digest.alias("d")).unionByName(second.select(F.lit(1).alias("side"), digest.alias("d")))
    least = both.groupBy("d").agg(F.min("side").alias("side"), F.count("*").alias("n"))
    # one row on each side
    taken = selected.agg(F.count_if(F.col("side") == 0).alias("selected_first"), F.count_if(F.col("side") == 1).alias("selected_second"))
    stats = least.agg(
        F.count_if(F.col("side") == 0).alias("available_first"), F.count_if(F.col("side") == 1).alias("available_second"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("duplicates"),
    )
    return stats.crossJoin(F.broadcast(taken))


def beats_uniform(loss: Column, vocabulary: int) -> Column:
    """Whether a loss is below that of an even guess over the vocabulary."""
    return loss < F.ln(F.lit(float(vocabulary)))


def batch_digest(batches: DataFrame, batch: int, key: str, first: int = 10) -> DataFrame:
    """(digest) of the first ids of a batch, by which a resumed run knows its place."""
    ids = batches.where(F.col("batch") == batch).orderBy("place").limit(first)
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", key))), lambda r: r[key].cast("string")), ",")
    return ids.agg(F.sha2(row, 256).alias("digest"))


def check_resume(saved: Mapping[str, Any], config: Mapping[str, Any], step: int, digest: str, epochs: int) -> tuple[int, int]:
    """(epoch, batch) at which a saved run goes on. It raises unless the run has the
    same configuration, ends at the given step, is within its epochs, has taken no
    negative time and meets the same next batch (batch_digest)."""
    rules = {
        "the configuration or the data changed": saved.get("config") == dict(config),
        "the step isn't the saved one": saved.get("base_step", 0) + saved.get("steps", 0) == step,
        "the elapsed time is negative": saved.get("seconds", 0.0) >= 0,
        "the run is beyond its epochs": saved.get("epoch", 0) <= epochs,
        "the next batch differs": saved.get("batch_digest", digest) == digest,
    }
    for problem, ok in rules.items():
        if not ok:
            raise ValueError(f"the run can't be resumed: {problem}")
    return saved.get("epoch", 0), saved.get("batch", 0)
