"""Counters of a stream in which a repeated batch counts once.

A stream gives each micro-batch a number, and may give the same one again after a
failure. What a batch decides is written under its number, over what was there, and
it reads only what batches of lower numbers have written. So a replay gives the same
rows in the same place, and totals over the ledger count every document once.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.sources import scratch


class Ledger:
    """Tables of a folder with a part for each batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch}")

    def read(self, table: str, schema: str, before: int | None = None) -> DataFrame:
        """A table's rows with their batch; only of batches before one if asked."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        out = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/{table}")
        return out if before is None else out.where(F.col("batch") < before)


def decide(rows: DataFrame, batch: int, ledger: Ledger, checks: Sequence[tuple[str, Column]], digest: Column, order: str, within: Sequence[str] = ()) -> None:
    """Writes a batch's decisions (order, reason): the first failed check's name,
    exact_duplicates (a row with the same digest, within the given columns, was kept by
    an earlier batch or comes before in this one) or kept; and the digests it keeps."""
    named = F.lit(None).cast("string")
    for name, failed in reversed(checks):
        named = F.when(failed, name).otherwise(named)
    # one key for the digest and what it counts within, so that nulls are like others
    key = F.sha2(F.concat_ws("\x1f", digest, *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in within)), 256)
    # three readers: checks and digests are computed once
    marked = scratch.table(rows.select(F.col(order).alias("id"), named.alias("reason"), key.alias("digest")))
    seen = ledger.read("digests", "digest string", batch).select(F.col("digest").alias("seen__")).distinct()
    joined = marked.join(seen, marked["digest"] == seen["seen__"], "left")
    good = joined.where("reason IS NULL AND seen__ IS NULL")
    first = good.groupBy(F.col("digest").alias("first__")).agg(F.min("id").alias("least__"))
    told = joined.join(first, joined["digest"] == first["first__"], "left")
    late = F.when(F.col("seen__").isNotNull() | (F.col("id") > F.col("least__")), "exact_duplicates").otherwise("kept")
    ledger.write(told.select("id", F.coalesce("reason", late).alias("reason")), "decisions", batch)
    kept = ledger.read("decisions", "id long, reason string").where((F.col("batch") == batch) & (F.col("reason") == "kept")).select("id")
    ledger.write(marked.join(kept, "id", "left_semi").select("digest"), "digests", batch)


def run(stream: DataFrame, ledger: Ledger, checkpoint: str, checks: Sequence[tuple[str, Column]], digest: Column, order: str, within: Sequence[str] = ()) -> StreamingQuery:
    """Starts the stream's decisions for all that is there now. The checks are columns
    of the stream's rows."""
    step = functools.partial(decide, ledger=ledger, checks=checks, digest=digest, order=order, within=within)
    return stream.writeStream.foreachBatch(lambda rows, batch: step(rows, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reasons(ledger: Ledger) -> DataFrame:
    """(reason, n) over all batches."""
    return ledger.read("decisions", "id long, reason string").groupBy("reason").agg(F.count("*").alias("n"))
