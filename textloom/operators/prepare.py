"""Preparation of many sources with a ledger: what fails is told, what is done stays.

Each source is sampled, converted and written by itself. A ledger beside the outputs
has a row for every try (source, state, rows, error), one small file each; a source
that fails gets an error row and the others go on. A further run with the same
settings takes up sources that are done as they are and tries the rest again. Then
each output gathers its sources' records in a seeded order, and a manifest is
written last.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.checks import positive
from textloom.operators.sampling import sample, shuffled

LEDGER = "source string, bucket string, state string, sampled long, usable long, error string, settings string"


@dataclass(frozen=True)
class Source:
    """Rows with a key, how they become records (rows to rows; others give none), the
    output that they belong to and what its ledger row says of it besides. `settings`
    names what the rows depend on: where it changes, the source is prepared again."""

    name: str
    bucket: str
    rows: Callable[[SparkSession], DataFrame]
    convert: Callable[[DataFrame], DataFrame]
    key: str = "id"
    settings: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Output:
    """A file set: the buckets that it gathers, and sources that it leaves out since
    another step samples them by themselves."""

    name: str
    buckets: Sequence[str]
    without: Sequence[str] = ()


class Store:
    """A folder with the ledger, the sources' records and the outputs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def ledger(self) -> DataFrame:
        """All tries so far; `try` numbers them in the order in which they were written."""
        at = f"{self.folder}/ledger"
        if not self._fs.exists(self._path(at)):
            return self.spark.createDataFrame([], f"{LEDGER}, try long")
        return self.spark.read.schema(f"{LEDGER}, try long").json(at)

    def write(self, name: str, value: Mapping) -> None:
        """A small JSON file, written beside its place and moved there."""
        goal, draft = self._path(f"{self.folder}/{name}"), self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray((json.dumps(value, ensure_ascii=False) + "\n").encode()))
        out.close()
        self._fs.mkdirs(goal.getParent())
        self._fs.delete(goal, False)
        if not self._fs.rename(draft, goal):
            raise OSError(f"{goal} could not be written")

    def note(self, n: int, row: Mapping) -> None:
        self.write(f"ledger/{n:06d}-{uuid.uuid4().hex}.json", {**row, "try": n})

    def records(self, source: Source) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/sources/{source.name}")


def _settings(source: Source, limit: int, seed: int) -> str:
    said = json.dumps([source.bucket, limit, seed, dict(source.settings)], sort_keys=True)
    return hashlib.sha256(said.encode()).hexdigest()[:16]


def _one(store: Store, source: Source, limit: int, seed: int) -> tuple[int, int]:
    """Rows sampled and records written of a source."""
    rows = sample(source.rows(store.spark), source.key, seed, limit)
    at = f"{store.folder}/sources/{source.name}"
    made = source.convert(rows.withColumn("key__", F.col(source.key).cast("string")))
    if "key__" not in made.columns:
        raise ValueError("the conversion must keep the column key__")
    made.withColumn("source__", F.lit(source.name)).write.mode("overwrite").parquet(at)
    usable = store.spark.read.parquet(at).count()
    if not usable:
        raise ValueError("no rows became records")
    return rows.count(), usable


def prepare(spark: SparkSession, sources: Sequence[Source], outputs: Sequence[Output], folder: str, limit: int, seed: int) -> dict:
    """Prepares all sources that are not done yet and writes the outputs: JSON lines of
    the records in an order seeded with seed + the output's index, and a manifest, which
    is returned. A source keeps at most `limit` rows of an order seeded with seed + its
    index. Only if no source has any record it raises, after the ledger is written."""
    positive(limit=limit)
    if len({s.name for s in sources}) < len(sources) or len({o.name for o in outputs}) < len(outputs):
        raise ValueError("sources and outputs must have names of their own")
    store = Store(spark, folder)
    tries = [r.asDict() for r in store.ledger().collect()]  # a row for each try of a source
    done = {(r["source"], r["settings"]): r for r in tries if r["state"] == "done"}
    n = max((r["try"] for r in tries), default=-1) + 1
    ready, errors, report = [], [], {}
    for i, s in enumerate(sources):
        told = _settings(s, limit, seed + i)
        row = done.get((s.name, told))
        if row is None:
            row = {"source": s.name, "bucket": s.bucket, "settings": told}
            try:
                sampled, usable = _one(store, s, limit, seed + i)
                row |= {"state": "done", "sampled": sampled, "usable": usable, "error": None}
            except Exception as e:  # whatever it is, the others go on
                row |= {"state": "error", "sampled": None, "usable": None, "error": f"{type(e).__name__}: {str(e).splitlines()[0][:500] if str(e) else ''}"}
            store.note(n, row)
            n += 1
        if row["state"] == "done":
            ready.append(s)
            report[s.name] = {"bucket": s.bucket, "sampled": row["sampled"], "usable": row["usable"]}
        else:
            errors.append({"source": s.name, "error": row["error"]})
    counts = {}
    for i, o in enumerate(outputs):
        own = [s for s in ready if s.bucket in o.buckets and s.name not in o.without]
        at = f"{store.folder}/outputs/{o.name}"
        if not own:
            store._fs.delete(store._path(at), True)
            counts[o.name] = 0
            continue
        both = store.records(own[0])
        for s in own[1:]:
            both = both.unionByName(store.records(s), allowMissingColumns=True)
        placed = shuffled(both.withColumn("order_key__", F.concat_ws("/", "source__", "key__")), "order_key__", seed + i, "pos__")
        placed.repartitionByRange("pos__").sortWithinPartitions("pos__").drop("pos__", "order_key__", "key__", "source__").write.mode("overwrite").json(at)
        counts[o.name] = sum(report[s.name]["usable"] for s in own)
    manifest = {
        "sources": report, "errors": errors, "counts": counts, "sample_limit_per_source": limit, "seed": seed,
        "prepared_sources": len(ready), "requested_sources": len(sources),
    }
    store.write("manifest.json", manifest)
    if not ready:
        raise RuntimeError("no source has usable records; the ledger tells why")
    return manifest
