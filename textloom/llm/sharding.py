"""Shards by size-tiered compaction under a versioned manifest.

An arrival is appended as small immutable Parquet shards. Compaction looks at
runs of shards of similar size (a tier is a power of FAN of the least size) and
merges a tier that has FAN or more of them into files of the target size; merged
files climb tiers until they reach the target. Readers see only what the last
manifest lists, and a manifest is committed by renaming a complete file to the
next version's name, which fails if another writer has taken it (where the file
system's rename never overwrites, as HDFS's and local ones' do not; an object store
needs a committer that guarantees it).

All work is DataFrame scans and writes. Merging needs no shuffle: the scan packs
whole small files into splits of the target size, and each split is written as
one file.

Defined cases: null columns and texts are kept as they are; repeated rows stay;
an empty arrival commits a version without new shards; all columns are carried,
whatever their names, and the location columns of a read replace those of the
same name; a writer that loses a commit race raises and leaves the store as is.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from collections.abc import Collection
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.blocks import remove_at_exit, shared_folder

#: Shards of a tier that make it worth merging, and the ratio between tiers.
FAN = 4


class CommitConflict(RuntimeError):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's root
    bytes: int
    arrival: int  # first version that had its rows
    level: int  # merges that its rows went through at most


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, small_bytes: int = 8 << 20):
        self.spark, self.root, self.target, self.small = spark, root.rstrip("/"), target_bytes, small_bytes
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("_manifests"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # manifests

    def version(self) -> int:
        """The last committed version; 0 before any."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("_manifests"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"_manifests/v{version:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def _commit(self, version: int, shards: list[Shard]) -> int:
        """Makes `shards` the store's content as the version after `version`."""
        body = json.dumps({"version": version + 1, "shards": [asdict(s) for s in shards]})
        draft = self._path(f"_manifests/.draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
        final = self._path(f"_manifests/v{version + 1:08d}.json")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise CommitConflict(f"version {version + 1} exists")
        return version + 1

    # writing

    def _write(self, df: DataFrame, rows: int | None = None) -> list[tuple[str, int]]:
        """Writes an immutable folder of files; (path, bytes) of each."""
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        if rows:
            writer = writer.option("maxRecordsPerFile", rows)
        writer.parquet(f"{self.root}/{folder}")
        found = self._fs.listStatus(self._path(folder))
        return sorted((f"{folder}/{s.getPath().getName()}", s.getLen()) for s in found if s.getPath().getName().endswith(".parquet"))

    def append(self, arrival: DataFrame, rows_per_shard: int = 2000) -> int:
        """Commits an arrival as new small shards."""
        version = self.version()
        new = [Shard(p, n, version + 1, 0) for p, n in self._write(arrival, rows_per_shard)]
        return self._commit(version, self.shards(version) + new)

    def _tier(self, shard: Shard) -> int:
        return max(0, math.floor(math.log(max(shard.bytes, 1) / self.small, FAN)) + 1)

    def plan(self, shards: list[Shard], stuck: Collection[frozenset[str]] = ()) -> list[Shard]:
        """The lowest run that is due: shards of one tier, FAN at least, that are
        below the target, and not stuck. None: the store is compact."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.bytes < self.target:
                tiers.setdefault(self._tier(s), []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= FAN and frozenset(s.path for s in tiers[t]) not in stuck), [])

    def compact(self) -> int:
        """Merges runs of similar size until none is due; one version a merge. A run
        that can't become fewer files is left, and others go on."""
        stuck: set[frozenset[str]] = set()
        while True:
            version = self.version()
            shards = self.shards(version)
            run = self.plan(shards, stuck)
            if not run:
                return version
            total = sum(s.bytes for s in run)
            files = max(1, round(total / self.target))
            conf = {"spark.sql.files.maxPartitionBytes": math.ceil(total / files * 1.05), "spark.sql.files.openCostInBytes": 0, "spark.sql.files.minPartitionNum": 1}
            before = {k: self.spark.conf.get(k, None) for k in conf}
            try:
                for k, v in conf.items():
                    self.spark.conf.set(k, str(v))
                merged = self._write(self.spark.read.parquet(*(f"{self.root}/{s.path}" for s in run)))
            finally:
                for k, v in before.items():
                    self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
            gone = {s.path for s in run}
            level, first = 1 + max(s.level for s in run), min(s.arrival for s in run)
            if len(merged) >= len(run):  # the scan can't make fewer files of them
                self._drop(p for p, _ in merged)
                stuck.add(frozenset(gone))
                continue
            self._commit(version, [s for s in shards if s.path not in gone] + [Shard(p, n, first, level) for p, n in merged])

    def vacuum(self, grace_seconds: float = 24 * 3600.0) -> None:
        """Deletes the files that older versions list and the last one doesn't, and
        their manifests; they can be read no more. Files that no version lists may be
        another writer's, not committed yet: they go once they are older than the
        grace time."""
        last = self.version()
        keep = {s.path for s in self.shards(last)}
        old = sorted(int(s.getPath().getName()[1:-5]) for s in self._fs.listStatus(self._path("_manifests")) if re.fullmatch(r"v\d+\.json", s.getPath().getName()))
        listed = {s.path for v in old if v < last for s in self.shards(v)}
        before = (time.time() - grace_seconds) * 1000
        for folder in self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []:
            name = f"data/{folder.getPath().getName()}"
            held = self._fs.listStatus(folder.getPath())
            gone = [s for s in held if (p := f"{name}/{s.getPath().getName()}") not in keep and (p in listed or s.getModificationTime() < before)]
            data = [s for s in held if s.getPath().getName().endswith(".parquet")]
            if data and all(s in gone for s in data):  # nothing else is left in it
                self._fs.delete(folder.getPath(), True)
            else:
                self._drop(f"{name}/{s.getPath().getName()}" for s in gone if s in data)
        self._drop(f"_manifests/v{v:08d}.json" for v in old if v < last)

    def _drop(self, paths) -> None:
        for p in list(paths):
            self._fs.delete(self._path(p), False)

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with shard (file), shard_row, shard_bytes and
        shard_level."""
        shards = self.shards(version)
        if not shards:
            raise ValueError("the store has no shards")
        rows = self.spark.read.parquet(*(f"{self.root}/{s.path}" for s in shards))
        names = self.spark.createDataFrame([(s.path.split("/", 1)[1], s.bytes, s.level) for s in shards], "shard string, shard_bytes long, shard_level int")
        shard = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/]+/[^/]+)$", 1)
        rows = rows.drop("shard", "shard_row", "shard_bytes", "shard_level").select("*", shard.alias("shard"), F.col("_metadata.row_index").alias("shard_row"))
        return rows.join(F.broadcast(names) if len(shards) <= 10_000 else names, "shard", "left")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in three parts (by a hash of the id), are compacted after
    each, and are read back from the last version: where each row lies now."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")
    remove_at_exit(spark, store.root)
    parts = 3
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    for k in range(parts):
        store.append(docs.where(arrival == k))
        store.compact()
        store.vacuum()
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return store.read().select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), size.cast("long").alias("n_bytes"), "shard", "shard_row", "shard_bytes", "shard_level")
