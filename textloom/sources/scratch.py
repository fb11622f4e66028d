"""Folders for what a job writes and reads again."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The address of a new folder below the one that spark.checkpoint.dir names; only
    where that is unset, in a local run, below a temporary one. It is made by whoever
    writes to it and removed when the program ends."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{base}/scratch-{uuid.uuid4().hex}")
    system = path.getFileSystem(sc._jsc.hadoopConfiguration())
    system.deleteOnExit(path)
    return system.makeQualified(path).toString()


def remove(spark: SparkSession, at: str) -> None:
    """Deletes a folder that `folder` named."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(df: DataFrame) -> DataFrame:
    """df, written to a folder of its own and read back: what it is made of is read
    once, however often the table is."""
    at = folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Applications whose tasks can import this package.
_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Lets tasks import this package: it is sent to the executors once, unless they
    share the driver's path in a local run."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    known = [Path.cwd(), *(Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    if sc.applicationId in _SHIPPED or re.fullmatch(r"local(\[.*\])?", sc.master) and package.parent in known:
        return
    at = tempfile.mkdtemp(prefix="package-")  # the driver serves it from here
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    made = Path(at, f"{package.name}.zip")
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(made))
    _SHIPPED.add(sc.applicationId)
