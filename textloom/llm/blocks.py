"""Vectorised text primitives over Arrow batches, shared by the operators here.

Every word class that the operators use is separated by ASCII bytes only, so
words can be cut on the UTF-8 bytes with one table lookup per byte, and word
identity comes from Arrow's exact dictionary encoding. Nothing loops per word
in Python.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one vectorised step handles; longer texts are a step of their own.
STEP_BYTES = 2 << 20
#: Rows and bytes that Spark hands to Python at once; a row is never cut.
BATCH_ROWS, BATCH_BYTES = 1024, 32 << 20


def _table(members) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


#: `[^\x20\x09-\x0D]+`
SPACED = ~_table([0x20, *range(0x09, 0x0E)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lower-cased
ALNUM = _table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z to a-z, other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of the Arrow batches that later plans of this
    session use, and lets its Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship(spark)


#: Applications that have the package, and that clean up their checkpoints.
_SHIPPED: set[str] = set()
_CLEANED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a session."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    # workers of a local run share the driver's folder and path; others may not
    known = [Path.cwd(), *(Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    if sc.applicationId in _SHIPPED or _local(sc) and package.parent in known:
        return
    folder = tempfile.mkdtemp(prefix="package-")  # the driver serves it from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = Path(folder, f"{package.name}.zip")
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(made))
    _SHIPPED.add(sc.applicationId)


def _local(sc) -> bool:
    """Whether the workers are the driver's own."""
    return re.fullmatch(r"local(\[.*\])?", sc.master) is not None


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where that is unset, in a
    local run, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not _local(sc):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    if sc.applicationId not in _CLEANED:  # the folder below is this application's own
        remove_at_exit(spark, sc.getCheckpointDir())
        _CLEANED.add(sc.applicationId)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """A table in the shared folder that cuts the lineage; columnar and compressed,
    since it holds texts. Removed when the session's program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the session's program ends."""

    def drop() -> None:
        try:
            jvm = spark._jvm
            if jvm is not None and spark.sparkContext._jsc is not None:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone already
            pass

    atexit.register(drop)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def about(df: DataFrame, rows: int) -> DataFrame:
    """A sample of about `rows` rows, taken by a hash of the whole row, so that no
    task gathers it and copies that differ in any column are taken one by one."""
    n = df.count()
    if n <= rows:
        return df
    key = F.xxhash64(*(quoted(c) for c in hashable(df)))
    return df.where(F.pmod(key, F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives the memory that it has free back to the system:
    it may wait for further tasks for long, beside others that wait."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return wrapped


def quoted(name: str) -> Column:
    """A column by its name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def hashable(df: DataFrame) -> list[str]:
    """Columns without a map or variant anywhere inside."""
    return [f.name for f in df.schema.fields if not re.search(r"\b(map<|variant\b)", f.dataType.simpleString())]


def apart(docs: DataFrame, text: str, added: Iterable[str] = (), keep_text: bool = True) -> tuple[DataFrame, Callable[..., DataFrame], dict[str, str]]:
    """The rows under names that nothing clashes with (the text's is text__), without
    the columns that added ones replace; what gives the columns their names back, with
    further ones behind them; and the names by the columns' own."""
    gone = {a.lower() for a in added}
    names = {f.name: "text__" if f.name == text else f"c{i}__" for i, f in enumerate(docs.schema.fields) if f.name == text or f.name.lower() not in gone}
    inner = docs.select(*(quoted(n).alias(safe) for n, safe in names.items()))

    def back(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*(F.col(safe).alias(n) for n, safe in names.items() if keep_text or n != text), *more)

    return inner, back, names


def others(docs: DataFrame, text: str, added: Iterable[str]) -> list:
    """The fields of docs but the text and those that added columns replace; names
    differ in more than case, as Spark resolves them."""
    gone = {text.lower(), *(a.lower() for a in added)}
    return [f for f in docs.schema.fields if f.name.lower() not in gone]


def renamed(docs: DataFrame, fields: list, text: str) -> tuple[DataFrame, list[T.StructField]]:
    """The rows with the fields under names that can't clash, the text as text__,
    and those names' fields."""
    carried = [T.StructField(f"c{i}__", f.dataType) for i, f in enumerate(fields)]
    return docs.select(*(quoted(f.name).alias(c.name) for f, c in zip(fields, carried)), quoted(text).alias("text__")), carried


def restored(fields: list, carried: list) -> list[Column]:
    return [F.col(c.name).alias(f.name) for f, c in zip(fields, carried)]


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `most` bytes, one row at least."""
    if not batch.num_rows:
        return
    _, ends = raw(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, ends, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(ends, kind, len(texts) + 1, texts.offset * kind().itemsize) if ends else np.zeros(len(texts) + 1, kind)
    offsets = offsets.astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column from its bytes and offsets (first one 0)."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(ends) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Exact small integers for equal values, and the distinct values."""
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def grouped(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Small integers for equal keys, in order of first appearance."""
    codes, found = pd.factorize(keys)
    return codes.astype(np.int64), len(found)


def per_row(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values by row, where row i holds values[ends[i]:ends[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]


@dataclass
class Words:
    """The words of a column of texts: words starts[i]:stops[i] of data; row r has
    the words ends[r]:ends[r + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    ends: np.ndarray
    inside: np.ndarray

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.ends)

    @cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @cached_property
    def values(self) -> pa.Array:
        ends = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.stops - self.starts, out=ends[1:])
        return binary(self.data[self.inside], ends)

    @cached_property
    def codes(self) -> tuple[np.ndarray, pa.Array]:
        return coded(self.values)

    @cached_property
    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words, each with a blank behind it, and where each begins (and the end)."""
        sizes = self.stops - self.starts
        starts = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes + 1, out=starts[1:])
        out = np.full(int(starts[-1]), 0x20, np.uint8)
        out[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = self.data[self.inside]
        return out.tobytes(), starts

    def of(self, rows: np.ndarray) -> Words:
        """The words of some rows (marked), which are not cut again."""
        if rows.all():
            return self
        sizes = np.diff(self.offsets)
        bytes_, own = np.repeat(rows, sizes), rows[self.row]
        offsets = np.concatenate([[0], np.cumsum(sizes[rows])])
        shift = np.zeros(len(rows), np.int64)
        shift[rows] = offsets[:-1] - self.offsets[:-1][rows]
        moved = shift[self.row[own]]
        out = Words(
            self.data[bytes_], offsets, self.starts[own] + moved, self.stops[own] + moved,
            np.concatenate([[0], np.cumsum(self.counts[rows])]), self.inside[bytes_],
        )
        if "codes" in self.__dict__:  # equal words keep theirs
            out.codes = (self.codes[0][own], self.codes[1])
        return out

    def windows(self, n: int) -> np.ndarray:
        """Indexes of the words that n consecutive words of one row start at."""
        if len(self.starts) < n:
            return np.zeros(0, np.int64)
        left = np.repeat(self.ends[1:], self.counts) - np.arange(len(self.starts))
        return np.flatnonzero(left >= n)


def words(texts: pa.Array, table: np.ndarray = SPACED, lower: bool = False) -> Words:
    data, offsets = raw(texts)
    if lower:
        data = LOWER[data]
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = np.flatnonzero(np.diff(offsets))  # words end where a row ends
        first[offsets[full]] = inside[offsets[full]]
        last[offsets[full + 1] - 1] = inside[offsets[full + 1] - 1]
    starts = np.flatnonzero(first)
    return Words(data, offsets, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets), inside)


#: A fixed odd multiplier for each use of a rolling hash, and fixed values for bytes.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64 bits (shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """BASES[which] ** 0..n modulo 2 ** 64, and their inverses."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        base = int(BASES[which])
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[which] = (out[0], out[1])
    return have


class Rolling:
    """64-bit hashes of any runs of a sequence in constant time each."""

    def __init__(self, values: np.ndarray, which: int):
        power, self.inverse = powers(len(values), which)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start])


def word_hashes(w: Words, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    codes, distinct = w.codes
    data, ends = raw(distinct)
    table = mix((np.arange(1, 257, dtype=np.uint64)) * BASES[1 - which])
    r = Rolling(table[data], which)
    return r.of(ends[:-1], ends[1:])[codes] if len(codes) else np.zeros(0, np.uint64)
