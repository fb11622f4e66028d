"""Files that tasks open themselves, as streams: archives, pinned files, token shards.

Spark hands out names and sizes, and each task reads its files block by block, so
that no file becomes a row (which ends at 2 GB) and memory is bounded by a batch.
Archives are read member by member and members row by row: CSV with quoted line
breaks, lines, items of a JSON array. A file with a catalogue checksum is hashed
in blocks before its first row is given. Token shards are read with a halo: a task
takes the first tokens of the shards behind its own by byte range, so that windows
across shards need no shuffle.

Addresses are those that pyarrow opens (local files, hdfs, viewfs, s3, gs).
"""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import json
import re
import sys
import tarfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.checks import positive
from textloom.sources import scratch

#: Bytes of a file that are read, and of rows that are given, at once; rows likewise.
BLOCK, BATCH_BYTES, BATCH_ROWS = 1 << 20, 4 << 20, 4096


def located(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of an address, and its path there."""
    if re.match(r"[a-z][a-z0-9+.-]*:", uri) is None or uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", uri)
    return pa.fs.FileSystem.from_uri(uri)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the files that a path or pattern names, or that its folders
    have; hidden ones are left out. Names and sizes are all that the driver sees."""
    scratch.shipped(spark)
    jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found, held = [], list(system.globStatus(at) or [])
    if not held:
        raise FileNotFoundError(path)
    for status in held:
        for s in system.listStatus(status.getPath()) if status.isDirectory() else [status]:
            if s.isFile() and not s.getPath().getName().startswith(("_", ".")):
                found.append((s.getPath().toString(), s.getLen()))
    rows = spark.createDataFrame(sorted(found), "path string, bytes long")
    return rows.repartition(max(1, len(found)), "path") if len(found) > 1 else rows


def _hashed(uri: str) -> tuple[int, str]:
    system, path = located(uri)
    digest, n = hashlib.sha256(), 0
    with system.open_input_stream(path) as f:
        while block := f.read(BLOCK):
            digest.update(block)
            n += len(block)
    return n, digest.hexdigest()


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, each hashed by a task in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                n, digest = _hashed(uri)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n]), pa.array([digest])], ["path", "bytes", "sha256"])

    return files(spark, path).mapInArrow(run, "path string, bytes long, sha256 string")


def members(name: str, f) -> Iterator[tuple[str, io.IOBase]]:
    """(name, stream) of what an open file holds: the files of an archive and of zips
    inside it, in order, or the file itself. A stream is read before the next one."""
    if name.endswith(".zip"):
        with zipfile.ZipFile(f) as z:
            for inner in z.namelist():
                if inner.endswith(".zip"):
                    with z.open(inner) as g:
                        for deeper, h in members(inner, g):
                            yield f"{inner}/{deeper}", h
                elif not inner.endswith("/"):
                    with z.open(inner) as g:
                        yield inner, g
    elif re.search(r"\.(tar|tgz|tar\.(gz|bz2|xz))$", name):
        with tarfile.open(fileobj=f, mode="r:*") as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m)
    elif name.endswith(".gz"):
        with gzip.open(f) as g:
            yield name.rsplit("/", 1)[-1][:-3], g
    else:
        yield name.rsplit("/", 1)[-1], f


def read(spark: SparkSession, path: str, parse: Callable[[io.IOBase], Iterator[tuple]], columns: str, pattern: str | None = None, digests: Mapping[str, str] | None = None) -> DataFrame:
    """(path, member, nth, columns) of the rows that parse gives for each member whose
    name the pattern finds. With digests (SHA-256 by file name) a file that differs or
    is missing there raises before it gives rows."""
    schema = f"path string, member string, nth long, {columns}"
    kinds = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(kinds)
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                name = uri.rsplit("/", 1)[-1]
                if digests is not None and _hashed(uri)[1] != digests.get(name):
                    raise ValueError(f"checksum differs: {name}")
                system, at = located(uri)
                with system.open_input_file(at) as f:
                    for member, stream in members(name, f):
                        if pattern is not None and not re.search(pattern, member):
                            continue
                        held, size = [], 0
                        for nth, row in enumerate(parse(stream)):
                            held.append((uri, member, nth, *row))
                            size += sum(len(v) for v in row if isinstance(v, str))
                            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                                yield _batch(held, shape)
                                held, size = [], 0
                        if held:
                            yield _batch(held, shape)

    return files(spark, path).mapInArrow(run, schema)


def _batch(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)


def _text(stream: io.IOBase) -> io.TextIOWrapper:
    """UTF-8 text without its byte order mark, line ends as they are."""
    return io.TextIOWrapper(stream, "utf-8-sig", newline="")


def csv_rows(spark: SparkSession, path: str, columns: Sequence[str], pattern: str | None = None, digests: Mapping[str, str] | None = None) -> DataFrame:
    """(path, member, nth, columns as strings) of CSV files or members with a header;
    quoted fields may hold line breaks. A column that the header lacks raises."""
    def parse(stream: io.IOBase) -> Iterator[tuple]:
        csv.field_size_limit(sys.maxsize)
        rows = csv.reader(_text(stream))
        header = next(rows, None)
        if header is None:
            return
        if missing := [c for c in columns if c not in header]:
            raise ValueError(f"the header lacks {', '.join(missing)}")
        at = [header.index(c) for c in columns]
        for row in rows:
            if row:
                yield tuple(row[i] if i < len(row) else None for i in at)

    return read(spark, path, parse, ", ".join(f"`{c}` string" for c in columns), pattern, digests)


def lines(spark: SparkSession, path: str, pattern: str | None = None, digests: Mapping[str, str] | None = None) -> DataFrame:
    """(path, member, nth, text) of the lines of files or members."""
    def parse(stream: io.IOBase) -> Iterator[tuple]:
        for line in io.TextIOWrapper(stream, "utf-8-sig", newline="\n"):
            yield (re.sub(r"\r?\n\Z", "", line),)

    return read(spark, path, parse, "text string", pattern, digests)


def json_items(spark: SparkSession, path: str, pattern: str | None = None, digests: Mapping[str, str] | None = None) -> DataFrame:
    """(path, member, nth, value) of the items of a JSON array, as JSON; any other
    document is one item. Items are read one after another, never the whole array."""
    return read(spark, path, _items, "value string", pattern, digests)


#: Blanks as Python strips them, and those around one comma.
_BLANK = re.compile(r"\s*")
_BETWEEN = re.compile(r"\s*,?\s*")


def _items(stream: io.IOBase) -> Iterator[tuple]:
    text, decode = _text(stream), json.JSONDecoder().raw_decode
    held = ""
    while not held and (block := text.read(BLOCK)):
        held = block.lstrip()
    if not held.startswith("["):
        whole = held + text.read()
        if whole.strip():
            yield (json.dumps(json.loads(whole), ensure_ascii=False, separators=(",", ":")),)
        return
    # items are told by their place in what is held: nothing is copied for an item
    at, ended = 1, False
    while True:
        at = _BETWEEN.match(held, at).end()
        if held.startswith("]", at):
            return
        try:
            value, to = decode(held, at)
            if not held.startswith((",", "]"), _BLANK.match(held, to).end()):  # a number may go on in the next block
                raise ValueError("the JSON array is broken")
            yield (json.dumps(value, ensure_ascii=False, separators=(",", ":")),)
            at = to
        except ValueError:
            if ended:
                raise
            more = text.read(max(BLOCK, len(held) - at))  # doubling, so that a long item is not tried often
            held, at, ended = held[at:] + more, 0, not more


def write_csv_archives(rows: DataFrame, folder: str) -> None:
    """A tar.gz for each partition with a CSV member for each batch of rows, header
    first, all fields quoted. A file is written beside its place and then moved, so
    that a repeated task does no harm."""
    scratch.shipped(rows.sparkSession)
    names, root = rows.columns, folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        system, base = located(root)
        system.create_dir(base, recursive=True)
        draft, n = f"{base}/.{uuid.uuid4().hex}", 0
        with system.open_output_stream(draft) as out, tarfile.open(fileobj=out, mode="w|gz", bufsize=BLOCK) as t:
            for batch in batches:
                for lo in range(0, batch.num_rows, BATCH_ROWS):
                    text = io.StringIO(newline="")
                    writer = csv.writer(text, quoting=csv.QUOTE_ALL)
                    writer.writerow(names)
                    writer.writerows(zip(*(c.to_pylist() for c in batch.slice(lo, BATCH_ROWS).columns)))
                    data = text.getvalue().encode()
                    info = tarfile.TarInfo(f"part-{part:05d}/{n:05d}.csv")
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
                    n += 1
        system.move(draft, f"{base}/part-{part:05d}.tar.gz")
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["members"])

    rows.mapInArrow(run, "members long").write.format("noop").mode("overwrite").save()


def shard_windows(spark: SparkSession, folder: str, size: int, stride: int = 1) -> DataFrame:
    """(idx, window): `size` tokens from every stride-th place of a shard set's stream
    that has as many. A window belongs to the shard that it begins in; what it has
    beyond that is read from the next shards' beginnings."""
    positive(size=size, stride=stride)
    scratch.shipped(spark)
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])
    if manifest.get("format") != 1 or manifest.get("dtype") != "uint32":
        raise ValueError("unknown shard format")
    shards = [(s["path"], s["tokens"]) for s in manifest["shards"]]
    total = sum(n for _, n in shards)
    if total != manifest["total_tokens"]:
        raise ValueError("the manifest's tokens don't add up")
    rows, start = [], 0
    for i, (name, n) in enumerate(shards):
        halo, need, k = [], size - 1, i + 1
        while need > 0 and k < len(shards):
            halo.append((shards[k][0], shards[k][1], min(need, shards[k][1])))
            need -= shards[k][1]
            k += 1
        rows.append((name, n, start, halo))
        start += n
    listed = spark.createDataFrame(rows, "path string, tokens long, start long, halo array<struct<path:string,tokens:long,take:long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from _windows(folder, r, total, size, stride)

    return listed.mapInArrow(run, "idx long, window array<long>")


def _tokens(folder: str, path: str, tokens: int, lo: int, hi: int) -> np.ndarray:
    """A range of a shard's tokens, by bytes; a size that doesn't fit raises."""
    system, at = located(f"{folder}/{path}")
    with system.open_input_file(at) as f:
        if f.size() != 4 * tokens:
            raise ValueError(f"{path} has {f.size()} bytes for {tokens} tokens")
        return np.frombuffer(f.read_at(4 * (hi - lo), 4 * lo), "<u4")


def _windows(folder: str, shard: dict, total: int, size: int, stride: int) -> Iterator[pa.RecordBatch]:
    start, n = shard["start"], shard["tokens"]
    first = -start % stride  # of the windows that begin here
    last = min(n, total - size + 1 - start)
    tail = [_tokens(folder, h["path"], h["tokens"], 0, h["take"]) for h in shard["halo"]]
    tail = np.concatenate(tail) if tail else np.zeros(0, "<u4")
    begins = np.arange(first, last, stride)
    at_once = max(1, BATCH_BYTES // (8 * max(size, stride)))
    for lo in range(0, len(begins), at_once):
        own = begins[lo : lo + at_once]
        end = int(own[-1]) + size
        held = _tokens(folder, shard["path"], n, int(own[0]), min(end, n))
        if end > n:
            held = np.concatenate([held, tail[: end - n]])
        windows = np.lib.stride_tricks.sliding_window_view(held, size)[own - own[0]]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(own) + 1, size), pa.int32()), pa.array(windows.astype(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array((start + own) // stride), lists], ["idx", "window"])
