"""Readers of the corpora's file formats, all through Spark's file systems.

Archives can't be split: `binaryFile` gives one row a file, and Arrow batches
unpack them on the executors.
"""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.schemas import MESSAGES
from textloom.operators.chat import state_problems, valid
from textloom.operators.corpus import duplicate_ids
from textloom.operators.sampling import sample, shuffled


def text_file(spark: SparkSession, path: str) -> DataFrame:
    """One row a file with its whole text; an empty file raises."""
    rows = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    return rows.withColumn("text", F.when(X.blank("text"), F.raise_error(F.lit("the text is empty"))).otherwise(F.col("text")))


def numbered(spark: SparkSession, path: str, sep: str, keep: Column | None = None) -> DataFrame:
    """(ord, value) of the pieces between separators, numbered over all files in
    path order. The scan stays split: pieces are counted by file block, blocks get
    their offsets from those counts, and pieces their number within the block.
    keep drops pieces before they are numbered."""
    rows = spark.read.option("lineSep", sep).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    rows = rows if keep is None else rows.where(keep)
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    offsets = sizes.select("file", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    return rows.withColumn("nth", inside).join(offsets, ["file", "block"]).select((F.col("offset") + F.col("nth")).alias("ord"), "value")


def documents(spark: SparkSession, path: str, sidecar: str | None = None, fallback: dict[str, str] | None = None) -> DataFrame:
    """(ord, text, meta) of texts that are closed by a line with the end marker.
    Blank ones are skipped and take no sidecar line; meta has the sidecar's k-th
    object over the fallback, and unequal numbers raise."""
    tail = F.regexp_replace("value", r"(?:^|\n)<EOS>\s*\z", "")  # a last marker without a newline
    docs = numbered(spark, path, f"\n{X.EOS}\n", ~X.blank(tail)).select("ord", X.strip(F.regexp_replace("value", r"(?:^|\n)<EOS>\s*\z", "")).alias("text"))
    base = F.create_map(*(F.lit(x) for kv in (fallback or {}).items() for x in kv)) if fallback else F.create_map().cast("map<string,string>")
    if sidecar is None:
        return docs.withColumn("meta", base)
    lines = numbered(spark, sidecar, "\n", ~X.blank("value")).withColumnRenamed("value", "json")
    joined = docs.join(lines, "ord", "full_outer")
    even = F.when(F.col("text").isNull() | F.col("json").isNull(), F.raise_error(F.lit("documents and sidecar differ in number"))).otherwise(F.col("text"))
    side = F.from_json("json", "map<string,string>")
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(side, k)), side)
    return joined.select("ord", even.alias("text"), merged.alias("meta"))


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines (also gz and zstd): strict raises at a bad line, else it goes."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of CSV files with a header; a byte order mark goes, quoted fields may
    hold line breaks and doubled quotes. All columns are text unless a schema says
    otherwise."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    out = (reader.schema(schema) if schema else reader).csv(path)
    return out.toDF(*(c.removeprefix("\ufeff") for c in out.columns))


def trees(spark: SparkSession, path: str, schema: str, max_trees: int | None = None, strict: bool = True) -> DataFrame:
    """(ord, the schema's columns) of message trees, one a line, in file order; the
    first max_trees of them. A bad line raises, or goes if not strict."""
    if max_trees is not None and max_trees < 1:
        raise ValueError("max_trees must be positive")
    rows = numbered(spark, path, "\n", ~X.blank("value"))
    parsed = rows.select("ord", F.from_json("value", schema + ", broken__ string", {"columnNameOfCorruptRecord": "broken__"}).alias("t")).select("ord", "t.*")
    bad = F.col("broken__").isNotNull()
    if strict:
        parsed = parsed.withColumn("ord", F.when(bad, F.raise_error(F.concat(F.lit("invalid JSON in line "), (F.col("ord") + 1).cast("string"))).cast("long")).otherwise(F.col("ord")))
    parsed = (parsed if strict else parsed.where(~bad)).drop("broken__")
    return parsed if max_trees is None else parsed.orderBy("ord").limit(max_trees)


def web_documents(spark: SparkSession, documents_path: str) -> DataFrame:
    """(row, raw_content) of a shard in line order; the row is the join key."""
    rows = numbered(spark, documents_path, "\n", F.col("value") != "")
    return rows.select(F.col("ord").alias("row"), F.get_json_object("value", "$.raw_content").alias("raw_content"))


def duplicate_id_files(spark: SparkSession, path: str) -> DataFrame:
    return duplicate_ids(spark.read.option("mergeSchema", True).parquet(path))


def chats(spark: SparkSession, path: str) -> DataFrame:
    """(file, messages, state, tools) of a strict chat file."""
    schema = f"messages {MESSAGES}, state string, tools array<struct<name:string,description:string,parameters:string>>"
    return jsonl(spark, path, schema).withColumn("file", F.input_file_name())


def strict_chats(spark: SparkSession, path: str) -> DataFrame:
    """(line, messages, state, tools) of a chat file's lines, blank ones left out. A
    line that is no JSON object, has no state or a bad one, or whose messages aren't
    valid raises with its number."""
    rows = numbered(spark, path, "\n").where(~X.blank("value")).withColumn("line", F.col("ord") + 1)
    shape = f"messages {MESSAGES}, state string, tools array<struct<name:string,description:string,parameters:string>>"
    rows = rows.select("line", F.try_parse_json("value").alias("any"), X.json_object("value").alias("object"), F.from_json("value", shape).alias("r")).select("line", "any", "object", "r.*")
    problem = (
        F.when(F.col("any").isNull(), "invalid JSON").when(F.col("object").isNull(), "not a JSON object").when(F.col("state").isNull(), "no state")
        .when(F.size(state_problems(F.col("state"))) > 0, "bad state").when(~valid(F.col("messages")), "invalid messages")
    )
    line = F.when(problem.isNull(), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), problem)).cast("long"))
    return rows.select(line.alias("line"), "messages", "state", "tools")


def shard_list(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """(shard, pos) of a list of shards, one a line, in a seeded order."""
    rows = spark.read.text(path).select(X.strip("value").alias("shard")).where("shard <> ''").distinct()
    return shuffled(rows, "shard", seed)


def json_sample(spark: SparkSession, path: str, schema: str, seed: int, size: int) -> DataFrame:
    """(ord, the schema's columns) of `size` JSON lines that are objects, in a seeded
    order; other lines don't count. Without any it raises."""
    rows = numbered(spark, path, "\n").where(X.json_object("value").isNotNull())
    out = sample(rows, "ord", seed, size).select("ord", F.from_json("value", schema).alias("r")).select("ord", "r.*")
    if out.isEmpty():
        raise ValueError("there are no JSON objects")
    return out


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """(step, epoch, loss) of runs' metadata, one JSON object a line; a missing epoch
    is 0, a missing step raises."""
    rows = jsonl(spark, path, "step long, epoch long, loss double")
    step = F.coalesce("step", F.raise_error(F.lit("a checkpoint has no step")).cast("long"))
    return rows.select(step.alias("step"), F.coalesce("epoch", F.lit(0).cast("long")).alias("epoch"), "loss")


def unpacked(spark: SparkSession, path: str, opener: Callable[[bytes], Iterator[tuple[str, bytes]]]) -> DataFrame:
    """(path, member, content) of the members of archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for member, data in opener(content):
                    yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([member]), pa.array([data], pa.binary())], ["path", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, content binary")


def zip_members(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Files of a zip, and of the zips inside it."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            if name.endswith(".zip"):
                for inner, data in zip_members(z.read(name)):
                    yield f"{name}/{inner}", data
            elif not name.endswith("/"):
                yield name, z.read(name)


def tar_members(content: bytes) -> Iterator[tuple[str, bytes]]:
    with tarfile.open(fileobj=io.BytesIO(content)) as t:
        for m in t:
            if m.isfile():
                yield m.name, t.extractfile(m).read()


def lines_of(members: DataFrame, pattern: str) -> DataFrame:
    """(line, text) of the members that match, by line number; a byte order mark
    goes."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    rows = members.where(F.col("member").rlike(pattern)).select(F.posexplode(F.split(F.regexp_replace(text, r"\n\z", ""), r"\r?\n")).alias("line", "text"))
    return rows.select(F.col("line").cast("long").alias("line"), "text")


def paired_lines(first: DataFrame, second: DataFrame) -> DataFrame:
    """(line, first, second): the k-th lines side by side; unequal numbers raise."""
    joined = first.withColumnRenamed("text", "first").join(second.withColumnRenamed("text", "second"), "line", "full_outer")
    odd = F.col("first").isNull() | F.col("second").isNull()
    return joined.withColumn("first", F.when(odd, F.raise_error(F.lit("the files differ in their number of lines"))).otherwise(F.col("first")))


def pinned(files: DataFrame, digests: dict[str, str]) -> DataFrame:
    """Files whose SHA-256 is the catalogue's (by file name); another one raises."""
    known = F.create_map(*(F.lit(x) for kv in digests.items() for x in kv))
    name = F.element_at(F.split("path", "/"), -1)
    same = F.sha2("content", 256) == F.try_element_at(known, name)
    return files.withColumn("content", F.when(F.coalesce(same, F.lit(False)), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("checksum differs: "), name)).cast("binary")))


def token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(pos, token) of a shard set; a manifest that doesn't fit the files raises."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])
    if manifest.get("format") != 1 or manifest.get("dtype") != "uint32":
        raise ValueError("unknown shard format")
    names = [s["path"] for s in manifest["shards"]]
    starts, at = {}, 0
    for s in manifest["shards"]:
        starts[s["path"]] = (at, s["tokens"])
        at += s["tokens"]
    if at != manifest["total_tokens"]:
        raise ValueError("the manifest's tokens don't add up")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if path.rsplit("/", 1)[-1] not in starts:
                    continue
                start, n = starts[path.rsplit("/", 1)[-1]]
                if len(content) != 4 * n:
                    raise ValueError(f"{path} has {len(content)} bytes for {n} tokens")
                tokens = np.frombuffer(content, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + n)), pa.array(tokens)], ["pos", "token"])

    # one listing of the folder, not one of each shard
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(folder)
    there = {s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)}
    if missing := sorted(set(names) - there):
        raise FileNotFoundError(f"{folder}/{missing[0]}")
    read = spark.read.format("binaryFile")
    if all(n.endswith(".bin") for n in names):
        files = read.option("pathGlobFilter", "*.bin").load(folder)
    else:
        files = read.load([f"{folder}/{n}" for n in names])
    return files.select("path", "content").mapInArrow(run, "pos long, token long")

