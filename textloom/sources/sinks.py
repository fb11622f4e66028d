"""Writers: document files, JSON lines, manifests, buckets, token shards."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators.corpus import append_merge
from textloom.sources import scratch, streams


def document_block(text: Column | str) -> Column:
    """A text with its end-marker line and a blank line."""
    return F.concat(X.strip_right(text), F.lit(f"\n{X.EOS}\n\n"))


def write_documents(docs: DataFrame, path: str, order: str, text: str = "text") -> None:
    """Ordered text files: each file holds a range of the order, named by range."""
    ranged = docs.repartitionByRange(order).sortWithinPartitions(order)
    block = F.regexp_replace(document_block(text), r"\n\z", "")  # the writer adds the last newline
    ranged.select(block.alias("value")).write.text(path)


def write_ordered(rows: DataFrame, path: str, order: str, value: str) -> int:
    """One file with the values in order, each closed by a newline, and its bytes.
    Ranges of the order are sorted and written in parallel; one task then copies their
    files behind one another in blocks, and the whole file appears by a rename."""
    spark = rows.sparkSession
    base, _, name = path.rpartition("/")
    parts = f"{base}/.{name}-{uuid.uuid4().hex}"
    rows.repartitionByRange(order).sortWithinPartitions(order).select(F.col(value).alias("value")).write.text(parts)
    # a part's number is its range's
    found = sorted((int(r.path.rsplit("/part-", 1)[1].split("-", 1)[0]), r.path) for r in streams.files(spark, parts).collect())

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sources in batch.column("sources").to_pylist():
                system, at = streams.located(path)
                draft, n = f"{at}.{uuid.uuid4().hex}", 0
                with system.open_output_stream(draft) as out:
                    for uri in sources:
                        own, part = streams.located(uri)
                        with own.open_input_stream(part) as f:
                            while block := f.read(streams.BLOCK):
                                out.write(block)
                                n += len(block)
                system.move(draft, at)
                yield pa.RecordBatch.from_arrays([pa.array([n])], ["bytes"])

    done = spark.createDataFrame([([p for _, p in found],)], "sources array<string>").mapInArrow(copy, "bytes long").collect()
    where = spark._jvm.org.apache.hadoop.fs.Path(parts)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return done[0]["bytes"]


def write_document_file(docs: DataFrame, path: str, order: str, text: str = "text") -> int:
    """The corpus as one ordered file: each text with its end marker and a blank line."""
    block = F.regexp_replace(document_block(text), r"\n\z", "")  # the writer adds the last newline
    return write_ordered(docs.select(order, block.alias("value")), path, order, "value")


def write_jsonl(records: DataFrame, path: str, *columns: str) -> None:
    """Compact JSON lines; nulls are left out. The committer makes the folder
    appear at once."""
    records.select(*(columns or records.columns)).write.json(path)


def write_manifest(counts: DataFrame, path: str) -> None:
    """A one-row table of counts as JSON."""
    counts.coalesce(1).write.json(path)


def write_buckets(records: DataFrame, path: str, bucket: str) -> None:
    records.write.partitionBy(bucket).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, all fields quoted, as the CSV reader takes it."""
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**options).csv(path)


def write_merged(existing: DataFrame, new: DataFrame, digest: Column, order: str, path: str) -> DataFrame:
    """Existing rows and the new ones that none of them equals, written to a new
    folder as JSON lines; the old ones stay as they are until that is there."""
    append_merge(existing, new, digest, order).write.json(path)
    return existing.sparkSession.read.schema(existing.schema).json(path)


def write_token_shards(tokens: DataFrame, folder: str, per_shard: int, pos: str = "pos", token: str = "token") -> dict:
    """Little-endian uint32 shards of `per_shard` tokens and a manifest. A shard is
    one task's group, bounded by per_shard, and that task writes its file: beside
    it first, then moved, so that a repeated task does no harm. Only names and
    sizes reach the driver. An id outside uint32 raises. Tokens that follow one another
    are joined to runs before they are shuffled."""
    scratch.shipped(tokens.sparkSession)
    checked = F.when(F.col(token).between(0, 4294967295), F.col(token)).otherwise(F.raise_error(F.lit("token id outside uint32")).cast("long"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("pos").null_count:
                raise ValueError("a token has no place")
            batch = batch.sort_by("pos")
            at = batch.column("pos").to_numpy()
            shard = at // per_shard
            begins = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(shard) != 0)])[: len(at)])
            ids = pa.ListArray.from_arrays(pa.array(np.append(begins, len(at)), pa.int32()), batch.column("id"))
            yield pa.RecordBatch.from_arrays([pa.array(shard[begins]), pa.array(at[begins]), ids], ["shard", "pos", "ids"])

    rows = tokens.select(F.col(pos).cast("long").alias("pos"), checked.cast("long").alias("id"))
    return _write_shards(rows.mapInArrow(runs, "shard long, pos long, ids array<long>"), folder, per_shard)


def write_token_stream(rows: DataFrame, folder: str, per_shard: int, start: str = "start", tokens: str = "tokens") -> dict:
    """write_token_shards of rows that hold a run of the stream each: its first
    token's place and the tokens. A row gives each shard that it touches its slice."""
    n = F.size(tokens)
    bad = F.exists(tokens, lambda t: t.isNull() | ~t.cast("long").between(0, 4294967295))
    own = rows.where(n > 0).withColumn("shard", F.explode(F.sequence(F.floor(F.col(start) / per_shard), F.floor((F.col(start) + n - 1) / per_shard))))
    lo = F.greatest(F.col("shard") * per_shard - F.col(start), F.lit(0))
    hi = F.least((F.col("shard") + 1) * per_shard - F.col(start), n.cast("long"))
    ids = F.when(bad, F.raise_error(F.lit("token id outside uint32")).cast("array<bigint>")).otherwise(F.slice(tokens, (lo + 1).cast("int"), (hi - lo).cast("int")).cast("array<bigint>"))
    return _write_shards(own.select("shard", (F.col(start) + lo).cast("long").alias("pos"), ids.alias("ids")), folder, per_shard)


def _write_shards(rows: DataFrame, folder: str, per_shard: int) -> dict:
    """Shards and manifest of (shard, pos, ids): runs of a shard by their places."""
    spark = rows.sparkSession
    root = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        shard, ids = table.column("shard")[0].as_py(), table.column("ids").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        files, base = pa.fs.FileSystem.from_uri(root)
        files.create_dir(base, recursive=True)
        draft = f"{base}/.{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(ids.astype("<u4").tobytes())
        files.move(draft, f"{base}/shard-{shard:05d}.bin")
        return pa.table({"shard": [shard], "n": [len(ids)]})

    written = rows.groupBy("shard").applyInArrow(write, "shard long, n long").collect()
    if not written:
        raise ValueError("there are no tokens")
    listed = [{"path": f"shard-{r.shard:05d}.bin", "tokens": r.n} for r in sorted(written)]
    manifest = {"format": 1, "dtype": "uint32", "tokens_per_shard": per_shard, "total_tokens": sum(s["tokens"] for s in listed), "shards": listed}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest.json")
    stream = path.getFileSystem(conf).create(path, True)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    return manifest
