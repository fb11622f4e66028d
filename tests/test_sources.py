import gzip
import hashlib
import io
import json
import struct
import tarfile
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from textloom.sources import files, sinks
from textloom.streaming.dedup import stream_counts, stream_dedup


def test_documents_and_sidecar(spark, tmp_path):
    (tmp_path / "d.txt").write_text("first <EOS> inline\n<EOS>\n\nsecond\nline\n<EOS>\n\n \n<EOS>\nlast without marker\n")
    (tmp_path / "s.jsonl").write_text('{"license":"MIT"}\n{"id":"2","dataset":"own"}\n\n{"id":"3"}\n')
    plain = files.documents(spark, str(tmp_path / "d.txt")).orderBy("ord").collect()
    assert [(r.ord, r.text) for r in plain] == [(0, "first <EOS> inline"), (1, "second\nline"), (2, "last without marker")]
    out = files.documents(spark, str(tmp_path / "d.txt"), str(tmp_path / "s.jsonl"), {"dataset": "fallback"}).orderBy("ord").collect()
    assert [r.meta for r in out] == [{"license": "MIT", "dataset": "fallback"}, {"id": "2", "dataset": "own"}, {"id": "3", "dataset": "fallback"}]
    for lines in ("{}\n{}\n", "{}\n" * 4):
        (tmp_path / "bad.jsonl").write_text(lines)
        with pytest.raises(Exception, match="differ in number"):
            files.documents(spark, str(tmp_path / "d.txt"), str(tmp_path / "bad.jsonl")).collect()


def test_documents_over_many_splits(spark, tmp_path):
    texts = [f"document {i} " + "x" * (i % 50) for i in range(400)]
    (tmp_path / "d.txt").write_text("".join(f"{t}\n<EOS>\n\n" for t in texts))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        got = files.documents(spark, str(tmp_path / "d.txt"))
        assert [r.text for r in got.orderBy("ord").collect()] == [t.strip() for t in texts]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_document_writer_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}\nwith lines  \n") for i in range(7)], "ord long, text string")
    sinks.write_documents(df, str(tmp_path / "out"), "ord")
    back = files.documents(spark, str(tmp_path / "out")).orderBy("ord").collect()
    assert [r.text for r in back] == [f"text {i}\nwith lines" for i in range(7)]


def test_compressed_json_lines(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"raw_content":"one"}\n\n{"raw_content":"two"}\n')
    assert [(r.row, r.raw_content) for r in files.web_documents(spark, str(tmp_path / "a.jsonl.gz")).orderBy("row").collect()] == [(0, "one"), (1, "two")]
    (tmp_path / "b.jsonl").write_text('{"x": 1}\nnot json\n')
    assert files.jsonl(spark, str(tmp_path / "b.jsonl"), "x int", strict=False).count() == 1
    with pytest.raises(Exception):
        files.jsonl(spark, str(tmp_path / "b.jsonl"), "x int").collect()
    (tmp_path / "c.jsonl.zst").write_bytes(zstandard.compress(b'{"x": 1}\n{"x": 2}\n'))


def test_text_file_and_id_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\nb")
    assert files.text_file(spark, str(tmp_path / "t.txt")).first().text == "a\nb"
    (tmp_path / "e.txt").write_text(" \n")
    with pytest.raises(Exception, match="empty"):
        files.text_file(spark, str(tmp_path / "e.txt")).collect()
    spark.createDataFrame([("a",), (None,)], "doc_id string").write.parquet(str(tmp_path / "ids"))
    assert [r.id for r in files.duplicate_id_files(spark, str(tmp_path / "ids")).collect()] == ["a"]


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("dialogues.txt", "a __eou__ b __eou__\nc __eou__\n")
        z.writestr("emotions.txt", "0 1\n2\n")
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("train.zip", inner.getvalue())
    members = files.unpacked(spark, str(tmp_path / "outer.zip"), files.zip_members)
    pairs = files.paired_lines(files.lines_of(members, r"dialogues\.txt$"), files.lines_of(members, r"emotions\.txt$"))
    assert [(r.first, r.second) for r in pairs.orderBy("line").collect()] == [("a __eou__ b __eou__", "0 1"), ("c __eou__", "2")]
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        data = "﻿id,text\n1,x\n".encode()
        info = tarfile.TarInfo("train.csv")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    rows = files.lines_of(files.unpacked(spark, str(tmp_path / "t.tar.gz"), files.tar_members), "csv$").orderBy("line").collect()
    assert [r.text for r in rows] == ["id,text", "1,x"]


def test_pinned_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    df = spark.read.format("binaryFile").load(str(tmp_path / "a.json"))
    assert files.pinned(df, {"a.json": hashlib.sha256(b"{}").hexdigest()}).select("content").first()[0] == b"{}"
    with pytest.raises(Exception, match="checksum differs"):
        files.pinned(df, {"a.json": "0" * 64}).select("content").collect()


def test_token_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 1000) for i in range(8)], "pos long, token long").repartition(3)
    manifest = sinks.write_token_shards(df, f"file://{tmp_path}/s", 3)
    assert [s["tokens"] for s in manifest["shards"]] == [3, 3, 2]
    assert (tmp_path / "s" / "shard-00002.bin").read_bytes() == struct.pack("<2I", 6000, 7000)
    back = files.token_shards(spark, f"file://{tmp_path}/s").orderBy("pos").collect()
    assert [(r.pos, r.token) for r in back] == [(i, i * 1000) for i in range(8)]
    (tmp_path / "s" / ".shard-00002.bin.crc").unlink(missing_ok=True)
    (tmp_path / "s" / "shard-00002.bin").write_bytes(b"1234")
    with pytest.raises(Exception, match="bytes for"):
        files.token_shards(spark, f"file://{tmp_path}/s").collect()
    broken = json.loads((tmp_path / "s" / "manifest.json").read_text()) | {"total_tokens": 9}
    (tmp_path / "s" / "manifest.json").write_text(json.dumps(broken))
    (tmp_path / "s" / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        files.token_shards(spark, f"file://{tmp_path}/s")
    with pytest.raises(Exception, match="uint32"):
        sinks.write_token_shards(df.withColumn("token", F.lit(-1)), f"file://{tmp_path}/t", 3)
    with pytest.raises(ValueError):
        sinks.write_token_shards(df.limit(0), f"file://{tmp_path}/u", 3)


def test_records_and_buckets(spark, tmp_path):
    df = spark.createDataFrame([("approved", [("user", "é")]), ("research", [("user", "x")])], "bucket string, messages array<struct<role:string,content:string>>")
    sinks.write_jsonl(df, str(tmp_path / "j"), "messages")
    lines = [l for p in (tmp_path / "j").glob("*.json") for l in p.read_text().splitlines()]
    assert '{"messages":[{"role":"user","content":"é"}]}' in lines
    sinks.write_buckets(df, str(tmp_path / "b"), "bucket")
    assert spark.read.json(str(tmp_path / "b")).where("bucket = 'approved'").count() == 1
    sinks.write_manifest(df.groupBy().count(), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["count"] == 2


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:01:00", " a "), ("2024-01-01 00:02:00", "b")]
    df = spark.createDataFrame(rows, "t string, text string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_dedup(stream, "ts").writeStream.format("memory").queryName("deduped").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.text.strip() for r in spark.sql("SELECT text FROM deduped").collect()) == ["a", "b"]
    q = stream_counts(stream.withColumn("reason", F.lit("kept")), "ts", "1 minute", "reason").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.sql("SELECT n FROM counted").collect()) == 3


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('\ufeffname,"text"\nx,"a ""b"", c\nd"\ny,é\n'.encode())
    out = files.csv(spark, str(tmp_path / "a.csv"))
    assert out.columns == ["name", "text"]
    assert [tuple(r) for r in out.orderBy("name").collect()] == [("x", 'a "b", c\nd'), ("y", "é")]


def test_trees(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"message_tree_id":"a"}\n\n{"message_tree_id":"b"}\n{broken\n')
    schema = "message_tree_id string"
    out = files.trees(spark, str(tmp_path / "t.jsonl"), schema, strict=False).orderBy("ord").collect()
    assert [r.message_tree_id for r in out] == ["a", "b"]
    first = files.trees(spark, str(tmp_path / "t.jsonl"), schema, max_trees=1, strict=False).collect()
    assert [r.message_tree_id for r in first] == ["a"]
    with pytest.raises(Exception, match="invalid JSON in line 3"):
        files.trees(spark, str(tmp_path / "t.jsonl"), schema).collect()
    with pytest.raises(ValueError):
        files.trees(spark, str(tmp_path / "t.jsonl"), schema, max_trees=0)
