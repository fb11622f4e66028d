"""Archives, pinned files, ordered files and windows over shards, against plain versions."""

import csv
import gzip
import hashlib
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.sources import files, sinks, streams

ROWS = [["a", "one\ntwo"], ["b,\"q\"", "x\r\ny"], ["", "é 😀"], ["last", ""]]


def csv_bytes(header, rows, bom=False):
    out = io.StringIO(newline="")
    w = csv.writer(out)
    w.writerow(header)
    w.writerows(rows)
    return (b"\xef\xbb\xbf" if bom else b"") + out.getvalue().encode()


def tar_of(path, members, mode="w:gz"):
    with tarfile.open(path, mode) as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_csv_in_an_archive(spark, tmp_path):
    tar_of(tmp_path / "a.tar.gz", {"d/train.csv": csv_bytes(["id", "text"], ROWS, bom=True), "d/skip.txt": b"no", "d/test.csv": csv_bytes(["text", "id"], [r[::-1] for r in ROWS])})
    out = streams.csv_rows(spark, str(tmp_path), ["id", "text"], r"\.csv$").orderBy("member", "nth").collect()
    assert [(r.member, r.nth, r.id, r.text) for r in out] == [(m, i, *r) for m in ("d/test.csv", "d/train.csv") for i, r in enumerate(ROWS)]
    with pytest.raises(Exception, match="the header lacks other"):
        streams.csv_rows(spark, str(tmp_path), ["other"], r"\.csv$").collect()


def test_checksums_are_enforced(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(csv_bytes(["id"], [["1"]]))
    digest = hashlib.sha256((tmp_path / "x.csv").read_bytes()).hexdigest()
    assert streams.checksums(spark, str(tmp_path)).select("bytes", "sha256").collect() == [(len((tmp_path / "x.csv").read_bytes()), digest)]
    assert streams.csv_rows(spark, str(tmp_path), ["id"], digests={"x.csv": digest}).count() == 1
    for bad in ({"x.csv": "0" * 64}, {}):
        with pytest.raises(Exception, match="checksum differs: x.csv"):
            streams.csv_rows(spark, str(tmp_path), ["id"], digests=bad).collect()


def test_lines_in_zips_of_zips(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("d/text.txt", "hello __eou__ hi\r\nsecond\n")
        z.writestr("d/label.txt", "0 1\n2")
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("train.zip", inner.getvalue())
        z.writestr("readme", "x")
    both = [streams.lines(spark, str(tmp_path), p).select(F.col("nth").alias("line"), "text") for p in (r"text\.txt$", r"label\.txt$")]
    assert sorted(map(tuple, files.paired_lines(*both).collect())) == [(0, "hello __eou__ hi", "0 1"), (1, "second", "2")]
    with gzip.open(tmp_path / "z.txt.gz", "wt") as f:
        f.write("a\nb")
    assert [r.text for r in streams.lines(spark, str(tmp_path / "z.txt.gz")).orderBy("nth").collect()] == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        streams.lines(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_json_arrays_in_blocks(monkeypatch, block):
    monkeypatch.setattr(streams, "BLOCK", block)
    items = [{"a": 1, "b": "x]y,"}, [1, 2], 1234, -5.5, "é\"", None, True, {}]
    for text in (json.dumps(items), json.dumps(items, indent=2, ensure_ascii=False), " [ ] "):
        assert [json.loads(v) for (v,) in streams._items(io.BytesIO(text.encode()))] == json.loads(text)
    assert [json.loads(v) for (v,) in streams._items(io.BytesIO(b'{"a": [1]}'))] == [{"a": [1]}]
    with pytest.raises(ValueError):
        list(streams._items(io.BytesIO(b'[1, {"a": ')))


def test_json_items_of_an_archive(spark, tmp_path):
    tar_of(tmp_path / "t.tar.gz", {"d/train.json": json.dumps([{"k": i} for i in range(5)]).encode(), "d/valid.json": b"[]"})
    out = streams.json_items(spark, str(tmp_path), r"train\.json$").orderBy("nth").collect()
    assert [json.loads(r.value) for r in out] == [{"k": i} for i in range(5)]


def test_archives_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"t\n{i},\"") for i in range(50)], "id string, text string").repartition(3)
    streams.write_csv_archives(df, str(tmp_path / "a"))
    assert sorted(map(tuple, streams.csv_rows(spark, str(tmp_path / "a"), ["id", "text"]).select("id", "text").collect())) == sorted((str(i), f"t\n{i},\"") for i in range(50))


def test_an_ordered_file(spark, tmp_path):
    texts = {9: "b \n", 3: "a\nb", 40: "", 11: "c\t"}
    df = spark.createDataFrame(list(texts.items()), "k long, text string").repartition(3)
    n = sinks.write_document_file(df, str(tmp_path / "f/corpus.txt".replace("f/", "")), "k")
    want = "".join(f"{texts[k].rstrip()}\n<EOS>\n\n" for k in sorted(texts)).encode()
    assert (tmp_path / "corpus.txt").read_bytes() == want and n == len(want)
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["corpus.txt"]


@pytest.mark.parametrize("size,stride,per_shard", [(4, 1, 10), (4, 3, 10), (7, 7, 3), (25, 2, 4), (2, 50, 10), (200, 1, 10)])
def test_windows_over_shards(spark, tmp_path, size, stride, per_shard):
    tokens = [(i * 37 + 5) % 4_000_000_000 for i in range(101)]
    rows = spark.createDataFrame([(0, tokens[:40]), (40, []), (40, tokens[40:41]), (41, tokens[41:])], "start long, tokens array<long>")
    manifest = sinks.write_token_stream(rows, str(tmp_path), per_shard)
    assert manifest["total_tokens"] == 101
    assert [r.token for r in files.token_shards(spark, str(tmp_path)).orderBy("pos").collect()] == tokens
    out = streams.shard_windows(spark, str(tmp_path), size, stride)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = [(k, tokens[s : s + size]) for k, s in enumerate(range(0, 101 - size + 1, stride))]
    assert sorted((r.idx, list(r.window)) for r in out.collect()) == want


def test_broken_shards_raise(spark, tmp_path):
    rows = spark.createDataFrame([(0, list(range(20)))], "start long, tokens array<long>")
    sinks.write_token_stream(rows, str(tmp_path), 8)
    with open(tmp_path / "shard-00001.bin", "ab") as f:
        f.write(b"xx")
    with pytest.raises(Exception, match="bytes for 8 tokens"):
        streams.shard_windows(spark, str(tmp_path), 3).collect()
    with pytest.raises(Exception, match="outside uint32"):
        sinks.write_token_stream(spark.createDataFrame([(0, [-1])], "start long, tokens array<long>"), str(tmp_path / "x"), 8)
