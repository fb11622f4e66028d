"""Steps whose tasks must not grow with the table: ranges, chunks, runs, items."""

import io
import json
import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus as C
from textloom.operators import order
from textloom.operators import tokens as K
from textloom.plans import chat, records
from textloom.sources import files, sinks, streams
from textloom.streaming import counters

SF = "/root/testdata/sf0.001"


def test_ranges_follow_the_rows(spark):
    df = spark.range(300_000).select((F.col("id") * 7 % 300_000).alias("o"))
    few, many = (order.totals(df.where(f"o < {n}"), F.lit(1), "o") for n in (30_000, 300_000))
    assert few.ranges >= 15 and many.ranges >= 9 * few.ranges
    assert many.slim.groupBy("part__").count().agg(F.max("count")).first()[0] < 20_000
    placed = many.attach(df, "p")
    assert placed.where("o <> p").isEmpty()
    assert placed.rdd.getNumPartitions() >= 12


@pytest.mark.parametrize(("size", "stride"), [(16, 1), (129, 128), (5000, 7), (3, 10)])
def test_windows_across_chunks(spark, size, stride):
    long = [i * i % 251 for i in range(20_000)]
    rows = [[1, 2], long, [], None, [7], long[:9_000], [5, 6]]
    flat = [x for r in rows for x in r or []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, t array<int>").repartition(3)
    out = K.stream_windows(df, F.transform("t", lambda x: x + 1), "i", size, stride)
    got = {r.idx: r.s for r in out.select("idx", F.hash("window").alias("s")).collect()}
    want = spark.createDataFrame([(i, [x + 1 for x in flat[s : s + size]]) for i, s in list(enumerate(range(0, len(flat) - size + 1, stride)))[::97]], "idx long, w array<int>")
    assert len(got) == len(range(0, len(flat) - size + 1, stride))
    assert all(got[r.idx] == r.s for r in want.select("idx", F.hash("w").alias("s")).collect())


def test_tokens_are_joined_to_runs(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(sinks, "_write_shards", lambda rows, *_: seen.append(rows.collect()))
    df = spark.createDataFrame([(i, i * 1000) for i in (3, 0, 1, 2, 4, 7)], "pos long, token long").coalesce(1)
    sinks.write_token_shards(df, str(tmp_path), 3)
    assert sorted((r.shard, r.pos, r.ids) for r in seen[0]) == [(0, 0, [0, 1000, 2000]), (1, 3, [3000, 4000]), (2, 7, [7000])]


def test_shards_are_listed_once(spark, tmp_path):
    df = spark.range(8).select(F.col("id").alias("pos"), F.col("id").alias("token"))
    sinks.write_token_shards(df, f"file://{tmp_path}/s", 3)
    (tmp_path / "s" / "other.bin").write_bytes(b"1")
    assert files.token_shards(spark, f"file://{tmp_path}/s").count() == 8
    (tmp_path / "s" / "shard-00001.bin").unlink()
    with pytest.raises(FileNotFoundError, match="shard-00001"):
        files.token_shards(spark, f"file://{tmp_path}/s")


def test_items_cost_their_own_length(monkeypatch):
    monkeypatch.setattr(streams, "BLOCK", 1 << 23)
    text = json.dumps([{"id": i, "lang": "en" * 20} for i in range(100_000)])
    began = time.perf_counter()
    assert sum(1 for _ in streams._items(io.BytesIO(text.encode()))) == 100_000
    assert time.perf_counter() - began < 20


def test_a_batch_is_judged_once(spark, tmp_path):
    judged = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def short(text):
        judged.add(1)
        return len(text) < 2

    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, "d e")], "id long, text string")
    ledger = counters.Ledger(spark, str(tmp_path))
    counters.decide(rows, 0, ledger, [("short", short("text"))], C.text_digest("text"), "id")
    assert {r.reason: r.n for r in counters.reasons(ledger).collect()} == {"kept": 2, "exact_duplicates": 1, "short": 1}
    assert judged.value == 4


@pytest.mark.parametrize("name", ["chat_sources", "more_chat_sources"])
def test_sources_read_stored_chats(spark, name):
    plan = getattr(records, name)(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Exchange" in chat.chats(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_rare_words_are_merged_where_they_stand(spark, monkeypatch):
    """Only long words are joined; others make no row of their own."""
    merges = [("a", "b"), ("ab", "c")]
    vocabulary = ["a", "b", "c", "ab", "abc", " ", K.UNK, K.EOS]
    df = spark.createDataFrame([(i, f"abcab {'abc' * (i + 1)} b{K.EOS}ca") for i in range(6)] + [(9, None)], "i long, text string")
    lone = [4, 3, 5]
    want = {i: [*lone, *[4] * (i + 1), 5, 1, 7, 2, 0] for i in range(6)} | {9: None}
    monkeypatch.setattr(K, "TASK_WORDS", 1)
    out = K.bpe_encode(df, vocabulary, merges, head=1)
    assert {r.i: r.tokens for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    longer = df.withColumn("text", F.concat("text", F.repeat(F.lit("abc"), F.lit(30))))
    assert {r.i: r.tokens for r in K.bpe_encode(longer, vocabulary, merges, head=1).collect()} == {i: w and [*w[:-2], 2, 0, *[4] * 30] for i, w in want.items()}
