"""Samples by a threshold, buffered shuffles and counters of replayed batches."""

import hashlib

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import convert as V
from textloom.operators import corpus as C
from textloom.operators import epochs as E
from textloom.operators import sampling as S
from textloom.streaming import counters


def order(seed, keys):
    return sorted(keys, key=lambda k: hashlib.md5(f"{seed}-{k}".encode()).hexdigest())


@pytest.mark.parametrize("size", [0, 1, 7, 50, 99, 100, 101, 500])
@pytest.mark.parametrize("bits", [2, 14])
def test_samples_by_a_threshold(spark, monkeypatch, size, bits):
    monkeypatch.setattr(S, "TOP", 3 if size else 0)
    monkeypatch.setattr(S, "BAR_BITS", bits)
    df = spark.range(100).withColumnRenamed("id", "k").repartition(3)
    out = S.sample(df, "k", 4, size)
    assert sorted(r.k for r in out.collect()) == sorted(order(4, range(100))[:size])
    if size > 3:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Limit" not in plan and "Sort" not in plan


def test_samples_of_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(S, "TOP", 2)
    df = spark.createDataFrame([(i // 10,) for i in range(100)], "k long")
    first = order(1, range(10))
    for size in (15, 20, 99):
        got = sorted(r.k for r in S.sample(df, "k", 1, size).collect())
        assert got == sorted([k for k in first for _ in range(10)][:size])


def test_the_least_rows(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "o long").repartition(4)
    assert sorted(r.o for r in S.least(df, "o", 30).collect()) == list(range(30))
    assert S.least(df, "o", 1000).count() == 101


@pytest.mark.parametrize("n,buffer", [(1, 4), (8, 4), (101, 7), (30, 100)])
def test_buffered_shuffles(spark, n, buffer):
    df = spark.createDataFrame([(i * 3, f"t{i}") for i in range(n)], "o long, t string").repartition(3)
    out = sorted((r.pos, r.o) for r in E.buffered(df, "o", "o", 5, buffer).collect())
    assert [p for p, _ in out] == list(range(n))
    assert sorted(o for _, o in out) == [i * 3 for i in range(n)]
    # a run's rows stay together, in an order of their own
    runs = [o // 3 // buffer for _, o in out]
    assert sum(a != b for a, b in zip(runs, runs[1:])) == len(set(runs)) - 1
    assert out == sorted((r.pos, r.o) for r in E.buffered(df.repartition(5), "o", "o", 5, buffer).collect())
    if n > 50:
        assert runs[: len(set(runs))] != sorted(runs)[: len(set(runs))]
    assert E.buffered(df.limit(0), "o", "o", 5, buffer).count() == 0


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, source string")


def test_a_replayed_batch_counts_once(spark, tmp_path):
    batches = [
        [(1, "a", "x"), (2, " a", "x"), (3, "a", "y"), (4, "", "x")],
        [(5, "a", "x"), (6, "b", None), (7, "b", None)],
        [(8, "b", None), (9, "c", "x")],
    ]
    ledger = counters.Ledger(spark, str(tmp_path))
    checks = [("empty", X.blank("text"))]

    def go(i):
        counters.decide(rows_of(spark, batches[i]), i, ledger, checks, C.text_digest("text"), "id", ["source"])

    def counts():
        return {r.reason: r.n for r in counters.reasons(ledger).collect()}

    go(0)
    assert counts() == {"kept": 2, "exact_duplicates": 1, "empty": 1}
    go(1)
    go(1)  # the same batch again
    want = {"kept": 3, "exact_duplicates": 3, "empty": 1}
    assert counts() == want
    go(0)  # and one before it
    assert counts() == want
    go(2)
    assert counts() == {"kept": 4, "exact_duplicates": 4, "empty": 1}
    whole = C.classify(rows_of(spark, sum(batches, [])), spark.createDataFrame([], "id string"), "id", checks, C.text_digest("text"), "id", ["source"])
    assert counts() == {r.reason: r["count"] for r in whole.groupBy("reason").count().collect()}


def test_a_stream_from_its_start_again(spark, tmp_path):
    """A lost checkpoint replays all batches; the counters stay."""
    rows_of(spark, [(i, f"t{i % 7}", "s") for i in range(40)]).repartition(4).write.parquet(str(tmp_path / "in"))
    ledger = counters.Ledger(spark, str(tmp_path / "ledger"))
    for at in ("one", "two"):
        stream = spark.readStream.schema("id long, text string, source string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        counters.run(stream, ledger, str(tmp_path / at), [], C.text_digest("text"), "id", ["source"]).awaitTermination()
        assert {r.reason: r.n for r in counters.reasons(ledger).collect()} == {"kept": 7, "exact_duplicates": 33}


def test_emotion_records(spark):
    df = spark.createDataFrame([(1, "so glad,", [17]), (2, "", [1])], "id long, text string, labels array<int>")
    out = V.emotion_records(V.recognition(df), "some_emotions", "cc-by").collect()
    assert [(r.id, r.dataset_source, r.dataset_license, r.emotion_labels, r.state.emotions.happiness) for r in out] == [(1, "some_emotions", "cc-by", ["joy"], 0.5)]
    assert out[0].messages[1].content.startswith("Identify the emotions")
    with pytest.raises(ValueError):
        V.emotion_records(df, "x", "")
