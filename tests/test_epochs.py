"""Keyed orders: bijections, the same in columns and in plain numbers, close to random."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import epochs as E


def through(o, x):
    while True:
        x = o._through(x, False)
        if x < o.n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 16, 17, 100, 1000, 4097])
def test_a_bijection_and_its_inverse(spark, n):
    o = E.Order(n, 5, 1)
    want = [through(o, i) for i in range(n)]
    assert sorted(want) == list(range(n))
    assert [o.number_at(p) for p in want] == list(range(n))
    df = spark.range(n).select("id", o.place("id").alias("p")).withColumn("back", o.number("p"))
    got = sorted(df.collect())
    assert [r.p for r in got] == want and all(r.back == r.id for r in got)


def test_large_numbers(spark):
    o = E.Order((1 << 51) + 12345, 3)
    xs = [0, 1, 99, (1 << 51) + 12344, 1 << 50]
    got = {r.x: (r.p, r.b) for r in spark.createDataFrame([(x,) for x in xs], "x long").select("x", o.place("x").alias("p")).withColumn("b", o.number("p")).collect()}
    assert got == {x: (through(o, x), x) for x in xs}


def test_orders_differ_by_epoch_and_spread():
    n = 1000
    a, b = ([through(E.Order(n, 1, e), i) for i in range(n)] for e in (0, 1))
    assert sum(x == y for x, y in zip(a, b)) < 12
    near = sum(abs(x - y) == 1 for x, y in zip(a, a[1:]))
    assert near < 15  # neighbours are apart
    rank = sum((i - n / 2) * (x - n / 2) for i, x in enumerate(a)) / sum((i - n / 2) ** 2 for i in range(n))
    assert abs(rank) < 0.15


@pytest.mark.parametrize("named", [4_096, 5])
def test_batches_and_stages_hold_each_row_once(spark, monkeypatch, named):
    monkeypatch.setattr(E, "NAMED", named)
    df = spark.createDataFrame([(i * 7 % 101, f"t{i}") for i in range(101)], "k long, t string").repartition(4)
    rows, n = E.numbered(df, "k")
    assert n == 101
    o = E.Order(n, 9, 4)
    whole = {r.k: (r.batch, r.place) for r in E.epoch_places(rows, o, 8).collect()}
    assert sorted(whole.values()) == [(i // 8, i % 8) for i in range(101)]
    seen = {}
    for first in range(0, 13, 3):
        for r in E.batches(rows, o, 8, first, 3).collect():
            assert r.k not in seen and first <= r.batch < first + 3
            seen[r.k] = (r.batch, r.place)
    assert seen == whole
    stages = [r.k for i in range(5) for r in E.stage(rows, o, 8, i, 0.25).collect()]
    assert sorted(stages) == sorted(whole)
    assert E.batches(rows, o, 8, 50, 2).count() == 0


def test_an_epoch_takes_no_shuffle(spark):
    rows, n = E.numbered(spark.range(500).withColumnRenamed("id", "k"), "k")
    for df in (E.epoch_places(rows, E.Order(n, 1), 10), E.batches(rows, E.Order(n, 1), 10, 3, 2)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    plan = E.batches(rows, E.Order(n, 1), 10, 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(number" in plan or "INSET" in plan or "IN (" in plan


def test_bad_arguments(spark):
    for n in (0, 1 << 52):
        with pytest.raises(ValueError):
            E.Order(n, 1)
    with pytest.raises(ValueError):
        E.epoch_places(spark.range(3).withColumnRenamed("id", "number"), E.Order(3, 1), 0)
