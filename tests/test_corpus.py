import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import corpus as C
from textloom.operators import sampling as S
from textloom.operators.order import position, running_total

ODD = ["", " a  b ", "\x1c x \x1f", " em  nb\n", "tab\tx", None, "a" * 300, "word " * 60, "x" + " y" * 150]


def one(spark, value, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(value)], f"i int, v {kind}").orderBy("i").select(expression).collect()]


def test_python_text_semantics(spark):
    some = [t or "" for t in ODD]
    assert one(spark, some, X.strip("v")) == [t.strip() for t in some]
    assert one(spark, some, X.words("v")) == [t.split() for t in some]
    assert one(spark, ODD, X.collapse("v")) == [" ".join((t or "").split()) for t in ODD]
    assert one(spark, [" a_comma_  b "], X.comma_token("v")) == ["a, b"]


def test_bounded_prompt(spark):
    def expected(p):
        if len(p) <= 220:
            return p
        return (p[:217].rsplit(" ", 1)[0].rstrip() or p[:217]) + "..."

    some = ["short", "a" * 220, "a" * 221, "word " * 60, "x" + " y" * 150, " " + "z" * 400]
    assert one(spark, some, X.bounded(F.col("v"))) == [expected(t) for t in some]


def test_licences(spark):
    yes = ["Public Domain", "CC0 1.0", "CC BY 4.0", "cc-by", "CC-BY-3.0", "Creative Commons Attribution 3.0", "MIT", "MIT License", "Apache License 2.0", "ODC-By 1.0", "Licence Ouverte", "Open Government Licence v3"]
    no = ["CC BY-NC", "CC BY-SA 4.0", "CC BY-ND", "Various open data", None, "", "MIT-like", "Creative Commons Attribution NonCommercial", "Public Domain, no derivatives", "GPL"]
    assert one(spark, yes + no, X.license_allowed("v")) == [True] * len(yes) + [False] * len(no)


def signals(words, mean, symbols, top, bullets):
    names = ["rps_doc_word_count", "rps_doc_mean_word_length", "rps_doc_symbol_to_word_ratio", "rps_doc_frac_chars_top_2gram"]
    out = {n: [[0.0, 1.0, v]] for n, v in zip(names, (words, mean, symbols, top)) if v is not None}
    return out | ({"rps_lines_start_with_bulletpoint": [[0.0, 1.0, b] for b in bullets]} if bullets is not None else {})


def test_signal_map_rules(spark):
    clean = (60.0, 5.0, 0.02, 0.04, [0.0] * 4)
    cases = [
        (signals(*clean), True), (signals(60.0, 5.0, 0.2, 0.04, [0.0]), False), (signals(12.0, 5.0, 0.0, 0.0, []), False),
        (signals(None, 5.0, 0.0, 0.0, []), False), (signals(60.0, 5.0, 0.0, 0.0, [1.0] * 10), False), (signals(60.0, 5.0, 0.0, 0.0, None), True),
        (signals(60.0, 5.0, 0.0, 0.0, [1.0] * 9 + [0.0]), True), (signals(60.0, float("nan"), 0.0, 0.0, []), False), ({}, False),
    ]
    assert one(spark, [s for s, _ in cases], C.map_rules_pass(F.col("v")), "map<string,array<array<double>>>") == [e for _, e in cases]


def test_signals_join_on_the_row_and_first_wins(spark):
    rows = [("s/0002", 0, 9.0), ("s/2", 1, 1.0), ("s/0", 2, 2.0), ("t/1", 3, 3.0), ("s/x", 4, 4.0), ("s/1/2", 5, 5.0)]
    df = spark.createDataFrame([(i, o, {"a": [[0.0, 1.0, v]]}) for i, o, v in rows], "id string, ord int, quality_signals map<string,array<array<double>>>")
    got = {r.row: r.quality_signals["a"][0][2] for r in C.first_signals(df, "s").collect()}
    assert got == {2: 9.0, 0: 2.0}


def test_classification_order(spark):
    t = "some words that are quite enough for the check here ok"
    docs = spark.createDataFrame([(0, t), (1, f" {t} "), (2, t + " listed"), (3, "tiny"), (4, "tiny"), (5, None)], "id long, text string")
    dups = spark.createDataFrame([("2",)], "id string")
    failed = ~C.long_enough("text", 10)
    out = C.classify(docs, dups, "id", [("quality_rejected", failed)], C.text_digest("text"), "id").orderBy("id").collect()
    assert [r.reason for r in out] == ["kept", "exact_duplicates", "duplicate_ids", "quality_rejected", "quality_rejected", "quality_rejected"]


def test_duplicate_ids(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", None)], "doc_id string, id_int int")
    assert sorted(r.id for r in C.duplicate_ids(df).collect()) == ["1", "2", "a"]
    with pytest.raises(ValueError):
        C.duplicate_ids(df.toDF("x", "y"))


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "x "), (2, "b", "x"), (4, None, "x"), (5, None, "x"), (6, "a", None), (7, "a", None)], "o int, s string, t string")
    assert sorted(r.o for r in C.dedup_first(df, C.text_digest("t"), "o", ["s"]).collect()) == [1, 2, 4, 6]
    assert C.dedup_first(df.limit(0), C.text_digest("t"), "o").count() == 0


@pytest.mark.parametrize("per_range", [3, 1000])
def test_running_totals(spark, per_range):
    r = random.Random(0)
    rows = [(i * 7 % 101, r.choice("ab"), r.randint(0, 9)) for i in range(101)]
    df = spark.createDataFrame(rows, "o int, s string, v int").repartition(4)
    got = {x.o: x.t for x in running_total(df, "v", "o", "t", rows_per_range=per_range).collect()}
    assert got == {o: sum(v for p, _, v in rows if p < o) for o, _, _ in rows}
    got = {x.o: x.t for x in running_total(df, "v", "o", "t", ["s"], rows_per_range=per_range).collect()}
    assert got == {o: sum(v for p, q, v in rows if p < o and q == s) for o, s, _ in rows}
    assert sorted(x.n for x in position(df, "o", "n").collect()) == list(range(101))
    assert running_total(df.limit(0), "v", "o", "t").count() == 0


def greedy(texts, target, least=None):
    out, left = [], target
    for i, t in enumerate(texts):
        if left <= 0:
            break
        cut = (t or "")[:left]
        if least is not None and len(cut) < len(t or "") and len(cut.split()) < least:
            continue
        out.append((i, None if t is None else cut))
        left -= len(cut)
        if least is not None and len(cut) < len(t or ""):
            break
    return out


@pytest.mark.parametrize("target", [1, 10, 57, 400, 100_000])
def test_budgets_match_a_greedy_loop(spark, target):
    r = random.Random(target)
    texts = [" ".join("w" * r.randint(1, 6) for _ in range(r.randint(0, 12))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "o long, text string").repartition(3)
    got = [(x.o, x.text) for x in C.char_budget(df, target, "o").orderBy("o").collect()]
    assert got == [g for g in greedy(texts, target)]
    for least in (2, 5):
        got = [(x.o, x.text) for x in C.char_budget_min_tail(df, target, "o", least).orderBy("o").collect()]
        assert got == greedy(texts, target, least)


def test_a_budget_s_tail_takes_few_jobs(spark, monkeypatch):
    """Many documents try the remainder, some rows of the tail at a time."""
    r = random.Random(3)
    texts = ["w" * 30, "x " * 400] + ["long" * r.randint(5, 90) if r.random() < 0.5 else "w" * r.randint(0, 2) for _ in range(400)] + ["a b c d e f g h"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "o long, text string").repartition(3)
    for rows in (10_000, 7):
        monkeypatch.setattr(C, "TAIL_ROWS", rows)
        before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        got = [(x.o, x.text) for x in C.char_budget_min_tail(df, 300, "o", 401).orderBy("o").collect()]
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before)
        assert got == greedy(texts, 300, 401)
        assert jobs < (40 if rows > 7 else 600)


def test_more_ranges_than_bounds(spark):
    from textloom.operators import order

    df = spark.range(0, 5000).select((F.col("id") * F.col("id") - 9).alias("o"))
    out = order.position(df.repartition(3), "o", "p").collect()
    few = order.running_total(df, F.lit(1), "o", "p", rows_per_range=3).collect()
    for rows in (out, few):
        assert all(r.o == r.p * r.p - 9 for r in rows) and len(rows) == 5000


def test_sources_without_training_rows(spark):
    from textloom.operators import sampling as S

    df = spark.createDataFrame([(i, "a") for i in range(10)] + [(10, "b")], "k long, s string")
    with pytest.raises(Exception, match="no training rows are left of b"):
        S.split_sources(df, "k", "s", ["a", "b"], 1, 0.1).collect()
    part = S.split_sources(df, "k", "s", ["a"], 1, 0.25)
    assert sorted(r.part for r in part.collect()) == ["train"] * 8 + ["validation"] * 2


def test_round_robin(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, "a"), (6, "z")], "o int, source string")
    out = C.round_robin(df, ["a", "b"], "o").orderBy("turn", "source_index").collect()
    assert [r.o for r in out] == [2, 1, 3, 4, 5]


def test_balanced_quota_matches_the_definition():
    for a in range(9):
        for b in range(9):
            for limit in range(20):
                x, y = min(a, -(-limit // 2)), min(b, limit // 2)
                spare = limit - x - y
                more = min(spare, a - x)
                x, spare = x + more, spare - more
                y += min(spare, b - y)
                assert C.balanced_quota(a, b, limit) == (x, y)
    assert C.balanced_quota(12, 12, 7) == (4, 3) and C.balanced_quota(1, 5, 5) == (1, 4)


def test_append_merge(spark):
    old = spark.createDataFrame([(1, "q1", "old"), (2, "q2", "old")], "o int, t string, side string")
    new = spark.createDataFrame([(1, "q2", "new"), (2, "q3", "new"), (3, "q3", "new")], "o int, t string, side string")
    out = sorted((r.t, r.side, r.o) for r in C.append_merge(old, new, F.col("t"), "o").collect())
    assert out == [("q1", "old", 1), ("q2", "old", 2), ("q3", "new", 2)]


def test_samples_and_splits(spark):
    df = spark.range(350).withColumnRenamed("id", "k").repartition(5)
    a, b = ({r.k for r in S.page_sample(df, "k", 5, 120).collect()} for _ in range(2))
    assert a == b and len(a) == 120 and len({k // 100 for k in a}) == 2
    assert len(S.sample(df, "k", 1, 40).collect()) == 40 and S.sample(df, "k", 1, 999).count() == 350
    parts = {r.part: r["count"] for r in S.split(df, "k", 3, 0.1).groupBy("part").count().collect()}
    assert parts == {"validation": 35, "train": 315}
    assert S.split(df.limit(3), "k", 3, 0.1).where("part = 'validation'").count() == 1
    batches = {r.batch: r["count"] for r in S.epoch_batches(df, "k", 7, 0, 100).groupBy("batch").count().collect()}
    assert batches == {0: 100, 1: 100, 2: 100, 3: 50}
    one, two = ([r.k for r in S.epoch_batches(df, "k", 7, e, 400).orderBy("place").collect()] for e in (0, 1))
    assert sorted(one) == sorted(two) and one != two
    all_batches = S.epoch_batches(df, "k", 7, 0, 10)
    assert sorted(r.batch for s in range(4) for r in S.stage_slice(all_batches, 35, s, 0.25).select("batch").distinct().collect()) == list(range(35))


def test_ratio_draws(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "k int, source string")
    ratios = S.source_ratios({"b": 0.3, "c": 0.1}, "a")
    assert ratios["a"] == 0.6
    out = S.ratio_draws(df, "source", "k", ratios, 4000, 5)
    share = {r.source: r["count"] / 4000 for r in out.groupBy("source").count().collect()}
    assert out.count() == 4000 and all(abs(share[s] - p) < 0.03 for s, p in ratios.items())
    assert out.select("k").distinct().count() > 55
    with pytest.raises(ValueError):
        S.source_ratios({"b": 1.0}, "a")


def scans(df, name="documents.parquet"):
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_rows_are_read_once(spark):
    """Totals come from slim tables: the plan of the rows reads its input once, and a
    budget doesn't shuffle it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert scans(C.round_robin(docs, ["src0", "src1"], "doc_id")) == 1
    assert scans(C.dedup_first(docs, C.text_digest("text"), "doc_id", ["source"])) == 1
    cut = C.char_budget(docs, 20_000, "doc_id")
    assert scans(cut) == 1 and "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), LessThanOrEqual(doc_id" in cut._jdf.queryExecution().executedPlan().toString()
    assert scans(C.char_budget(docs, 2_000, "doc_id", strata=["source"])) == 1


def test_ends_of_totals(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, 0, "a"), (3, 5, "a"), (4, 1, "b"), (5, 7, None)], "o long, v long, s string")
    from textloom.operators import order

    t = order.totals(df, "v", "o", rows_per_range=2)
    for target, want in ((1, (1, 5, 1)), (5, (1, 5, 5)), (6, (3, 5, 1)), (18, (5, 7, 7))):
        assert tuple(t.ends(F.lit(target)).first()) == want
    assert t.ends(F.lit(19)).first() is None and t.sums().first()["total__"] == 18
    t = order.totals(df, "v", "o", ["s"], rows_per_range=2)
    assert sorted(map(tuple, t.ends(F.lit(6)).collect()), key=str) == [("a", 3, 5, 1), (None, 5, 7, 6)]
    assert sorted((r.o, r.room__) for r in t.until(df, 6).collect()) == [(1, None), (2, None), (3, 1), (4, None), (5, 6)]
