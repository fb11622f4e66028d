"""What the strict operators, readers and writers raise, and their rare cases."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.schemas import STATE
from textloom.operators import account as A
from textloom.operators import chat as H
from textloom.operators import convert as V
from textloom.operators import corpus as C
from textloom.operators import sampling as S
from textloom.operators import tokens as K
from textloom.sources import files, scratch, sinks

MESSAGES = "array<struct<role:string,content:string>>"
U, R = ("user", " q "), ("assistant", "a")


@pytest.mark.parametrize("bad, problem", [
    ([U], "no complete exchange"), (None, "no complete exchange"), ([(None, "x"), R], "no role"), ([("user", " "), R], "no content"),
    ([R, U], "from the user"), ([U, U, R], "alternate"),
])
def test_strict_exchanges(spark, bad, problem):
    df = spark.createDataFrame([(7, [U, R]), (8, bad)], f"k int, m {MESSAGES}")
    good = df.where("k = 7").select(H.strict_exchange(F.col("m"), F.col("k")).alias("m")).first().m
    assert [(m.role, m.content) for m in good] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(Exception, match=f"8: .*{problem}"):
        df.select(H.strict_exchange(F.col("m"), F.col("k"))).collect()


def test_json_objects(spark):
    rows = ['{"a":1}', " {} ", "[1]", "1", "null", '"x"', "{", "", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(X.json_object("t").isNotNull()).collect()] == [True, True] + [False] * 7


def test_scores(spark):
    rows = [("3.0", 0.8, True), ("2.9", 1.0, False), ("x", 1.0, False), (None, 1.0, False), ("5", None, False), ("NaN", 0.9, True)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b double")
    assert [r[0] for r in df.select(C.scores_pass(F.col("a"), F.col("b"))).collect()] == [ok for _, _, ok in rows]


def test_strata_share_a_target(spark):
    df = spark.createDataFrame([(0, "b", "x" * 9), (1, "a", "y" * 2), (2, "c", "z" * 9), (3, "a", None), (4, "d", "w")], "k long, source string, text string")
    out = {r.k: (r.start, r.text) for r in C.stratified_budget(df, 10, ["b", "a", "c"], "k").collect()}
    assert out == {0: (0, "xxxx"), 1: (4, "yy"), 2: (6, "zzzz"), 3: (6, None)}
    assert sum(len(t or "") for _, t in out.values()) == 10
    assert C.stratified_budget(df.limit(0), 10, ["b"], "k").count() == 0
    with pytest.raises(ValueError):
        C.stratified_budget(df, 0, ["b"], "k")


def test_signal_counters_of_no_lines(spark):
    empty = spark.createDataFrame([], "value string")
    assert tuple(C.signal_counters(empty, "s", 3).first()) == (0, 0, 0)
    rows = [('{"id":"s/1"}',), ('{"id":"s/1"}',), ('{"id":"s/9"}',), ('{"id":"s/99999999999999999999"}',), ('{"id":"sx1"}',), ('{"id":null}',), ("{}",), (None,)]
    assert tuple(C.signal_counters(spark.createDataFrame(rows, "value string"), "s", 3).first()) == (1, 5, 1)


def test_page_samples_that_lack_rows(spark):
    df = spark.range(90).withColumnRenamed("id", "k")
    assert sorted(r.pos for r in S.full_page_sample(df, "k", 1, 40, page_rows=10).collect()) == list(range(40))
    with pytest.raises(ValueError, match="90 rows of 91"):
        S.full_page_sample(df, "k", 1, 91, page_rows=10)
    with pytest.raises(ValueError):
        S.full_page_sample(df, "k", 1, 0)


@pytest.mark.parametrize("limit, sides", [(None, (3, 9)), (99, (3, 9)), (8, (3, 5)), (4, (2, 2)), (5, (3, 2))])
def test_balanced_merges(spark, limit, sides):
    out = S.balanced_merge(spark.range(3), spark.range(9), "id", 1, limit).collect()
    assert sorted(r.pos for r in out) == list(range(sum(sides)))
    assert tuple(sum(r.side == i for r in out) for i in (0, 1)) == sides


def test_losses_without_tokens(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 3), (9.0, 0)], "loss double, tokens long")
    assert tuple(A.trained_loss(df).first()) == (1.75, 4)
    for none in (df.where("tokens = 0"), df.limit(0)):
        with pytest.raises(Exception, match="no trained tokens"):
            A.trained_loss(none).collect()


def test_resuming():
    saved = {"config": {"a": 1}, "base_step": 5, "steps": 2, "seconds": 1.0, "epoch": 1, "batch": 3, "batch_digest": "d"}
    assert A.check_resume(saved, {"a": 1}, 7, "d", 2) == (1, 3)
    for change, problem in (({"config": {}}, "configuration"), ({"steps": 3}, "step"), ({"seconds": -1}, "time"), ({"epoch": 3}, "epochs"), ({"batch_digest": "x"}, "batch differs")):
        with pytest.raises(ValueError, match=problem):
            A.check_resume(saved | change, {"a": 1}, 7, "d", 2)


def test_waves(spark):
    rows = lambda *t: spark.createDataFrame([(i, q, "a") for i, q in enumerate(t)], "id long, prompt string, response string")
    spec = {"license": "mit", "repository": "r", "split": "train"}
    chat = spark.createDataFrame([(0, "x", "a"), (1, "new", "a")], "id long, question string, answer string")
    out, counts = V.chat_wave({"gpt4all": rows("x", "x", "y", "")}, {"gpt4all": spec}, "id", 1, 5)
    assert sorted(r.messages[0].content for r in out.collect()) == ["x", "y"] and counts.first().usable == 2
    assert V.chat_wave({"gpt4all": rows("x", "y", "z")}, {"gpt4all": spec}, "id", 1, 2)[0].count() == 2
    both, _ = V.chat_wave({"gpt4all": rows("x"), "gsm8k": chat}, {"gpt4all": spec, "gsm8k": spec}, "id", 1, 5)
    assert sorted(r.pos for r in both.collect()) == [0, 1, 2]
    with pytest.raises(ValueError, match="gpt4all"):
        V.chat_wave({"gpt4all": rows("")}, {"gpt4all": spec}, "id", 1, 5)


@pytest.mark.parametrize("line, problem", [
    ("{", "invalid JSON"), ("[1]", "not a JSON object"), ("null", "not a JSON object"), ('{"messages":[]}', "no state"), ('{"state":{},"messages":[]}', "bad state"),
    (json.dumps({"state": STATE, "messages": [{"role": "user", "content": "q"}]}), "invalid messages"),
])
def test_strict_chat_files(spark, tmp_path, line, problem):
    good = json.dumps({"state": STATE, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]})
    (tmp_path / "c.jsonl").write_text(f"{good}\n\n{good}\n")
    assert sorted(r.line for r in files.strict_chats(spark, str(tmp_path / "c.jsonl")).collect()) == [1, 3]
    (tmp_path / "bad.jsonl").write_text(f"{good}\n\n{line}\n")
    with pytest.raises(Exception, match=f"line 3: {problem}"):
        files.strict_chats(spark, str(tmp_path / "bad.jsonl")).collect()


def test_lists_samples_and_checkpoints(spark, tmp_path):
    (tmp_path / "shards.txt").write_text("a\n b \n\na\n")
    assert sorted((r.shard, r.pos) for r in files.shard_list(spark, str(tmp_path / "shards.txt"), 1).collect()) in ([("a", 0), ("b", 1)], [("a", 1), ("b", 0)])
    (tmp_path / "none.jsonl").write_text("{\n[]\n")
    with pytest.raises(ValueError, match="no JSON objects"):
        files.json_sample(spark, str(tmp_path / "none.jsonl"), "a int", 1, 5)
    (tmp_path / "runs.jsonl").write_text('{"step":3,"loss":0.5}\n{"step":4,"epoch":1}\n')
    assert sorted(tuple(r) for r in files.checkpoints(spark, str(tmp_path / "runs.jsonl")).collect()) == [(3, 0, 0.5), (4, 1, None)]
    (tmp_path / "bad.jsonl").write_text('{"epoch":1}\n')
    with pytest.raises(Exception, match="no step"):
        files.checkpoints(spark, str(tmp_path / "bad.jsonl")).collect()


def test_csv_and_merge_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "b",\n c '), (2, "é"), (3, None)], "k int, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted((r.k, r.t) for r in files.csv(spark, str(tmp_path / "c"), "k int, t string").collect())[:2] == [(1, ' a "b",\n c '), (2, "é")]
    out = sinks.write_merged(df.where("k < 3"), df.withColumn("k", F.col("k") + 10), F.md5("t"), "k", str(tmp_path / "m"))
    assert sorted(r.k for r in out.collect()) == [1, 2, 13]


def test_scratch_folders_differ(spark):
    a, b = scratch.folder(spark), scratch.folder(spark)
    assert a != b and a.startswith("file:")


def test_sources_left_out(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "source string")
    assert [r.source for r in C.without_sources(df, "a").collect()] == ["b", None]


@pytest.mark.parametrize("call", [
    lambda d: C.char_budget(d, 0, "k"), lambda d: C.char_budget_min_tail(d, 5, "k", 1, max_documents=0), lambda d: S.page_sample(d, "k", 1, 0), lambda d: S.split(d, "k", 1, 1.0),
    lambda d: S.epoch_batches(d, "k", 1, 0, 0), lambda d: S.stage_slice(d, 5, 0, 0.0), lambda d: K.strided_windows(d, "t", 4, 0), lambda d: K.dense_windows(d, "t", 0),
    lambda d: K.stream_windows(d, "t", "k", 0), lambda d: K.capped_stream(d, "t", "k", 1, 0), lambda d: A.tokens_per_parameter(F.col("k"), 1, 1, 0), lambda d: V.chat_wave({}, {}, "k", 1, 0),
])
def test_bad_arguments(spark, call):
    df = spark.createDataFrame([(1, [1, 2], "x")], "k long, t array<int>, text string")
    with pytest.raises(ValueError, match="must be"):
        call(df)
