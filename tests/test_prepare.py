"""Gates before a write, the ledger driver, and trees of any depth."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import prepare as R
from textloom.operators import trees
from textloom.sources import gates


def left(path):
    return sorted(p.name for p in path.iterdir())


def test_token_gates(spark, tmp_path):
    df = spark.createDataFrame([(1, [5, 6, 9]), (2, [7, 9])], "k int, tokens array<int>").repartition(2)
    ok = gates.token_gates("tokens", 9, 10, 0.5, 2)
    assert gates.write_gated(df, str(tmp_path / "good"), ok) == {"ends": 2, "tokens": 5}
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2
    with pytest.raises(FileExistsError):
        gates.write_gated(df, str(tmp_path / "good"), ok)
    for bad, name in ((gates.token_gates("tokens", 9, 10, 0.7, 2), "tokens"), (gates.token_gates("tokens", 5, 10, 0.5, 2), "ends")):
        with pytest.raises(gates.GateError) as e:
            gates.write_gated(df, str(tmp_path / "bad"), bad)
        assert set(e.value.failed) == {name}
    with pytest.raises(gates.GateError):  # an empty stream
        gates.write_gated(df.limit(0), str(tmp_path / "bad"), ok)
    assert left(tmp_path) == ["good"]
    assert gates.token_gates("tokens", 9, 10, 0, 2) == {}


def test_sample_gates(spark, tmp_path):
    df = spark.createDataFrame([(1, [-100, 4]), (2, [-100, -100])], "k int, labels array<int>")
    rules = gates.sample_gates("labels")
    for rows, name in ((df, "untrained"), (df.limit(0), "samples")):
        with pytest.raises(gates.GateError) as e:
            gates.write_gated(rows, str(tmp_path / "x"), rules, "json")
        assert set(e.value.failed) == {name}
    gates.write_gated(df.where("k = 1"), str(tmp_path / "x"), rules, "json")
    assert left(tmp_path) == ["x"]


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    df = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="no"):
        gates.write_gated(df, str(tmp_path / "x"), {"n": gates.Gate(F.count("v"), lambda v: True, "")})
    assert left(tmp_path) == []


@pytest.mark.parametrize("change,wrong", [({}, None), ({"training": None}, "recorded"), ({"training": {"total_tokens": 100}}, "boundaries"), ({"training": {"total_tokens": 10, "document_eos_version": 1}}, "tokens")])
def test_base_checkpoints(change, wrong):
    base = {"model": {"parameter_count": 5}, "tokenizer": {}, "training": {"total_tokens": 100, "document_eos_version": 1}} | change
    assert gates.check_base(base, 0) is None
    if wrong is None:
        assert gates.check_base(base, 20) == 20
    else:
        with pytest.raises(gates.GateError) as e:
            gates.check_base(base, 20)
        assert set(e.value.failed) == {wrong}
    with pytest.raises(ValueError):
        gates.check_base({"model": {}}, 0)


def test_the_ledger_and_a_second_run(spark, tmp_path):
    calls = []

    def source(name, bucket, n, broken=()):
        def rows(s):
            calls.append(name)
            if name in broken:
                raise OSError("not there")
            return s.range(n).select("id", F.concat(F.lit(f"{name}-"), F.col("id").cast("string")).alias("text"))

        return R.Source(name, bucket, rows, lambda r: r.where("id % 2 = 0").select("key__", "text"))

    outputs = [R.Output("all", ["a"]), R.Output("some", ["a"], ["two"]), R.Output("other", ["b"]), R.Output("none", ["c"])]
    broken = {"bad"}
    plan = lambda: [source("one", "a", 10, broken), source("two", "a", 6, broken), source("bad", "b", 8, broken), source("empty", "b", 0, broken)]
    out = R.prepare(spark, plan(), outputs, str(tmp_path), 100, 1)
    assert out["counts"] == {"all": 8, "some": 5, "other": 0, "none": 0}
    assert [e["source"] for e in out["errors"]] == ["bad", "empty"] and "OSError: not there" in out["errors"][0]["error"]
    assert json.loads((tmp_path / "manifest.json").read_text()) == out
    first = [r.text for r in spark.read.json(str(tmp_path / "outputs/all")).select("text").collect()]
    assert sorted(first) == sorted([f"one-{i}" for i in range(0, 10, 2)] + [f"two-{i}" for i in range(0, 6, 2)]) and first != sorted(first)
    # what failed is tried again, what is done isn't read again
    calls.clear()
    broken.clear()
    out = R.prepare(spark, plan(), outputs, str(tmp_path), 100, 1)
    assert calls == ["bad", "empty"] and out["counts"]["other"] == 4 and out["prepared_sources"] == 3
    states = [(r.source, r.state) for r in R.Store(spark, str(tmp_path)).ledger().orderBy("try").collect()]
    assert states == [("one", "done"), ("two", "done"), ("bad", "error"), ("empty", "error"), ("bad", "done"), ("empty", "error")]
    # another limit is another preparation
    calls.clear()
    out = R.prepare(spark, plan(), outputs, str(tmp_path), 4, 1)
    assert calls[:3] == ["one", "two", "bad"] and out["sources"]["one"]["sampled"] == 4
    with pytest.raises(RuntimeError):
        R.prepare(spark, plan()[3:], outputs, str(tmp_path / "x"), 4, 1)
    with pytest.raises(ValueError):
        R.prepare(spark, plan() + plan(), outputs, str(tmp_path / "x"), 4, 1)


def plain_paths(node, cap):
    """(place, texts) of usable paths."""
    def usable(n):
        flagged = any(k == "spam" and v["value"] >= 0.5 and v.get("count", 1) > 0 for k, v in n.get("labels", {}).items()) or any(k == "insult" and v >= 0.5 for k, v in n.get("detoxify", {}).items())
        return bool((n.get("text") or "").strip()) and n.get("role") in ("prompter", "assistant") and n.get("lang") == "en" and not n.get("deleted") and n.get("review_result") is not False and not (n["role"] == "assistant" and (n.get("rank") or 0) > 1) and not flagged

    def down(n, place, texts):
        texts = [*texts, n["text"].strip()]
        below = [r for r in n.get("replies") or [] if usable(r)]
        if not below or len(texts) == cap:
            return [(place, texts)]
        return [p for i, r in enumerate(below) for p in down(r, [*place, i], texts)]

    return down(node, [], []) if usable(node) else []


@pytest.mark.parametrize("cap", [None, 3])
def test_trees_of_any_depth(spark, cap):
    import random

    r = random.Random(2)

    def node(depth):
        out = {"text": r.choice([" a ", "b ", "c", "", None]) if r.random() < 0.03 else f"t{r.random()}", "role": r.choice(["prompter", "assistant"]), "lang": "en" if r.random() < 0.99 else "de"}
        odd = r.random() * 6
        if odd < 0.05:
            out["deleted"] = True
        elif odd < 0.1:
            out["review_result"] = False
        elif odd < 0.15:
            out["rank"] = 3
        elif odd < 0.2:
            out["labels"] = {"spam": {"value": r.random(), "count": r.choice([0, 2])}, "quality": {"value": 1.0}}
        elif odd < 0.25:
            out["detoxify"] = {"insult": r.random()}
        if depth:
            out["replies"] = [node(depth - 1) for _ in range(2 if depth % 8 == 0 else 1)]
        return out

    given = [node(r.choice([0, 3, 25])) for _ in range(40)]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(given)], "`a.b` long, j string").withColumn("t", F.parse_json("j"))
    out = trees.deep_paths(df, "t", "a.b", max_depth=cap)
    got = sorted((x["a.b"], x.place, [m.content for m in x.messages]) for x in out.collect())
    assert got == sorted((i, p, t) for i, tree in enumerate(given) for p, t in plain_paths(tree, cap))
    assert any(len(t) > 20 for _, _, t in got) or cap
    whole = trees.conversations(out.withColumnRenamed("a.b", "k"), state=True)
    assert "state" in whole.columns
