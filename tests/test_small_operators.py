import hashlib

import pytest
from pyspark.sql import functions as F

from textloom.operators import account as A
from textloom.operators import convert as V
from textloom.operators import generate as G
from textloom.operators import sampling as S
from textloom.operators import tokens as K


def test_generated_sentences(spark):
    make = lambda seed: [r.text for r in G.sentences(spark, 200, seed, ["{a} sees {b}.", "No {a}!"], {"a": ["x", "y", "z"], "b": ["one", "two"]}).orderBy("i").collect()]
    first = make(1)
    assert first == make(1) and first != make(2)
    assert all(t.startswith("No ") for t in first[1::2]) and {t[0] for t in first[::2]} == {"x", "y", "z"}
    assert spark.range(1).select(G.capitalized(F.lit("éLAN x"))).first()[0] == "Élan x"


def test_scenario_formats(spark):
    out = G.scenario_formats(spark.range(8).withColumnRenamed("id", "s"), spark.range(9).withColumnRenamed("id", "f"))
    assert out.count() == 72 and out.distinct().count() == 72


def test_vocabulary_checks():
    K.check_vocabulary(["a", "b", "ab", K.UNK, K.EOS], [("a", "b")])
    for vocabulary, merges in (([], ()), (["a", "a"], ()), ([K.EOS, "a"], ()), (["a", "b"], [("a", "b")]), (["a", "b", "ab"], [("a", "b")] * 2)):
        with pytest.raises(ValueError):
            K.check_vocabulary(vocabulary, merges)


def test_gates_and_resume_digest(spark):
    assert [r[0] for r in spark.createDataFrame([(1.0,), (9.0,)], "x double").select(A.beats_uniform(F.col("x"), 2048)).collect()] == [True, False]
    batches = S.epoch_batches(spark.range(50).withColumnRenamed("id", "k"), "k", 1, 0, 20)
    ids = [r.k for r in batches.where("batch = 1").orderBy("place").collect()][:10]
    assert A.batch_digest(batches, 1, "k").first().digest == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_scripted_emotions(spark):
    rows = [("0", "2", "B", "c", "Joy"), ("0", "0", "A", "a", "neutral"), ("0", "1", "B", " b\n", "anger"), ("1", "0", "C", "", "joy"), ("0", "3", "A", "d", "fear")]
    out = V.scripted_emotions(spark.createDataFrame(rows, "Dialogue_ID string, Utterance_ID string, Speaker string, Utterance string, Emotion string")).orderBy("utterance_index").collect()
    assert [(r.prompt, r.emotion) for r in out] == [("A: a", "neutral"), ("A: a\nB: b", "anger"), ("A: a\nB: b\nB: c", "joy"), ("B: b\nB: c\nA: d", "fear")]
