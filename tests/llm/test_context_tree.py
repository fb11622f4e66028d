"""Context-tree weighting over whole texts, against a recursive version."""

import math
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import context_tree

TEXTS = [
    "The cat sat.", "the dog é sat on", "", None, "cat cat cat", "zz top 12", "the cat and the dog\n", "unseen: Ω!", "a" * 130 + " cats  thesis", "\x00 theses",
    "thesis the\tcatalogue", "a" * 130, "The cat sat.", "the dog sat. The cat sat", "ab\ncd ab\ncd",
]


def path(data, i):
    """A byte's contexts, from none to the longest."""
    before = [data[i - k] if i >= k else 0xFE for k in range(1, context_tree.DEPTH + 1)]
    return [tuple(before[:d]) for d in range(context_tree.DEPTH + 1)]


def decisions(text):
    data = plain.lower(text).encode() + b"\xff"
    for i, b in enumerate(data):
        for k in range(8):
            yield path(data, i), 1 << k | b >> (8 - k), b >> (7 - k) & 1


def recursive(train, texts):
    """log10 probability of each text, a decision at a time."""
    counts, children = Counter(), defaultdict(set)
    for t in train:
        for nodes, place, bit in decisions(t):
            for d, node in enumerate(nodes):
                counts[node, place, bit] += 1
                if d:
                    children[nodes[d - 1], place].add(node)

    @cache
    def weighted(node, place):
        own = plain.kt(counts[node, place, 0], counts[node, place, 1])
        if len(node) == context_tree.DEPTH:
            return own
        return math.log(0.5) + np.logaddexp(own, sum(weighted(x, place) for x in children[node, place]))

    def one(nodes, place):
        n0, n1 = counts[nodes[0], place, 0], counts[nodes[0], place, 1]
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if len(nodes) == 1:
            return own
        stop = math.exp(math.log(0.5) + plain.kt(n0, n1) - weighted(nodes[0], place))
        return stop * own + (1 - stop) * one(nodes[1:], place)

    return [sum(math.log10(p if bit else 1 - p) for nodes, place, bit in decisions(t) for p in [one(nodes, place)]) for t in texts]


def score(spark, table):
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    return context_tree.score(df, training).collect()


def test_grams():
    keys, ends = context_tree.grams(pa.array(["Ab", None, "x yé"]).slice(0, 3))
    expected = []
    for t in ("ab", "", "x yé"):
        data = t.encode() + b"\xff"
        expected += [int.from_bytes(bytes([*path(data, i)[-1], b]), "big") for i, b in enumerate(data)]
    assert keys.tolist() == expected and ends.tolist() == [0, 3, 4, 10]
    assert context_tree.grams(pa.array([], pa.string()))[1].tolist() == [0]


@pytest.mark.parametrize("size", [1, 1 << 17])
def test_all_depths_are_mixed(spark, monkeypatch, size):
    """Also where counts leave a task often, groups are worked on one by one and most
    grams are joined."""
    for name in ("HEAD", "CHUNK", "HELD"):
        monkeypatch.setattr(context_tree, name, min(size, getattr(context_tree, name)))
    table = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in score(spark, table)}
    want = recursive([t for i, t in table if not plain.held_out(i)], TEXTS)
    assert len(got) == len(table)
    for (i, t), w, (held, n, known, total, base) in zip(table, want, plain.base_scores(table)):
        r = got[i]
        assert math.isclose(r.score, w, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.code_length, -w * math.log2(10) / (len((t or "").encode()) + 1), rel_tol=1e-9)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9)


def test_the_query_knows_the_word_before(spark, tmp_path):
    """Two held-out texts of the same words: the one in the trained order is likelier."""
    from textloom.llm.queries import QUERIES

    held = [i for i in range(200) if plain.held_out(i)][:2]
    table = [(i, "red fox \nold owl \n") for i in range(40) if not plain.held_out(i)] + [(held[0], "red fox \nold owl \n"), (held[1], "red owl \nold fox \n")]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in QUERIES["op5_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got[held[0]] > got[held[1]] + 1
    want = recursive([t for i, t in table if not plain.held_out(i)], [t for _, t in table])
    assert all(math.isclose(got[i], w, rel_tol=1e-9) for (i, _), w in zip(table, want))


def test_held_out_texts_need_fewer_bits_than_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("doc_id % 4 = 0")
    r = context_tree.score(docs, "doc_id % 20 > 0").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_no_training_no_rows_and_odd_columns(spark, empty):
    only = next(i for i in range(100) if plain.held_out(i))
    (r,) = score(spark, [(only, "abc")])
    assert math.isclose(r.score, 4 * 8 * math.log10(0.5)) and (r.n_known, r.train_tokens) == (0, 0)
    assert context_tree.score(empty, "doc_id > 0").count() == 0
    odd = spark.createDataFrame([(1, "a b", "x", 2, 3, 4, {"k": 5})], "id int, text string, `a.b` string, row__ int, grams__ int, Score int, m map<string,int>")
    out = context_tree.score(odd, "true")
    assert out.columns[:5] == ["id", "a.b", "row__", "grams__", "m"] and tuple(out.first()[:5]) == (1, "x", 2, 3, {"k": 5})
