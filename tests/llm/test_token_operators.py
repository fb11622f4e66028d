import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import frequent, lm, packing, token_counts, vocab


def ids_of(text):
    return vocab.load(vocab.vocabulary_path()).encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_library_s(rows):
    rng = np.random.default_rng(2)
    alphabet = [*map(chr, range(0x20, 0x180)), " ", " ", "\n", "́", "̸", "Σ", "İ", "<|endoftext|>", "'s", "'LL", "中", "한", "　"]
    texts = [r[1] for r in rows] + ["".join(rng.choice(alphabet, size=rng.integers(0, 15)).tolist()) for _ in range(3000)]
    ids, ends = vocab.piece_ids(pa.array(texts, pa.string()), vocab.vocabulary_path())
    expected = [ids_of(t) for t in texts]
    assert [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(texts))] == expected
    codes, distinct, ends = vocab.pre_tokens(pa.array(texts, pa.string()))
    n = vocab.pieces_of(distinct.to_pylist(), vocab.vocabulary_path())[codes]
    assert [int(n[a:b].sum()) for a, b in zip(ends[:-1], ends[1:])] == list(map(len, expected))


def test_token_counts(docs, rows, empty):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs).collect()}
    assert got == {i: (len((t or "").encode()), n := len(ids_of(t)), n > 2048) for i, t, *_ in rows}
    assert token_counts.token_counts(empty).count() == 0


def check_packing(out, table):
    pieces = set()
    for i, t in table:
        ids = np.array([*ids_of(t), 0], "<u4")
        pieces |= {(i, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == pieces
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_token_counts_beyond_the_head(spark, docs, rows, monkeypatch):
    """Rare and very long pre-tokens, repeated rows, and columns with clashing names."""
    monkeypatch.setattr(frequent, "HEAD", 20)
    assert len(frequent.head(spark.createDataFrame([(bytes([i]), i) for i in range(1, 100)], "token binary, n long"), 20)) <= 20
    extra = docs.withColumn("N_Tokens", F.lit("x")).withColumn("pieces", F.lit("y")).withColumn("row__", F.lit(1))
    long = spark.createDataFrame([(-1, "a" * 100_000 + " " + "é'" * 50_000, None, None, 0)], docs.schema)
    extra = extra.unionByName(long, allowMissingColumns=True)
    out = token_counts.token_counts(extra.unionByName(extra))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "pieces", "row__", "n_bytes", "n_tokens", "over_limit"]
    tokenizer = vocab.load(vocab.vocabulary_path())
    texts = {i: t or "" for i, t, *_ in rows} | {-1: "a" * 100_000 + " " + "é'" * 50_000}
    found = {(r.doc_id, r.n_bytes, r.n_tokens): r.n for r in out.groupBy("doc_id", "n_bytes", "n_tokens").agg(F.count("*").alias("n")).collect()}
    assert found == {(i, len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)): 2 for i, t in texts.items()}


def test_packing(docs, rows, empty):
    out = packing.pack(docs.select("doc_id", "text")).collect()
    bins = check_packing(out, [(r[0], r[1]) for r in rows])
    assert bins == math.ceil(sum(r.length for r in out) / 2048)
    assert packing.pack(empty).count() == 0
    twice = packing.pack(docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))).collect()
    assert len(twice) == 2 * len(out)
    check_packing(twice, [(r[0], r[1]) for r in rows])


def test_packing_merges_underfull_bins_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 7)
    table = [(i, "a " * (300 + 13 * (i % 31))) for i in range(120)]
    out = packing.pack(spark.createDataFrame(table, "doc_id long, text string").repartition(24)).collect()
    bins = check_packing(out, table)
    assert bins <= 1.25 * sum(r.length for r in out) / 2048


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit(np.array([6, 5, 4, 5]), 10).tolist() == [0, 1, 0, 1]
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 11, size=500)
    found = packing.best_fit(sizes, 10)
    assert np.bincount(found, weights=sizes).max() <= 10
    assert found.max() + 1 <= sizes.sum() / 10 * 1.05 + 1


def score(spark, table, **more):
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    return lm.score(df, training, **more)


def test_base_scores(spark, rows, monkeypatch):
    table = [(r[0], r[1]) for r in rows] + [(None, "no id"), (900, "w" * 200 + " " + "w" * 200), (901, "W" * 48 + "\n" + "w" * 47)]
    for head in (4, 1 << 17):  # most units are looked up by a join, or none is
        monkeypatch.setattr(frequent, "HEAD", head)
        got = {r.doc_id: r for r in score(spark, table).collect()}
        for (i, _), (held, n, known, total, base) in zip(table, plain.base_scores(table)):
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
            assert math.isclose(r.base_score, base, rel_tol=1e-9)


def decisions(text, kept, begin):
    """(context by depth, place, bit) of every decision about a text's bytes."""
    data = plain.lower(text).encode() + bytes([lm.END])
    units, unit = [], b""
    for b in data:
        unit += bytes([b])
        if b in b" \t\n\v\f\r\xff":
            units.append(unit)
            unit = b""
    for unit in units:
        for lo in range(0, len(unit), lm.CUT):
            piece = (bytes([lm.ON]) if lo else b"") + unit[lo : lo + lm.CUT]
            for i in range(bool(lo), len(piece)):
                c = [piece[i - k] if i >= k else lm.START for k in (1, 2, 3)]
                path = ["", (c[0],), (c[0], c[1])] + ([tuple(c)] if kept is None or tuple(c) in kept else [])
                path.append(("from", piece[:i]) if i >= begin(piece) else ("end", path[-1]))
                for k in range(8):
                    yield path, 1 << k | piece[i] >> (8 - k), piece[i] >> (7 - k) & 1


def ctw_log10(train, text, kept=None, begin=lambda piece: 3):
    """Recursive context-tree weighting, a decision at a time."""
    counts, children, deepest = Counter(), defaultdict(set), set()
    for t in train:
        for path, place, bit in decisions(t, kept, begin):
            for d, node in enumerate(path):
                counts[node, place, bit] += 1
                if d:
                    children[path[d - 1], place].add(node)
            deepest.add((path[-1], place))

    memo = {}

    def weighted(node, place):
        if (node, place) not in memo:
            e = plain.kt(counts[node, place, 0], counts[node, place, 1])
            if (node, place) not in deepest:
                w = sum(weighted(x, place) for x in children[node, place])
                e = math.log(0.5) + max(e, w) + math.log1p(math.exp(-abs(e - w)))
            memo[node, place] = e
        return memo[node, place]

    def p_one(path, place):
        n0, n1 = counts[path[0], place, 0], counts[path[0], place, 1]
        if n0 + n1 == 0:
            return 0.5
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if len(path) == 1:
            return own
        share = math.exp(math.log(0.5) + plain.kt(n0, n1) - weighted(path[0], place))
        return share * own + (1 - share) * p_one(path[1:], place)

    return sum(math.log10(p if bit else 1 - p) for path, place, bit in decisions(text, kept, begin) for p in [p_one(path, place)])


CTW = ["The cat sat.", "the dog é sat on", "", None, "cat cat cat", "zz top 12", "the cat and the dog\n", "unseen: Ω!", "a" * 130 + " cats  thesis", "\x00 theses", "thesis the\tcatalogue", "a" * 130]


@pytest.mark.parametrize("keep", [1 << 17, 0])
def test_context_tree_weighting(spark, monkeypatch, keep):
    monkeypatch.setattr(lm, "KEEP", keep)
    table = list(enumerate(CTW))
    train = [t for i, t in table if not plain.held_out(i)]
    assert len(train) < len(table)
    for r in score(spark, table).collect():
        t = dict(table)[r.doc_id]
        assert math.isclose(r.score, ctw_log10(train, t, None if keep else ()), rel_tol=1e-6, abs_tol=1e-6)
        assert math.isclose(r.code_length, -r.score * math.log2(10) / (len((t or "").encode()) + 1))


def test_large_groups_of_units_begin_later(spark, monkeypatch):
    """With more than two units of three bytes alike, six bytes tell a group."""
    monkeypatch.setattr(lm, "GROUP", 2)
    monkeypatch.setattr(lm, "BEGINS", (3, 6))
    monkeypatch.setattr(lm, "CHUNK", 2)
    table = list(enumerate(CTW))
    train = [t for i, t in table if not plain.held_out(i)]
    units = {u for _, t in table for u in lm.units(pa.array([t], pa.string()))[1].to_pylist() if u[0] != lm.DIGEST}
    times = Counter(u[:3] for u in units)
    for r in score(spark, table).collect():
        want = ctw_log10(train, dict(table)[r.doc_id], None, lambda piece: 6 if times[piece[:3]] > 2 else 3)
        assert math.isclose(r.score, want, rel_tol=1e-6, abs_tol=1e-6)


def test_held_out_code_length(spark):
    """On held-out documents, real contexts need far fewer bits a byte than none,
    about as many as the word model (which leaves out the blanks), and fewer with more
    training texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    data = "\n".join(plain.lower(r.text) for r in docs.where("pmod(xxhash64(doc_id), 5) = 0").collect()).encode()
    share = np.bincount(np.frombuffer(data, np.uint8)) / len(data)
    alone = -(share[share > 0] * np.log2(share[share > 0])).sum()
    bits, base = [], []
    for training in ("pmod(xxhash64(doc_id), 5) > 0", "pmod(xxhash64(doc_id), 50) = 1"):
        held = lm.score(docs, training).where("pmod(xxhash64(doc_id), 5) = 0")
        r = held.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
        bits.append(-r.s * math.log2(10) / len(data))
        base.append(-r.b * math.log2(10) / len(data))
    assert bits[0] < bits[1] < alone and bits[0] < 0.65 * alone and bits[0] < 1.2 * base[0]


def test_a_model_without_training_texts(spark):
    only = next(i for i in range(100) if plain.held_out(i))
    r = score(spark, [(only, "abc")]).first()
    assert math.isclose(r.score, 4 * 8 * math.log10(0.5), rel_tol=1e-5)  # three letters and the end, eight bits each
    assert (r.n_known, r.train_tokens) == (0, 0)
    assert score(spark, [(only, "abc")]).limit(0).count() == 0


def test_empty_scores(empty):
    assert lm.score(empty, "doc_id > 0").count() == 0
