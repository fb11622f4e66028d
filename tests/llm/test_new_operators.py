"""Importance resampling, vector codes and personal data against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import plain
import pytest

from textloom.llm import codes, pii, resampling
from textloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

# importance resampling


def resampled(docs, target, shortest=1, longest=1, buckets=10_000, least=20, percent=10):
    """(key, n_features, weight, score, rank) of (key, text) pairs."""
    def features(t):
        w = plain.ALNUM.findall(plain.lower(t))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]

    cut = [(k, *features(t)) for k, t in docs]
    s, t = Counter(b for _, _, f in cut for b in f), Counter(b for x in target for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for k, w, f in cut:
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    eligible = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("options", [{}, {"shortest": 1, "longest": 3, "buckets": 64, "percent": 50}])
def test_resampling(spark, docs, rows, options):
    target = [rows[0][1], None, "", "a word of its own"]
    given = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.resample(docs, given, **{k: v for k, v in options.items()})
    assert out.columns == ["doc_id", "lang", "source", "n_chars", *resampling.ADDED]
    got = sorted((tuple(r) for r in out.select("doc_id", *resampling.ADDED).collect()), key=str)
    assert got == resampled([(r[0], r[1]) for r in rows], target, **options)


def test_resampling_ties_nulls_and_repeats(spark):
    rows = [(None, "x y " * 10)] * 3 + [(7, "x y " * 10)] * 3 + [(1, "x"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = resampling.resample(docs, docs.select("text"), percent=100).collect()
    assert len(out) == 9 and sorted(r.rank for r in out if r.rank) == [1, 2, 3, 4, 5, 6]
    assert {r.weight for r in out if r.doc_id in (2, 3)} == {0}
    ranks = {k: sorted(r.rank for r in out if r.doc_id == k and r.rank) for k in (None, 7)}
    assert sorted(ranks.values()) == [[1, 2, 3], [4, 5, 6]]


def test_resampling_of_empty_tables(spark, docs, empty):
    assert resampling.resample(empty, docs).count() == 0
    out = resampling.resample(docs, empty)
    assert out.count() == docs.count() and out.where("rank IS NOT NULL").count() > 0


def test_resampling_prefers_the_target(spark):
    r = random.Random(3)
    say = lambda words: " ".join(r.choices(words, k=40))
    near, far = [f"near{i}" for i in range(50)], [f"far{i}" for i in range(50)]
    docs = spark.createDataFrame([(i, say(near if i % 10 == 0 else far)) for i in range(200)], "doc_id long, text string")
    target = spark.createDataFrame([(say(near),) for _ in range(20)], "text string")
    drawn = resampling.resample(docs, target).where("rank IS NOT NULL")
    assert drawn.count() == 20 and drawn.where("doc_id % 10 <> 0").count() == 0


# vector codes


def lloyd(vectors, parts=4, entries=256, rounds=4):
    """(codes, errors, codebooks) of rows of numbers sorted by key."""
    v = np.array([[math.floor(1024 * x) for x in r] for r in vectors], object)
    width = v.shape[1] // parts
    cut = [v[:, p * width : (p + 1) * width] for p in range(parts)]
    books = [c[:entries].copy() for c in cut]

    def nearest(x, book):
        return [min((sum((a - b) ** 2 for a, b in zip(r, e)), i) for i, e in enumerate(book)) for r in x]

    for _ in range(rounds):
        for x, book in zip(cut, books):
            at = [i for _, i in nearest(x, book)]
            for e in set(at):
                own = [r for r, i in zip(x, at) if i == e]
                book[e] = [sum(c) // len(own) for c in zip(*own)]
    last = [nearest(x, b) for x, b in zip(cut, books)]
    return ["".join(f"{a[i][1]:02x}" for a in last) for i in range(len(v))], [sum(a[i][0] for a in last) for i in range(len(v))], books


@pytest.mark.parametrize("seed,n,spread,entries", [(0, 120, 0.002, 8), (1, 200, 1.0, 16), (2, 5, 0.5, 256), (3, 150, 0.004, 150), (4, 60, 30_000.0, 8), (5, 40, 0.0, 7)])
def test_codes(spark, seed, n, spread, entries):
    """Small spreads make many ties and equal parts, large ones leave doubles."""
    r = random.Random(seed)
    vectors = [[r.uniform(-spread, spread) for _ in range(8)] for _ in range(n)]
    vectors = [[np.float32(x).item() for x in v] for v in vectors]
    vectors[n // 2 :: 3] = [vectors[n - 1]] * len(vectors[n // 2 :: 3])
    labels = [r.choice([None, 0, 1, 2]) for _ in range(n)]
    df = spark.createDataFrame([(i, v, l) for i, (v, l) in enumerate(zip(vectors, labels))], "vec_id long, embedding array<float>, label int").repartition(3)
    want, errors, books = lloyd(vectors, entries=entries)
    by_label = Counter()
    for e, l in zip(errors, labels):
        by_label[l] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = codes.compress(df, entries=entries).orderBy("vec_id").collect()
    assert [tuple(x) for x in got] == [(i, l, c, e, by_label[l], digest) for i, (l, c, e) in enumerate(zip(labels, want, errors))]


def test_codes_leave_bad_vectors_out(spark):
    good = [float(i) for i in range(8)]
    rows = [(0, None), (1, []), (2, [None] * 8), (3, good), (4, [float("nan"), *good[1:]]), (5, [float("inf"), *good[1:]]), (6, good[:4]), (7, good[:7]), (None, good), (3, [1e30] * 8)]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, `a.b` string")
    out = codes.compress(df, label=None).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in out) == [(False, 3), (False, 3), (True, None)]
    assert all(r.label_error is None and r["a.b"] == "x" and r.error == 0 for r in out)
    assert codes.compress(df.limit(0), label=None).count() == 0
    assert codes.compress(df.where("vec_id < 3"), label=None).columns == ["vec_id", "a.b", *codes.ADDED]


def test_many_labels_are_joined(spark, monkeypatch):
    monkeypatch.setattr(codes, "HEAVY", 4)
    df = spark.createDataFrame([(i, [float(i % 7)] * 4, i if i % 2 else None) for i in range(60)], "vec_id long, embedding array<float>, label int")
    out = codes.compress(df, entries=3).collect()
    sums = Counter()
    for r in out:
        sums[r.label] += r.error
    assert len(out) == 60 and all(r.label_error == sums[r.label] for r in out)


def test_bounds_pass_over_most_parts():
    r = np.random.default_rng(0)
    centres = r.integers(-5000, 5000, (8, 4))
    x = centres[r.integers(0, 8, 500)] + r.integers(-20, 20, (500, 4))
    first = codes.Step.after(None, centres)
    e, u, l, n = codes.assign(x, first, None, np.zeros(500), np.zeros(500))
    assert n == 500
    moved = centres + r.integers(-3, 3, centres.shape)
    e2, _, _, n = codes.assign(x, codes.Step.after(centres, moved), e, u, l)
    assert n == 0 and (e2 == codes.distances(x, moved).argmin(1)).all()


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(d) <= 15


def base_spans(t):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if valid(k, m[0])]


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def generated(seed, n=300):
    r = random.Random(seed)
    pieces = ["@", ".", "+", "-", " ", "(", ")", "_", "a", "b.c", "x@y.z", "4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "300.1", "+1 (800) 555-1212", "é", "😀", "12", "\n", "0", "255", "%"]
    return ["".join(r.choices(pieces, k=r.randint(0, 14))) for _ in range(n)]


ODD = [
    None, "", "@", "+", "a@b.c_d@e.f g@h.i", "1.2.3.4.5.6.7.8 300.1.1.1 0001.002.3.4", "1111 2222 3333 4444 5555", "+1 (800) 555-1212 +12 +1 2",
    "4111-1111-1111-1111 4111111111111111x 41111111111111112222", "a" * 50_000, "1" * 50_000, "1." * 20_000, "a@b.c " * 3_000, "4111111111111111 " * 3_000, "+1" * 5_000, "@a" * 5_000,
]


def test_base_spans(spark):
    texts = ODD + generated(1) + generated(2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    out = {r.doc_id: r for r in pii.personal_data(docs, precision=2.0).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert (out[i].spans, out[i].base_sha256) == (said(want), hashlib.sha256(said(want).encode()).hexdigest()), t
        assert tuple(out[i][c] for c in pii.COUNTS) == tuple(sum(k == x[0] for x in want) for k in pii.KINDS)


def with_cards(n=1200):
    """Texts with a card each, a few with a wrong check digit, and ids of the same length in words."""
    r = random.Random(5)
    out = []
    for i in range(n):
        d = "".join(r.choices("0123456789", k=15))
        good = next(d + c for c in "0123456789" if luhn(d + c))
        card = good if i % 100 else good[:-1] + str((int(good[-1]) + 1) % 10)
        after = " 10.1" if i == 50 else " now"  # what follows makes the base's match longer, and fail
        out.append(f"pay with card {card}{after}" if i % 2 == 0 else f"file x{''.join(r.choices('0123456789', k=16))}y here")
    return out


def test_trees_add_what_looks_alike(spark):
    texts = with_cards()
    docs = spark.createDataFrame([(i, t, {"k": i}) for i, t in enumerate(texts)], "doc_id int, text string, `a.b` map<string,int>").repartition(4)
    out = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert out[0]["a.b"] == {"k": 0}
    for i, t in enumerate(texts):
        if i % 100 == 0 or i == 50:  # mistyped, or run into another number
            assert out[i].n_card == 0 and out[i].spans == "card:14:30"
        elif i % 2 == 0:
            assert out[i].n_card == 1 and out[i].spans == "card:14:30"
        else:
            assert out[i].spans == said(base_spans(t))


def test_margins_and_thresholds_by_plain_version(spark):
    """Trees as expressions give what they give as arrays, and selection follows."""
    r = np.random.default_rng(1)
    cells = np.unique(r.integers(0, pii.CELLS, 300))
    n = r.integers(1, 50, len(cells))
    y = (n * r.random(len(cells))).astype(int)
    model = pii.boost(cells, n.astype(float), y.astype(float))
    df = spark.createDataFrame([(int(c),) for c in cells], "cell int")
    from pyspark.sql import functions as F

    got = {x.cell: x.m for x in df.select("cell", model.margin(F.col("cell")).alias("m")).collect()}
    assert np.allclose([got[c] for c in cells.tolist()], model.margins(cells))
    loss = lambda m: -(y * m - n * np.logaddexp(0, m)).sum()
    assert loss(model.margins(cells)) < 0.95 * loss(np.full(len(cells), model.start))


def test_calibration():
    m = np.array([0.0, 1.0, 2.0, 3.0])
    n = np.array([100, 100, 100, 100])
    assert pii.calibrated(m, n, np.array([0, 99, 90, 100]), 0.9) == 1.0  # 1 and 2 are one step
    assert pii.calibrated(m, n, np.array([0, 10, 20, 30]), 0.9) == math.inf
    assert pii.calibrated(m[:1], np.array([5]), np.array([5]), 0.9) == math.inf  # too few


def test_prefixes(spark):
    from pyspark.sql import functions as F

    rows = [[], [3], list(range(50)), [1] * 1000]
    df = spark.createDataFrame([(x,) for x in rows], "a array<int>")
    assert [r.p for r in df.select(pii.prefixes(F.col("a")).alias("p")).collect()] == [[sum(x[:i]) for i in range(len(x))] for x in rows]


def test_redaction(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([("mail é a@b.cd or 1.2.3.4", [(0, 7, 13), (1, 17, 24)]), ("none", []), (None, None)], "text string, s array<struct<kind:int,start:int,stop:int>>")
    assert [r.text for r in pii.redact(docs, F.col("s")).collect()] == ["mail é <email> or <ip>", "none", None]


def test_personal_data_of_an_empty_table(spark, empty):
    assert pii.personal_data(empty).collect() == []


def test_op13_registered(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    out = QUERIES["op13_personal_data"](spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(said(want).encode()).hexdigest()
        assert set(filter(None, r.spans.split(","))) >= {said([s]) for s in want}
