import hashlib
import random
from fractions import Fraction

import numpy as np
import plain
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import bits, blocks, components, decontam, jaccard, quality, simhash, substring

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x1cé🙂|#", max_size=60)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    w = blocks.words(pa.array(texts, pa.string()))
    assert [x.decode() for x in w.values.to_pylist()] == [x for t in texts for x in plain.words(t)]
    assert w.counts.tolist() == [len(plain.words(t)) for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_quality_facts(texts):
    f = quality.Facts(pa.array(texts, pa.string()))
    got = zip(f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words)
    assert [tuple(map(int, g)) for g in got] == [plain.quality(t)[:5] for t in texts]


def test_quality_report(docs, rows):
    got = {r.doc_id: tuple(r)[1:] for r in quality.quality_report(docs.select("doc_id", "text")).collect()}
    assert got == {i: plain.quality(t) for i, t, *_ in rows}


def test_quality_order_and_short_circuit(rows):
    texts = pa.array([t for _, t, *_ in rows], pa.string())
    rules = (*quality.BASE, *quality.RULES)
    expected = [plain.quality(t)[-1] for _, t, *_ in rows]
    assert quality.passes(quality.Facts(texts), rules).tolist() == expected
    assert quality.passes(quality.Facts(texts), rules[::-1]).tolist() == expected
    seen = []  # a rule sees what those before it left

    def watch(rule):
        return quality.Rule(rule.name, lambda f: (seen.append(len(f.n_words)), rule.rejects(f))[1])

    alone = [int((~r.rejects(quality.Facts(texts))).sum()) for r in rules[:1]]
    quality.passes(quality.Facts(texts), [watch(r) for r in rules])
    assert seen[0] == len(texts) and seen[1] == alone[0] and seen == sorted(seen, reverse=True)


def test_rules_are_ordered_by_what_they_still_reject(spark, docs, rows):
    names = [r.name for r in quality.RULES]  # long, symbols, word_length, dup_lines, top_word
    cost = dict.fromkeys(names, 1.0)
    seen = quality.Seen(cost | {"long": 0.1}, {0b00010: 5, 0b00110: 60, 0b01000: 40, 0b10000: 1, 0: 10})
    # word_length's rows are all rejected by symbols, so that it comes last; long rejects none
    assert [r.name for r in quality.ordered(quality.RULES, seen)] == ["symbols", "dup_lines", "top_word", "long", "word_length"]
    found = quality.estimate(docs, quality.RULES, base=quality.BASE)
    texts = pa.array([t for _, t, *_ in rows], pa.string())
    facts = quality.Facts(texts)
    left = ~np.logical_or.reduce([r.rejects(facts) for r in quality.BASE])
    mask = sum(r.rejects(facts).astype(int) << i for i, r in enumerate(quality.RULES))[left]
    assert found.masks == {int(m): int(n) for m, n in zip(*np.unique(mask, return_counts=True))} and set(found.seconds) == set(names)


def test_quality_filter_keeps_columns(docs, rows):
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t, *_ in rows if plain.quality(t)[-1]]


def near_expected(rows, n=4, radius=4):
    f = [plain.fingerprint(t, n) for _, t, *_ in rows]
    label = plain.groups(len(f), lambda i, j: (f[i] ^ f[j]).bit_count() <= radius)
    return {rows[i][0]: (f"{f[i]:016x}", rows[label[i]][0]) for i in range(len(f))}


def test_simhash_components(docs, rows):
    out = simhash.near_duplicates(docs.select("doc_id", "text")).select("doc_id", F.lower(F.hex("fp")).alias("fp"), "component_id")
    assert {r.doc_id: (r.fp, r.component_id) for r in out.collect()} == near_expected(rows)


@pytest.mark.parametrize(("lanes", "radius"), [(1, 4), (4, 51)])
def test_bit_sliced_links_connect_what_is_near(lanes, radius):
    rng = np.random.default_rng(lanes)
    f = rng.integers(0, (1 << 64) - 1, size=(60, lanes), dtype=np.uint64)[rng.integers(0, 60, size=900)].copy()
    for row in f:
        for b in rng.integers(0, 64 * lanes, size=rng.integers(0, radius + 3)):
            row[b // 64] ^= np.uint64(1 << int(b % 64))
    bucket = np.sort(np.concatenate([rng.integers(0, 90, size=700), np.full(200, 999)]))
    near = lambda i, j: bucket[i] == bucket[j] and np.bitwise_count(f[i] ^ f[j]).sum() <= radius
    links = bits.link_near(bucket, f, radius).tolist()
    assert all(near(a, b) for a, b in links)
    have = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    for b in np.unique(bucket):
        at = np.flatnonzero(bucket == b)
        n = len(at)
        assert plain.groups(n, lambda i, j: near(at[i], at[j])) == plain.groups(n, lambda i, j: (at[i], at[j]) in have)


def test_every_pair_within_the_radius_meets_in_a_table():
    tables = simhash.exact_tables(64, 4, 1000)
    rng = np.random.default_rng(3)
    for _ in range(300):
        flipped = set(rng.choice(64, size=4, replace=False).tolist())
        assert any(not flipped & set(t.tolist()) for t in tables)


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(bits, "BLOCK", 16)
    rng = np.random.default_rng(5)
    f = np.full(150, 0x0123456789ABCDEF, np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, size=150, dtype=np.uint64))
    f = np.unique(np.append(f, np.array([7, 8], np.uint64)))
    nodes = spark.createDataFrame([(i, int(x).to_bytes(8, "big")) for i, x in enumerate(f)], "node long, fp binary").repartition(3)
    links = simhash.links(nodes, 1, 4, simhash.exact_tables(64, 4, len(f))).collect()
    have = {(r.a, r.b) for r in links} | {(r.b, r.a) for r in links}
    n = len(f)
    assert plain.groups(n, lambda i, j: (i, j) in have) == plain.groups(n, lambda i, j: (int(f[i]) ^ int(f[j])).bit_count() <= 4)


def test_near_dedup_keeps_one_of_each_group(spark, rows, docs):
    kept = {r.doc_id for r in simhash.near_dedup(docs).collect()}
    by_text = {}
    for i, t, *_ in rows:
        by_text.setdefault(tuple(plain.words(plain.lower(t))), []).append(i)
    for copies in by_text.values():
        assert len(kept & set(copies)) <= 1
    assert set(range(25)) <= kept  # the originals
    assert not kept & set(range(25, 38))  # near and exact copies
    twice = simhash.near_dedup(docs.unionByName(docs))
    assert sorted(r.doc_id for r in twice.collect()) == sorted(kept)


def shingle_sets(texts):
    words = [plain.words(plain.lower(t)) for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]


def test_near_dedup_keeps_texts_below_the_similarity(spark):
    texts = [" ".join(f"t{k}w{i}" for i in range(404)) for k in range(40)]
    # 68 or 80 shingles differ on each side: 332 / 468 = 0.71 and 320 / 480 = 0.67
    near = [" ".join(f"other{i}" if i < 64 + 12 * (k % 2) else w for i, w in enumerate(t.split(" "))) for k, t in enumerate(texts)]
    a, b = shingle_sets([texts[0], near[0]])
    assert 0.6 < len(a & b) / len(a | b) < 0.8
    out = simhash.near_dedup(spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string"))
    assert out.count() == 80


def test_radius_keeps_the_similarity():
    """Random sets of a similarity just at 0.8, small ones and large ones."""
    radius = jaccard.radius_of(Fraction(4, 5))
    assert radius < 150
    rng = np.random.default_rng(1)
    h, per = [], []
    for _ in range(400):
        common = int(rng.choice([20, 24, 28, 40, 400]))
        both = rng.integers(0, 1 << 63, common, dtype=np.uint64)
        apart = rng.integers(0, common // 4 + 1)
        for n in (apart, common // 4 - apart):
            h.append(np.concatenate([both, rng.integers(0, 1 << 63, n, dtype=np.uint64)]))
            per.append(common + n)
    fps = bits.majority(blocks.mix(np.concatenate(h)), np.array(per), jaccard.LANES)
    far = np.bitwise_count(fps[::2] ^ fps[1::2]).sum(1)
    assert 70 < far.mean() < 90 and far.max() <= radius


def test_sets_in_a_family():
    """The sparse way and the dense one find what brute force finds."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 60)
    sets = []
    for _ in range(300):
        s = set(base.tolist()) - set(rng.choice(base, rng.integers(0, 9)).tolist()) | set(rng.integers(0, 40, rng.integers(0, 6)).tolist())
        sets.append(s)
    sets += [set(), set(), {1}, set(rng.integers(0, 1 << 62, 30_000).tolist())]
    alike = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    for many in (len(sets), 40):
        of = sets[-many:]
        h = np.array([x for s in of for x in sorted(s)], np.int64)
        links = jaccard.together(h, np.concatenate([[0], np.cumsum([len(s) for s in of])]), Fraction(4, 5)).tolist()
        first = len(sets) - many
        assert all(alike(a + first, b + first) for a, b in links)
        have = {(a, b) for a, b in links} | {(b, a) for a, b in links}
        assert plain.groups(many, lambda i, j: (i, j) in have) == plain.groups(many, lambda i, j: alike(i + first, j + first))


@pytest.mark.parametrize("block", [1024, 3])
def test_near_dedup_links_what_brute_force_links(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(3)
    texts = [None, " ", "a b", "A  b"]
    for k in range(30):  # about 0.8 on either side, and chains
        w = [f"t{k}w{i}" for i in range(r.randint(30, 120))]
        for _ in range(8):
            texts.append(" ".join(w))
            at = r.randrange(len(w))
            w = [*w[:at], *(f"x{r.random()}" for _ in range(r.randint(0, 12))), *w[at + r.randint(0, 3) :]]
    sets = shingle_sets(texts)
    alike = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    got = simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert {x.doc_id for x in got.collect()} == set(plain.groups(len(texts), alike))


def test_substring_counts(docs, rows):
    out = substring.substring_dedup(docs.select("doc_id", "text"), counts=True).collect()
    expected = plain.substring([t for _, t, *_ in rows])
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == {r[0]: e for r, e in zip(rows, expected)}


def test_substring_texts_keep_the_rest(docs, rows):
    out = {r.doc_id: r for r in substring.substring_dedup(docs).collect()}
    for (i, t, *rest), (n, removed, digest) in zip(rows, plain.substring([t for _, t, *_ in rows])):
        got = out[i]
        assert hashlib.sha256(" ".join(plain.words(got.text)).encode()).hexdigest() == digest
        assert (got.lang, got.source) == tuple(rest[:2])
        if not removed:
            assert got.text == t


def test_substring_many_random_texts(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(list("ab"), size=rng.integers(0, 120)).tolist()) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    out = substring.substring_dedup(df, counts=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == dict(enumerate(plain.substring(texts)))


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, None), (4, "..."), (5, "w"), (1, "again the same id but other words in here now ok yes"), (None, "no id here")]


@pytest.mark.parametrize("block_words", [2_000_000, 5])
def test_decontamination(spark, rows, block_words):
    extra = [(1000, "x ALPHA beta, gamma delta epsilon zeta eta theta iota kappa; lambda mu y"), (1001, "a short. item w"), (1002, "no id here"), (1003, "alpha beta gamma")]
    table = [(r[0], r[1]) for r in rows] + extra
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontam.digest(decontam.contaminate(df, bench, block_words=block_words)).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out}
    assert got == {i: plain.contaminated(t, ITEMS) for i, t in table}


def test_empty_tables_and_repeated_rows(spark, docs, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert quality.quality_report(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_dedup(empty).count() == 0
    assert substring.substring_dedup(empty).count() == 0
    assert decontam.contaminate(empty, bench).count() == 0
    assert decontam.contaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    twice = docs.unionByName(docs)
    assert quality.quality_report(twice).count() == twice.count()
    out = substring.substring_dedup(twice.select("doc_id", "text"), counts=True)
    assert out.where("n_words >= 35 AND n_removed < n_words").count() == 0
    assert simhash.near_duplicates(twice).count() == twice.count()


def test_null_ids_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(None, long, "x"), (5, long, None), (None, None, "y")], "doc_id long, text string, kept string")
    df = df.withColumns({"n_words": F.lit("mine"), "items": F.lit(1)})
    assert {r.n_words for r in quality.quality_report(df).collect()} == {80, 0}
    got = simhash.near_duplicates(df).collect()
    assert sorted((r.component_id or 0) for r in got) == [0, 5, 5]
    assert [r.n_removed for r in substring.substring_dedup(df.select("doc_id", "text", "kept"), counts=True).orderBy("kept").collect()] == [80, 80, 0]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contaminate(df, bench).count() == 3


def test_samples_are_about_as_large_as_asked(spark, docs):
    assert blocks.about(docs, 10_000).count() == docs.count()
    many = spark.range(20_000).withColumn("text", F.lit("a copy"))
    assert 800 < blocks.about(many, 1000).count() < 1200
    assert blocks.about(many.limit(0), 5).count() == 0


def test_different_texts_without_ids_stay(spark):
    one, two = (" ".join(f"{k}{i}" for i in range(80)) for k in "ab")
    df = spark.createDataFrame([(None, one), (None, two), (None, one), (7, one + " x")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.near_dedup(df).collect()) == sorted([one + " x", two])


def test_substring_compares_words_and_not_their_hashes(spark):
    """Two words whose polynomial hashes modulo 2 ** 64 agree."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = "".join("ba"[i.bit_count() % 2] for i in range(1024))
    r = random.Random(7)
    say = [f"w{r.random()}" for _ in range(40)]
    texts = [" ".join(say[:20] + [x] + say[21:]) for x in (one, other)]
    out = substring.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), counts=True)
    assert [x.n_removed for x in out.collect()] == [0, 0]


def test_substring_hot_anchors_and_large_groups(spark, monkeypatch):
    """A passage in many texts, a frequent phrase in changing company, and anchors
    with more blocks than a task takes."""
    monkeypatch.setattr(substring, "HOT_LEAST", 3)
    monkeypatch.setattr(substring, "HOT_TOLD", 2)
    r = random.Random(5)
    say = lambda n: [f"v{r.randint(0, 10**6)}" for _ in range(n)]
    passage, phrase = say(60), say(8)
    texts = [" ".join(say(40) + passage[: r.randint(36, 60)] + say(30)) for _ in range(40)]
    texts += [" ".join(say(30) + phrase + say(30)) for _ in range(60)]
    texts += [" ".join(say(5) + passage[i : i + 45] + say(5)) for i in range(0, 15)]
    expected = plain.substring(texts)
    for group in (substring.GROUP, 2):
        monkeypatch.setattr(substring, "GROUP", group)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        out = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.substring_dedup(df, counts=True).collect()}
        assert out == dict(enumerate(expected))


def test_substring_equal_rows_and_clashing_columns(spark):
    r = random.Random(3)
    text = " ".join(f"v{r.random()}" for _ in range(120))
    df = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit(text).alias("text"), F.lit("x").alias("N_words"), F.lit(2).alias("key__"), F.lit(3).alias("a.b"))
    out = substring.substring_dedup(df, counts=True)
    assert out.columns == ["doc_id", "key__", "a.b", "n_words", "n_removed", "kept_sha256"]
    assert out.groupBy("n_removed", "key__").count().collect() == [(120, 2, 3000)]
    assert substring.substring_dedup(df).columns == df.columns


def test_decontamination_with_more_words_than_a_million():
    n = (1 << 20) + 50
    index = decontam.build([("a", " ".join(f"{i:x}" for i in range(n)))])
    assert len(index.words) == n and len(index.shingles) == n - 2
    index.prefix = np.zeros(len(index.windows), np.int64)
    text = " ".join(["none", *(f"{i:x}" for i in range(n - 30, n - 10)), "none"])
    w = blocks.words(pa.array([text]), blocks.ALNUM, lower=True)
    window, place = decontam._occurrences(w, index, decontam._by_prefix(index))
    assert sorted(place.tolist()) == list(range(1, 12))


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(229, 41)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    linked = {(nodes.index(a), nodes.index(b)) for a, b in edges} | {(nodes.index(b), nodes.index(a)) for a, b in edges}
    roots = plain.groups(len(nodes), lambda i, j: (i, j) in linked)
    assert got == {x: nodes[k] for x, k in zip(nodes, roots) if nodes[k] != x}


def test_a_frequent_shingle_makes_no_large_bucket(spark, monkeypatch):
    """Without any counters: a passage in a third of the texts, which differ else."""
    monkeypatch.setattr(jaccard, "BUCKET", 40)
    monkeypatch.setattr(jaccard, "rarity", lambda texts, n: np.zeros(jaccard.SLOTS, np.int64))
    r = random.Random(9)
    say = lambda n: " ".join(r.choices([f"w{i}" for i in range(3000)], k=n))
    passage = say(12)
    texts = [f"{say(40)} {passage} {say(20)}" if i % 3 == 0 else say(70) for i in range(600)]
    texts += [t + " end" for t in texts[:60:5]]
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(4)
    met = jaccard.meeting(df, Fraction(4, 5), 5)
    assert met.groupBy("shingle").count().where("count > 40").isEmpty()
    got = {frozenset(x) for x in components.components(jaccard.links(df, Fraction(4, 5), 5)).collect()}
    assert got == {frozenset((600 + k, 5 * k)) for k in range(12)}
