import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import account as A
from textloom.operators import merging
from textloom.operators import tokens as K

VOCABULARY = [*K.PRINTABLE, K.UNK, K.EOS]


def texts(spark, *t):
    return spark.createDataFrame(list(enumerate(t)), "i long, text string").repartition(2)


def test_characters(spark):
    df = texts(spark, "ab<EOS>é🙂", "", "<EOS>", "a\nb").orderBy("i")
    got = [r[0] for r in df.select(K.char_ids("text", VOCABULARY)).collect()]
    a = VOCABULARY.index("a")
    assert got == [[a, a + 1, 97, 96, 96], [], [97], [a, 0, a + 1]]
    back = [r[0] for r in df.select(K.decode(K.char_ids("text", VOCABULARY), VOCABULARY)).collect()]
    assert back == ["ab", "", "", "a\nb"]
    with pytest.raises(Exception, match="outside the vocabulary"):
        df.select(K.decode(F.array(F.lit(98)), VOCABULARY)).collect()
    assert K.char_vocabulary(df)[-4:] == ["é", "🙂", K.UNK, K.EOS]


def sequential(text, size):
    """Merges learnt and applied on the whole character stream, one pass each."""
    symbols = list(text)
    limit = min(256, size - 2)
    vocabulary = {c for c, _ in sorted(Counter(text).items(), key=lambda x: (-x[1], x[0]))[:limit]}
    merges = []
    while len(vocabulary) < size - 2:
        pairs = Counter(p for p in zip(symbols, symbols[1:]) if all(x in vocabulary and not x.isspace() for x in p))
        best = max(((n, p) for p, n in pairs.items() if p[0] + p[1] not in vocabulary), default=None)
        if not best:
            break
        merges.append(best[1])
        vocabulary.add("".join(best[1]))
        symbols = apply(symbols, best[1])
    return merges


def apply(symbols, pair):
    out, i = [], 0
    while i < len(symbols):
        if tuple(symbols[i : i + 2]) == pair:
            out.append("".join(pair))
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


@pytest.mark.parametrize("size", [12, 18, 40, 90])
def test_bpe_equals_sequential_passes(spark, size):
    t = ["banana bandana aaa aaaa", "the then these banana", "a cat sat on a mat", "ana nana"]
    vocabulary, merges = K.train_bpe(texts(spark, *t), size, "i")
    assert merges == sequential("\n".join(t), size) or len(set("\n".join(t))) > len(set("".join(t)))
    assert len(vocabulary) <= size and vocabulary[-2:] == [K.UNK, K.EOS]
    ids = {x: i for i, x in enumerate(vocabulary)}
    probe = ["banana <EOS>the aaaa", "zebra thethe", "", None, " a  b "]
    got = {r.i: r.tokens for r in K.bpe_encode(texts(spark, *probe), vocabulary, merges).collect()}
    for i, p in enumerate(probe):
        if p is None:
            assert got[i] is None
            continue
        expected = []
        for k, part in enumerate(p.split(K.EOS)):
            symbols = list(part)
            for m in merges:
                symbols = apply(symbols, m)
            expected += ([ids[K.EOS]] if k else []) + [ids.get(s, ids[K.UNK]) for s in symbols]
        assert got[i] == expected


def test_bpe_bounds(spark):
    many = "".join(chr(0x4E00 + i) for i in range(600))
    vocabulary, _ = K.train_bpe(texts(spark, many), 512, "i")
    assert len(vocabulary) <= 512
    with pytest.raises(ValueError):
        K.train_bpe(texts(spark, "x"), 2, "i")
    with pytest.raises(ValueError):
        K.train_bpe(texts(spark, ""), 10, "i")


def test_training_sample_keeps_the_corpus_s_characters(spark):
    t = ["a" * 60, "a" * 40 + " rare-symbol Ω", "banana"]
    vocabulary, merges = K.train_bpe(texts(spark, *t), 16, "i", sample_characters=20)
    assert len(vocabulary) <= 16 and {"a", "-"} <= set(vocabulary) and "Ω" in vocabulary
    assert all(set(a + b) == {"a"} for a, b in merges)  # nothing else is in the sample
    with pytest.raises(ValueError):
        K.train_bpe(texts(spark, "x"), 10, "i", sample_characters=0)


def stream(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, tokens array<int>").repartition(3)


def test_capped_stream(spark):
    rows = [[1, 2, 3], None, [], [4, 5], [6, 9]]

    def tokens(most):
        out = K.capped_stream(stream(spark, *rows), "tokens", "i", 9, most).orderBy("start").collect()
        return [x for r in out for x in r.tokens]

    assert tokens(None) == [1, 2, 3, 4, 5, 6, 9]  # ends with the end token
    assert tokens(4) == [1, 2, 3, 4, 9]  # cut, then closed
    assert tokens(7) == [1, 2, 3, 4, 5, 6, 9] and tokens(1) == [1, 9]
    with pytest.raises(ValueError):
        tokens(0)
    with pytest.raises(ValueError):
        K.capped_stream(stream(spark, [], None), "tokens", "i", 9)


@pytest.mark.parametrize(("size", "stride"), [(3, 1), (4, 3), (2, 5), (50, 1), (1, 1)])
def test_stream_windows(spark, size, stride):
    rows = [[1, 2, 3], None, [], list(range(10, 30)), [4], [5, 6]]
    flat = [x for r in rows for x in r or []]
    out = K.stream_windows(stream(spark, *rows), "tokens", "i", size, stride)
    got = {r.idx: r.window for r in out.collect()}
    assert got == {i: flat[s : s + size] for i, s in enumerate(range(0, len(flat) - size + 1, stride))}


def test_windows(spark):
    df = spark.createDataFrame([(list(range(5)),), ([],), ([1],)], "t array<int>")
    assert [r.window for r in K.strided_windows(df, "t", 3, 1).collect()] == [[0, 1, 2, 3], [1, 2, 3, 4]]
    df = spark.createDataFrame([(list(range(9)),)], "t array<int>")
    out = K.strided_windows(df, "t", 3, 3)
    assert [r.window for r in out.collect()] == [[0, 1, 2, 3], [3, 4, 5, 6]]
    a, b = out.select(*K.shifted("window")).first()
    assert (a, b) == ([0, 1, 2], [1, 2, 3])
    assert K.dense_windows(spark.createDataFrame([(list(range(6)),)], "t array<int>"), "t", 3).count() == 4


def sample(spark, length, *messages):
    df = spark.createDataFrame([(list(messages),)], "m array<struct<role:string,content:string>>")
    parts = df.select(K.sample_parts(F.col("m"), lambda t: K.char_ids(t, VOCABULARY)).alias("p"))
    fitted = parts.select(K.fit_parts(F.col("p"), length).alias("f")).select("f.*")
    return fitted.select("outcome", K.supervised(F.col("parts"), length, 97).alias("s")).first()


def test_supervised_samples(spark):
    r = sample(spark, 40, ("user", "hi"), ("assistant", "yo"))
    text = "<|user|>\nhi\n<|assistant|>\nyo\n"
    ids = [VOCABULARY.index(c) for c in text] + [97]
    full = ids + [97] * (41 - len(ids))
    assert r.outcome == "kept" and r.s.input_ids == full[:-1] and len(r.s.labels) == 40
    trained = [(i, x) for i, x in enumerate(r.s.labels) if x != -100]
    assert [x for _, x in trained] == [VOCABULARY.index(c) for c in "yo\n"] + [97]
    two = sample(spark, 100, ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"))
    assert two.s.labels.count(97) == 2
    assert sample(spark, 20, ("system", "x" * 50), ("user", "q"), ("assistant", "a")).outcome == "skipped_system"
    assert sample(spark, 20, ("user", "x" * 50), ("assistant", "a")).outcome == "skipped_overlength"
    assert sample(spark, 10, ("assistant", "a" * 30),).outcome == "skipped_overlength"
    long = sample(spark, 60, ("system", "s"), ("user", "x" * 90), ("assistant", "y"), ("user", "q"), ("assistant", "a"))
    kept = "".join(VOCABULARY[i] for i in long.s.input_ids if i < 96)
    assert long.outcome == "compacted" and kept == "<|system|>\ns\n<|user|>\nq\n<|assistant|>\na\n"


def test_learning_rates(spark):
    rates = [r.rate for r in A.learning_rates(spark, 1.0, 100, 0.1).orderBy("step").collect()]
    assert math.isclose(rates[0], 0.1) and math.isclose(rates[9], 1.0) and math.isclose(rates[10], 1.0) and math.isclose(rates[-1], 0.1)
    assert all(a >= b for a, b in zip(rates[10:], rates[11:]))
    assert [r.rate for r in A.learning_rates(spark, 0.5, 1).collect()] == [0.5]
    assert A.learning_rates(spark, 1.0, 4, 0.0).first().rate == 1.0
    with pytest.raises(ValueError):
        A.learning_rates(spark, 0.0, 4)


def test_losses_and_gates(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 3), (99.0, 0)], "loss double, tokens int")
    r = A.weighted_loss(df).first()
    assert (r.batch_mean, r.token_mean) == (2.0, 2.5)
    df = spark.createDataFrame([([0.0, 0.0], 1), ([1000.0, 0.0], 0), ([1.0], -100)], "z array<float>, t int")
    got = [x[0] for x in df.select(A.cross_entropy(F.col("z"), F.col("t"))).collect()]
    assert math.isclose(got[0], math.log(2)) and got[1] == 0 and got[2] is None
    with pytest.raises(Exception, match="too few"):
        spark.range(1).select(A.gate(F.col("id") > 0, "too few tokens")).collect()
    runs = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 2.0), ("a", 3, 2.0), ("a", 4, 2.5), ("b", 1, 1.0)], "run string, epoch int, loss double")
    assert {(r.run, r.best_epoch, r.stale) for r in A.best_epoch(runs, "run").collect()} == {("a", 2, 2), ("b", 1, 0)}
    assert {(r.run, r.stop_epoch) for r in A.first_impatient(runs, "run", 2).collect()} == {("a", 4), ("b", None)}


def in_passes(word, ranks):
    """Merging as it is defined: the lowest rank that is there, wherever it is, from the left."""
    symbols = list(word)
    while True:
        least = min((ranks[p] for p in zip(symbols, symbols[1:]) if p in ranks), default=None)
        if least is None:
            return symbols
        out, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and ranks.get((symbols[i], symbols[i + 1])) == least:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out


@pytest.mark.parametrize("seed", range(4))
def test_merging_by_heap_equals_merging_in_passes(seed):
    """Also for merges whose parts come behind them, which training never gives."""
    import random

    r = random.Random(seed)
    tokens = ["a", "b", "c"]
    for _ in range(12):
        tokens.append(r.choice(tokens) + r.choice(tokens))
    pairs = list({(r.choice(tokens), r.choice(tokens)) for _ in range(25)})
    r.shuffle(pairs)
    ranks = {p: i for i, p in enumerate(pairs)}
    for _ in range(400):
        w = "".join(r.choices("abc", k=r.randint(0, 30)))
        assert K.merge_word(w, ranks) == in_passes(w, ranks), w
    assert K.merge_word("ab" * 50_000, {("a", "b"): 0, ("ab", "ab"): 1}) == ["abab"] * 25_000


@pytest.mark.parametrize("head", [0, 3, 1 << 17])
def test_encoding_by_the_corpus_words(spark, head):
    """Whatever is looked up and whatever is joined, ids and columns are the same."""
    rows = [(1, "low lower lowest<EOS>low new  newer\n", {"k": 1}), (2, None, None), (3, "", {}), (4, "<EOS>", {}), (5, "  x é low", {}), (5, "low low low wide wide", {}), (6, "widest" * 30, {})]
    df = spark.createDataFrame(rows, "i int, `t.x` string, `a.b` map<string,int>").repartition(3)
    vocabulary, merges = [*sorted(set("lowernstid xé\n") | {"lo", "low", "er", "ne"}), K.UNK, K.EOS], [("l", "o"), ("lo", "w"), ("e", "r"), ("n", "e")]
    ranks, ids = {p: i for i, p in enumerate(merges)}, {t: i for i, t in enumerate(vocabulary)}

    def plain(t):
        if t is None:
            return None
        import re

        out = []
        for piece in re.findall(r"<EOS>|\s|(?:(?!<EOS>)\S)+", t):
            out += [ids[K.EOS]] if piece == K.EOS else [ids.get(s, ids[K.UNK]) for s in in_passes(piece, ranks)]
        return out

    out = K.bpe_encode(df, vocabulary, merges, text="t.x", head=head)
    assert out.columns == ["i", "t.x", "a.b", "tokens"]
    got = sorted(((r.i, r["t.x"], r["a.b"], r.tokens) for r in out.collect()), key=str)
    assert got == sorted(((i, t, m, plain(t)) for i, t, m in rows), key=str)
    assert K.bpe_encode(df.limit(0), vocabulary, merges, text="t.x").count() == 0


def test_bpe_learns_from_whole_texts(spark):
    """Merges and the base alphabet also come from what is beyond any number of leading characters."""
    t = ["ab " * 90_000, "zq " * 100_000]
    vocabulary, merges = K.train_bpe(texts(spark, *t), 9, "i")
    assert merges == [("z", "q"), ("a", "b")]
    vocabulary, merges = K.train_bpe(texts(spark, *t), 5, "i")
    assert (vocabulary[:3], merges) == ([" ", "q", "z"], [])


@pytest.mark.parametrize("most", [0, 5, 40, 1000])
def test_merges_do_not_depend_on_where_words_are(spark, monkeypatch, most):
    """On the driver or in the stored table, in whatever blocks: as by sequential passes."""
    seed, t = 1, []
    for i in range(120):
        w = []
        for _ in range(5):
            seed = seed * 48271 % 2147483647
            w.append("".join("aabcé"[(seed >> k) % 5] for k in range(0, 2 + seed % 19, 2)))
        t.append(" ".join(w) + (" aaaaaaa abab" + K.EOS + "ab " if i % 3 else ""))
    t.append("abc" * 30 + " " + "aé" * 40)  # never on the driver
    monkeypatch.setattr(merging, "HEAD", most)
    monkeypatch.setattr(merging, "BLOCK", 200)
    monkeypatch.setattr(merging, "STEPS", 5)
    _, merges = K.train_bpe(texts(spark, *t), 60, "i")
    assert merges == sequential(" ".join(t).replace(K.EOS, ""), 60) and len(merges) > 45


def test_changes_of_a_merge_are_those_of_counting_anew():
    for word in ("aaaaa", "aaaa", "aaa", "abab", "cababab", "abcab", "aabb"):
        place = np.zeros(0x110000, np.uint16)
        for i, c in enumerate("abc"):
            place[ord(c)] = i + 1
        for pair in ((1, 1), (1, 2), (2, 1)):
            state = merging.State(*merging.cut([word, "x" + word + "xa"], np.array([3, 2 << 24, 0]), place))
            counts = Counter(state.pairs())
            merging.change(counts, (*pair, 4), state.merge(*pair, 4, 5))
            assert {p: n for p, n in counts.items() if n} == state.pairs()
