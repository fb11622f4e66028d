import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import language, url_rules, vocab
from textloom.llm.sharding import CommitConflict, Shard, ShardStore

ODD = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://EXAMPLE.NET/en/x", "http://a.b.example.net/en/?q", "http://example.net/EN/", "http://x.example.com/de/1#f", "http://org/fr/", "http://myorg/fr/", "http://a..org/fr/x", "ftp://example.com?x/de/", "http://notexample.net/en/", "http://example.net.evil/en/", "a://b://net/"]


def judge(url, rules, default="allow"):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = lambda s, marks: min([s.find(m) for m in marks if m in s], default=len(s))
    host = rest[: cut(rest, "/?#")]
    path = rest[cut(rest, "/?#") : cut(rest, "?#")]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


@pytest.mark.parametrize("hosts", [200_000, 1])
def test_url_rules(spark, hosts):
    rules = [*url_rules.OP8_RULES, ("block", "com", "/"), ("allow", "b.example.net", "/en/"), ("block", "b.example.net", "/en/x")]
    rng = np.random.default_rng(0)
    made = [f"http://{'.'.join(rng.choice(['a', 'b', 'example', 'www'], size=rng.integers(0, 4)).tolist() + [t])}/{l}/{k}" for t in ("net", "com", "org", "io") for l in ("en", "de", "fr", "e") for k in range(8)]
    urls = list(enumerate(ODD + made + made[:5]))
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("verdict", F.lit(7))
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.apply_rules(pages, table, points=hosts).collect()}
    assert got == {i: judge(u, rules) for i, u in urls}
    assert url_rules.apply_rules(pages.limit(0), table).count() == 0
    none = url_rules.apply_rules(pages, table.limit(0))
    assert none.count() == len(urls) and none.where("verdict <> 'allow' OR rule IS NOT NULL").count() == 0


def test_shard_store(spark, docs, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=200_000, small_bytes=2_000)
    assert store.version() == 0 and store.shards() == []
    for k in range(4):
        store.append(docs.where(F.pmod("doc_id", F.lit(4)) == k), rows_per_shard=3)
    before = store.shards()
    old = store.version()
    store.compact()
    after = store.shards()
    assert len(after) < len(before) and max(s.level for s in after) >= 1
    assert not store.plan(after)
    for version in (old, store.version()):  # both versions can be read until a vacuum
        back = store.read(version)
        assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert store.read().groupBy("shard", "shard_row").count().where("count > 1").isEmpty()
    # a file that no version lists yet may be another writer's
    (pending, _), *_ = store._write(docs.limit(3))
    store.vacuum()
    assert (tmp_path / "s" / pending).exists() and not any((tmp_path / "s" / s.path).exists() for s in before if s.path not in {x.path for x in after})
    assert store.read().count() == docs.count()
    store.vacuum(grace_seconds=-10)
    assert not (tmp_path / "s" / pending).exists() and store.read().count() == docs.count()
    assert store.append(docs.limit(0)) == store.version()
    assert store.read().count() == docs.count()


def test_a_lost_commit_race_leaves_the_store(spark, docs, tmp_path):
    a, b = (ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    version = a.version()
    a.append(docs)
    with pytest.raises(CommitConflict):
        b._commit(version, [])
    assert b.read().count() == docs.count()


def test_separators_in_hosts_and_many_rules_of_one_host(spark):
    """Hosts hold any character; a host has many path rules, some nested."""
    hosts = ["example.net", "a.example.net", "example\x01y.net", "\x01.net", "\x02.net", "net", "x\x02.\x011.net", "org", "example\x02.net", ".net", "net."]
    paths = ["/", "/a", "/a/", "/a/b", "/a/b/c", "/b", "/\x01", "/é/x", "/a0", ""]
    rules = [("block", "net", "/"), ("allow", "example.net", "/a"), ("block", "example.net", "/a/b"), ("allow", "example.net", "/b"), ("block", "x\x02.\x011.net", "/"), ("allow", "", "/"), ("block", "example.net", "/b")]
    rules += [("allow", "example.net", f"/a/{i}") for i in range(200)]
    urls = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("stack", F.lit(1)).withColumn("RULE", F.lit(2))
    for points in (url_rules.POINTS, 2):
        out = url_rules.apply_rules(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), points=points)
        assert out.columns == ["page_id", "url", "stack", "host", "path", "rule", "verdict"]
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
        for i, u in urls:
            host, path = judge(u, [])[:2]
            fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fits, default=(0, 0, "allow", None))
            assert got[i] == (host, path, best[3], best[2]), u


PAGES = [
    (0, "http://a.example.com/1", '<html lang="en"><body><p>the of and to in that with this from have</p></body></html>'),
    (1, "http://a.example.com/2", '<html lang="fr"><script>var the = 1</script><body>les des une est dans pour avec que qui sur</body></html>'),
    (2, "http://b.example.fr/", "<p></p>"), (3, None, None), (4, "http://b.example.fr/x", "les des une est dans pour avec"),
    (4, "http://b.example.fr/x", "les des une est dans pour avec"), (5, "no scheme", "<html lang=zz>"),
]


@pytest.fixture(scope="module")
def model(spark):
    texts = [("the of and to in that with this from have for not are was", "en")] * 5 + [("les des une est dans pour avec que qui sur pas plus", "fr")] * 5 + [(None, "en"), ("x", None)]
    rows = [(f"{t} {i}" if t else t, l) for i, (t, l) in enumerate(texts * 20)]
    return language.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_language_id(spark, model):
    names, logs = model
    assert names == ["en", "fr"]
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("mine"))
    out = language.identify(pages, names, logs).collect()
    assert len(out) == len(PAGES)
    got = {r.page_id: r for r in out}
    assert got[0].lang == "en" and got[1].lang == "fr" and got[4].lang == "fr"
    assert got[2].lang == "fr"  # no text: its host's other pages decide
    assert (got[0].declared, got[1].declared, got[3].declared) == ("en", "fr", "")
    assert got[2].suffix == "fr" and all(0 < r.probability <= 1 + 1e-9 for r in out)
    assert language.identify(pages.limit(0), names, logs).count() == 0


def test_fusion_is_bayes_rule(spark, model):
    """The posterior of every page from plain counts."""
    names, logs = model
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    out = language.identify(pages, names, logs).collect()
    seen = {r.page_id: r.evidence for r in language.text_evidence(pages, names, logs).collect()}
    host = {r.page_id: judge(next(u for i, u, _ in PAGES if i == r.page_id), [])[0] for r in out}
    rows = [(host[r.page_id], r.suffix, ".".join(host[r.page_id].split(".")[-2:]), r.declared, names.index(r.text_lang) if r.text_lang else None) for r in out]
    total = [sum(x[4] == k for x in rows) for k in range(2)]
    whole = rows
    for i, r in enumerate(out):
        h = host[r.page_id]
        rows = whole[:i] + whole[i + 1 :]  # a page's own vote doesn't count
        total = [sum(x[4] == k for x in rows) for k in range(2)]
        prior = [(t + 1) / (sum(total) + 2) for t in total]
        for at, key in ((2, ".".join(h.split(".")[-2:])), (0, h)):
            own = [sum(x[at] == key and x[4] == k for x in rows) for k in range(2)]
            prior = [(o + language.PARENT * p) / (sum(own) + language.PARENT) for o, p in zip(own, prior)]
        assert np.allclose(r.host_prior, prior)
        like = []
        for at, key in ((3, r.declared), (1, r.suffix)):
            values = len({x[at] for x in whole})
            like.append([(sum(x[at] == key and x[4] == k for x in rows) + 1) / (total[k] + values + 1) for k in range(2)])
        logp = np.array(seen[r.page_id] or [0, 0]) + np.log(like[0]) + np.log(like[1]) + np.log(prior)
        p = np.exp(logp - logp.max())
        assert r.lang == names[int(logp.argmax())] and np.isclose(r.probability, (p / p.sum()).max())


def test_pages_without_text_are_no_votes(spark, model):
    names, logs = model
    rows = [(i, f"http://h{i}.example.fr/", "les des une est dans pour avec que qui sur") for i in range(10)] + [(i, f"http://e{i}.example.fr/", "<p></p>") for i in range(10, 50)]
    out = language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), names, logs).collect()
    assert {r.lang for r in out} == {"fr"}
    assert all((r.text_lang is None) == (r.page_id >= 10) for r in out)


def test_page_text_and_trigrams():
    pages = ["<html><!-- a --><style>b {}</style><p class='x'>Ab&amp;Cé</p>d1e", None, "", "<script>x</script >", "ab", "z" * 5]
    text = language.plain(pa.array(pages)).to_pylist()
    assert [t.split() if t else t for t in text] == [["Ab".encode(), "Cé".encode(), b"d1e"], None, b"", [], [b"ab"], [b"zzzzz"]]
    slots, ends = language._slots(language.plain(pa.array(pages)))
    # letters of every text, one blank behind each run; trigrams that begin in a text are its own
    runs = [re.findall(rb"[a-z\x80-\xff]+", (t or b"").lower()) for t in text]
    joined = [b"".join(r + b" " for r in own) for own in runs]
    stream = b"".join(joined)
    expected = [((stream[i] << 16 | stream[i + 1] << 8 | stream[i + 2]) * 0x9E3779B1 % 2**32) >> 16 for i in range(len(stream) - 2)]
    assert slots.tolist() == expected
    assert ends.tolist() == [min(sum(map(len, joined[:i])), len(expected)) for i in range(len(pages) + 1)]


def test_all_labels_are_kept(spark):
    rows = [(f"word{i} " * 3, f"l{i:03d}") for i in range(300)]
    names, logs = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert names == sorted(f"l{i:03d}" for i in range(300)) and logs.shape[1] == 300


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 100")
    train = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) > 0)
    names, logs = language.fit(train)
    test = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).select("doc_id", "lang", F.col("text").alias("html"), F.lit(None).cast("string").alias("url"))
    test = test.withColumnRenamed("lang", "truth")
    out = language.identify(test, names, logs).toPandas()
    assert (out.truth == out.text_lang).mean() > 0.97


def test_a_run_that_cannot_shrink_does_not_stop_others(spark, docs, tmp_path, monkeypatch):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=10_000, small_bytes=100)
    tiny = [Shard(f"data/a/{i}.parquet", 50, 1, 0) for i in range(4)]
    more = [Shard(f"data/b/{i}.parquet", 900, 1, 0) for i in range(4)]
    first = store.plan(tiny + more)
    assert first == tiny
    assert store.plan(tiny + more, {frozenset(s.path for s in first)}) == more


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="cuts texts in another way"):
        vocab.load(vocab.vocabulary_path("byte_bpe_50k.json"))


def test_fusion_helps_short_texts(spark):
    """Measured against the truth: texts of few words, hosts that mostly keep to a language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 100")
    names, logs = language.fit(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) > 0))
    few = F.substring("text", 1, 5)
    host = F.when(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) < 8, F.concat(F.lit("http://"), F.col("lang"), F.lit(".example.com/"))).otherwise("http://mixed.example.com/")
    test = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).select("doc_id", F.col("lang").alias("truth"), few.alias("html"), host.alias("url"))
    out = language.identify(test, names, logs).toPandas()
    text, fused = ((out.truth == out[c]).mean() for c in ("text_lang", "lang"))
    assert fused > text + 0.03 and fused > 0.85, (text, fused)
