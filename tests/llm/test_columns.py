"""Columns of any legal name and type go through every operator that carries them."""

import pytest
from pyspark.sql import functions as F

from textloom.llm import blocks, codes, decontam, language, lm, packing, pii, quality, resampling, sharding, simhash, substring, token_counts, url_rules

SCHEMA = (
    "doc_id long, text string, `a.b` string, N_Words string, PIECE int, Kept int, hits__ int, items__ int, bin__ int, open__ int, mark__ int, n__ int, key__ int, row__ int, file__ int, "
    "c0__ int, text__ int, url__ int, nested struct<m:map<string,int>>, listed array<map<string,int>>, Score int, SPANS int, fold__ int, url string, html string"
)


@pytest.fixture(scope="module")
def odd(spark):
    fill = list(range(13))
    rows = [
        (i, t, "x", "y", 1, 2, *fill[:11], 7, ({"k": i},), [{"k": 1}], 3, 4, 5, "http://a.net/", "<html lang=en>some words</html>")
        for i, t in enumerate(["word " * 60 + str(i) for i in range(4)] + [None, "", "mail a@b.cd"])
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


OPERATORS = {
    "quality_report": lambda s, d: quality.quality_report(d),
    "quality_filter": lambda s, d: quality.quality_filter(d, rules=()),
    "near_dedup": lambda s, d: simhash.near_dedup(d, similarity=1.0),
    "substring": lambda s, d: substring.substring_dedup(d),
    "contaminate": lambda s, d: decontam.contaminate(d, s.createDataFrame([(1, "some other words here")], "item_id long, text string")),
    "token_counts": lambda s, d: token_counts.token_counts(d),
    "pack": lambda s, d: packing.pack(d),
    "url_rules": lambda s, d: url_rules.apply_rules(d, s.createDataFrame([("block", "net", "/")], "verdict string, host string, path string")),
    "language": lambda s, d: language.identify(d, *language.fit(d.withColumn("lang", F.lit("en")))),
    "no_language": lambda s, d: language.identify(d, *language.fit(d.withColumn("lang", F.lit(None).cast("string")))),
    "resample": lambda s, d: resampling.resample(d, d.select("text")),
    "personal_data": lambda s, d: pii.personal_data(d),
    "codes": lambda s, d: codes.compress(d.withColumn("embedding", F.array(*[F.lit(0.5)] * 4)), key="doc_id", label="a.b"),
}
GONE = {  # what the added columns replace or the operator takes
    "quality_report": {"text", "N_Words", "Kept"}, "contaminate": {"N_Words"}, "token_counts": {"text"}, "pack": {"text", "PIECE"}, "url_rules": set(),
    "language": {"html"}, "no_language": {"html"}, "resample": {"text", "Score"}, "personal_data": {"text", "SPANS"}, "codes": set(),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_are_carried(spark, odd, name):
    out = OPERATORS[name](spark, odd)
    kept = [f.name for f in odd.schema.fields if f.name not in GONE.get(name, set())]
    assert [c for c in out.columns if c in kept] == kept
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert rows
    given = {r.doc_id: r for r in odd.collect()}
    for r in rows:
        for c in kept:
            if c not in ("text", "Kept"):
                assert r[c] == given[r["doc_id"]][c], c


def test_shards_carry_them(spark, odd, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path))
    store.append(odd)
    out = store.read()
    assert sorted(out.columns) == sorted([*odd.columns, "shard", "shard_row", "shard_bytes", "shard_level"])
    assert sorted(r.file__ for r in out.collect()) == sorted(r.file__ for r in odd.collect())


def test_no_labelled_rows(spark, odd):
    names, logs = language.fit(spark.createDataFrame([], "text string, lang string"))
    out = language.identify(odd, names, logs).collect()
    assert names == [] and all(r.lang is None and r.probability is None and r.host_prior == [] and r.declared in ("en", "") for r in out)


def test_samples_of_nested_maps(spark, odd):
    assert 0 <= blocks.about(odd.unionByName(odd), 3).count() <= 14
