"""Queries of the corpus operators over documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import corpus as C
from textloom.operators.order import position
from textloom.plans.registry import query, sql_of
from textloom.sources import scratch
from textloom.streaming import counters

#: Targets of the budget queries, in characters.
BUDGET, STRATUM_BUDGET = 500_000, 20_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_STRIP = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"


@query(f"SELECT doc_id, len({_WORDS})::BIGINT AS n_words FROM documents")
def word_counts(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(X.words("text")).cast("long").alias("n_words"))


@query(f"SELECT doc_id, array_to_string({_WORDS}, ' ') AS collapsed FROM documents")
def collapse_ws(spark, sf):
    return docs(spark, sf).select("doc_id", X.collapse("text").alias("collapsed"))


@query(f"SELECT doc_id, length({_STRIP})::BIGINT AS n FROM documents")
def strip_len(spark, sf):
    return docs(spark, sf).select("doc_id", F.length(X.strip("text")).cast("long").alias("n"))


@query(r"""
SELECT doc_id, CASE WHEN length(text) <= 220 THEN text ELSE
  (CASE WHEN regexp_replace(regexp_replace(left(text, 217), ' [^ ]*$', ''), '\s+$', '') = '' THEN left(text, 217)
        ELSE regexp_replace(regexp_replace(left(text, 217), ' [^ ]*$', ''), '\s+$', '') END) || '...' END AS bounded FROM documents""")
def bounded_text(spark, sf):
    return docs(spark, sf).select("doc_id", X.bounded("text").alias("bounded"))


_SIGNALS = rf"""
sig0 AS (SELECT doc_id, text, source, n_chars, lang, {_WORDS} AS ws FROM documents),
pair AS (SELECT doc_id, p, count(*) AS c FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS p FROM sig0) GROUP BY doc_id, p),
top AS (SELECT doc_id, max(CASE WHEN c > 1 THEN c * (length(p) - 1) ELSE 0 END) AS best FROM pair GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(l, '^\s*[•*-]')) AS b
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM sig0) WHERE regexp_matches(l, '\S') GROUP BY doc_id),
signals AS (SELECT doc_id, text, source, lang, len(ws)::BIGINT AS word_count,
  length(array_to_string(ws, ''))::DOUBLE / greatest(len(ws), 1) AS mean_word_length,
  len(regexp_extract_all(text, '#|\.\.\.|…'))::DOUBLE / greatest(len(ws), 1) AS symbol_ratio,
  coalesce(best, 0)::DOUBLE / greatest(length(array_to_string(ws, '')), 1) AS top_2gram,
  coalesce(b, 0)::DOUBLE / greatest(coalesce(n, 0), 1) AS bullet_share
  FROM sig0 LEFT JOIN top USING (doc_id) LEFT JOIN lines USING (doc_id)),
rules AS (SELECT *, word_count BETWEEN 50 AND 100000 AND mean_word_length BETWEEN 3 AND 10 AND symbol_ratio <= 0.1
  AND top_2gram <= 0.2 AND bullet_share <= 0.9 AS passed FROM signals)"""
_RULE = ("word_count", "mean_word_length", "symbol_ratio", "top_2gram", "bullet_share")


@query(f"WITH {_SIGNALS} SELECT doc_id, word_count, mean_word_length, symbol_ratio, top_2gram, bullet_share FROM signals")
def quality_signals(spark, sf):
    return C.quality_signals(docs(spark, sf)).select("doc_id", *_RULE)


@query(f"WITH {_SIGNALS} SELECT doc_id, passed FROM rules")
def quality_pass(spark, sf):
    return C.quality_signals(docs(spark, sf)).select("doc_id", C.rules_pass(*map(F.col, _RULE)).alias("passed"))


_REASONS = rf"""{_SIGNALS},
dups AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
marked AS (SELECT r.doc_id, r.source, sha256({_STRIP}) AS digest,
  CASE WHEN d.doc_id IS NOT NULL THEN 'duplicate_ids' WHEN l.doc_id IS NULL THEN 'missing_signals' WHEN NOT passed THEN 'quality_rejected' END AS reason
  FROM rules r LEFT JOIN dups d USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON r.doc_id = l.doc_id),
reasons AS (SELECT doc_id, source, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason, source, digest ORDER BY doc_id) > 1
  THEN 'exact_duplicates' ELSE 'kept' END) AS reason FROM marked)"""


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    dups = C.duplicate_ids(labels.where("toxic = 1"))
    signals = labels.select(F.col("doc_id").alias("signal__")).distinct()
    d = C.quality_signals(docs(spark, sf)).join(signals, F.col("doc_id") == F.col("signal__"), "left")
    checks = [("missing_signals", F.col("signal__").isNull()), ("quality_rejected", ~C.rules_pass(*map(F.col, _RULE)))]
    return C.classify(d, dups, "doc_id", checks, C.text_digest("text"), "doc_id", ["source"])


@query(f"WITH {_REASONS} SELECT doc_id, reason FROM reasons")
def reject_reasons(spark, sf):
    return _classified(spark, sf).select("doc_id", "reason")


@query(f"WITH {_REASONS} SELECT reason, count(*) AS n FROM reasons GROUP BY reason")
def reject_reason_counts(spark, sf):
    return _classified(spark, sf).groupBy("reason").agg(F.count("*").alias("n"))


@query(sql_of("reject_reason_counts"))
def stream_reason_counts(spark, sf):
    """The same counts from a stream of the documents in several batches."""
    labels = table(spark, sf, "labels")
    dups = C.duplicate_ids(labels.where("toxic = 1")).select(F.col("id").cast("long").alias("dup__"))
    signals = labels.select(F.col("doc_id").alias("signal__")).distinct()
    at = scratch.folder(spark)
    # as many files as the scan has tasks, half of them a batch
    d = docs(spark, sf)
    (d if d.rdd.getNumPartitions() >= 4 else d.repartition(4)).write.parquet(f"{at}/in")
    written = len(spark.read.schema(d.schema).parquet(f"{at}/in").inputFiles())
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", max(1, -(-written // 2))).parquet(f"{at}/in")
    d = C.quality_signals(stream).join(signals, F.col("doc_id") == F.col("signal__"), "left").join(dups, F.col("doc_id") == F.col("dup__"), "left")
    checks = [("duplicate_ids", F.col("dup__").isNotNull()), ("missing_signals", F.col("signal__").isNull()), ("quality_rejected", ~C.rules_pass(*map(F.col, _RULE)))]
    ledger = counters.Ledger(spark, f"{at}/ledger")
    counters.run(d, ledger, f"{at}/checkpoint", checks, C.text_digest("text"), "doc_id", ["source"]).awaitTermination()
    return counters.reasons(ledger)


@query("SELECT doc_id FROM documents WHERE lower(trim(lang)) IN ('english', 'en')")
def lang_filter(spark, sf):
    return docs(spark, sf).where(C.english("lang")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE len({_WORDS}) >= 50 AND length({_STRIP}) >= 250")
def min_len_filter(spark, sf):
    return docs(spark, sf).where(C.long_enough("text", 50, 250)).select("doc_id")


@query("SELECT d.doc_id, coalesce(quality, 0)::DOUBLE AS score FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(quality, 0) >= 1 AND coalesce(toxic, 0) < 1")
def score_threshold(spark, sf):
    both = docs(spark, sf).select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    clean = 1 - F.coalesce("toxic", F.lit(0))
    return both.where(C.scores_pass(F.col("quality"), clean, 1, 1)).select("doc_id", F.coalesce("quality", F.lit(0)).cast("double").alias("score"))


_LABEL = r"nullif(regexp_extract(text, '(?m)^(?:Released|Licensed) under (?:the )?([^\n]+?)\.?$', 1), '')"
_ALLOWED = (
    "CASE WHEN coalesce(up, '') = '' THEN false WHEN " + " OR ".join(f"regexp_matches(compact, '{p}')" for p in X.LICENSE_DENIED) + " THEN false ELSE "
    + " OR ".join(f"regexp_matches(up, '{p}')" for p in X.LICENSE_ALLOWED) + f" OR regexp_matches(compact, '{X.LICENSE_WHOLE}') END"
)
_LICENSES = rf"""lic0 AS (SELECT doc_id, {_LABEL} AS license FROM documents),
lic1 AS (SELECT *, upper(array_to_string(list_filter(regexp_split_to_array(license, '\s+'), lambda x: x <> ''), ' ')) AS up FROM lic0),
lic AS (SELECT *, trim(regexp_replace(up, '[^A-Z0-9]+', ' ', 'g')) AS compact FROM lic1)"""


@query(f"SELECT doc_id, {_LABEL} AS license FROM documents WHERE {_LABEL} IS NOT NULL")
def license_extract(spark, sf):
    return docs(spark, sf).select("doc_id", X.license_label("text").alias("license")).where("license IS NOT NULL")


@query(f"WITH {_LICENSES} SELECT doc_id, license, {_ALLOWED} AS allowed FROM lic")
def license_allowed(spark, sf):
    d = docs(spark, sf).select("doc_id", X.license_label("text").alias("license"))
    return d.withColumn("allowed", X.license_allowed("license"))


@query(f"WITH {_LICENSES} SELECT coalesce(license, 'unknown') AS license, count(*) AS n FROM lic GROUP BY 1")
def license_histogram(spark, sf):
    d = docs(spark, sf).select(F.coalesce(X.license_label("text"), F.lit("unknown")).alias("license"))
    return d.groupBy("license").agg(F.count("*").alias("n"))


_FIRST = f"row_number() OVER (PARTITION BY source, sha256({_STRIP}) ORDER BY doc_id) AS k"


@query(f"SELECT doc_id FROM (SELECT doc_id, {_FIRST} FROM documents) WHERE k = 1")
def exact_dedup(spark, sf):
    return C.dedup_first(docs(spark, sf), C.text_digest("text"), "doc_id", ["source"]).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256({_STRIP}) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def exact_dedup_global(spark, sf):
    return C.dedup_first(docs(spark, sf), C.text_digest("text"), "doc_id").select("doc_id")


@query(f"SELECT source, count(*) AS seen, count(*) FILTER (WHERE k = 1) AS kept, count(*) FILTER (WHERE k > 1) AS removed FROM (SELECT source, {_FIRST} FROM documents) GROUP BY source")
def dedup_stats(spark, sf):
    d = docs(spark, sf).select("source", C.text_digest("text").alias("digest")).groupBy("source", "digest").agg(F.count("*").alias("n"))
    return d.groupBy("source").agg(F.sum("n").alias("seen"), F.count("*").alias("kept"), (F.sum("n") - F.count("*")).alias("removed"))


@query("SELECT doc_id FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)")
def dup_id_antijoin(spark, sf):
    dups = C.duplicate_ids(table(spark, sf, "labels").where("toxic = 1"))
    return docs(spark, sf).join(dups, F.col("doc_id").cast("string") == F.col("id"), "left_anti").select("doc_id")


@query("SELECT DISTINCT x AS id FROM (SELECT doc_id::VARCHAR AS x FROM labels UNION ALL SELECT item_id::VARCHAR FROM benchmark) WHERE x IS NOT NULL")
def dup_id_union(spark, sf):
    both = table(spark, sf, "labels").select("doc_id").unionByName(table(spark, sf, "benchmark").select(F.col("item_id").alias("id")), allowMissingColumns=True)
    return C.duplicate_ids(both)


@query("""
WITH s AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) AS k FROM (SELECT * FROM labels UNION ALL SELECT doc_id, quality + 1, toxic FROM labels))
SELECT d.doc_id, quality IS NOT NULL AS matched, quality::DOUBLE AS score FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id AND k = 1""")
def signal_join_first_wins(spark, sf):
    labels = table(spark, sf, "labels")
    again = labels.withColumn("quality", F.col("quality") + 1)
    entry = lambda q: F.array(F.array(F.lit(0.0), F.lit(1.0), q.cast("double")))
    signals = labels.unionByName(again).select(
        F.concat(F.lit("en/0001/"), F.col("doc_id").cast("string")).alias("id"), (F.col("quality") * 2 + F.col("toxic")).alias("ord"),
        F.create_map(F.lit("score"), entry(F.col("quality"))).alias("quality_signals"),
    )
    first = C.first_signals(signals, "en/0001")
    joined = docs(spark, sf).select("doc_id").join(first, F.col("doc_id") == F.col("row"), "left")
    return joined.select("doc_id", F.col("row").isNotNull().alias("matched"), C.mean(C.signal_scores(F.col("quality_signals"), "score")).alias("score"))


@query(f"""
WITH r AS (SELECT doc_id, text, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT doc_id, left(text, ({BUDGET} - before)::BIGINT) AS text FROM r WHERE before < {BUDGET}""")
def char_budget(spark, sf):
    return C.char_budget(docs(spark, sf), BUDGET, "doc_id").select("doc_id", "text")


@query(f"""
WITH r AS (SELECT doc_id, source, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT doc_id, source, left(text, ({STRATUM_BUDGET} - before)::BIGINT) AS text FROM r WHERE before < {STRATUM_BUDGET}""")
def stratum_budget(spark, sf):
    return C.char_budget(docs(spark, sf), STRATUM_BUDGET, "doc_id", strata=["source"]).select("doc_id", "source", "text")


@query(f"""
WITH RECURSIVE o AS (SELECT doc_id, text, length(text) AS n, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
r AS (SELECT 0::BIGINT AS k, {BUDGET}::BIGINT AS room, NULL::BIGINT AS doc_id, NULL::VARCHAR AS text
  UNION ALL SELECT o.k, r.room - CASE WHEN o.n <= r.room THEN o.n WHEN c.w >= 20 THEN r.room ELSE 0 END, CASE WHEN o.n <= r.room OR c.w >= 20 THEN o.doc_id END, left(o.text, r.room)
  FROM r JOIN o ON o.k = r.k + 1, LATERAL (SELECT len(list_filter(regexp_split_to_array(left(o.text, r.room), '\\s+'), lambda x: x <> '')) AS w) c WHERE r.room > 0)
SELECT doc_id, text FROM r WHERE doc_id IS NOT NULL""")
def char_budget_min_tail(spark, sf):
    return C.char_budget_min_tail(docs(spark, sf), BUDGET, "doc_id", 20).select("doc_id", "text")


@query("""
WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents)),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS turn FROM documents)
SELECT doc_id, source, turn, i::INTEGER AS source_index FROM r JOIN s USING (source)""")
def round_robin_mix(spark, sf):
    d = docs(spark, sf)
    sources = [r.source for r in d.select("source").distinct().orderBy("source").collect()]  # one name a source
    return C.round_robin(d, sources, "doc_id").select("doc_id", "source", "turn", "source_index")


@query("""
WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || doc_id)) AS k FROM documents WHERE lang IN ('en', 'fr')),
n AS (SELECT count(*) FILTER (WHERE lang = 'en') AS n1, count(*) FILTER (WHERE lang = 'fr') AS n2 FROM a),
q AS (SELECT least(n1, greatest(200, 400 - n2)) AS k1, n2 FROM n)
SELECT doc_id, lang FROM a, q WHERE k <= CASE WHEN lang = 'en' THEN k1 ELSE least(n2, 400 - k1) END""")
def balanced_quota(spark, sf):
    from textloom.operators.sampling import sample

    d = docs(spark, sf).select("doc_id", "lang")
    sizes = {r.lang: r["count"] for r in d.where("lang IN ('en', 'fr')").groupBy("lang").count().collect()}
    k1, k2 = C.balanced_quota(sizes.get("en", 0), sizes.get("fr", 0), 400)
    return sample(d.where("lang = 'en'"), "doc_id", 42, k1).unionByName(sample(d.where("lang = 'fr'"), "doc_id", 42, k2))


@query(f"""
WITH b AS (SELECT 'benchmark' AS origin, 0 AS t, item_id AS id, text FROM benchmark UNION ALL SELECT 'documents', 1, doc_id, text FROM documents)
SELECT origin, id FROM (SELECT *, row_number() OVER (PARTITION BY sha256({_STRIP}) ORDER BY t, id) AS k FROM b) WHERE k = 1""")
def append_merge(spark, sf):
    old = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text")
    new = docs(spark, sf).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    return C.append_merge(old, new, C.text_digest("text"), "id").select("origin", "id")


@query("SELECT source, lang, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def source_rollup(spark, sf):
    return docs(spark, sf).rollup("source", "lang").agg(F.count("*").alias("docs"), F.sum(F.length("text").cast("long")).alias("chars"))


@query(f"""
WITH p AS (SELECT DISTINCT sha256({_STRIP}) AS d FROM benchmark), q AS (SELECT sha256({_STRIP}) AS d FROM documents),
a AS (SELECT d, 0 AS side FROM (SELECT sha256({_STRIP}) AS d FROM benchmark) UNION ALL SELECT d, 1 FROM q),
m AS (SELECT d, min(side) AS side, count(*) AS n FROM a GROUP BY d)
SELECT count(*) FILTER (WHERE side = 0) AS available_first, count(*) FILTER (WHERE side = 1) AS available_second, (sum(m.n) - count(*))::BIGINT AS duplicates,
 any_value(n1.k)::BIGINT AS selected_first, any_value(least(n2.n, 60 - n1.k))::BIGINT AS selected_second
FROM m, (SELECT count(*) AS n FROM documents) n2, (SELECT least(count(*), greatest(30, 60 - (SELECT count(*) FROM documents))) AS k FROM benchmark) n1""")
def merge_stats(spark, sf):
    """A balanced merge of 60 rows of both tables, in numbers."""
    from textloom.operators.account import merge_statistics
    from textloom.operators.sampling import balanced_merge

    first, second = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    return merge_statistics(first, second, balanced_merge(first, second, "id", 42, 60), C.text_digest("text"))


@query(f"""
WITH r AS (SELECT doc_id, source, text FROM documents WHERE lower(trim(lang)) IN ('english', 'en') AND len({_WORDS}) >= 10),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, sha256({_STRIP}) ORDER BY doc_id) AS k FROM r) WHERE k = 1),
b AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT doc_id, source, least(length(text), {BUDGET} - before)::BIGINT AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS turn
FROM b WHERE before < {BUDGET}""")
def curated_corpus(spark, sf):
    """Lengths and digests alone tell which documents stay: the texts are read once."""
    d = docs(spark, sf).where(C.english("lang") & C.long_enough("text", 10))
    slim = scratch.table(d.select("doc_id", "source", F.length("text").cast("long").alias("chars"), C.text_digest("text").alias("digest")))
    kept = C.size_budget(C.dedup_first(slim, F.col("digest"), "doc_id", ["source"]), "chars", BUDGET, "doc_id")
    return position(kept.select("doc_id", "source", "chars"), "doc_id", "turn", ["source"])
