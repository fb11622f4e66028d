"""Queries of the token plane over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import tokens as K
from textloom.operators.corpus import char_budget
from textloom.operators.order import running_total
from textloom.plans.corpus import docs, table
from textloom.plans.registry import query

_CHARS = "(SELECT doc_id, source, unnest(string_split(text, '')) AS t, generate_subscripts(string_split(text, ''), 1) AS p FROM documents)"
_ID = "CASE WHEN t = chr(10) THEN 0 WHEN length(t) = 1 AND unicode(t) BETWEEN 32 AND 126 THEN unicode(t) - 31 ELSE 96 END"
_VOCABULARY = [*K.PRINTABLE, K.UNK, K.EOS]


def encoded(df, text="text"):
    return df.withColumn("tokens", K.char_ids(text, _VOCABULARY))


def counted(df, text="text"):
    """encoded, with the number of tokens told by the text's length."""
    return encoded(df, text).withColumn("n", K.char_token_count(text))


@query(f"""
WITH d AS (SELECT DISTINCT t FROM {_CHARS} WHERE t <> ''), base AS (SELECT chr(10) AS token, 0 AS id UNION ALL SELECT chr(i::INTEGER), i - 31 FROM range(32, 127) r(i)),
extra AS (SELECT t AS token, row_number() OVER (ORDER BY t) + 95 AS id FROM d WHERE t NOT IN (SELECT token FROM base)),
v AS (SELECT * FROM base UNION ALL SELECT * FROM extra)
SELECT token, id::BIGINT AS id FROM v UNION ALL SELECT '<UNK>', count(*) FROM v UNION ALL SELECT '<EOS>', count(*) + 1 FROM v""")
def char_vocab(spark, sf):
    return spark.createDataFrame([(t, i) for i, t in enumerate(K.char_vocabulary(docs(spark, sf)))], "token string, id long")


@query(f"SELECT t AS token, count(*) AS n FROM {_CHARS} WHERE t <> '' GROUP BY t")
def char_freq(spark, sf):
    return K.character_counts(docs(spark, sf))


@query(r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def word_freq(spark, sf):
    return K.word_counts(docs(spark, sf))


@query(rf"""SELECT t AS first, nxt AS second, count(*) AS n FROM (SELECT t, lead(t) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM {_CHARS} WHERE t <> '')
WHERE nxt IS NOT NULL AND NOT regexp_matches(t, '\s') AND NOT regexp_matches(nxt, '\s') GROUP BY 1, 2""")
def pair_freq(spark, sf):
    out = K.pair_counts(K.word_counts(docs(spark, sf)))
    return out.select("first", "second", F.col("n").cast("long").alias("n"))


_BY_DOC = f"(SELECT d.doc_id, d.source, count(t) AS n, count(t) FILTER (WHERE {_ID} = 96) AS unk, coalesce(string_agg(({_ID})::VARCHAR, ',' ORDER BY p) FILTER (WHERE t IS NOT NULL), '') AS ids, coalesce(string_agg(CASE WHEN {_ID} = 96 THEN chr(65533) ELSE t END, '' ORDER BY p), '') AS decoded FROM documents d LEFT JOIN (SELECT doc_id, t, p FROM {_CHARS} WHERE t <> '') c ON c.doc_id = d.doc_id GROUP BY d.doc_id, d.source)"


@query(f"SELECT doc_id, n AS n_tokens, unk AS n_unk, sha256(ids) AS ids_sha256 FROM {_BY_DOC}")
def char_encode(spark, sf):
    d = encoded(docs(spark, sf)).withColumn("tokens", F.coalesce("tokens", F.array().cast("array<int>")))
    return d.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.filter("tokens", lambda t: t == 96)).cast("long").alias("n_unk"), F.sha2(F.array_join("tokens", ","), 256).alias("ids_sha256"))


@query(f"SELECT doc_id, decoded FROM {_BY_DOC}")
def char_decode(spark, sf):
    return encoded(docs(spark, sf)).select("doc_id", F.coalesce(K.decode(F.col("tokens"), _VOCABULARY), F.lit("")).alias("decoded"))


@query(f"SELECT source, sum(unk) / sum(n)::DOUBLE AS unk_fraction, count(*) AS n_eos FROM {_BY_DOC} GROUP BY source")
def unk_fraction(spark, sf):
    d = encoded(docs(spark, sf)).withColumn("tokens", F.coalesce("tokens", F.array().cast("array<int>")))
    unk = F.sum(F.size(F.filter("tokens", lambda t: t == 96)).cast("long"))
    return d.groupBy("source").agg((unk / F.sum(F.size("tokens").cast("long"))).alias("unk_fraction"), F.count("*").alias("n_eos"))


_WINDOW = f"""w AS (SELECT doc_id, list({_ID} ORDER BY p) AS ids FROM {_CHARS} WHERE t <> '' GROUP BY doc_id),
s AS (SELECT doc_id, ids, unnest(range(0, greatest(len(ids) - 128, 0), 128)) AS start FROM w)"""


@query(f"WITH {_WINDOW} SELECT doc_id, (start // 128)::INTEGER AS idx, list_sum(ids[start + 1 : start + 129])::BIGINT AS total, 129::BIGINT AS size FROM s")
def token_windows(spark, sf):
    w = K.strided_windows(encoded(docs(spark, sf)).select("doc_id", "tokens"), "tokens", 128, 128)
    return w.select("doc_id", "idx", F.aggregate("window", F.lit(0), lambda a, x: a + x).cast("long").alias("total"), F.size("window").cast("long").alias("size"))


@query(f"WITH {_WINDOW} SELECT doc_id, (start // 128)::INTEGER AS idx, array_to_string(ids[start + 1 : start + 128], ',') AS inputs, array_to_string(ids[start + 2 : start + 129], ',') AS targets FROM s")
def shift_pairs(spark, sf):
    w = K.strided_windows(encoded(docs(spark, sf)).select("doc_id", "tokens"), "tokens", 128, 128)
    a, b = K.shifted("window")
    return w.select("doc_id", "idx", F.array_join(a, ",").alias("inputs"), F.array_join(b, ",").alias("targets"))


@query(f"""WITH c AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS t, generate_subscripts(string_split(text, ''), 1) AS p FROM conversations),
w AS (SELECT conv_id, turn, list({_ID} ORDER BY p) AS ids FROM c WHERE t <> '' GROUP BY conv_id, turn),
s AS (SELECT conv_id, turn, ids, unnest(range(0, len(ids) - 15)) AS idx FROM w WHERE len(ids) >= 16)
SELECT conv_id, turn, idx::INTEGER AS idx, list_sum(ids[idx + 1 : idx + 16])::BIGINT AS total FROM s""")
def dense_windows(spark, sf):
    w = K.dense_windows(encoded(table(spark, sf, "conversations")).select("conv_id", "turn", "tokens"), "tokens", 16)
    return w.select("conv_id", "turn", "idx", F.aggregate("window", F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


@query(f"""WITH t AS (SELECT doc_id, p, {_ID} AS id FROM {_CHARS} WHERE t <> '' UNION ALL SELECT doc_id, length(text) + 1, 97 FROM documents),
s AS (SELECT id, (row_number() OVER (ORDER BY doc_id, p) - 1) // 100000 AS shard FROM t)
SELECT shard::BIGINT AS shard, count(*) AS n_tokens, sum(id)::BIGINT AS total FROM s GROUP BY shard""")
def token_shards(spark, sf):
    """Texts with their end tokens, one after another, in shards of 100,000 tokens:
    a text gives each shard that it touches its slice, never a row a token."""
    d = running_total(docs(spark, sf).select("doc_id", "text", (K.char_token_count("text") + 1).alias("n")), "n", "doc_id", "start")
    d = encoded(d).select("start", F.concat(F.coalesce("tokens", F.array().cast("array<int>")), F.array(F.lit(97))).alias("tokens"))
    size = 100_000
    d = d.withColumn("shard", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.size("tokens") - 1) / size))))
    lo = F.greatest(F.col("shard") * size - F.col("start"), F.lit(0))
    hi = F.least((F.col("shard") + 1) * size - F.col("start"), F.size("tokens"))
    own = F.slice("tokens", (lo + 1).cast("int"), (hi - lo).cast("int"))
    d = d.select("shard", F.size(own).cast("long").alias("n"), F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))
    return d.groupBy("shard").agg(F.sum("n").alias("n_tokens"), F.sum("s").alias("total"))


_STREAM = f"s AS (SELECT id, row_number() OVER (ORDER BY doc_id, p) - 1 AS g FROM (SELECT doc_id, p, {_ID} AS id FROM {_CHARS} WHERE t <> ''))"


@query(f"""WITH {_STREAM}, c AS (SELECT id, g FROM s WHERE g < 100000), e AS (SELECT * FROM c UNION ALL SELECT 97, max(g) + 1 FROM c)
SELECT (g // 1000)::BIGINT AS part, count(*) AS n_tokens, sum(id)::BIGINT AS total, sum(id * (g % 1000))::BIGINT AS weighted FROM e GROUP BY 1""")
def corpus_tokens(spark, sf):
    """At most 100,000 tokens of the corpus and the end token, summed in thousands."""
    d = K.capped_stream(counted(docs(spark, sf)).select("doc_id", "n", "tokens"), "tokens", "doc_id", 97, 100_000, "n")
    t = d.select("start", F.posexplode("tokens").alias("i", "id")).withColumn("g", F.col("start") + F.col("i"))
    return t.groupBy(F.floor(F.col("g") / 1000).cast("long").alias("part")).agg(
        F.count("*").alias("n_tokens"), F.sum("id").alias("total"), F.sum(F.col("id") * (F.col("g") % 1000)).alias("weighted"))


@query(f"""WITH {_STREAM}, f AS (SELECT id, g, lead(id, 128) OVER (ORDER BY g) AS far, count(*) OVER () AS n FROM s)
SELECT (g // 128)::BIGINT AS idx, (sum(id) + max(far) FILTER (WHERE g % 128 = 0))::BIGINT AS total, 129::BIGINT AS size FROM f WHERE (g // 128) * 128 + 129 <= n GROUP BY 1""")
def token_windows_stream(spark, sf):
    """Windows of 129 tokens, 128 apart, over all texts as one stream."""
    texts = docs(spark, sf).select("doc_id", "text", K.char_token_count("text").alias("n"))
    w = K.stream_windows(texts, K.char_ids("text", _VOCABULARY), "doc_id", 129, 128, "n")
    return w.select("idx", F.aggregate("window", F.lit(0), lambda a, x: a + x).cast("long").alias("total"), F.size("window").cast("long").alias("size"))


@query(f"""WITH c AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS t, generate_subscripts(string_split(text, ''), 1) AS p FROM conversations),
s AS (SELECT {_ID} AS id, row_number() OVER (ORDER BY conv_id, turn, p) - 1 AS g FROM c WHERE t <> ''),
w AS (SELECT g AS idx, sum(id) OVER (ORDER BY g ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS total, count(*) OVER (ORDER BY g ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS n FROM s)
SELECT idx::BIGINT AS idx, total::BIGINT AS total FROM w WHERE n = 16""")
def dense_windows_stream(spark, sf):
    """Windows of 16 tokens from every place of all turns as one stream."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 2**20 + F.col("turn")).alias("at"), "text", K.char_token_count("text").alias("n"))
    w = K.stream_windows(turns, K.char_ids("text", _VOCABULARY), "at", 16, 1, "n")
    return w.select("idx", F.aggregate("window", F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


@query(f"""WITH d AS (SELECT text, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents),
s AS (SELECT unnest(string_split(left(text, ({K.SAMPLE_CHARACTERS} - before)::BIGINT), '')) AS t FROM d WHERE before < {K.SAMPLE_CHARACTERS}),
k AS (SELECT t, count(*) AS n FROM s WHERE t <> '' GROUP BY t), a AS (SELECT DISTINCT t FROM {_CHARS} WHERE t <> '')
SELECT t AS token, coalesce(n, 0)::BIGINT AS n FROM a LEFT JOIN k USING (t) ORDER BY n DESC, t LIMIT 256""")
def bpe_alphabet(spark, sf):
    """The base alphabet: characters by their counts in the sample, all others last."""
    sample = char_budget(docs(spark, sf).select("doc_id", "text"), K.SAMPLE_CHARACTERS, "doc_id")
    known = K.character_counts(sample).unionByName(K.distinct_characters(docs(spark, sf)).withColumn("n", F.lit(0).cast("long")))
    return known.groupBy("token").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "token").limit(256)


@query()
def bpe_merges(spark, sf):
    _, merges = K.train_bpe(docs(spark, sf), 400, "doc_id")
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, first string, second string")


@query()
def bpe_encode_len(spark, sf):
    words = K.bpe_words(docs(spark, sf))
    vocabulary, merges = K.train_bpe(docs(spark, sf), 400, "doc_id", words=words)
    d = K.bpe_encode(docs(spark, sf).select("doc_id", "text"), vocabulary, merges, words=words)
    return d.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))
