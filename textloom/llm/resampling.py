"""Importance resampling towards a target distribution, over hashed n-grams.

All of it is DataFrame expressions. A text's n-grams become an array of buckets
(crc32 modulo the number of buckets), cut and hashed once and stored. Exploded
arrays give counts by bucket for the documents and for the target texts; the two
make a table of gains, one row a bucket, which is small by its parameter and
broadcast. Joined to the exploded arrays again and summed by document it gives
each document's weight. With a Gumbel noise from a hash of the key the highest
scores are a sample without replacement in proportion to the weights. Ranks come
from one distributed sort: a row's place in its partition and the rows of the
partitions before it.

Defined cases: null and empty texts have no features and weight 0; a very long
text is one array, as long as its words; repeated rows are counted, scored and
ranked one by one; a null key hashes as empty text and comes first among equal
scores; equal scores and keys are ranked in an order that is fixed within a run;
without documents the result is empty, without target texts (or features) gains
compare with the smoothing alone; all columns but the text are carried, and one
with the name of an added column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import blocks

BUCKETS = 10_000
#: What separates words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Low bits of monotonically_increasing_id: a row's place in its partition.
PLACE = (1 << 33) - 1
ADDED = ("n_features", "weight", "score", "rank")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def grams(words: Column, shortest: int, longest: int) -> Column:
    """All runs of `shortest` to `longest` consecutive words, joined by a blank."""
    def runs(n: int) -> Column:
        if n == 1:
            return words
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    parts = [runs(n) for n in range(shortest, longest + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def bucketed(words: Column, shortest: int, longest: int, buckets: int) -> Column:
    return F.transform(grams(words, shortest, longest), lambda g: (F.crc32(g) % buckets).cast("int"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket, from two tables of arrays `buckets__`."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode("buckets__").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))

    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(counted(source, "s"), "bucket", "left").join(counted(target, "t"), "bucket", "left")
    counts = blocks.cut(counts.select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in "st")))
    total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + buckets))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).cast("long").alias("gain"))


def noise(key: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel draw) of the key's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranks(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """(row__, name): the one-based place of each row in an order. The sorted rows are
    stored, so that places and partition sizes speak of the same partitions."""
    placed = blocks.stored(rows.orderBy(*order).select("row__", F.spark_partition_id().alias("part__"), F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE)).alias("at__")))
    sizes = placed.groupBy("part__").agg(F.count("*").alias("n")).orderBy("part__").collect()  # a row for each partition
    offsets, before = [], 0
    for r in sizes:
        offsets.append((r["part__"], before))
        before += r["n"]
    table = rows.sparkSession.createDataFrame(offsets, "part__ int, offset__ long")
    return placed.join(F.broadcast(table), "part__").select("row__", (F.col("offset__") + F.col("at__") + 1).alias(name))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """All columns of docs but the text, with n_features, weight, score and rank.
    Of the documents with at least least_words words, floor(percent * N / 100) are
    drawn and have a rank."""
    if not 1 <= shortest <= longest or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("the n-grams', buckets' or percent's range is wrong")
    fields = blocks.others(docs, text, ADDED)
    if key not in [f.name for f in fields]:
        raise ValueError(f"there is no column {key} besides the text and added columns")
    rows, carried = blocks.renamed(docs, fields, text)
    own = carried[[f.name for f in fields].index(key)].name
    carried_names = [c.name for c in carried]
    cut_up = rows.select(*carried_names, words_of(F.col("text__")).alias("words__"))
    parts = blocks.stored(
        cut_up.select(
            *carried_names, F.monotonically_increasing_id().alias("row__"), F.size("words__").alias("n_words__"),
            bucketed(F.col("words__"), shortest, longest, buckets).alias("buckets__"),
        )
    )
    wanted = target.select(words_of(F.col(f"`{target_text}`")).alias("words__")).select(bucketed(F.col("words__"), shortest, longest, buckets).alias("buckets__"))
    gain = gains(parts, wanted, buckets)
    each = parts.select("row__", F.explode("buckets__").alias("bucket"))
    # a document's rows are in one task, so that the sum is made there: one row each is shuffled
    sums = each.join(F.broadcast(gain), "bucket").groupBy("row__").agg(F.sum("gain").alias("weight__"))
    scored = parts.select(*carried_names, "row__", "n_words__", F.size("buckets__").cast("long").alias("n_features")).join(sums, "row__", "left")
    scored = scored.withColumn("weight", F.coalesce("weight__", F.lit(0).cast("long"))).withColumn("score", F.col("weight") + noise(F.col(own), seed))
    scored = blocks.stored(scored.drop("weight__"))
    eligible = scored.where(F.col("n_words__") >= least_words)
    drawn = percent * eligible.count() // 100
    rank = ranks(eligible.select("row__", "score", own), [F.desc("score"), F.asc(own), F.asc("row__")]).where(F.col("rank") <= drawn)
    return scored.join(rank, "row__", "left").select(*blocks.restored(fields, carried), *ADDED)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


#: crc32 is written out: a table of 256 entries from its polynomial, then a fold over
#: the bytes of each distinct word.
SQL = r"""
WITH steps AS (
  SELECT i, list_reduce(range(0, 8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(0, 256) t(i)
), crc AS (
  SELECT list(v ORDER BY i) AS v FROM steps
), texts AS (
  SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), w AS (
  SELECT side, id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts
), v AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM w)
), b AS (
  SELECT w, xor(4294967295, list_reduce(list_transform(range(0, length(h) // 2), lambda k: ('0x' || h[2 * k + 1 : 2 * k + 2])::BIGINT),
    lambda a, x: xor(a >> 8, crc.v[(xor(a, x) & 255) + 1]), 4294967295)) % 10000 AS bucket FROM v, crc
), c AS (
  SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM w JOIN b USING (w) GROUP BY bucket
), n AS (
  SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM c
), g AS (
  SELECT bucket, floor(1000 * ln((c.t + 1)::DOUBLE * (n.s + 10000) / ((c.s + 1)::DOUBLE * (n.t + 10000))))::BIGINT AS gain FROM c, n
), d AS (
  SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM w JOIN b USING (w) JOIN g USING (bucket) WHERE side = 'd' GROUP BY id
), k AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN d ON id = doc_id
), z AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM k
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20
)
SELECT z.doc_id, z.n_features, z.weight, z.score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)
"""
