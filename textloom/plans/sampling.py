"""Queries of the sampling and accounting operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import account as A
from textloom.operators import convert as C
from textloom.operators import epochs as E
from textloom.operators import sampling as S
from textloom.operators.order import position
from textloom.plans.corpus import docs, table
from textloom.plans.registry import query

_POS = "(row_number() OVER (ORDER BY md5('{seed}-' || {key})) - 1)"


@query(f"SELECT doc_id, {_POS.format(seed=7, key='doc_id')} AS pos FROM documents")
def seeded_shuffle(spark, sf):
    return S.shuffled(docs(spark, sf).select("doc_id"), "doc_id", 7)


@query("SELECT doc_id FROM documents ORDER BY md5('11-' || doc_id) LIMIT 100")
def topk_sample(spark, sf):
    return S.sample(docs(spark, sf).select("doc_id"), "doc_id", 11, 100)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY md5('21-' || event_id)) AS k, count(*) OVER () AS n FROM events) WHERE k <= n // 2")
def half_sample(spark, sf):
    """A sample that is too large for one task: a filter by the greatest hash in it."""
    e = table(spark, sf, "events").select("event_id")
    return S.sample(e, "event_id", 21, e.count() // 2)


@query("""
WITH o AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS ord FROM events),
p AS (SELECT page, row_number() OVER (ORDER BY md5('5-' || page)) - 1 AS nth FROM (SELECT DISTINCT (ord // 100)::BIGINT AS page FROM o)),
r AS (SELECT event_id, p.page, nth * 100 + ord % 100 AS rank FROM o JOIN p ON p.page = ord // 100 WHERE nth < greatest(20, 5 * ceil(250 / 100.0)))
SELECT event_id, page FROM r ORDER BY rank LIMIT 250""")
def page_sample(spark, sf):
    return S.page_sample(table(spark, sf, "events").select("event_id"), "event_id", 5, 250).select("event_id", "page")


@query(f"""
WITH n AS (SELECT greatest(1, floor(count(*) * 0.05)) AS take FROM documents)
SELECT doc_id, CASE WHEN pos < take THEN 'validation' ELSE 'train' END AS part FROM (SELECT doc_id, {_POS.format(seed=3, key='doc_id')} AS pos FROM documents), n""")
def train_val_split(spark, sf):
    return S.split(docs(spark, sf).select("doc_id"), "doc_id", 3, 0.05)


@query("""
WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('3-' || vec_id)) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, label, CASE WHEN pos < greatest(1, floor(n * 0.1)) THEN 'validation' ELSE 'train' END AS part FROM r""")
def train_val_split_by_source(spark, sf):
    return S.split(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", 3, 0.1, "label").select("vec_id", "label", "part")


@query(f"SELECT doc_id, (pos // 32)::BIGINT AS batch, (pos % 32)::BIGINT AS place FROM (SELECT doc_id, {_POS.format(seed=9, key='doc_id')} AS pos FROM documents)")
def epoch_batches(spark, sf):
    return S.epoch_batches(docs(spark, sf).select("doc_id"), "doc_id", 7, 2, 32)


@query(f"""
WITH b AS (SELECT doc_id, (pos // 32)::BIGINT AS batch FROM (SELECT doc_id, {_POS.format(seed=9, key='doc_id')} AS pos FROM documents)),
s AS (SELECT greatest(1, ceil((max(batch) + 1) * 0.125)) AS size FROM b)
SELECT doc_id, batch FROM b, s WHERE batch >= 3 * size AND batch < 4 * size""")
def stage_slice(spark, sf):
    b = S.epoch_batches(docs(spark, sf).select("doc_id"), "doc_id", 7, 2, 32).select("doc_id", "batch")
    total = -(-docs(spark, sf).count() // 32)
    return S.stage_slice(b, total, 3, 0.125)


_NUMBERS = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents"


def _keyed(seed: int, epoch: int, numbers: str = _NUMBERS) -> str:
    """SQL of (doc_id, place): the rounds of an order over rows' numbers."""
    step = "SELECT doc_id, k, n, a, b, x // b AS d0, x % b AS d1 FROM w, c WHERE k = 0 OR x >= n"
    for r, (m, add, m2) in enumerate(E.Order(1, seed, epoch).keys):
        own, other, size = ("d0", "d1", "a") if r % 2 == 0 else ("d1", "d0", "b")
        mixed = f"(({other} * {m} + {add}) % {E.PRIME})"
        step = f"SELECT * REPLACE (({own} + ({mixed} * {m2} % {E.SECOND}) % {size}) % {size} AS {own}) FROM ({step})"
    return f"""WITH RECURSIVE o AS ({numbers}),
c AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM o)),
w AS (SELECT doc_id, number::BIGINT AS x, 0 AS k FROM o UNION ALL SELECT doc_id, d0 * b + d1, k + 1 FROM ({step})),
p AS (SELECT doc_id, x AS place FROM w, c WHERE k > 0 AND x < n)"""


@query(f"{_keyed(7, 2)} SELECT doc_id, place // 32 AS batch, place % 32 AS place FROM p")
def keyed_epoch(spark, sf):
    """An epoch's batches by a computed place: one scan of the numbered rows."""
    rows, n = E.numbered(docs(spark, sf).select("doc_id"), "doc_id")
    return E.epoch_places(rows, E.Order(n, 7, 2), 32).select("doc_id", "batch", "place")


@query(f"{_keyed(7, 3)} SELECT doc_id, place // 32 AS batch, place % 32 AS place FROM p WHERE place // 32 BETWEEN 2 AND 4")
def keyed_batches(spark, sf):
    """Three batches of an epoch; which rows they hold is computed before they are read."""
    rows, n = E.numbered(docs(spark, sf).select("doc_id"), "doc_id")
    return E.batches(rows, E.Order(n, 7, 3), 32, 2, 3).select("doc_id", "batch", "place")


_RUNS = f"SELECT DISTINCT number // 64 AS doc_id, number // 64 AS number FROM ({_NUMBERS})"


@query(f"""{_keyed(3, 0, _RUNS)}, i AS (SELECT doc_id, number // 64 AS run, row_number() OVER (PARTITION BY number // 64 ORDER BY md5('3-' || doc_id)) - 1 AS inside, count(*) OVER () AS total FROM ({_NUMBERS})),
l AS (SELECT place AS last FROM p, c WHERE p.doc_id = c.n - 1)
SELECT i.doc_id, p.place * 64 + inside - CASE WHEN p.place > last THEN (total + 63) // 64 * 64 - total ELSE 0 END AS pos FROM i JOIN p ON p.doc_id = i.run, l""")
def buffered_shuffle(spark, sf):
    """Runs of 64 documents in a seeded order, shuffled inside."""
    return E.buffered(docs(spark, sf).select("doc_id"), "doc_id", "doc_id", 3, 64)


@query(f"{_keyed(8, 0)}, s AS (SELECT greatest(1, ceil(((n + 31) // 32) * 0.125))::BIGINT AS size FROM c) SELECT doc_id, place // 32 AS batch FROM p, s WHERE place // 32 >= 3 * size AND place // 32 < 4 * size")
def keyed_stage(spark, sf):
    rows, n = E.numbered(docs(spark, sf).select("doc_id"), "doc_id")
    return E.stage(rows, E.Order(n, 8), 32, 3, 0.125).select("doc_id", "batch")


@query("""
WITH r(label, lo, hi) AS (VALUES (0, 0.0, 0.7), (1, 0.7, 0.9), (2, 0.9, 1.0)),
e AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS nth, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
u AS (SELECT i AS draw, ('0x' || substr(md5('13-s-' || i), 1, 8))::BIGINT / 4294967296.0 AS u, ('0x' || substr(md5('13-r-' || i), 1, 8))::BIGINT / 4294967296.0 AS v FROM range(1000) t(i))
SELECT draw, r.label::INTEGER AS label, vec_id FROM u JOIN r ON u >= lo AND u < hi JOIN e ON e.label = r.label AND nth = floor(v * n)""")
def ratio_sample(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    ratios = S.source_ratios({"1": 0.2, "2": 0.1}, "0")
    out = S.ratio_draws(e, "label", "vec_id", ratios, 1000, 13)
    return out.select("draw", F.col("label").cast("int").alias("label"), "vec_id")


_BY_SOURCE = """s AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5((40 + label) || '-' || vec_id)) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label < 3),
p AS (SELECT *, CASE WHEN pos < greatest(1, floor(n * 0.2)) THEN 'validation' ELSE 'train' END AS part FROM s)"""


@query(f"WITH {_BY_SOURCE} SELECT vec_id, label::INTEGER AS label, part FROM p")
def split_by_source_seed(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    return S.split_sources(e, "vec_id", "label", ["0", "1", "2"], 40, 0.2).select("vec_id", F.col("label").cast("int").alias("label"), "part")


@query(f"""WITH {_BY_SOURCE}, v AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS nth, count(*) OVER (PARTITION BY label) AS n FROM p WHERE part = 'validation'),
r(label, lo, hi) AS (VALUES (0, 0.0, 0.5), (1, 0.5, 0.75), (2, 0.75, 1.0)), c AS (SELECT count(*) AS n FROM v),
u AS (SELECT i AS draw, ('0x' || substr(md5('1040-s-' || i), 1, 8))::BIGINT / 4294967296.0 AS u, ('0x' || substr(md5('1040-r-' || i), 1, 8))::BIGINT / 4294967296.0 AS v FROM c, unnest(range(c.n)) t(i))
SELECT draw, r.label::INTEGER AS label, vec_id FROM u JOIN r ON u >= lo AND u < hi JOIN v ON v.label = r.label AND nth = floor(u.v * v.n)""")
def ratio_validation(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    out = S.validation_draws(e, "vec_id", "label", {"0": 0.5, "1": 0.25, "2": 0.25}, 40, 0.2)
    return out.select("draw", F.col("label").cast("int").alias("label"), "vec_id")


_STRIPPED = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"
_MERGED = f"""d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY {_STRIPPED} ORDER BY source, doc_id) AS k FROM documents WHERE source IN ('src0', 'src1')), u AS (SELECT doc_id, source FROM d WHERE k = 1)"""


def _emotion_sources(spark, sf):
    turn = F.array(F.struct(F.lit("system").alias("role"), F.col("lang").alias("content")), F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    rows = docs(spark, sf).select("doc_id", F.col("source").alias("dataset_source"), F.lit("a licence").alias("dataset_license"), turn.alias("messages"))
    return [(s, rows.where(F.col("dataset_source") == s)) for s in ("src0", "src1")]


@query(f"WITH {_MERGED}, p AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || doc_id)) - 1 AS pos FROM u) SELECT doc_id, source, pos FROM p WHERE pos < 120")
def emotion_merge(spark, sf):
    out, _ = C.merge_emotions(_emotion_sources(spark, sf), "doc_id", "doc_id", 42, 120)
    return out.select("doc_id", F.col("dataset_source").alias("source"), "pos")


@query(f"WITH {_MERGED} SELECT source, count(*) AS n FROM u GROUP BY source")
def emotion_merge_counts(spark, sf):
    return C.merge_emotions(_emotion_sources(spark, sf), "doc_id", "doc_id", 42)[1].withColumnRenamed("dataset_source", "source")


@query(f"""{_keyed(7, 2)}, s AS (SELECT place // 32 AS step, count(*) AS rows FROM p GROUP BY 1),
t AS (SELECT (n + 31) // 32 AS total, greatest(1, floor((n + 31) // 32 * 0.03::DOUBLE)) AS warm FROM c)
SELECT step, rows, CASE WHEN total = 1 THEN 0.0003 WHEN step < warm THEN 0.0003 * (step + 1) / warm
 ELSE 0.0003 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, greatest(step - warm, 0) / greatest(1, greatest(1, total - warm) - 1))))) END::DOUBLE AS rate FROM s, t""")
def lr_schedule(spark, sf):
    """Rate and rows of each step of an epoch over the documents."""
    rows, n = E.numbered(docs(spark, sf).select("doc_id"), "doc_id")
    steps = E.epoch_places(rows, E.Order(n, 7, 2), 32).groupBy(F.col("batch").alias("step")).agg(F.count("*").alias("rows"))
    return steps.withColumn("rate", A.learning_rate(F.col("step"), 0.0003, -(-n // 32)))


@query("""
WITH b AS (SELECT l_orderkey, l_returnflag, ln(1 + l_discount * 10)::DOUBLE AS loss, l_quantity AS tokens FROM lineitem)
SELECT l_returnflag, avg(loss) AS batch_mean, sum(loss * tokens) / sum(tokens) AS token_mean FROM b WHERE tokens > 0 GROUP BY l_returnflag""")
def weighted_loss(spark, sf):
    b = table(spark, sf, "lineitem").select("l_returnflag", F.ln(1 + F.col("l_discount") * 10).alias("loss"), F.col("l_quantity").alias("tokens"))
    out = A.weighted_loss(b, "loss", "tokens", "l_returnflag")
    return out


@query("""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings)
SELECT vec_id, CASE WHEN label >= 0 THEN list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) - z[label + 1] END AS loss FROM e""")
def cross_entropy(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", A.cross_entropy(F.col("embedding"), F.col("label")).alias("loss"))


_EPOCHS = "SELECT l_returnflag || l_linestatus AS run, l_linenumber AS epoch, avg(l_discount) AS loss FROM lineitem GROUP BY 1, 2"


def _losses(spark, sf):
    li = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("run"), F.col("l_linenumber").alias("epoch"), "l_discount")
    return li.groupBy("run", "epoch").agg(F.round(F.avg("l_discount"), 9).alias("loss"))


@query(f"""
WITH e AS (SELECT run, epoch, round(loss, 9) AS loss FROM ({_EPOCHS})), b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss, epoch) AS k, max(epoch) OVER (PARTITION BY run) AS last FROM e)
SELECT run, epoch AS best_epoch, loss AS best_loss, (last - epoch)::INTEGER AS stale FROM b WHERE k = 1""")
def best_epoch(spark, sf):
    return A.best_epoch(_losses(spark, sf), "run")


@query(f"""
WITH e AS (SELECT run, epoch, round(loss, 9) AS loss FROM ({_EPOCHS})),
m AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e),
w AS (SELECT *, max(CASE WHEN best IS NULL OR loss < best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS won FROM m),
s AS (SELECT *, (SELECT count(*) FROM e x WHERE x.run = w.run AND x.epoch > w.won AND x.epoch <= w.epoch) AS since FROM w)
SELECT run, min(epoch) FILTER (WHERE since >= 2) AS stop_epoch FROM s GROUP BY run""")
def first_impatient(spark, sf):
    return A.first_impatient(_losses(spark, sf), "run", 2)


@query("SELECT source, sum(greatest(0, length(text) - 128))::BIGINT AS windows, sum(greatest(0, length(text) - 128)) * 128 * 2 / 1115264.0::DOUBLE AS tokens_per_parameter FROM documents GROUP BY source")
def tokens_per_param(spark, sf):
    d = docs(spark, sf).groupBy("source").agg(F.sum(F.greatest(F.length("text") - 128, F.lit(0)).cast("long")).alias("windows"))
    return d.withColumn("tokens_per_parameter", A.tokens_per_parameter(F.col("windows"), 128, 2, 1_115_264))


@query("""
WITH d AS (SELECT user_id, event_type, count(*) AS done, epoch(max(ts)) - epoch(min(ts)) AS secs FROM events GROUP BY 1, 2)
SELECT user_id, event_type, 100.0 * done / 20::DOUBLE AS percent, CASE WHEN secs > 0 THEN done / secs END AS rate,
 CASE WHEN secs > 0 THEN greatest(20 - done, 0) / (done / secs) END AS eta FROM d""")
def throughput(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.count("*").alias("done"), ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(1e6)).alias("secs")
    )
    return e.select("user_id", "event_type", A.progress(F.col("done"), F.lit(20), F.col("secs")).alias("p")).select("user_id", "event_type", "p.*")
