"""Queries that write whole tables with the sinks and read them with the sources."""

from __future__ import annotations


from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.schemas import MESSAGES
from textloom.operators import chat as H
from textloom.operators import corpus as C
from textloom.operators.order import running_total
from textloom.plans import chat as P
from textloom.plans.chat import _GROUPED, _ROWS, _strip, chats, transcript
from textloom.plans.corpus import docs, table
from textloom.plans.registry import query, sql_of
from textloom.plans.tokens import _ID, encoded
from textloom.operators import prepare as R
from textloom.operators import tokens as K
from textloom.sources import files, gates, scratch, sinks, streams


def _lines(rows, order, line, path):
    """Text files whose lines are in the given order."""
    rows.repartitionByRange(order).sortWithinPartitions(order).select(line.alias("value")).write.text(path)


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id::VARCHAR AS doc_id, 'own' AS dataset, {_strip('text')} AS text FROM documents WHERE {_strip('text')} <> ''")
def stored_documents(spark, sf):
    """Documents and their sidecar, joined line by line."""
    d, at = docs(spark, sf), scratch.folder(spark)
    sinks.write_documents(d, f"{at}/texts", "doc_id")
    _lines(d.where(~X.blank("text")), "doc_id", F.to_json(F.struct("doc_id")), f"{at}/sidecar")
    back = files.documents(spark, f"{at}/texts", f"{at}/sidecar", {"dataset": "own"})
    return back.select("ord", F.col("meta")["doc_id"].alias("doc_id"), F.col("meta")["dataset"].alias("dataset"), "text")


@query("SELECT doc_id AS row, text AS raw_content FROM documents")
def stored_web_shard(spark, sf):
    """A shard's documents by their row, which is the id here, for ids without gaps."""
    at = scratch.folder(spark)
    _lines(docs(spark, sf), "doc_id", F.to_json(F.struct(F.col("text").alias("raw_content"))), at)
    return files.web_documents(spark, at)


@query(sql_of("chat_serialize"))
def stored_chats(spark, sf):
    at = scratch.folder(spark)
    sinks.write_jsonl(chats(spark, sf), at, "conv_id", "messages")
    return files.jsonl(spark, at, f"conv_id long, messages {MESSAGES}").select("conv_id", H.serialize(F.col("messages")).alias("serialized"))


@query(rf"""WITH {_GROUPED}, {_ROWS}, v AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS line FROM ({sql_of("chat_valid")}) WHERE valid)
SELECT line, string_agg(role || ': ' || text, chr(10) ORDER BY i) AS transcript, 0.5::DOUBLE AS rest, 1::INTEGER AS n_tools FROM c JOIN v USING (conv_id) GROUP BY line""")
def stored_strict_chats(spark, sf):
    """Records with a state and tools, which the strict reader checks line by line."""
    at = scratch.folder(spark)
    tool = F.array(F.struct(F.lit("find").alias("name"), F.lit("Finds.").alias("description"), F.lit('{"type":"object"}').alias("parameters")))
    record = F.to_json(F.struct("messages", H.default_state().alias("state"), tool.alias("tools")))
    _lines(chats(spark, sf).where(H.valid(F.col("messages"))), "conv_id", record, at)
    back = files.strict_chats(spark, at)
    return back.select("line", transcript("messages").alias("transcript"), F.get_json_object("state", "$.needs.rest").cast("double").alias("rest"), F.size("tools").alias("n_tools"))


@query("SELECT CASE WHEN lang = 'en' THEN 'approved' ELSE 'research' END AS bucket, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def stored_buckets(spark, sf):
    at = scratch.folder(spark)
    sinks.write_buckets(docs(spark, sf).select("text", F.when(F.col("lang") == "en", "approved").otherwise("research").alias("bucket")), at, "bucket")
    back = spark.read.schema("text string, bucket string").json(at)
    return back.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def stored_manifest(spark, sf):
    at = scratch.folder(spark)
    sinks.write_manifest(docs(spark, sf).groupBy("source").agg(F.count("*").alias("n")), at)
    return files.jsonl(spark, at, "source string, n long")


@query("SELECT doc_id, lang, source, text FROM documents")
def stored_csv(spark, sf):
    at = scratch.folder(spark)
    sinks.write_csv(docs(spark, sf).select("doc_id", "lang", "source", "text"), at)
    return files.csv(spark, at, "doc_id long, lang string, source string, text string")


@query(f"""WITH {_ROWS}, x AS (SELECT conv_id, i, text FROM c WHERE i = 0),
o AS (SELECT conv_id, text, row_number() OVER (ORDER BY conv_id) - 1 AS ord FROM x) SELECT ord, conv_id::VARCHAR AS message_tree_id, text FROM o WHERE ord < 50""")
def stored_trees(spark, sf):
    """The first 50 message trees of a file."""
    at = scratch.folder(spark)
    tree = F.to_json(F.struct(F.col("conv_id").cast("string").alias("message_tree_id"), F.struct(F.col("messages")[0]["content"].alias("text")).alias("prompt")))
    _lines(chats(spark, sf), "conv_id", tree, at)
    return files.trees(spark, at, "message_tree_id string, prompt struct<text:string>", 50).select("ord", "message_tree_id", "prompt.text")


@query("""SELECT o AS ord, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents) WHERE doc_id % 3 <> 1 ORDER BY md5('9-' || o) LIMIT 100""")
def json_sample(spark, sf):
    """A sample of the lines that are objects; a third of the lines is broken."""
    at = scratch.folder(spark)
    whole = F.to_json(F.struct("doc_id"))
    _lines(docs(spark, sf), "doc_id", F.when(F.col("doc_id") % 3 == 1, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole), at)
    return files.json_sample(spark, at, "doc_id long", 9, 100)


@query("SELECT source AS shard, row_number() OVER (ORDER BY md5('4-' || source)) - 1 AS pos FROM (SELECT DISTINCT source FROM documents)")
def shard_order(spark, sf):
    at = scratch.folder(spark)
    docs(spark, sf).select(F.col("source").alias("value")).distinct().write.text(at)
    return files.shard_list(spark, at, 4)


@query("SELECT event_id AS step, CASE WHEN event_id % 2 = 0 THEN event_id // 10 ELSE 0 END::BIGINT AS epoch, value AS loss FROM events")
def stored_checkpoints(spark, sf):
    at = scratch.folder(spark)
    e = table(spark, sf, "events")
    epoch = F.when(F.col("event_id") % 2 == 0, F.floor(F.col("event_id") / 10))
    sinks.write_jsonl(e.select(F.col("event_id").alias("step"), epoch.alias("epoch"), F.col("value").alias("loss")), at)
    return files.checkpoints(spark, at)


_MERGE = f"""a AS (SELECT doc_id, 0 AS t, {_strip('text')} AS s FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1, {_strip('text')} FROM documents)"""


@query(f"WITH {_MERGE} SELECT doc_id, t = 1 AS added FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY t, doc_id) AS k FROM a) WHERE k = 1")
def stored_merge(spark, sf):
    """Existing rows (the English ones) and all others that none of them equals, in a
    new folder."""
    d = docs(spark, sf).select("doc_id", "text")
    old = docs(spark, sf).where("lang = 'en'").select("doc_id", "text", F.lit(False).alias("added"))
    out = sinks.write_merged(old, d.withColumn("added", F.lit(True)), C.text_digest("text"), "doc_id", scratch.folder(spark))
    return out.select("doc_id", "added")


@query(f"""WITH t AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS t, generate_subscripts(string_split(text, ''), 1) AS p FROM conversations),
s AS (SELECT {_ID} AS id, row_number() OVER (ORDER BY conv_id, turn, p) - 1 AS pos FROM t WHERE t <> '')
SELECT (pos // 1000)::BIGINT AS part, count(*) AS n, sum(id * (pos % 1000 + 1))::BIGINT AS weighted FROM s GROUP BY 1""")
def stored_token_shards(spark, sf):
    """The turns' tokens, through shards of 10,000 and back."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 2**20 + F.col("turn")).alias("at"), "text")
    placed = running_total(turns, K.char_token_count("text"), "at", "start")
    run = encoded(placed).select("start", F.posexplode("tokens").alias("i", "token"))
    at = scratch.folder(spark)
    sinks.write_token_shards(run.select((F.col("start") + F.col("i")).alias("pos"), "token"), at, 10_000)
    back = files.token_shards(spark, at)
    return back.groupBy(F.floor(F.col("pos") / 1000).cast("long").alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("token") * (F.col("pos") % 1000 + 1)).alias("weighted"))




def _stored_stream(spark, rows, per_shard):
    """A folder of shards of the tokens of rows (at, text) in the order of `at`."""
    at = scratch.folder(spark)
    placed = running_total(rows.withColumn("n", K.char_token_count("text")), "n", "at", "start").where("n > 0")
    sinks.write_token_stream(encoded(placed).select("start", "tokens"), at, per_shard)
    return at


@query(sql_of("dense_windows_stream"))
def stored_dense_windows(spark, sf):
    """Windows of 16 tokens from every place of a stored shard set, without a shuffle."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 2**20 + F.col("turn")).alias("at"), "text")
    w = streams.shard_windows(spark, _stored_stream(spark, turns, 10_000), 16)
    return w.select("idx", F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(sql_of("token_windows_stream"))
def stored_strided_windows(spark, sf):
    """Windows of 129 tokens, 128 apart, of the documents' stored shard set."""
    texts = docs(spark, sf).select(F.col("doc_id").alias("at"), "text")
    w = streams.shard_windows(spark, _stored_stream(spark, texts, 100_000), 129, 128)
    return w.select("idx", F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("window").cast("long").alias("size"))


@query("SELECT doc_id::VARCHAR AS doc_id, lang, text FROM documents")
def stored_csv_archive(spark, sf):
    """Texts with their line breaks through CSV members of tar.gz files, which must
    have the checksums of a catalogue."""
    at = scratch.folder(spark)
    streams.write_csv_archives(docs(spark, sf).select("doc_id", "lang", "text"), at)
    catalogue = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in streams.checksums(spark, at).collect()}
    return streams.csv_rows(spark, at, ["doc_id", "lang", "text"], r"\.csv$", catalogue).select("doc_id", "lang", "text")


@query("SELECT doc_id, lang FROM documents")
def stored_json_array(spark, sf):
    """Items of one JSON array, which may be of any size."""
    at = scratch.folder(spark)
    lines = F.concat(F.when(F.col("first"), "[").otherwise(","), F.to_json(F.struct("doc_id", "lang")))
    d = docs(spark, sf).select("doc_id", "lang")
    least = d.agg(F.min("doc_id").alias("least")).first()["least"]
    rows = d.withColumn("first", F.col("doc_id") == F.lit(least)).select(F.col("doc_id").alias("o"), lines.alias("value"))
    closed = rows.unionByName(spark.range(1).select(F.lit(2**62).alias("o"), F.lit("]").alias("value")))
    sinks.write_ordered(closed, f"{at}/items.json", "o", "value")
    items = streams.json_items(spark, f"{at}/items.json")
    return items.select(F.from_json("value", "doc_id long, lang string").alias("r")).select("r.*")


@query(f"""WITH b AS (SELECT string_agg(regexp_replace(text, '\\s+$', '') || chr(10) || '<EOS>' || chr(10) || chr(10), '' ORDER BY doc_id) AS t FROM documents)
SELECT strlen(t)::BIGINT AS bytes, sha256(t) AS sha256 FROM b""")
def stored_corpus_file(spark, sf):
    """The one ordered file of all texts, byte by byte."""
    at = scratch.folder(spark)
    sinks.write_document_file(docs(spark, sf), f"{at}/corpus.txt", "doc_id")
    return streams.checksums(spark, f"{at}/corpus.txt").select("bytes", "sha256")


@query(f"SELECT * FROM ({sql_of('sft_samples')}) WHERE n_trained > 0")
def gated_samples(spark, sf):
    """Samples that are written only if there are some and all have a trained target."""
    fitted, vocabulary = P._fitted(spark, sf)
    made = fitted.where("parts IS NOT NULL").withColumn("s", K.supervised(F.col("parts"), P._SFT_LEN, vocabulary.index(K.EOS)))
    real = F.aggregate("parts", F.lit(0), lambda a, m: a + F.size(m["ids"]))
    made = made.select("conv_id", "outcome", "s.*", F.greatest(F.lit(P._SFT_LEN + 1) - real, F.lit(0)).cast("long").alias("n_padding"))
    at = f"{scratch.folder(spark)}/samples"
    gates.write_gated(made.where(F.exists("labels", lambda x: x != -100)), at, gates.sample_gates("labels"))
    trained = F.size(F.filter("labels", lambda x: x != -100)).cast("long")
    return spark.read.parquet(at).select("conv_id", "outcome", trained.alias("n_trained"), "n_padding", F.size("input_ids").cast("long").alias("n_inputs"))


@query("SELECT count(*) AS ends, (sum(length(text)) + count(*))::BIGINT AS tokens, count(*) AS n_rows FROM documents")
def gated_tokens(spark, sf):
    """The corpus's tokens, written only if end tokens part the texts and there are
    enough for a small model; what the gates saw and what is there."""
    d = encoded(docs(spark, sf)).select("doc_id", F.concat(F.coalesce("tokens", F.array().cast("array<int>")), F.array(F.lit(97))).alias("tokens"))
    at = f"{scratch.folder(spark)}/tokens"
    seen = gates.write_gated(d, at, gates.token_gates("tokens", 97, 10_000, 20.0, 128))
    return spark.read.parquet(at).agg(F.lit(seen["ends"]).alias("ends"), F.lit(seen["tokens"]).alias("tokens"), F.count("*").alias("n_rows"))


_LIMIT = 40
_PREPARED = f"""s(name, bucket, i) AS (VALUES ('src0', 'approved', 0), ('src1', 'approved', 1), ('src2', 'research', 2), ('src3', 'emotion', 4)),
r AS (SELECT s.name, s.bucket, doc_id, text, row_number() OVER (PARTITION BY s.name ORDER BY md5((5 + i) || '-' || doc_id)) AS k FROM documents d JOIN s ON d.source = s.name),
u AS (SELECT name, bucket, doc_id FROM r WHERE k <= {_LIMIT} AND length({_strip('text')}) >= 200),
o(output, bucket, without) AS (VALUES ('approved_chat', 'approved', ''), ('approved_chat_for_sft', 'approved', 'src1'), ('research_chat', 'research', ''), ('emotion', 'emotion', ''))"""


@query(f"""WITH {_PREPARED} SELECT output, u.name AS source, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM u JOIN o ON o.bucket = u.bucket AND o.without <> u.name GROUP BY 1, 2
UNION ALL SELECT 'ledger', 'missing', 0, 0""")
def prepared_sources(spark, sf):
    """Four outputs of five sources, one of which fails: counts of what is written, and
    the ledger's errors. A second run finds the others done."""
    def rows(name):
        return lambda s: docs(s, sf).where(F.col("source") == name).select(F.col("doc_id").alias("id"), "text")

    def convert(r):
        message = F.array(F.struct(F.lit("user").alias("role"), X.strip("text").alias("content")))
        return r.where(F.length(X.strip("text")) >= 200).select("key__", "id", message.alias("messages"))

    def missing(s):
        return s.read.parquet(f"{sf}/there_is_no_such_table.parquet")

    sources = [R.Source("src0", "approved", rows("src0"), convert), R.Source("src1", "approved", rows("src1"), convert), R.Source("src2", "research", rows("src2"), convert),
               R.Source("missing", "research", missing, convert), R.Source("src3", "emotion", rows("src3"), convert)]
    outputs = [R.Output("approved_chat", ["approved"]), R.Output("approved_chat_for_sft", ["approved"], ["src1"]), R.Output("research_chat", ["research"]), R.Output("emotion", ["emotion"])]
    at = scratch.folder(spark)
    R.prepare(spark, sources, outputs, at, _LIMIT, 5)
    where = docs(spark, sf).select("doc_id", "source")
    written = None
    for o in outputs:
        part = spark.read.schema("id long").json(f"{at}/outputs/{o.name}").withColumn("output", F.lit(o.name))
        written = part if written is None else written.unionByName(part)
    counts = written.join(where, F.col("id") == F.col("doc_id")).groupBy("output", "source").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    failed = R.Store(spark, at).ledger().where("state = 'error'").select(F.lit("ledger").alias("output"), "source", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("ids"))
    return counts.unionByName(failed)
