"""Queries of the converters, record checks and generators over whole tables."""

from __future__ import annotations

import functools
import json

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.schemas import EMOTIONS_7, STATE
from textloom.operators import account as A
from textloom.operators import chat as H
from textloom.operators import convert as V
from textloom.operators import corpus as C
from textloom.operators import generate as G
from textloom.operators import sampling as S
from textloom.plans.chat import _PAIRS, _ROWS, _collapse, _strip, chats, transcript
from textloom.plans.corpus import docs, table
from textloom.plans.registry import query, sql_of
from textloom.plans.sampling import _POS
from textloom.sources import scratch


def _json(role, content):
    """JSON of the messages under other names."""
    return F.to_json(F.transform("messages", lambda m: F.struct(m["role"].alias(role), m["content"].alias(content))))


def _union(parts):
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


_BY_SOURCE = {"openhermes": "chat_normalize", "smol-smoltalk": "chat_keep_system", "synthetic_social_dialogues": "chat_two_speakers", "soda": "chat_two_speakers"}


@query(" UNION ALL ".join(f"SELECT '{s}' AS source, conv_id, transcript FROM ({sql_of(q)})" for s, q in _BY_SOURCE.items()))
def chat_sources(spark, sf):
    """The conversations in four sources' spellings."""
    c = scratch.table(chats(spark, sf))  # grouped once, and read in splits by each source
    field = lambda f: F.transform("messages", lambda m: m[f])
    rows = {
        "openhermes": c.select("conv_id", _json("from", "value").alias("conversations")),
        "smol-smoltalk": c.select("conv_id", _json("role", "content").alias("messages")),
        "synthetic_social_dialogues": c.select("conv_id", F.concat(F.lit('{"dialogue":'), _json("speaker", "line"), F.lit("}")).alias("output")),
        "soda": c.select("conv_id", field("role").alias("speakers"), field("content").alias("dialogue")),
    }
    return _union(V.convert_chat(s, r).select(F.lit(s).alias("source"), "conv_id", transcript("messages").alias("transcript")) for s, r in rows.items())


_MORE_SOURCES = {
    "cat_v28": "chat_normalize", "wizardlm": "chat_normalize", "ultrachat": "chat_normalize", "empathetic_dialogues": "chat_normalize", "esconv": "chat_normalize",
    "synthetic_conversations": "chat_normalize", "ultrachat_200k": "chat_keep_system", "english_daily_dialogues": "chat_two_speakers",
}


@query(" UNION ALL ".join(f"SELECT '{s}' AS source, conv_id, transcript FROM ({sql_of(q)})" for s, q in _MORE_SOURCES.items()))
def more_chat_sources(spark, sf):
    """The conversations in eight more sources' spellings."""
    c = scratch.table(chats(spark, sf))
    spelled = {"cat_v28": ("role", "content"), "wizardlm": ("from", "value"), "ultrachat": ("role", "content"), "empathetic_dialogues": ("speaker", "text"),
               "esconv": ("speaker", "content"), "synthetic_conversations": ("from", "text"), "ultrachat_200k": ("role", "content")}
    column = {"cat_v28": "messages", "ultrachat": "messages", "ultrachat_200k": "messages"}
    rows = {s: c.select("conv_id", _json(*keys).alias(column.get(s, "conversations"))) for s, keys in spelled.items()}
    rows["english_daily_dialogues"] = c.select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("speaker"), m["content"].alias("text"))).alias("turns"))
    return _union(V.convert_chat(s, r).select(F.lit(s).alias("source"), "conv_id", transcript("messages").alias("transcript")) for s, r in rows.items())


_PROVENANCE = {"license": "mit", "repository": "some/where", "split": "train"}
_LEAD = "'" + V.PROBLEM_LEAD.replace("\n", "' || chr(10) || '") + "'"


@query(rf'''WITH {_PAIRS}, q AS (SELECT conv_id, "at"::INTEGER AS "at", user_text AS u, reply AS r FROM p WHERE user_text <> '' AND reply <> ''),
s AS (SELECT 'gpt4all' AS source, conv_id, "at", u, r FROM q UNION ALL SELECT 'gsm8k', conv_id, "at", {_LEAD} || u, r FROM q
  UNION ALL SELECT 'dolly', conv_id, "at", u || CASE WHEN "at" % 4 = 0 THEN ' Context: some context' ELSE '' END, r FROM q)
SELECT source, conv_id, "at", 'user: ' || u || chr(10) || 'assistant: ' || r AS transcript, 'mit' AS dataset_license, 'some/where' AS dataset_repository, 'train' AS dataset_split, 0.5::DOUBLE AS rest FROM s''')
def pair_records(spark, sf):
    """Records of three sources of pairs, with state and provenance."""
    pairs = H.turn_pairs(chats(spark, sf), "conv_id")
    key = ["conv_id", "at"]
    rows = {
        "gpt4all": pairs.select(*key, F.col("user_text").alias("prompt"), F.col("reply").alias("response")),
        "gsm8k": pairs.select(*key, F.col("user_text").alias("question"), F.col("reply").alias("answer")),
        "dolly": pairs.select(*key, F.col("user_text").alias("instruction"), F.when(F.col("at") % 4 == 0, "some  context").alias("context"), F.col("reply").alias("response")),
    }
    made = (V.convert_chat(s, r, _PROVENANCE).withColumn("source", F.lit(s)) for s, r in rows.items())
    return _union(m.select("source", *key, transcript("messages").alias("transcript"), "dataset_license", "dataset_repository", "dataset_split", F.col("state.needs.rest").alias("rest")) for m in made)


@query(rf"""WITH {_PAIRS} SELECT conv_id, 'user: ' || user_text || chr(10) || 'assistant: ' || reply AS transcript FROM p WHERE user_text <> '' AND reply <> ''""")
def transcript_pairs(spark, sf):
    """The conversations' pairs as one transcript each, cut into pairs again."""
    line = F.concat(F.lit("User: "), F.col("user_text"), F.lit("\nCat: "), F.col("reply"))
    pairs = H.turn_pairs(chats(spark, sf), "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("l"))
    rows = pairs.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    return V.convert_chat("catgirl_corpus", rows).select("conv_id", transcript("messages").alias("transcript"))


@query(rf"""WITH {_ROWS}, k AS (SELECT conv_id, i, role, {_collapse('text')} AS t FROM c)
SELECT conv_id, string_agg(role || ': ' || t, chr(10) ORDER BY i) AS transcript FROM k GROUP BY conv_id HAVING bool_and(role IN ('user', 'assistant') AND t <> '') AND arg_max(role, i) = 'assistant'""")
def upper_speakers(spark, sf):
    who = lambda m: F.when(m["role"] == "user", " user ").when(m["role"] == "assistant", "SYSTEM").otherwise("NARRATOR")
    rows = chats(spark, sf).select("conv_id", F.transform("messages", lambda m: F.struct(who(m).alias("speaker"), m["content"].alias("utterance"))).alias("turns"))
    return V.convert_chat("multiwoz", rows).select("conv_id", transcript("messages").alias("transcript"))


@query(rf"""WITH {_ROWS}, n AS (SELECT conv_id, count(*) AS n FROM c GROUP BY conv_id), k AS (SELECT conv_id, i, role, {_strip('text')} AS t FROM c),
p AS (SELECT a.conv_id, string_agg('user: ' || a.t || chr(10) || 'assistant: ' || b.t, chr(10) ORDER BY a.i) AS rest FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.i = a.i + 1
  WHERE a.i % 2 = 0 AND a.role = 'user' AND b.role <> 'user' AND a.t <> '' AND b.t <> '' GROUP BY a.conv_id)
SELECT conv_id, concat_ws(chr(10), 'system: Your persona: I am ' || conv_id, CASE WHEN conv_id % 2 = 0 THEN 'Context source: wizard_of_wikipedia' || chr(10) || 'Topic: tides' END,
  'user: hello' || chr(10) || 'assistant: hi there', rest) AS transcript FROM n LEFT JOIN p USING (conv_id) WHERE n % 2 = 0""")
def persona_chats(spark, sf):
    rows = chats(spark, sf).select(
        "conv_id", F.array(F.array(F.lit("x")), F.array(F.concat(F.lit("I am "), F.col("conv_id").cast("string")), F.lit(" "))).alias("personas"),
        F.when(F.col("conv_id") % 2 == 0, "wizard_of_wikipedia").alias("context_dataset"), F.lit("tides").alias("additional_context"),
        F.lit(" hello").alias("free_turker_utterance"), F.lit("hi there ").alias("guided_turker_utterance"),
        F.transform("messages", lambda m: F.array(F.when(m["role"] == "user", "0").otherwise("1"), m["content"])).alias("dialog"),
    )
    return V.convert_chat("blended_skill_talk", rows).select("conv_id", transcript("messages").alias("transcript"))


@query(rf"""WITH k AS (SELECT conv_id, turn, (role <> 'user')::INTEGER AS who, {_collapse('text')} AS t, CASE WHEN turn % 3 = 0 THEN 'sad' ELSE '' END AS ctx, CASE WHEN turn = 0 THEN 'about ' || conv_id ELSE '' END AS about FROM conversations),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM k WHERE t <> ''), f AS (SELECT conv_id, who AS w0, ctx AS ctx0, about AS about0 FROM c WHERE i = 0),
r AS (SELECT a.conv_id, a.i AS "at", w0, CASE WHEN b.ctx <> '' THEN b.ctx WHEN ctx0 <> '' THEN ctx0 ELSE 'unspecified' END AS emotion, CASE WHEN b.about <> '' THEN b.about ELSE about0 END AS about
  FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.i = a.i - 1 JOIN f ON f.conv_id = a.conv_id WHERE a.who <> w0 AND b.who = w0),
s AS (SELECT r.*, CASE WHEN c.who = w0 THEN c.i ELSE c.i + 1 END AS lo FROM r JOIN c ON c.conv_id = r.conv_id AND c.i = greatest("at" - 3, 0)),
u AS (SELECT s.* FROM s JOIN c ON c.conv_id = s.conv_id AND c.i = lo WHERE c.who = w0)
SELECT u.conv_id::VARCHAR AS conv_id, "at"::INTEGER AS "at", any_value(CASE WHEN emotion = 'unspecified' THEN '' ELSE emotion END) AS labels, any_value(u.about) AS about,
  string_agg(CASE WHEN who = w0 THEN 'user: ' ELSE 'assistant: ' END || t, chr(10) ORDER BY i) AS transcript FROM u JOIN c ON c.conv_id = u.conv_id AND i BETWEEN lo AND "at" GROUP BY u.conv_id, "at" """)
def listener_replies(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("utterance_idx"), F.when(F.col("role") == "user", "0").otherwise("1").alias("speaker_idx"),
        F.when(F.col("turn") % 3 == 0, " Sad").otherwise("").alias("context"), F.when(F.col("turn") == 0, F.concat(F.lit("about  "), F.col("conv_id").cast("string"))).otherwise("").alias("prompt"), F.col("text").alias("utterance"),
    )
    out = V.listener_replies(rows)
    about = F.regexp_extract(F.col("messages")[0]["content"], "shared in the original prompt: (.*)$", 1)
    return out.select("conv_id", "at", F.array_join("emotion_labels", ",").alias("labels"), about.alias("about"), transcript(F.slice("messages", 2, 1000)).alias("transcript"))


_SEVEN = "['" + "','".join(EMOTIONS_7) + "']"


@query(rf"SELECT doc_id, {_SEVEN}[doc_id % 9 + 1] AS emotion, length({_collapse('text')}) AS chars FROM documents WHERE lang = 'en' AND doc_id % 5 <> 0 AND doc_id % 9 < 7 AND {_collapse('text')} <> ''")
def single_emotions(spark, sf):
    conflict = F.when(F.col("doc_id") % 5 == 0, True).when(F.col("doc_id") % 5 == 2, False)
    rows = docs(spark, sf).select("doc_id", "text", (F.col("doc_id") % 9).cast("string").alias("label"), F.upper("lang").alias("language"), conflict.alias("is_label_conflict"))
    return V.emotion_rows(rows, "many_emotions").select("doc_id", "emotion", F.length("text").cast("long").alias("chars"))


@query(rf"""WITH k AS (SELECT conv_id, turn, role || ': ' || {_collapse('text')} AS line, {_SEVEN}[turn % 7 + 1] AS emotion FROM conversations WHERE {_collapse('text')} <> '' AND turn % 5 <> 4),
x AS (SELECT conv_id::VARCHAR AS dialogue_id, emotion, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS utterance_index, string_agg(line, chr(10)) OVER w AS prompt, count(*) OVER w - 1 AS context_turns FROM k
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT *, row_number() OVER (ORDER BY md5('6-' || dialogue_id || '-' || utterance_index)) - 1 AS pos FROM x""")
def scripted_emotions(spark, sf):
    names = F.array(*map(F.lit, EMOTIONS_7))
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("Dialogue_ID"), F.col("turn").cast("string").alias("Utterance_ID"), F.col("role").alias("Speaker"), F.col("text").alias("Utterance"),
        F.when(F.col("turn") % 5 == 4, "").otherwise(F.upper(F.get(names, (F.col("turn") % 7).cast("int")))).alias("Emotion"),
    )
    return V.scripted_sample(rows, 6).withColumn("utterance_index", F.col("utterance_index").cast("long"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'bad value emotions.anger' WHEN 2 THEN 'bad value needs.rest' WHEN 3 THEN 'missing field emotions.fear' ELSE 'not an object' END AS problems FROM documents")
def state_problems(spark, sf):
    """States with a value out of range, a boolean, a field less, and none at all."""
    good = F.to_json(H.default_state())
    case = F.col("doc_id") % 5
    change = lambda a, b: F.replace(good, F.lit(a), F.lit(b))
    state = (
        F.when(case == 0, good).when(case == 1, change('"anger":0.0', '"anger":1.5')).when(case == 2, change('"rest":0.5', '"rest":true'))
        .when(case == 3, change('"fear":0.1,', "")).otherwise(F.col("lang"))
    )
    return docs(spark, sf).select("doc_id", F.array_join(H.state_problems(state), ";").alias("problems"))


_STATE_JSON = json.dumps(STATE, separators=(",", ":"))


@query(rf"""SELECT doc_id, 'You are kind.' || chr(10) || 'Internal state:' || chr(10) || '{_STATE_JSON}' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '{H.NO_TOOLS}' ELSE
  '{H.TOOLS_LEAD.strip()}' || chr(10) || '- ' || source || ': In ' || lang || '. Args: {{"n":"any","q":"string"}} (required: q).' || chr(10) || '{H.TOOLS_TAIL.strip()}' END AS prompt FROM documents""")
def system_prompts(spark, sf):
    """State and tools of a record's system message."""
    tool = F.struct(F.col("source").alias("name"), F.concat(F.lit("In "), F.col("lang"), F.lit(".")).alias("description"), F.lit('{"type":"object","properties":{"q":{"type":"string"},"n":5},"required":["q"]}').alias("parameters"))
    tools = F.when(F.col("doc_id") % 2 == 1, F.array(tool)).otherwise(F.array().cast("array<struct<name:string,description:string,parameters:string>>"))
    state = H.state_prompt(H.default_state(), "You are kind.")
    return docs(spark, sf).select("doc_id", F.concat(state, F.lit("\n"), H.tool_instructions(tools)).alias("prompt"))


@query(rf"""WITH {_ROWS}, k AS (SELECT conv_id, i, role, {_strip('text')} AS t, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM c)
SELECT conv_id, string_agg(role || ': ' || t, chr(10) ORDER BY i) AS transcript FROM k GROUP BY conv_id
HAVING count(*) > 1 AND arg_min(role, i) = 'user' AND arg_max(role, i) = 'assistant' AND bool_and(t <> '') AND count(*) FILTER (WHERE before = role) = 0""")
def strict_exchanges(spark, sf):
    m = F.col("messages")
    whole = chats(spark, sf).where(H.complete_exchange(m) & H.valid(m))
    return whole.select("conv_id", H.strict_exchange(m, F.col("conv_id")).alias("m")).select("conv_id", transcript("m").alias("transcript"))


@query(rf"""WITH {_ROWS} SELECT conv_id, sha256('[' || string_agg('{{"content":' || to_json(text) || ',"role":' || to_json(role) || '}}', ',' ORDER BY i) || ']') AS digest FROM c GROUP BY conv_id""")
def message_digests(spark, sf):
    return chats(spark, sf).select("conv_id", H.message_digest(F.col("messages")).alias("digest"))


@query("""WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"id": ' || doc_id || '}' WHEN 1 THEN '[' || doc_id || ']' ELSE text END AS j FROM documents)
SELECT doc_id, json_valid(j) AND coalesce(json_type(CASE WHEN json_valid(j) THEN j END) = 'OBJECT', false) AS is_object, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS id FROM x""")
def json_objects(spark, sf):
    case, text = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    value = F.when(case == 0, F.concat(F.lit('{"id": '), text, F.lit("}"))).when(case == 1, F.concat(F.lit("["), text, F.lit("]"))).otherwise(F.col("text"))
    d = docs(spark, sf).select("doc_id", X.json_object(value).alias("v"))
    return d.select("doc_id", F.col("v").isNotNull().alias("is_object"), F.try_variant_get("v", "$.id", "long").alias("id"))


@query("SELECT doc_id, source FROM documents WHERE source IS NULL OR source NOT IN ('src0', 'src1')")
def sources_excluded(spark, sf):
    return C.without_sources(docs(spark, sf), "src0", "src1").select("doc_id", "source")


_TARGET = 200_000
_STRATA = [f"src{i}" for i in range(20)]
_SHARE = -(-_TARGET // len(_STRATA))


@query(f"""
WITH r AS (SELECT doc_id, source, text, substr(source, 4)::INTEGER AS s, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WHERE source IN ('{"','".join(_STRATA)}')),
t AS (SELECT s, coalesce(sum(least(n, {_SHARE})) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM (SELECT s, sum(length(text)) AS n FROM r GROUP BY s)),
p AS (SELECT doc_id, source, text, (before + ahead)::BIGINT AS start, least({_SHARE} - before, {_TARGET} - before - ahead)::BIGINT AS room FROM r JOIN t USING (s))
SELECT doc_id, source, start, left(text, room) AS text FROM p WHERE room > 0""")
def stratified_budget(spark, sf):
    return C.stratified_budget(docs(spark, sf), _TARGET, _STRATA, "doc_id").select("doc_id", "source", "start", "text")


@query(f"WITH b AS ({sql_of('balanced_quota')}) SELECT doc_id, (lang = 'fr')::INTEGER AS side, row_number() OVER (ORDER BY md5('42-' || (lang = 'fr')::INTEGER || '-' || doc_id)) - 1 AS pos FROM b")
def balanced_merge(spark, sf):
    d = docs(spark, sf).select("doc_id", "lang")
    return S.balanced_merge(d.where("lang = 'en'"), d.where("lang = 'fr'"), "doc_id", 42, 400).select("doc_id", "side", "pos")


@query(f"WITH b AS ({sql_of('page_sample')}) SELECT event_id, page, row_number() OVER (ORDER BY md5('5-' || event_id)) - 1 AS pos FROM b")
def full_page_sample(spark, sf):
    return S.full_page_sample(table(spark, sf, "events").select("event_id"), "event_id", 5, 250).select("event_id", "page", "pos")


@query("""SELECT count(*) FILTER (WHERE doc_id % 7 IN (1, 2)) * 2 AS invalid_signal_records, (count(*) FILTER (WHERE doc_id % 7 IN (3, 4) OR doc_id % 7 IN (0, 5, 6) AND doc_id >= 150)) * 2 AS invalid_signal_ids,
count(*) FILTER (WHERE doc_id % 7 IN (0, 5, 6) AND doc_id < 150) AS duplicate_signal_ids FROM documents""")
def signal_counters(spark, sf):
    """Two lines a document: broken ones, arrays, ids of another shard, numbers as ids
    and ids beyond the shard's documents."""
    case, text = F.col("doc_id") % 7, F.col("doc_id").cast("string")
    line = (
        F.when(case == 1, F.lit('{"id": ')).when(case == 2, F.lit("[]")).when(case == 3, F.concat(F.lit('{"id": "other/'), text, F.lit('"}')))
        .when(case == 4, F.concat(F.lit('{"id": '), text, F.lit("}"))).otherwise(F.concat(F.lit('{"id": "en/0001/'), text, F.lit('"}')))
    )
    lines = docs(spark, sf).select(line.alias("value"))
    return C.signal_counters(lines.unionByName(lines), "en/0001", 150)


@query("SELECT sum(ln(1 + l_discount * 10)::DOUBLE * l_quantity) / sum(l_quantity) AS token_mean, sum(l_quantity)::DOUBLE AS tokens FROM lineitem WHERE l_quantity > 0")
def trained_loss(spark, sf):
    b = table(spark, sf, "lineitem").select(F.ln(1 + F.col("l_discount") * 10).alias("loss"), F.col("l_quantity").cast("double").alias("tokens"))
    return A.trained_loss(b)


@query(f"SELECT vec_id, loss < ln(6) AS beats FROM ({sql_of('cross_entropy')})")
def loss_gate(spark, sf):
    loss = A.cross_entropy(F.col("embedding"), F.col("label"))
    return table(spark, sf, "embeddings").select("vec_id", A.beats_uniform(loss, 6).alias("beats"))


@query(f"SELECT sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY pos)) AS digest FROM (SELECT doc_id, {_POS.format(seed=9, key='doc_id')} AS pos FROM documents) WHERE pos >= 32 AND pos < 42")
def batch_digest(spark, sf):
    return A.batch_digest(S.epoch_batches(docs(spark, sf).select("doc_id"), "doc_id", 7, 2, 32), 1, "doc_id")


_TEMPLATES = ("The {thing} from {source} is {how}.", "{thing} and {how} again, says {source}.")
_SLOTS = {"thing": ("cat", "boat", "tree"), "how": ("near", "far", "old", "new", "odd")}


def _chosen(slot):
    values = "['" + "','".join(_SLOTS[slot]) + "']"
    return f"{values}[floor(('0x' || substr(md5('3-{slot}-' || doc_id), 1, 8))::BIGINT / 4294967296.0 * {len(_SLOTS[slot])})::INTEGER + 1]"


@query(f"""SELECT doc_id, upper(left(t, 1)) || lower(substr(t, 2)) AS text FROM (SELECT doc_id, replace(replace(replace(['{_TEMPLATES[0]}', '{_TEMPLATES[1]}'][doc_id % 2 + 1],
 '{{thing}}', {_chosen('thing')}), '{{how}}', {_chosen('how')}), '{{source}}', coalesce(source, '')) AS t FROM documents)""")
def template_sentences(spark, sf):
    """A sentence about each document."""
    text = G.sentence(F.col("doc_id"), 3, _TEMPLATES, _SLOTS, {"source": F.col("source")})
    return docs(spark, sf).select("doc_id", G.capitalized(text).alias("text"))


@query("SELECT n_name AS scenario, r_name AS format FROM nation, region")
def scenario_formats(spark, sf):
    return G.scenario_formats(table(spark, sf, "nation").select(F.col("n_name").alias("scenario")), table(spark, sf, "region").select(F.col("r_name").alias("format")))


_WAVE = [("openhermes", "chat_normalize"), ("smol-smoltalk", "chat_keep_system")]
_WAVE_ROWS = " UNION ALL ".join(f"SELECT {i} AS s, '{name}' AS source, conv_id, transcript, row_number() OVER (ORDER BY md5('{7 + i}-' || conv_id)) AS r FROM ({sql_of(q)})" for i, (name, q) in enumerate(_WAVE))
_WAVE_CTE = f"""w AS ({_WAVE_ROWS}), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, transcript ORDER BY r) AS k FROM w) WHERE k = 1),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY r) AS j FROM u) WHERE j <= 90)"""


def _wave(spark, sf):
    c = scratch.table(chats(spark, sf))
    rows = {"openhermes": c.select("conv_id", _json("from", "value").alias("conversations")), "smol-smoltalk": c.select("conv_id", _json("role", "content").alias("messages"))}
    return V.chat_wave(rows, {"openhermes": _PROVENANCE, "smol-smoltalk": _PROVENANCE | {"bucket": "research"}}, "conv_id", 7, 90)


@query(f"""WITH {_WAVE_CTE}, d AS (SELECT *, row_number() OVER (PARTITION BY transcript ORDER BY s, r) AS n FROM l)
SELECT source, conv_id::VARCHAR AS source_id, transcript, row_number() OVER (ORDER BY md5('7-' || source || '-' || conv_id)) - 1 AS pos FROM d WHERE n = 1""")
def chat_wave(spark, sf):
    """At most 90 conversations of each of two sources, without copies."""
    return _wave(spark, sf)[0].select(F.col("dataset_source").alias("source"), "source_id", transcript("messages").alias("transcript"), "pos")


@query(f"WITH {_WAVE_CTE} SELECT source, CASE s WHEN 0 THEN 'approved' ELSE 'research' END AS bucket, count(*) AS usable FROM l GROUP BY source, s")
def chat_wave_counts(spark, sf):
    return _wave(spark, sf)[1]
