"""Queries of the chat, tree and converter operators over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.schemas import EMOTIONS_28, EMOTIONS_6, EMOTIONS_DIALOGUE
from textloom.operators import chat as H
from textloom.operators import convert as V
from textloom.operators import corpus as C
from textloom.operators import tokens as K
from textloom.operators import trees
from textloom.plans.corpus import docs, table
from textloom.plans.registry import query, sql_of


def chats(spark, sf):
    return H.group_turns(table(spark, sf, "conversations"), "conv_id", "turn")


def _strip(c):
    return rf"regexp_replace(regexp_replace({c}, '^\s+', ''), '\s+$', '')"


def _collapse(c):
    return rf"array_to_string(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''), ' ')"


_GROUPED = "g AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS roles, list(text ORDER BY turn, role, text) AS texts FROM conversations GROUP BY conv_id)"
_ROWS = "c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role, text FROM conversations)"
#: Conversations cut to whole exchanges: kept rows, their order and whether they alternate.
_NORMAL = rf"""{_ROWS},
k AS (SELECT conv_id, i, role, {_collapse('text')} AS t FROM c WHERE role IN ('user', 'assistant')),
b AS (SELECT conv_id, min(i) FILTER (WHERE role = 'user') AS lo FROM k WHERE t <> '' GROUP BY conv_id),
e AS (SELECT conv_id, max(i) FILTER (WHERE role = 'assistant') AS hi FROM k WHERE t <> '' GROUP BY conv_id),
n AS (SELECT k.*, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM k JOIN b USING (conv_id) JOIN e USING (conv_id) WHERE t <> '' AND i BETWEEN lo AND hi),
normal AS (SELECT conv_id, count(*) AS n, string_agg(role || ': ' || t, chr(10) ORDER BY i) AS transcript FROM n GROUP BY conv_id
  HAVING count(*) >= 2 AND count(*) FILTER (WHERE before = role) = 0)"""


def transcript(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


@query(f"WITH {_GROUPED} SELECT conv_id, len(roles)::BIGINT AS n_turns, array_to_string(roles, ',') AS roles FROM g")
def chat_grouped(spark, sf):
    roles = F.transform("messages", lambda m: m["role"])
    return chats(spark, sf).select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.array_join(roles, ",").alias("roles"))


@query(f"WITH {_NORMAL} SELECT conv_id, transcript FROM normal")
def chat_normalize(spark, sf):
    out = chats(spark, sf).withColumn("messages", H.normalize(F.col("messages"))).where("messages IS NOT NULL")
    return out.select("conv_id", transcript("messages").alias("transcript"))


@query(rf"""WITH {_ROWS}, k AS (SELECT conv_id, i, role, {_strip('text')} AS t FROM c), e AS (SELECT conv_id, max(i) FILTER (WHERE role = 'assistant' AND t <> '') AS hi FROM k GROUP BY conv_id)
SELECT conv_id, string_agg(role || ': ' || t, chr(10) ORDER BY i) AS transcript FROM k JOIN e USING (conv_id) WHERE t <> '' AND i <= hi
GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') > 0 AND count(*) FILTER (WHERE role = 'assistant') > 0""")
def chat_keep_system(spark, sf):
    out = chats(spark, sf).withColumn("messages", H.normalize_keep_system(F.col("messages"))).where("messages IS NOT NULL")
    return out.select("conv_id", transcript("messages").alias("transcript"))


@query(rf"""WITH {_GROUPED} SELECT conv_id, len(roles) > 0 AND len(list_filter(texts, lambda t: t IS NULL OR {_strip('t')} = '')) = 0
 AND list_contains(roles, 'assistant') AND roles[-1] = 'assistant' AS valid FROM g""")
def chat_valid(spark, sf):
    return chats(spark, sf).select("conv_id", H.valid(F.col("messages")).alias("valid"))


@query(rf"""WITH {_GROUPED}, {_ROWS}, a AS (SELECT conv_id, count(*) FILTER (WHERE before = role) = 0 AS alternates
  FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM c) GROUP BY conv_id)
SELECT conv_id, alternates, roles[1] = 'user' AND roles[-1] = 'assistant' AND alternates AND length({_strip('texts[-1]')}) >= 200 AS complete FROM g JOIN a USING (conv_id)""")
def chat_alternation(spark, sf):
    m = F.col("messages")
    return chats(spark, sf).select("conv_id", H.alternates(m).alias("alternates"), H.complete_exchange(m, 200).alias("complete"))


@query(rf"""WITH {_ROWS}, k AS (SELECT conv_id, i, role, {_collapse('text')} AS t FROM c), s AS (SELECT conv_id, count(DISTINCT role) AS n, arg_min(role, i) AS first, count(*) FILTER (WHERE t = '') AS blank,
  max(i) AS last FROM k GROUP BY conv_id),
r AS (SELECT conv_id, i, CASE WHEN role = first THEN 'user' ELSE 'assistant' END AS role, t FROM k JOIN s USING (conv_id) WHERE n = 2 AND blank = 0),
e AS (SELECT conv_id, max(i) FILTER (WHERE role = 'assistant') AS hi FROM r GROUP BY conv_id)
SELECT conv_id, string_agg(role || ': ' || t, chr(10) ORDER BY i) AS transcript FROM r JOIN e USING (conv_id) WHERE i <= hi GROUP BY conv_id""")
def chat_two_speakers(spark, sf):
    out = chats(spark, sf).withColumn("messages", H.two_speakers(F.col("messages"), "role", "content")).where("messages IS NOT NULL")
    return out.select("conv_id", transcript("messages").alias("transcript"))


@query(rf"""WITH {_ROWS}, d AS (SELECT conv_id, coalesce(string_agg(role || chr(1) || {_strip('text')}, chr(2) ORDER BY i) FILTER (WHERE role <> 'system'), '') AS k FROM c GROUP BY conv_id)
SELECT min(conv_id) AS conv_id, count(*) AS copies FROM d GROUP BY k""")
def chat_dedup(spark, sf):
    c = chats(spark, sf)
    key = F.sha2(H.canonical(H.without_system(F.col("messages"))), 256)
    kept = C.dedup_first(c, key, "conv_id").withColumn("k", key).select("conv_id", "k")
    return kept.join(c.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("copies")), "k").select("conv_id", "copies")


_PROMPT = "You are a helpful assistant."


@query(rf"""WITH {_ROWS}, f AS (SELECT conv_id, coalesce(min(i) FILTER (WHERE role <> 'system'), max(i) + 1) AS lead, count(*) AS n FROM c GROUP BY conv_id)
SELECT conv_id, concat_ws(chr(10), '{_PROMPT}', string_agg(text, chr(10) ORDER BY i) FILTER (WHERE i < lead)) AS system, (max(n) - max(lead) + 1)::BIGINT AS n_messages
FROM c JOIN f USING (conv_id) GROUP BY conv_id""")
def system_merge(spark, sf):
    merged = chats(spark, sf).withColumn("messages", H.merge_system(F.col("messages"), F.lit(_PROMPT)))
    return merged.select("conv_id", F.col("messages")[0]["content"].alias("system"), F.size("messages").cast("long").alias("n_messages"))


@query(rf"""WITH {_ROWS} SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || CASE WHEN role = 'assistant' THEN '<EOS>' ELSE '' END, '' ORDER BY i) || '<|assistant|>' || chr(10) AS serialized
FROM c GROUP BY conv_id""")
def chat_serialize(spark, sf):
    return chats(spark, sf).select("conv_id", H.serialize(F.col("messages")).alias("serialized"))


_PAIRS = rf"""{_ROWS}, p AS (SELECT a.conv_id, a.i AS "at", {_collapse('a.text')} AS user_text, {_collapse('b.text')} AS reply, a.i AS i FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.i = a.i + 1
  WHERE a.i % 2 = 0)"""


@query(f'''WITH {_PAIRS} SELECT conv_id, "at"::INTEGER AS "at", user_text, reply FROM p WHERE user_text <> '' AND reply <> '' ''')
def turn_pairs(spark, sf):
    return H.turn_pairs(chats(spark, sf), "conv_id")


@query(r"""
SELECT conv_id, turn, string_agg(text, chr(10)) OVER w AS context, (count(*) OVER w - 1)::BIGINT AS context_turns FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def context_window(spark, sf):
    return H.context_windows(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "context", "context_turns")


@query(rf"""WITH {_ROWS}, r AS (SELECT a.conv_id, a.i AS "at", greatest(a.i - 3, 0) AS s FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.i = a.i - 1 WHERE a.role = 'assistant' AND b.role = 'user'),
t AS (SELECT r.conv_id, "at", CASE WHEN c.role = 'user' THEN s ELSE s + 1 END AS s FROM r JOIN c ON c.conv_id = r.conv_id AND c.i = r.s),
u AS (SELECT t.* FROM t JOIN c ON c.conv_id = t.conv_id AND c.i = t.s WHERE c.role = 'user')
SELECT u.conv_id, "at"::INTEGER AS "at", string_agg(role || ': ' || text, chr(10) ORDER BY i) AS transcript FROM u JOIN c ON c.conv_id = u.conv_id AND c.i BETWEEN u.s AND u."at" GROUP BY u.conv_id, u."at" """)
def reply_context(spark, sf):
    return H.reply_contexts(chats(spark, sf), "conv_id").select("conv_id", "at", transcript("messages").alias("transcript"))


_IDS = "list_transform(['" + "','".join(EMOTIONS_28) + "'], lambda x: x)"


@query(rf"""WITH l AS (SELECT d.doc_id, {_collapse('text')} AS text, quality, toxic FROM documents d JOIN labels USING (doc_id)),
n AS (SELECT doc_id, text, {_IDS}[quality + 3] AS a, {_IDS}[toxic * 12 + 3] AS b FROM l)
SELECT doc_id, CASE WHEN a = b THEN a ELSE a || ', ' || b END AS labels, 'Identify the emotions expressed in this message:' || chr(10) || text AS asked FROM n WHERE text <> ''""")
def emotion_recognition(spark, sf):
    d = docs(spark, sf).select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id")
    out = V.recognition(d.withColumn("labels", F.array(F.col("quality") + 2, F.col("toxic") * 12 + 2)))
    return out.select("doc_id", F.array_join("emotion_labels", ", ").alias("labels"), F.col("messages")[1]["content"].alias("asked"))


@query(f"SELECT doc_id, labels, 'some_emotions' AS dataset_source, 'cc-by' AS dataset_license, 0.5::DOUBLE AS happiness FROM ({sql_of('emotion_recognition')})")
def emotion_records(spark, sf):
    """Recognition tasks as records, with the default state, source and licence."""
    d = docs(spark, sf).select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id")
    out = V.recognition(d.withColumn("labels", F.array(F.col("quality") + 2, F.col("toxic") * 12 + 2)))
    out = V.emotion_records(out, "some_emotions", "cc-by")
    return out.select("doc_id", F.array_join("emotion_labels", ", ").alias("labels"), "dataset_source", "dataset_license", F.col("state.emotions.happiness").alias("happiness"))


_DIALOGUE = "['" + "','".join(EMOTIONS_DIALOGUE) + "']"


@query(rf"""WITH {_PAIRS}, q AS (SELECT *, {_DIALOGUE}[("at" % 7) + 1] AS e FROM p WHERE user_text <> '' AND reply <> '')
SELECT conv_id, "at"::INTEGER AS "at", CASE WHEN e = 'no emotion' THEN '' ELSE e END AS labels, user_text, reply FROM q""")
def paired_emotions(spark, sf):
    c = chats(spark, sf).select(
        "conv_id", F.transform("messages", lambda m: m["content"]).alias("dialog"), F.transform("messages", lambda m, i: F.pmod(i, F.lit(7))).alias("emotion")
    )
    out = V.paired_emotions(c, "conv_id")
    return out.select("conv_id", "at", F.array_join("emotion_labels", ",").alias("labels"), F.col("messages")[1]["content"].alias("user_text"), F.col("messages")[2]["content"].alias("reply"))


_SIX = "['" + "','".join(EMOTIONS_6) + "']"


@query(f"SELECT vec_id, {_SIX}[label + 1] AS emotion FROM embeddings")
def label_decode(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", V.label_name(F.col("label").cast("string"), EMOTIONS_6).alias("emotion"))


@query(rf"""WITH {_ROWS}, f AS (SELECT conv_id, min(i) AS lo FROM c WHERE role <> 'system' GROUP BY conv_id),
r AS (SELECT c.conv_id, c.i, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.i) - 1 AS place, c.text FROM c JOIN f ON c.conv_id = f.conv_id AND c.i > lo WHERE role = 'assistant' AND {_strip('text')} <> ''),
root AS (SELECT c.conv_id, {_strip('c.text')} AS asked FROM c JOIN f ON c.conv_id = f.conv_id AND c.i = lo WHERE role = 'user' AND {_strip('c.text')} <> '')
SELECT conv_id, asked, {_strip('text')} AS reply FROM root JOIN r USING (conv_id)""")
def tree_paths(spark, sf):
    """Each conversation's first user turn as a root, its assistant turns as replies."""
    c = chats(spark, sf).select("conv_id", H.without_system(F.col("messages")).alias("m"))
    role = lambda r: F.when(r == "user", "prompter").otherwise(r)
    blank = "named_struct('message_id', '', 'text', t.content, 'role', t.role, 'lang', 'en', 'rank', 0, 'deleted', false, 'review_result', true, 'labels', map('spam', named_struct('value', 0.0D, 'count', 1.0D)), 'detoxify', map('insult', 0.1D))"
    named = c.select("conv_id", F.transform("m", lambda m: H.message(role(m["role"]), m["content"])).alias("m"))
    tree = named.selectExpr("conv_id", f"transform(slice(m, 1, 1), t -> {blank})[0] AS root", f"transform(filter(slice(m, 2, greatest(size(m), 1)), t -> t.role = 'assistant'), t -> {blank}) AS replies")
    tree = tree.where("root IS NOT NULL").withColumn("prompt", F.struct("root.*", "replies"))
    found = H.complete_exchange  # paths without a reply end with the user and go
    paths = trees.leaf_paths(tree, 2, "conv_id")
    return paths.where(found(F.col("messages"))).select("conv_id", F.col("messages")[0]["content"].alias("asked"), F.col("messages")[1]["content"].alias("reply"))


_CHAIN = f"""c AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
t AS (SELECT conv_id, k * n + row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) AS pos, role, {_strip('text')} AS text,
  coalesce({_strip('text')}, '') = '' OR role NOT IN ('user', 'assistant') OR length(text) % 7 = 0 AS bad FROM c, range(4) r(k)),
b AS (SELECT *, min(CASE WHEN bad THEN pos END) OVER (PARTITION BY conv_id) AS stop FROM t)"""


@query(f"""WITH {_CHAIN} SELECT conv_id, count(*) AS n, sha256(string_agg(role || ':' || text, '|' ORDER BY pos)) AS path_sha256
FROM b WHERE stop IS NULL OR pos < stop GROUP BY conv_id""")
def deep_tree_paths(spark, sf):
    """Trees as deep as four times a conversation, where turns of some lengths are flagged."""
    turn = F.struct("turn", F.to_json(F.struct(
        "text", F.when(F.col("role") == "user", "prompter").otherwise(F.col("role")).alias("role"), F.lit("en").alias("lang"), F.lit(0).alias("rank"),
        F.create_map(F.lit("spam"), F.struct(F.when(F.length("text") % 7 == 0, 0.75).otherwise(0.0).alias("value"), F.lit(2).alias("count"))).alias("labels"),
    )).alias("j"))
    chain = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn))["j"].alias("m"))
    nested = F.aggregate(
        F.reverse(F.flatten(F.array_repeat("m", 4))), F.lit(""),
        lambda inner, j: F.concat(F.substring(j, F.lit(1), F.length(j) - 1), F.lit(',"replies":['), inner, F.lit("]}")),
    )
    found = trees.deep_paths(chain.select("conv_id", F.parse_json(nested).alias("tree")), "tree", "conv_id")
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return found.select("conv_id", F.size("messages").cast("long").alias("n"), F.sha2(said, 256).alias("path_sha256"))


_SFT_LEN = 1024
_SFT = rf"""{_ROWS}, s AS (SELECT conv_id, i, role, length(role) + 5 + length(text) + 1 + (role = 'assistant')::INTEGER AS size, CASE WHEN role = 'assistant' THEN length(text) + 2 ELSE 0 END AS trained FROM c),
f AS (SELECT conv_id, count(*) AS n, sum(size) AS total, coalesce(min(i) FILTER (WHERE role <> 'system'), max(i) + 1) AS lead FROM s GROUP BY conv_id),
u AS (SELECT f.*, (SELECT coalesce(sum(size), 0) FROM s WHERE s.conv_id = f.conv_id AND i < lead) AS system,
  (SELECT max(i) FROM s WHERE s.conv_id = f.conv_id AND role = 'user' AND i >= lead AND i < n - 1) AS last FROM f),
v AS (SELECT u.*, (SELECT sum(size) FROM s WHERE s.conv_id = u.conv_id AND (i < lead OR i >= last)) AS short FROM u),
o AS (SELECT *, CASE WHEN total <= {_SFT_LEN + 1} THEN 'kept' WHEN system > {_SFT_LEN + 1} THEN 'skipped_system' WHEN last IS NULL OR short > {_SFT_LEN + 1} THEN 'skipped_overlength' ELSE 'compacted' END AS outcome FROM v)"""


def _fitted(spark, sf):
    vocabulary = [*K.PRINTABLE, K.UNK, K.EOS]
    ids = lambda t: K.char_ids(t, vocabulary)
    parts = chats(spark, sf).select("conv_id", K.sample_parts(F.col("messages"), ids).alias("parts"))
    return parts.select("conv_id", K.fit_parts(F.col("parts"), _SFT_LEN).alias("f")).select("conv_id", "f.*"), vocabulary


@query(f"WITH {_SFT} SELECT outcome, count(*) AS n FROM o GROUP BY outcome")
def sft_outcome_counts(spark, sf):
    return _fitted(spark, sf)[0].groupBy("outcome").agg(F.count("*").alias("n"))


@query(rf"""WITH {_SFT} SELECT o.conv_id, outcome, sum(trained)::BIGINT AS n_trained, greatest({_SFT_LEN + 1} - sum(size), 0)::BIGINT AS n_padding, {_SFT_LEN}::BIGINT AS n_inputs
FROM o JOIN s ON s.conv_id = o.conv_id AND (outcome = 'kept' OR i < lead OR i >= last) WHERE outcome IN ('kept', 'compacted') GROUP BY o.conv_id, outcome""")
def sft_samples(spark, sf):
    fitted, vocabulary = _fitted(spark, sf)
    made = fitted.where("parts IS NOT NULL").withColumn("s", K.supervised(F.col("parts"), _SFT_LEN, vocabulary.index(K.EOS)))
    real = F.aggregate("parts", F.lit(0), lambda a, m: a + F.size(m["ids"]))
    return made.select(
        "conv_id", "outcome", F.size(F.filter("s.labels", lambda x: x != -100)).cast("long").alias("n_trained"),
        F.greatest(F.lit(_SFT_LEN + 1) - real, F.lit(0)).cast("long").alias("n_padding"), F.size("s.input_ids").cast("long").alias("n_inputs"),
    )
