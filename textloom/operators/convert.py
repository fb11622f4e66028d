"""Source rows to chat and emotion records.

Each converter is an expression on a row's columns; CHAT and EMOTION map a source
to its converter. Rows that a converter rejects are dropped, and a malformed
label raises where the source promises valid ones.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.checks import positive
from textloom.functions.schemas import EMOTIONS_28, EMOTIONS_6, EMOTIONS_7, EMOTIONS_DIALOGUE, MESSAGES
from textloom.operators.chat import canonical, context_windows, default_state, message, message_digest, normalize, normalize_keep_system, turn_pairs_text, two_speakers, without_system
from textloom.operators.corpus import dedup_first
from textloom.operators.sampling import least, shuffled

#: Prompt texts are the caller's; these are this library's defaults.
RECOGNISE = "Name only the emotions that the message supports. Do not diagnose the writer."
RESPOND = "Answer naturally. The emotion label is a cue, not a certainty."

def as_messages(raw: Column) -> Column:
    """(role, content) of JSON in any of the usual spellings; the first key that is
    there counts, also with a null."""
    def first(m: Column, *keys: str) -> Column:
        out = F.when(F.map_contains_key(m, keys[0]), m[keys[0]])
        for k in keys[1:]:
            out = out.when(F.map_contains_key(m, k), m[k])
        return out

    items = F.from_json(raw, "array<map<string,string>>")
    return F.transform(items, lambda m: message(first(m, "role", "from", "speaker"), first(m, "content", "value", "text")))


def _pair(user: Column, reply: Column) -> Column:
    return F.array(message(F.lit("user"), user), message(F.lit("assistant"), reply))


def _dolly() -> Column:
    context = X.collapse("context")
    asked = F.concat(X.collapse("instruction"), F.when(context != "", F.concat(F.lit("\n\nContext:\n"), context)).otherwise(""))
    return _pair(asked, X.collapse("response"))


def _blended() -> Column:
    persona = F.filter(F.transform(F.get("personas", F.lit(1)), lambda p: X.strip(p)), lambda p: p != "")
    parts = F.filter(
        F.array(
            F.when(F.size(persona) > 0, F.concat(F.lit("Your persona: "), F.array_join(persona, " "))),
            F.when(~X.blank("context_dataset"), F.concat(F.lit("Context source: "), X.strip("context_dataset"))),
            F.when((F.col("context_dataset") == "wizard_of_wikipedia") & ~X.blank("additional_context"), F.concat(F.lit("Topic: "), X.strip("additional_context"))),
        ),
        lambda p: p.isNotNull(),
    )
    system = F.when(F.size(parts) > 0, F.array(message(F.lit("system"), F.array_join(parts, "\n")))).otherwise(F.array().cast(MESSAGES))
    n = F.size("dialog")
    at = F.when(n > 1, F.sequence(F.lit(0), n - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    ok = lambda i, who: (F.get("dialog", i)[0] == who) & ~X.blank(F.get("dialog", i)[1])
    pairs = F.transform(F.filter(at, lambda i: F.coalesce(ok(i, "0") & ok(i + 1, "1"), F.lit(False))), lambda i: _pair(X.strip(F.get("dialog", i)[1]), X.strip(F.get("dialog", i + 1)[1])))
    first = _pair(X.strip("free_turker_utterance"), X.strip("guided_turker_utterance"))
    return F.when(~X.blank("free_turker_utterance") & ~X.blank("guided_turker_utterance") & (n % 2 == 0), F.concat(system, first, F.flatten(pairs)))


#: Fixed value: what is put before a problem.
PROBLEM_LEAD = "Solve this grade-school math problem. Show a clear, concise calculation and state the final answer.\n\n"


def _gsm8k() -> Column:
    return F.when(~X.blank("question") & ~X.blank("answer"), _pair(F.concat(F.lit(PROBLEM_LEAD), X.strip("question")), X.strip("answer")))


def _multiwoz() -> Column:
    turns = F.transform("turns", lambda t: message(F.upper(X.strip(t["speaker"])), X.collapse(t["utterance"])))
    good = F.forall(turns, lambda t: t["role"].isin("USER", "SYSTEM") & (t["content"] != ""))
    named = F.transform(turns, lambda t: message(F.when(t["role"] == "USER", "user").otherwise("assistant"), t["content"]))
    return F.when(F.coalesce(good, F.lit(False)) & (F.try_element_at(named, F.lit(-1))["role"] == "assistant"), named)


def _zipped() -> Column:
    turns = F.zip_with("speakers", "dialogue", lambda s, t: F.struct(s.alias("speaker"), t.alias("text")))
    return F.when(F.size("speakers") == F.size("dialogue"), two_speakers(turns))


#: Sentences of the emotion prompts.
IDENTIFY = "Identify the emotions expressed in this message:\n"
ANSWER = "Emotions: "
TURN_NOTE = "\nThe user's latest turn is annotated as: "
CONTEXT_NOTE = "\nThe conversation's annotated emotional context is: "
CONTEXT_CAVEAT = ". Treat this as background context, not proof of the user's current mood."
SITUATION_NOTE = "\nSituation shared in the original prompt: "


#: Messages of a source's row, or null. Columns named messages, conversations and
#: output are JSON strings.
CHAT: dict[str, Callable[[], Column]] = {
    "cat_v28": lambda: normalize(as_messages(F.col("messages"))),
    "anime_girl_chat": lambda: normalize(_pair(F.col("user"), F.col("anime_girl"))),
    "openhermes": lambda: normalize(as_messages(F.col("conversations"))),
    "wizardlm": lambda: normalize(as_messages(F.col("conversations"))),
    "ultrachat": lambda: normalize(as_messages(F.col("messages"))),
    "dolly": lambda: normalize(_dolly()),
    "gpt4all": lambda: normalize(_pair(F.col("prompt"), F.col("response"))),
    "empathetic_dialogues": lambda: normalize(as_messages(F.col("conversations"))),
    "esconv": lambda: normalize(as_messages(F.col("conversations"))),
    "soda": _zipped,
    "everyday_conversations": lambda: F.coalesce(normalize(as_messages(F.col("messages"))), normalize(_pair(F.col("prompt"), F.col("completion")))),
    "english_daily_dialogues": lambda: two_speakers(F.col("turns")),
    "synthetic_social_dialogues": lambda: two_speakers(F.from_json("output", "struct<dialogue:array<struct<speaker:string,line:string>>>")["dialogue"], "speaker", "line"),
    "synthetic_conversations": lambda: normalize(as_messages(F.col("conversations"))),
    "multiwoz": _multiwoz,
    "smol-smoltalk": lambda: normalize_keep_system(as_messages(F.col("messages"))),
    "ultrachat_200k": lambda: normalize_keep_system(as_messages(F.col("messages"))),
    "blended_skill_talk": _blended,
    "gsm8k": _gsm8k,
}


def convert_chat(source: str, rows: DataFrame, provenance: Mapping[str, str] | None = None) -> DataFrame:
    """rows with messages; a transcript row may become several. The rest of the
    columns stay as they are. With provenance (license, repository, split) the rows
    are records: they get the default state and dataset_license, dataset_repository
    and dataset_split; a missing entry raises."""
    if provenance is not None and (missing := {"license", "repository", "split"} - set(provenance)):
        raise ValueError(f"the provenance lacks {', '.join(sorted(missing))}")
    if source == "catgirl_corpus":
        pairs = rows.select("*", F.explode(turn_pairs_text("text")).alias("messages"))
        out = pairs.withColumn("messages", normalize(F.col("messages")))
    else:
        out = rows.withColumn("messages", CHAT[source]())
    out = out.where(F.col("messages").isNotNull()).withColumn("dataset_source", F.lit(source))
    if provenance is None:
        return out
    return out.withColumns({"state": default_state(), **{f"dataset_{k}": F.lit(provenance[k]) for k in ("license", "repository", "split")}})


def merge_emotions(sources: Sequence[tuple[str, DataFrame]], order: str, key: str, seed: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, counts): the sources' records, each conversation once (its first one
    by source and order; system messages don't count), in a seeded order with their
    position, `most` of them; and the sources' numbers of records before that cut. A
    record of another source, or without a licence, raises; so does a total of zero."""
    positive(most=most)
    both = None
    for i, (name, rows) in enumerate(sources):
        same = F.col("dataset_source").eqNullSafe(F.lit(name))
        checked = F.when(~same, F.raise_error(F.lit(f"a record isn't of {name}"))).when(F.col("dataset_license").isNull(), F.raise_error(F.lit(f"a record of {name} has no licence")))
        tagged = rows.withColumn("dataset_source", F.coalesce(checked.cast("string"), F.col("dataset_source"))).withColumn("rank__", F.struct(F.lit(i).alias("t"), F.col(order).alias("o")))
        both = tagged if both is None else both.unionByName(tagged, allowMissingColumns=True)
    unique = dedup_first(both, F.md5(canonical(without_system(F.col("messages")))), "rank__").drop("rank__")
    counts = unique.groupBy("dataset_source").agg(F.count("*").alias("n"))
    if counts.isEmpty():
        raise ValueError("the sources have no records")
    placed = shuffled(unique, key, seed)
    return (placed if most is None else placed.where(F.col("pos") < most)), counts


def emotion_records(rows: DataFrame, source: str, license: str, state: bool = True) -> DataFrame:
    """rows of an emotion converter as records: with the default state, the source and
    its licence, which must not be empty."""
    if not source or not license:
        raise ValueError("a record needs its source and licence")
    out = rows.withColumns({"dataset_source": F.lit(source), "dataset_license": F.lit(license)})
    return out.withColumn("state", default_state()) if state else out


def label_name(label: Column, labels: tuple[str, ...]) -> Column:
    """A label's name from its id or spelling (given as text); null if unknown."""
    names = F.array(*map(F.lit, labels))
    number = F.try_to_number(F.when(label.rlike("^[0-9]{1,6}$"), label), F.lit("999999")).cast("int")
    spelled = F.lower(X.strip(label))
    return F.coalesce(F.try_element_at(names, number + 1), F.when(spelled.isin(*labels), spelled))


def recognition(rows: DataFrame, text: str = "text", labels: str = "labels", instruction: str = RECOGNISE) -> DataFrame:
    """rows with emotion_labels and messages, from arrays of label ids; an unknown
    id raises, a row without labels or text goes."""
    names = F.array(*map(F.lit, EMOTIONS_28))
    name = lambda i: F.when(i.between(0, len(EMOTIONS_28) - 1), F.try_element_at(names, (i + 1).cast("int"))).otherwise(F.raise_error(F.concat(F.lit("unknown label id "), i.cast("string"))))
    out = rows.withColumn("emotion_labels", F.array_distinct(F.transform(labels, name))).withColumn(text, X.comma_token(text))
    out = out.where((F.size("emotion_labels") > 0) & (F.col(text) != ""))
    return out.withColumn("messages", F.array(
        message(F.lit("system"), F.lit(instruction)),
        message(F.lit("user"), F.concat(F.lit(IDENTIFY), F.col(text))),
        message(F.lit("assistant"), F.concat(F.lit(ANSWER), F.array_join("emotion_labels", ", "))),
    ))


def paired_emotions(rows: DataFrame, key: str, dialog: str = "dialog", emotion: str = "emotion", instruction: str = RESPOND) -> DataFrame:
    """(key, at, emotion_labels, messages) of turns 0 and 1, 2 and 3, ...; arrays of
    different sizes and unknown ids raise."""
    names = F.array(*map(F.lit, EMOTIONS_DIALOGUE))
    n = F.when(F.size(dialog) == F.size(emotion), F.size(dialog)).otherwise(F.raise_error(F.lit("turns and emotions differ in number")).cast("int"))
    at = F.when(n > 1, F.sequence(F.lit(0), n - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    out = rows.select(key, F.explode(at).alias("at"), dialog, emotion)
    said = lambda i: X.comma_token(F.get(dialog, F.col("at") + i))
    i = F.get(emotion, F.col("at"))
    out = out.withColumn("user__", said(0)).withColumn("reply__", said(1)).where("user__ <> '' AND reply__ <> ''")
    label = F.coalesce(F.try_element_at(names, (i + 1).cast("int")), F.raise_error(F.concat(F.lit("unknown emotion id "), i.cast("string"))))
    label = F.when(label == "no emotion", "neutral").otherwise(label)
    return out.withColumn("label__", label).select(
        key, "at", F.when(F.col("label__") == "neutral", F.array().cast("array<string>")).otherwise(F.array("label__")).alias("emotion_labels"),
        F.concat(F.array(message(F.lit("system"), F.concat(F.lit(instruction + TURN_NOTE), F.col("label__"), F.lit(".")))), _pair(F.col("user__"), F.col("reply__"))).alias("messages"),
    )


def listener_replies(rows: DataFrame, instruction: str = RESPOND, back: int = 3) -> DataFrame:
    """(conv_id, at, emotion_labels, messages) of each listener reply to the first
    speaker, with up to `back` turns before it; the emotion and the situation are
    the previous turn's, or else the first turn's."""
    clean = rows.select(
        X.comma_token("conv_id").alias("conv_id"), F.col("utterance_idx").cast("int").alias("i"), F.col("speaker_idx").cast("int").alias("speaker"),
        X.comma_token("utterance").alias("utterance"), F.lower(X.comma_token("context")).alias("context"), X.comma_token("prompt").alias("prompt"),
    ).where("conv_id <> '' AND utterance <> ''")
    turns = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "speaker", "utterance", "context", "prompt"))).alias("t"))
    turns = turns.where(F.size("t") > 1).select("conv_id", "t", F.explode(F.sequence(F.lit(1), F.size("t") - 1)).alias("at"))
    mine = lambda i: F.get("t", i)["speaker"] == F.get("t", F.lit(0))["speaker"]
    turns = turns.where(mine(F.col("at") - 1) & ~mine(F.col("at")))
    start = F.greatest(F.col("at") - back, F.lit(0))
    turns = turns.withColumn("start", F.when(mine(start), start).otherwise(start + 1)).where(mine(F.col("start")))
    before, first = F.get("t", F.col("at") - 1), F.get("t", F.lit(0))
    pick = lambda f: F.when(before[f] != "", before[f]).otherwise(first[f])
    emotion = F.when(pick("context") != "", pick("context")).otherwise("unspecified")
    system = F.concat(
        F.lit(instruction + CONTEXT_NOTE), emotion,
        F.lit(CONTEXT_CAVEAT),
        F.when(pick("prompt") != "", F.concat(F.lit(SITUATION_NOTE), X.bounded(pick("prompt")))).otherwise(""),
    )
    said = F.transform(F.slice("t", F.col("start") + 1, F.col("at") - F.col("start") + 1), lambda u: message(F.when(u["speaker"] == F.get("t", F.lit(0))["speaker"], "user").otherwise("assistant"), u["utterance"]))
    return turns.select(
        "conv_id", "at", F.when(emotion == "unspecified", F.array().cast("array<string>")).otherwise(F.array(emotion)).alias("emotion_labels"),
        F.concat(F.array(message(F.lit("system"), system)), said).alias("messages"),
    )


def emotion_rows(rows: DataFrame, source: str) -> DataFrame:
    """rows with text (collapsed) and emotion, of the two single-label sources."""
    rows = rows.withColumn("text", X.collapse("text")).where("text <> ''")
    if source == "many_emotions":
        rows = rows.where((F.lower(X.collapse("language")) == "en") & ~F.coalesce("is_label_conflict", F.lit(False)))
    labels = {"emotion": EMOTIONS_6, "many_emotions": EMOTIONS_7}[source]
    return rows.withColumn("emotion", label_name(F.col("label").cast("string"), labels)).where("emotion IS NOT NULL")


def scripted_emotions(rows: DataFrame, back: int = 2) -> DataFrame:
    """(dialogue_id, utterance_index, prompt, emotion) of scripted dialogue lines:
    each line with up to `back` lines before it, a line a speaker's turn. Lines
    without an utterance or an emotion go first."""
    clean = rows.select(
        F.col("Dialogue_ID").cast("string").alias("dialogue_id"), F.coalesce(F.col("Utterance_ID").try_cast("int"), F.lit(0)).alias("at"),
        F.concat(X.collapse("Speaker"), F.lit(": "), X.collapse("Utterance")).alias("line"), X.collapse("Utterance").alias("said"), F.lower(X.collapse("Emotion")).alias("emotion"),
    ).where("dialogue_id <> '' AND said <> '' AND emotion <> ''")
    near = context_windows(clean, "dialogue_id", "at", "line", back)
    nth = F.row_number().over(Window.partitionBy("dialogue_id").orderBy("at")) - 1
    return near.select("dialogue_id", nth.alias("utterance_index"), F.col("context").alias("prompt"), "emotion", "context_turns")


def scripted_sample(rows: DataFrame, seed: int, most: int | None = None, back: int = 2) -> DataFrame:
    """scripted_emotions in a seeded order, by pos; `most` of them."""
    key = F.concat_ws("-", "dialogue_id", F.col("utterance_index").cast("string"))
    placed = shuffled(scripted_emotions(rows, back).withColumn("key__", key), "key__", seed).drop("key__")
    return placed if most is None else placed.where(F.col("pos") < most)


def chat_wave(sources: Mapping[str, DataFrame], provenance: Mapping[str, Mapping[str, str]], key: str, seed: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(records, counts) of several sources' rows: each source is converted, keeps the
    first one of equal conversations in an order seeded with seed + its index, and
    `most` of them; equal ones of several sources stay with the first source. Records
    have pos, their place in a seeded order; counts have source, bucket (that of the
    provenance, if any) and usable. A source without records raises."""
    positive(most=most)
    parts = []
    for i, (name, rows) in enumerate(sources.items()):
        found = convert_chat(name, rows, provenance[name]).withColumns({"source_index": F.lit(i), "bucket": F.lit(provenance[name].get("bucket", "approved"))})
        placed = shuffled(found, key, seed + i, "rank__").withColumn("digest__", message_digest(F.col("messages")))
        unique = dedup_first(placed, F.col("digest__"), "rank__")
        few = least(unique, "rank__", most)
        parts.append(few.select("source_index", "rank__", "dataset_source", "dataset_license", "dataset_repository", "dataset_split", "bucket", F.col(key).cast("string").alias("source_id"), "state", "messages"))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    counts = both.groupBy(F.col("dataset_source").alias("source"), "bucket").agg(F.count("*").alias("usable"))
    if missing := sorted(set(sources) - {r.source for r in counts.collect()}):  # a row a source
        raise ValueError(f"no usable records of {', '.join(missing)}")
    both = both.withColumn("rank__", F.struct("source_index", "rank__"))
    unique = dedup_first(both, message_digest(F.col("messages")), "rank__").drop("rank__", "source_index")
    return shuffled(unique.withColumn("key__", F.concat_ws("-", "dataset_source", "source_id")), "key__", seed).drop("key__"), counts
