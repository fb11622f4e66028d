import json

import pytest
from pyspark.sql import functions as F

from textloom.functions.schemas import STATE, tree_type
from textloom.operators import chat as H
from textloom.operators import convert as V
from textloom.operators import trees


def chats(spark, *rows):
    return spark.createDataFrame([(i, m) for i, m in enumerate(rows)], "i int, m array<struct<role:string,content:string>>").orderBy("i")


def value(spark, messages, f):
    return [x[0] if not isinstance(x[0], list) else [(m.role, m.content) for m in x[0]] for x in chats(spark, *messages).select(f(F.col("m"))).collect()]


U, A, S = ("user", "q"), ("assistant", "a"), ("system", "s")


def test_validation(spark):
    good = [[U, A], [S, U, A], [("user", "x"), ("tool_call:assistant", "y")], [("assistant:Qwen", "z")]]
    bad = [[], None, [U], [("robot", "x"), A], [("user", "  "), A], [U, A, U], [(None, "x"), A], [("user", None), A]]
    assert value(spark, good + bad, H.valid) == [True] * 4 + [False] * 8


def test_alternation_and_complete_exchanges(spark):
    rows = [[U, A], [U, U, A], [], [U], [A, U], [U, A, U, A]]
    assert value(spark, rows, H.alternates) == [True, False, True, True, True, True]
    assert value(spark, rows, lambda m: H.complete_exchange(m)) == [True, False, False, False, False, True]
    assert value(spark, [[U, ("assistant", " hello ")]] * 2, lambda m: H.complete_exchange(m, 5)) == [True, True]
    assert value(spark, [[U, ("assistant", " hell ")]], lambda m: H.complete_exchange(m, 5)) == [False]


def test_normalisers(spark):
    rows = [
        [S, ("Human", " a\n b "), ("gpt", "c")], [A, ("usr", "x"), ("bot", "y"), ("human", "tail")], [U, U, A], [U], [U, ("user", " "), A],
        [(" SEEKER ", "x"), ("supporter", "y")], None,
    ]
    assert value(spark, rows, H.normalize) == [
        [("user", "a b"), ("assistant", "c")], [("user", "x"), ("assistant", "y")], None, None, [U, A], [("user", "x"), ("assistant", "y")], None,
    ]
    assert value(spark, [[S, ("human", " a  b "), ("gpt", "c"), U], [A], [U, U, A], [("usr", "x"), A]], H.normalize_keep_system) == [
        [S, ("user", "a  b"), A[:1] + ("c",)], None, [U, U, A], None,
    ]
    assert value(spark, [[("Ann", "hi"), ("Bob", "yo"), ("Ann", "?")], [("a", "x"), ("b", ""), ("a", "y")], [("a", "x")], [("a", "1"), ("b", "2"), ("c", "3")]], lambda m: H.two_speakers(m, "role", "content")) == [
        [("user", "hi"), ("assistant", "yo")], None, None, None,
    ]


def test_system_merge_and_serialisation(spark):
    assert value(spark, [[S, ("system", "t"), U, A], [U, A], [S]], lambda m: H.merge_system(m, F.lit("p"))) == [
        [("system", "p\ns\nt"), U, A], [("system", "p"), U, A], [("system", "p\ns")],
    ]
    assert value(spark, [[U, A]], H.serialize) == ["<|user|>\nq\n<|assistant|>\na\n<EOS><|assistant|>\n"]
    assert value(spark, [[("user", ' "é" '), A]], H.canonical) == ['[{"content":"\\"é\\"","role":"user"},{"content":"a","role":"assistant"}]']


def test_state_validation(spark):
    good = json.loads(json.dumps(STATE))
    bad = json.loads(json.dumps(STATE))
    bad["emotions"]["anger"] = 1.5
    bad["needs"]["rest"] = True
    bad["personality"]["playful"] = "0.5"
    del bad["emotions"]["fear"]
    bad["needs"]["extra"] = 0.1
    rows = [good, bad, {k: good[k] for k in ("emotions", "needs")} | {"other": {}}, "x", None]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, j string").orderBy("i")
    got = [r[0] for r in df.select(H.state_problems(F.col("j"))).collect()]
    assert got[0] == []
    assert sorted(got[1]) == sorted(["missing field emotions.fear", "unexpected field needs.extra", "bad value emotions.anger", "bad value needs.rest", "bad value personality.playful"])
    assert sorted(got[2]) == ["missing section personality", "unexpected section other"]
    assert got[3] == ["not an object"] and got[4] == ["not an object"]
    assert spark.range(1).select(H.default_state().alias("s")).first().s.needs.rest == 0.5


def test_transcripts_and_windows(spark):
    text = "User: hi\nCat: hello\n  there\nuser: more?\n cat: yes"
    got = spark.createDataFrame([(text,), ("none",)], "t string").select(H.turn_pairs_text("t")).collect()
    assert [[(a.content, b.content) for a, b in r[0]] for r in got] == [[("hi", "hello\n  there"), ("more?", "yes")], []]
    df = chats(spark, [U, A, ("user", "q2"), ("assistant", "a2"), ("user", "q3"), ("assistant", "a3")]).withColumnRenamed("m", "messages")
    windows = {r.at: [m.content for m in r.messages] for r in H.reply_contexts(df, "i").collect()}
    assert windows == {1: ["q", "a"], 3: ["q", "a", "q2", "a2"], 5: ["q2", "a2", "q3", "a3"]}
    pairs = H.turn_pairs(chats(spark, [U, A, ("user", " "), A, U]).withColumnRenamed("m", "messages"), "i").collect()
    assert [(r.at, r.user_text, r.reply) for r in pairs] == [(0, "q", "a")]
    turns = spark.createDataFrame([(1, i, t) for i, t in enumerate("abcd")], "c int, t int, text string")
    assert [r.context for r in H.context_windows(turns, "c", "t").orderBy("t").collect()] == ["a", "a\nb", "a\nb\nc", "b\nc\nd"]


def test_tools(spark):
    schema = "t array<struct<name:string,description:string,parameters:string>>"
    one = ("find", "Finds.", '{"type":"object","properties":{"q":{"type":"string"},"n":5},"required":["q"]}')
    ask = lambda tools: spark.createDataFrame([(tools,)], schema).select(H.tool_instructions(F.col("t"))).first()[0]
    assert ask([]).startswith("No tools")
    assert '- find: Finds. Args: {"n":"any","q":"string"} (required: q).' in ask([one])
    for bad in ([one, one], [("", "", one[2])], [("x", "", '{"type":"array"}')], [("x", "", '{"type":"object","required":["q"]}')]):
        with pytest.raises(Exception, match="tool definition"):
            ask(bad)


def node(text, role, replies=(), **more):
    base = dict(message_id="m", text=text, role=role, lang="en", rank=None, deleted=False, review_result=True, labels={}, detoxify={})
    return base | more | {"replies": list(replies)}


def paths(spark, tree, depth=4, **more):
    def cut(n, d):
        return {k: (v if k != "replies" else [cut(r, d - 1) for r in v]) for k, v in n.items() if k != "replies" or d > 1}

    df = spark.createDataFrame([("t", cut(tree, depth))], f"message_tree_id string, prompt {tree_type(depth)}")
    out = trees.leaf_paths(df, depth, **more).collect()
    return [[m.content for m in r.messages] for r in sorted(out, key=lambda r: r.place)]


def test_trees(spark):
    line = node("q", "prompter", [node("a", "assistant", [node("q2", "prompter", [node("a2", "assistant")])])])
    assert paths(spark, line) == [["q", "a", "q2", "a2"]]
    assert paths(spark, line, max_depth=2) == [["q", "a"]]
    assert paths(spark, node("q", "prompter", lang="es")) == []
    many = node("q", "prompter", [
        node("good", "assistant", rank=0), node("low", "assistant", rank=4), node("tox", "assistant", labels={"toxicity": {"value": 0.9, "count": None}}),
        node("auto", "assistant", detoxify={"insult": 0.95}), node("fails", "assistant", labels={"fails_task": {"value": 0.9, "count": 2.0}}),
        node("uncounted", "assistant", labels={"spam": {"value": 0.9, "count": 0.0}}), node("gone", "assistant", deleted=True), node("rejected", "assistant", review_result=False), node(" ", "assistant"), node("x", "owner"),
    ])
    assert paths(spark, many) == [["q", "good"], ["q", "uncounted"]]
    df = spark.createDataFrame([(0, [U, ("assistant", "12345")]), (1, [U])], "k int, messages array<struct<role:string,content:string>>")
    assert trees.conversations(df, 20).count() == 0 and trees.conversations(df).count() == 1


def converted(spark, source, schema, *rows):
    out = V.convert_chat(source, spark.createDataFrame(list(rows), schema)).collect()
    return [[(m.role, m.content) for m in r.messages] for r in out]


def test_chat_converters(spark):
    share = json.dumps([{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}])
    assert converted(spark, "openhermes", "conversations string", (share,), ("not json",), (None,)) == [[U, A]]
    assert converted(spark, "dolly", "instruction string, context string, response string", ("do", "some\nthing", "done"), ("do", "", "")) == [[("user", "do Context: some thing"), ("assistant", "done")]]
    assert converted(spark, "catgirl_corpus", "text string", ("User: a\nCat: b\nUser: c\nCat: d",)) == [[("user", "a"), ("assistant", "b")], [("user", "c"), ("assistant", "d")]]
    assert converted(spark, "anime_girl_chat", "user string, anime_girl string", ("q", "a"), ("q", None)) == [[U, A]]
    assert converted(spark, "soda", "dialogue array<string>, speakers array<string>", (["x", "y", "z"], ["A", "B", "A"]), (["x"], ["A", "B"])) == [[("user", "x"), ("assistant", "y")]]
    assert converted(spark, "everyday_conversations", "messages string, prompt string, completion string", (None, "q", "a")) == [[U, A]]
    assert converted(spark, "english_daily_dialogues", "turns array<struct<speaker:string,text:string>>", ([("A", "q"), ("B", "a")],), ([("A", "q"), ("B", "a"), ("C", "c")],)) == [[U, A]]
    assert converted(spark, "synthetic_social_dialogues", "output string", (json.dumps({"dialogue": [{"speaker": "x", "line": "q"}, {"speaker": "y", "line": "a"}]}),), ("[]",)) == [[U, A]]
    assert converted(spark, "multiwoz", "turns array<struct<speaker:string,utterance:string>>", ([("user", "q"), ("SYSTEM", "a")],), ([("USER", "q")],), ([("X", "q"), ("SYSTEM", "a")],)) == [[U, A]]
    assert converted(spark, "smol-smoltalk", "messages string", (json.dumps([{"role": "system", "content": " s "}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]),)) == [[S, U, A]]
    schema = "personas array<array<string>>, context_dataset string, additional_context string, free_turker_utterance string, guided_turker_utterance string, dialog array<array<string>>"
    good = ([["x"], ["I am.", " "]], "wizard_of_wikipedia", "Topic", "q", "a", [["0", "q2"], ["1", "a2"], ["1", "odd"], ["0", "pair"]])
    assert converted(spark, "blended_skill_talk", schema, good, (None, None, None, "q", "a", [["0", "only"]]), (None, None, None, " ", "a", [])) == [
        [("system", "Your persona: I am.\nContext source: wizard_of_wikipedia\nTopic: Topic"), U, A, ("user", "q2"), ("assistant", "a2")],
    ]
    math = converted(spark, "gsm8k", "question string, answer string", (" 1+1? ", " 2 "), ("x", " "))
    assert len(math) == 1 and math[0][0][1].endswith("\n\n1+1?") and math[0][1] == ("assistant", "2")
    assert set(V.CHAT) >= {"cat_v28", "wizardlm", "ultrachat", "gpt4all", "empathetic_dialogues", "esconv", "synthetic_conversations", "ultrachat_200k"}


def test_emotion_converters(spark):
    rows = spark.createDataFrame([("Hi  there", [2, 14, 2]), ("none", []), (" ", [1])], "text string, labels array<int>")
    out = V.recognition(rows).collect()
    assert [r.emotion_labels for r in out] == [["anger", "fear"]] and out[0].messages[2].content == "Emotions: anger, fear"
    with pytest.raises(Exception, match="unknown label id"):
        V.recognition(spark.createDataFrame([("x", [28])], "text string, labels array<int>")).collect()
    rows = spark.createDataFrame([(1, ["a", "b", "c"], [5, 0, 4]), (2, ["x_comma_ y", "z"], [0, 0])], "k int, dialog array<string>, emotion array<int>")
    got = {(r.k, r.at): (r.emotion_labels, r.messages[1].content) for r in V.paired_emotions(rows, "k").collect()}
    assert got == {(1, 0): (["sadness"], "a"), (2, 0): ([], "x, y")}
    with pytest.raises(Exception, match="differ in number"):
        V.paired_emotions(spark.createDataFrame([(1, ["a", "b"], [5])], "k int, dialog array<string>, emotion array<int>"), "k").collect()
    schema = "conv_id string, utterance_idx string, speaker_idx string, context string, prompt string, utterance string"
    turns = [("c", str(i), str(i % 2), "Sad" if i == 0 else "", "long " * 80 if i == 0 else "", f"u{i}") for i in range(4)]
    out = sorted(V.listener_replies(spark.createDataFrame(turns, schema)).collect(), key=lambda r: r.at)
    assert [(r.at, r.emotion_labels, [m.content for m in r.messages[1:]]) for r in out] == [(1, ["sad"], ["u0", "u1"]), (3, ["sad"], ["u0", "u1", "u2", "u3"])]
    assert out[0].messages[0].content.endswith("...")
    many = spark.createDataFrame([("t", "3", "en", False), ("t", "joy", "EN ", None), ("t", "0", "de", False), ("t", "0", "en", True), ("t", "9", "en", False)], "text string, label string, language string, is_label_conflict boolean")
    assert [r.emotion for r in V.emotion_rows(many, "many_emotions").collect()] == ["love", "joy"]
    assert [r.emotion for r in V.emotion_rows(many.select("text", "label"), "emotion").collect()] == ["anger", "joy", "sadness", "sadness"]


def test_records_have_their_provenance(spark):
    rows = spark.createDataFrame([("q", "a")], "prompt string, response string")
    spec = {"license": "mit", "repository": "some/where", "split": "train"}
    r = V.convert_chat("gpt4all", rows, spec).first()
    assert (r.dataset_license, r.dataset_repository, r.dataset_split, r.dataset_source) == ("mit", "some/where", "train", "gpt4all")
    assert r.state.needs.rest == 0.5 and [m.role for m in r.messages] == ["user", "assistant"]
    with pytest.raises(ValueError, match="lacks license"):
        V.convert_chat("gpt4all", rows, {"repository": "x", "split": "y"})


def test_an_explicit_null_counts(spark):
    raw = '[{"role":null,"from":"user","content":"a"},{"from":"user","value":"b"},{"speaker":"x","text":null}]'
    out = spark.createDataFrame([(raw,)], "r string").select(V.as_messages(F.col("r")).alias("m")).first().m
    assert [(m.role, m.content) for m in out] == [(None, "a"), ("user", "b"), ("x", None)]


def test_tool_arguments_are_escaped(spark):
    tools = [("t", "d", '{"type":"object","properties":{"a\\"b":{"type":"string"}},"required":[]}')]
    df = spark.createDataFrame([(tools,)], "tools array<struct<name:string,description:string,parameters:string>>")
    assert 'Args: {"a\\"b":"string"}.' in df.select(H.tool_instructions(F.col("tools"))).first()[0]


def test_merge_of_emotion_sources(spark):
    def rows(name, license_, *texts):
        made = [(i, name, license_, [("system", f"s{i}"), ("user", t)]) for i, t in enumerate(texts)]
        return spark.createDataFrame(made, "i long, dataset_source string, dataset_license string, messages array<struct<role:string,content:string>>")

    a, b = rows("a", "x", "one", " one ", "two"), rows("b", "x", "two", "three")
    out, counts = V.merge_emotions([("a", a), ("b", b)], "i", "messages.content", 1)
    assert {r.dataset_source: r.n for r in counts.collect()} == {"a": 2, "b": 1}
    assert sorted((r.dataset_source, r.i) for r in out.collect()) == [("a", 0), ("a", 2), ("b", 1)]
    with pytest.raises(Exception, match="isn't of b"):
        V.merge_emotions([("b", a)], "i", "i", 1)[0].collect()
    with pytest.raises(Exception, match="no licence"):
        V.merge_emotions([("a", rows("a", None, "one"))], "i", "i", 1)[0].collect()
    with pytest.raises(ValueError):
        V.merge_emotions([("a", a.limit(0))], "i", "i", 1)
