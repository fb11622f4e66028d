"""Types, enumerations and label tables of the chat and corpus records."""

from __future__ import annotations

MESSAGE = "struct<role:string,content:string>"
MESSAGES = f"array<{MESSAGE}>"
DOCUMENT = "source string, ord long, text string, meta map<string,string>"

#: Chat roles.
BASE_ROLES = ("system", "user", "assistant")
EXTENDED_ROLES = (
    "file", "moderator", "tool_call:assistant", "tool_call:result->assistant", "system-1",
    "mcp_tool_call:assistant", "mcp_tool_call:result->assistant", "error", "tool_call:error", "mcp_tool_call:error",
)
MULTI_ASSISTANT_ROLES = ("assistant:Gemini", "assistant:Claude", "assistant:ChatGPT", "assistant:Qwen", "assistant:DeepSeek")
ROLES = (*BASE_ROLES, *EXTENDED_ROLES, *MULTI_ASSISTANT_ROLES)
#: Roles whose text is a model's output.
OUTPUT_ROLES = ("assistant", "tool_call:assistant", "mcp_tool_call:assistant", *MULTI_ASSISTANT_ROLES)

#: Spellings of roles in imported chats, and in the stricter import.
ROLE_ALIASES = {
    "human": "user", "prompter": "user", "usr": "user", "user": "user",
    "gpt": "assistant", "bot": "assistant", "sys": "system", "assistant": "assistant",
    "cat": "assistant", "anime_girl": "assistant", "seeker": "user", "supporter": "assistant", "system": "system",
}
FEW_ROLE_ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant"}

#: Sections and fields of a state, with the default of each field.
STATE = {
    "emotions": {
        "happiness": 0.5, "sadness": 0.1, "affection": 0.5, "curiosity": 0.7, "excitement": 0.3, "frustration": 0.1,
        "anger": 0.0, "fear": 0.1, "calmness": 0.6, "confidence": 0.7, "loneliness": 0.1, "playfulness": 0.4,
    },
    "needs": {"social_connection": 0.5, "stimulation": 0.5, "task_completion": 0.6, "rest": 0.5},
    "personality": {"playful": 0.9, "curious": 0.85, "helpful": 0.8, "affectionate": 0.9, "seriousness": 0.3},
}
STATE_TYPE = "struct<" + ",".join(f"{s}:struct<{','.join(f'{f}:double' for f in fields)}>" for s, fields in STATE.items()) + ">"

#: Emotion labels by their ids in the source corpora.
EMOTIONS_28 = (
    "admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion", "curiosity", "desire",
    "disappointment", "disapproval", "disgust", "embarrassment", "excitement", "fear", "gratitude", "grief", "joy",
    "love", "nervousness", "optimism", "pride", "realization", "relief", "remorse", "sadness", "surprise", "neutral",
)
EMOTIONS_DIALOGUE = ("no emotion", "anger", "disgust", "fear", "happiness", "sadness", "surprise")
EMOTIONS_6 = ("sadness", "joy", "love", "anger", "fear", "surprise")
EMOTIONS_7 = ("anger", "fear", "joy", "love", "sadness", "surprise", "neutral")

#: Reasons to drop a node of a message tree.
HUMAN_FLAGS = ("spam", "fails_task", "lang_mismatch", "pii", "not_appropriate", "hate_speech", "sexual_content", "toxicity")
AUTO_FLAGS = ("toxicity", "severe_toxicity", "obscene", "identity_attack", "insult", "threat", "sexual_explicit")

#: Columns that may hold a duplicate's id.
ID_COLUMNS = ("id", "doc_id", "document_id", "id_int")


def tree_type(depth: int) -> str:
    """The type of a message tree's node with replies down to `depth` levels."""
    node = (
        "message_id:string,text:string,role:string,lang:string,rank:int,deleted:boolean,review_result:boolean,"
        "labels:map<string,struct<value:double,count:double>>,detoxify:map<string,double>"
    )
    if not 1 <= depth <= 16:
        raise ValueError("depth must be between 1 and 16")
    return f"struct<{node}>" if depth == 1 else f"struct<{node},replies:array<{tree_type(depth - 1)}>>"
