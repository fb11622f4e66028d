"""Message trees to root-to-leaf conversations.

leaf_paths takes trees of a type, which has a fixed depth as Spark types aren't
recursive, and builds a path by one explode a level; deep_paths takes trees of any
depth as variants and goes down by a recursive query. Nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.schemas import AUTO_FLAGS, HUMAN_FLAGS
from textloom.operators.chat import complete_exchange, default_state, message


#: Levels that a recursive query may go down; a deeper tree raises.
MOST_LEVELS = 10_000


def role_of(role: Column) -> Column:
    return F.when(role == "prompter", "user").when(role == "assistant", "assistant")


def usable(node: Column, language: str | None = "en", max_rank: int | None = 1) -> Column:
    ok = ~X.blank(node["text"]) & role_of(node["role"]).isNotNull()
    if language is not None:
        ok &= F.coalesce(node["lang"] == language, F.lit(False))
    ok &= ~F.coalesce(node["deleted"], F.lit(False)) & F.coalesce(node["review_result"], F.lit(True))
    if max_rank is not None:
        ok &= F.coalesce((node["role"] != "assistant") | (node["rank"] <= max_rank), F.lit(True))
    flagged = F.exists(
        F.map_entries(node["labels"]),
        lambda e: e["key"].isin(*HUMAN_FLAGS) & (e["value"]["value"] >= 0.5) & (F.coalesce(e["value"]["count"], F.lit(1.0)) > 0),
    )
    scored = F.exists(F.map_entries(node["detoxify"]), lambda e: e["key"].isin(*AUTO_FLAGS) & (e["value"] >= 0.5))
    return F.coalesce(ok & ~F.coalesce(flagged, F.lit(False)) & ~F.coalesce(scored, F.lit(False)), F.lit(False))


def leaf_paths(trees: DataFrame, depth: int, key: str = "message_tree_id", root: str = "prompt", language: str | None = "en", max_rank: int | None = 1, max_depth: int = 4) -> DataFrame:
    """(key, place, messages): usable paths down to a node without usable replies
    or the depth cap; place sorts them depth first. depth is the type's depth."""
    paths = trees.where(usable(F.col(root), language, max_rank)).select(
        key, F.array().cast("array<int>").alias("place"), F.col(root).alias("node"),
        F.array(message(role_of(F.col(root)["role"]), X.strip(F.col(root)["text"]))).alias("messages"),
    )
    done = None
    for level in range(1, min(depth, max_depth) + 1):
        if level == min(depth, max_depth):
            ended = paths
        else:
            paths = paths.withColumn("next", F.filter(F.coalesce(F.col("node")["replies"], F.expr("array()").cast(paths.schema["node"].dataType["replies"].dataType)), lambda r: usable(r, language, max_rank)))
            ended = paths.where(F.size("next") == 0)
            paths = paths.where(F.size("next") > 0).select(key, "place", "messages", F.posexplode("next").alias("i", "node")).select(
                key, F.concat("place", F.array("i")).alias("place"), "node",
                F.concat("messages", F.array(message(role_of(F.col("node")["role"]), X.strip(F.col("node")["text"])))).alias("messages"),
            )
        ended = ended.select(key, "place", "messages")
        done = ended if done is None else done.unionByName(ended)
    return done


def conversations(paths: DataFrame, min_reply: int = 0, state: bool = False) -> DataFrame:
    """Paths that are whole exchanges, as records with the default state if asked."""
    out = paths.where(complete_exchange(F.col("messages"), min_reply))
    return out.withColumn("state", default_state()) if state else out


def _sql_usable(r: str, language: str | None, max_rank: int | None) -> str:
    """SQL of usable for a node that is a variant."""
    get = lambda path, kind: f"try_variant_get({r}, '$.{path}', '{kind}')"
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    role = get("role", "string")
    tests = [f"{_sql_strip(get('text', 'string'))} <> ''", f"{role} IN ('prompter', 'assistant')", f"NOT coalesce({get('deleted', 'boolean')}, false)", f"coalesce({get('review_result', 'boolean')}, true)"]
    if language is not None:
        tests.append(f"{get('lang', 'string')} = '{language}'")
    if max_rank is not None:
        tests.append(f"coalesce({role} <> 'assistant' OR {get('rank', 'int')} <= {max_rank}, true)")
    tests.append(f"NOT coalesce(exists(map_entries({get('labels', 'map<string,struct<value:double,count:double>>')}), e -> e.key IN ({quoted(HUMAN_FLAGS)}) AND e.value.value >= 0.5 AND coalesce(e.value.count, 1) > 0), false)")
    tests.append(f"NOT coalesce(exists(map_entries({get('detoxify', 'map<string,double>')}), e -> e.key IN ({quoted(AUTO_FLAGS)}) AND e.value >= 0.5), false)")
    return f"coalesce({' AND '.join(tests)}, false)"


def _sql_strip(text: str) -> str:
    return f"regexp_replace({text}, r'(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '')"


def deep_paths(trees: DataFrame, tree: str, key: str = "message_tree_id", language: str | None = "en", max_rank: int | None = 1, max_depth: int | None = None) -> DataFrame:
    """leaf_paths of trees of any depth, each a variant column: a recursive query goes
    down one level at a time from the rows of the level before, so that the trees are
    read once and what has ended is not read again."""
    spark = trees.sparkSession
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(MOST_LEVELS))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    say = lambda r: f"named_struct('role', CASE try_variant_get({r}, '$.role', 'string') WHEN 'prompter' THEN 'user' ELSE 'assistant' END, 'content', {_sql_strip(f'''try_variant_get({r}, '$.text', 'string')''')})"
    below = lambda r: f"filter(coalesce(try_variant_get({r}, '$.replies', 'array<variant>'), cast(array() AS array<variant>)), r -> {_sql_usable('r', language, max_rank)})"
    cap = f"level >= {max_depth}" if max_depth else "false"
    return spark.sql(
        f"""WITH RECURSIVE n(tree_key, place, messages, below, level) AS (
        SELECT tree_key, cast(array() AS array<int>), array({say('node')}), {below('node')}, 1 FROM {{trees}} WHERE {_sql_usable('node', language, max_rank)}
        UNION ALL
        SELECT n.tree_key, concat(n.place, array(e.i)), concat(n.messages, array({say('e.node')})), {below('e.node')}, n.level + 1
        FROM n, LATERAL posexplode(n.below) AS e(i, node) WHERE NOT ({cap}))
        SELECT tree_key AS `{key}`, place, messages FROM n WHERE size(below) = 0 OR {cap}""",
        trees=trees.select(F.col(f"`{key}`").alias("tree_key"), F.col(f"`{tree}`").alias("node")),
    )
