"""Corpus curation: quality signals, filters, joins, dedup, budgets, mixing.

Every operator that depends on an order takes it as a column; "first" means least
in it. Nulls: a null text has no words and fails the filters; rows without a
partner in a join are classified, never lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X
from textloom.functions.checks import positive
from textloom.functions.schemas import ID_COLUMNS
from textloom.operators.order import position, totals
from textloom.sources import scratch


def signal_scores(signals: Column, name: str) -> Column:
    """Third elements of a signal's entries that have one and are numbers."""
    entries = F.coalesce(signals[name], F.array().cast("array<array<double>>"))
    return F.filter(F.transform(entries, lambda e: F.when(F.size(e) >= 3, F.try_element_at(e, F.lit(3)))), lambda v: v.isNotNull())


def mean(values: Column) -> Column:
    """Mean of an array; null if it is empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def quality_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with word_count, mean_word_length, symbol_ratio (# and ... a word),
    top_2gram (share of characters in the most frequent word pair) and
    bullet_share (lines that start with a bullet). No shuffle: a row's pairs are
    sorted in place and their longest run is found by one fold."""
    w = X.words(F.coalesce(text, F.lit("")))
    out = docs.withColumn("words__", w).withColumn("word_count", F.size("words__").cast("long"))
    n = F.greatest("word_count", F.lit(1))
    chars = F.length(F.array_join("words__", ""))
    pairs = F.when(
        F.size("words__") > 1,
        F.sort_array(F.zip_with(F.slice("words__", 1, F.size("words__") - 1), F.slice("words__", 2, F.size("words__") - 1), lambda a, b: F.concat_ws(" ", a, b))),
    ).otherwise(F.array().cast("array<string>"))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, p: Column) -> Column:
        run = F.when(s["last"] == p, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("last"), run.alias("run"), F.greatest(s["best"], F.when(run > 1, run * (F.length(p) - 1)).otherwise(F.lit(0))).alias("best"))

    symbols = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(#|\.\.\.|…)"), F.lit(1)))
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"\S"))
    bullets = F.filter(lines, lambda x: x.rlike(r"^\s*[•*-]"))
    return (
        out.withColumn("mean_word_length", chars / n)
        .withColumn("symbol_ratio", symbols / n)
        .withColumn("top_2gram", F.aggregate(pairs, start, step)["best"] / F.greatest(chars, F.lit(1)))
        .withColumn("bullet_share", F.size(bullets) / F.greatest(F.size(lines), F.lit(1)))
        .drop("words__")
    )


def rules_pass(word_count: Column, mean_word_length: Column, symbol_ratio: Column, top_2gram: Column, bullet_share: Column) -> Column:
    """The document rules; a missing signal fails, missing bullets don't, NaN fails."""
    ok = word_count.between(50, 100_000) & mean_word_length.between(3, 10) & (symbol_ratio <= 0.1) & (top_2gram <= 0.2)
    return F.coalesce(ok, F.lit(False)) & F.coalesce(bullet_share <= 0.9, F.lit(True))


def map_rules_pass(signals: Column) -> Column:
    """The rules on a signal map, as the web corpora ship it."""
    bullets = signal_scores(signals, "rps_lines_start_with_bulletpoint")
    high = F.size(F.filter(bullets, lambda v: v >= 0.5))
    names = ("rps_doc_word_count", "rps_doc_mean_word_length", "rps_doc_symbol_to_word_ratio", "rps_doc_frac_chars_top_2gram")
    return rules_pass(*(mean(signal_scores(signals, n)) for n in names), F.when(F.size(bullets) > 0, high / F.size(bullets)))


def english(lang: Column | str) -> Column:
    return F.coalesce(F.lower(X.strip(lang)).isin("english", "en"), F.lit(False))


def scores_pass(score: Column, language_score: Column, least: float = 3.0, least_language: float = 0.8) -> Column:
    """Both scores (numbers or text) reach their thresholds; a missing one is 0, one
    that is no number fails."""
    def reaches(c: Column, floor: float) -> Column:
        return F.coalesce(F.when(c.isNull(), F.lit(0.0)).otherwise(c.cast("string").try_cast("double")) >= floor, F.lit(False))

    return reaches(score, least) & reaches(language_score, least_language)


def without_sources(records: DataFrame, *sources: str, source: str = "source") -> DataFrame:
    """records but those of the given sources, which another step samples by itself."""
    return records.where(~F.coalesce(F.col(source).isin(*sources), F.lit(False)))


def long_enough(text: Column | str, words: int = 0, characters: int = 0) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.size(X.words(text)) >= words) & (F.length(X.strip(text)) >= characters)


def duplicate_ids(ids: DataFrame) -> DataFrame:
    """(id) distinct non-null values of any known id column, as strings."""
    have = [c for c in ID_COLUMNS if c in ids.columns]
    if not have:
        raise ValueError(f"none of the columns {', '.join(ID_COLUMNS)} is there")
    return ids.select(F.explode(F.array(*(F.col(c).cast("string") for c in have))).alias("id")).where("id IS NOT NULL").distinct()


def first_signals(signals: DataFrame, shard: str, order: str = "ord") -> DataFrame:
    """Signals of a shard's documents: ids are `shard`/row; the first of a row wins."""
    row = F.regexp_extract("id", "^" + shard.replace(".", r"\.") + r"/(\p{Nd}+)$", 1)
    rows = signals.withColumn("row", F.try_to_number(F.when(row != "", row), F.lit("9" * 18)).cast("long")).where("row IS NOT NULL")
    return rows.groupBy("row").agg(F.min_by("quality_signals", order).alias("quality_signals"))


def signal_counters(lines: DataFrame, shard: str, documents: int, line: str = "value") -> DataFrame:
    """One row about a shard's lines of signals: invalid_signal_records (no JSON
    objects), invalid_signal_ids (not of the shard, or of no document) and
    duplicate_signal_ids (beyond the first one of a document)."""
    record = lines.select(X.json_object(line).alias("v"))
    # an id that is no text doesn't count; its type tells, since a cast would hide it
    is_text = F.schema_of_variant(F.try_variant_get("v", "$.id", "variant")) == "STRING"
    row = F.regexp_extract(F.when(is_text, F.try_variant_get("v", "$.id", "string")), "^" + shard.replace(".", r"\.") + r"/(\p{Nd}+)$", 1)
    at = F.try_to_number(F.when(row != "", row), F.lit("9" * 18)).cast("long")
    rows = record.select(F.col("v").isNotNull().alias("good"), at.alias("at")).groupBy("good", F.when(F.col("at") < documents, F.col("at")).alias("at")).agg(F.count("*").alias("n"))
    total = lambda c, n="n": F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0))
    valid = F.col("at").isNotNull()
    return rows.agg(
        total(~F.col("good")).alias("invalid_signal_records"), total(F.col("good") & ~valid).alias("invalid_signal_ids"),
        (total(valid) - F.count_if(valid)).alias("duplicate_signal_ids"),
    )


def classify(docs: DataFrame, dups: DataFrame, key: str, checks: Sequence[tuple[str, Column]], digest: Column, order: str, within: Sequence[str] = ()) -> DataFrame:
    """(order, within, reason) of docs: duplicate_ids, the first failed check's name,
    exact_duplicates (a row with the same digest, within the given columns, comes
    before and passed the checks) or kept. The order is unique. Checks and digests are
    computed once: what they give is dealt out by the order, and both the digests'
    minima and the join read that one shuffle."""
    marked = docs.join(dups.select(F.col("id").alias("dup__")), F.col(key).cast("string") == F.col("dup__"), "left")
    reason = F.when(F.col("dup__").isNotNull(), "duplicate_ids")
    for name, failed in checks:
        reason = reason.when(failed, name)
    slim = marked.select(order, *within, reason.alias("reason__"), digest.alias("digest__")).repartition(order)
    # no filter, so that both sides have the same columns and rows of the shuffle
    first = slim.groupBy(*within, "digest__").agg(F.min(F.when(F.col("reason__").isNull(), F.col(order))).alias("first__"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*within, "digest__")]
    late = F.when(F.col(f"m.{order}") > F.col("first__"), "exact_duplicates").otherwise("kept")
    joined = slim.alias("m").join(first.alias("f"), same, "left")
    return joined.select(*(F.col(f"m.{c}") for c in (order, *within)), F.coalesce("reason__", late).alias("reason"))


def dedup_first(df: DataFrame, digest: Column, order: str, within: Sequence[str] = ()) -> DataFrame:
    """The first row of each digest (within columns). A grouped minimum over a slim
    table and a semi-join: the minimum is pre-aggregated, so a hot digest isn't one
    task's, and the rows themselves are read once."""
    marked = df.withColumn("digest__", digest)
    first = scratch.table(marked.select(F.col(order).alias("order__"), *within, "digest__")).groupBy(*within, "digest__").agg(F.min("order__").alias("first__"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*within, "digest__")]
    return marked.alias("m").join(first.alias("f"), [*same, F.col(f"m.{order}") == F.col("first__")], "left_semi").drop("digest__")


def text_digest(text: Column | str) -> Column:
    return F.sha2(X.strip(text), 256)


def size_budget(rows: DataFrame, size: str, target: int, order: str, strata: Sequence[str] = ()) -> DataFrame:
    """Rows in order until the numbers in `size` reach the target (in each stratum);
    the last one's number is cut to what is left."""
    positive(target=target)
    kept = totals(rows, F.col(size).cast("long"), order, strata).until(rows, target)
    return kept.withColumn(size, F.coalesce("room__", size)).drop("room__")


def char_budget(docs: DataFrame, target: int, order: str, text: str = "text", strata: Sequence[str] = ()) -> DataFrame:
    """Documents in order until `target` characters (in each stratum); the last
    one's text is cut to what is left. Lengths alone tell where that is: the texts
    that are kept are a filter of a scan, without a shuffle."""
    positive(target=target)
    kept = totals(docs, F.length(F.coalesce(text, F.lit(""))).cast("long"), order, strata).until(docs, target)
    cut = F.when(F.col("room__").isNull(), F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), F.col("room__").cast("int")))
    return kept.withColumn(text, cut).drop("room__")


def stratified_budget(docs: DataFrame, target: int, strata: Sequence[str], order: str, stratum: str = "source", text: str = "text") -> DataFrame:
    """Documents of the listed strata, one stratum after another, each until its even
    share of `target` characters (rounded up) and all until the target; what a stratum
    lacks no other one gets. Adds start, the characters before a document."""
    positive(target=target)
    share = -(-target // len(strata))
    index = F.array_position(F.array(*map(F.lit, strata)), F.col(stratum))
    n = F.length(F.coalesce(text, F.lit(""))).cast("long")
    known = docs.where(F.col(stratum).isin(*strata))
    seen = totals(known, n, order, [stratum])
    taken = seen.sums().withColumn("taken__", F.least("total__", F.lit(share))).drop("total__")
    ahead = Window.orderBy(index).rowsBetween(Window.unboundedPreceding, -1)  # a row for each of the listed strata
    offsets = taken.withColumn("offset__", F.coalesce(F.sum("taken__").over(ahead), F.lit(0))).drop("taken__")
    placed = seen.attach(known, "before__").join(F.broadcast(offsets), stratum).withColumn("start", F.col("before__") + F.col("offset__"))
    room = F.least(F.lit(share) - F.col("before__"), F.lit(target) - F.col("start"))
    return placed.where(room > 0).withColumn(text, F.substring(F.col(text), F.lit(1), room.cast("int"))).drop("before__", "offset__")


#: Rows of a budget's tail that are decided at once.
TAIL_ROWS = 10_000


def char_budget_min_tail(docs: DataFrame, target: int, order: str, min_words: int, text: str = "text", max_documents: int | None = None) -> DataFrame:
    """char_budget where a cut text must keep `min_words` words, or else it is
    skipped and later documents try the same remainder. Everything before the
    first overflow is one prefix sum. From there on a document counts only if it
    fits the remainder or is cut long enough by it; the remainder never grows, so
    what doesn't count is out for good. Those that count are decided TAIL_ROWS at a
    time, in order, from their lengths; the remainder is shorter than the document
    that overflowed, so there are few of them."""
    positive(target=target, max_documents=max_documents)
    n = F.length(F.coalesce(text, F.lit(""))).cast("long")
    over = totals(docs, n, order).ends(F.lit(target)).first()
    if over is None:
        out = docs
    elif over["value__"] == over["room__"]:
        out = docs.where(F.col(order) <= over["last__"])
    else:
        room, at, first, taken, last = over["room__"], over["last__"], True, [], None
        # characters up to the first one of the last word that a cut must keep
        word, gap = r"[^\s\x1c-\x1f]++", r"[\s\x1c-\x1f]++"
        need = F.length(F.regexp_extract(F.coalesce(text, F.lit("")), f"(?U)^(?:{gap})?(?:{word}{gap}){{{min_words - 1}}}[^\\s\\x1c-\\x1f]", 0)) if min_words > 0 else F.lit(1)
        rest = docs.withColumn("chars__", n).withColumn("need__", F.when(need > 0, need)).select(order, "chars__", "need__")
        while room > 0 and last is None:
            beyond = F.col(order) >= at if first else F.col(order) > at
            counts = (F.col("chars__") > 0) & ((F.col("chars__") <= room) | (F.col("need__") <= room))
            live = rest.where(beyond & counts).orderBy(order).limit(TAIL_ROWS).collect()
            for row in live:
                if row["chars__"] <= room:
                    taken.append(row[order])
                    room -= row["chars__"]
                elif row["need__"] is not None and row["need__"] <= room:
                    last = (row[order], room)
                if room <= 0 or last is not None:
                    break
            if len(live) < TAIL_ROWS:
                break
            at, first = live[-1][order], False
        # empty texts fit wherever something is left
        end = last[0] if last else taken[-1] if taken and room <= 0 else None
        empty = (n == 0) & (F.col(order) > over["last__"]) & (F.lit(True) if end is None else F.col(order) < end)
        kind = docs.schema[order].dataType
        # fewer than the characters of the text that overflowed
        marks = docs.sparkSession.createDataFrame([(o,) for o in taken + ([last[0]] if last else [])], T.StructType([T.StructField("taken__", kind)]))
        out = docs.join(F.broadcast(marks), F.col(order) == F.col("taken__"), "left").where((F.col(order) < over["last__"]) | empty | F.col("taken__").isNotNull()).drop("taken__")
        if last:
            out = out.withColumn(text, F.when(F.col(order) == F.lit(last[0]), F.substring(F.col(text), 1, int(last[1]))).otherwise(F.col(text)))
    return out if max_documents is None else position(out, order, "nth__").where(F.col("nth__") < max_documents).drop("nth__")


def round_robin(docs: DataFrame, sources: Sequence[str], order: str, source: str = "source") -> DataFrame:
    """docs with turn and source_index; sorted by both, the k-th document of every
    source comes before any source's next one."""
    index = F.array_position(F.array(*map(F.lit, sources)), F.col(source)) - 1
    known = docs.where(F.col(source).isin(*sources)).withColumn("source_index", index.cast("int"))
    return position(known, order, "turn", [source])


def balanced_quota(first: int, second: int, limit: int) -> tuple[int, int]:
    """Half each, the larger half to the first; what one lacks the other fills."""
    a = min(first, max(-(-limit // 2), limit - second))
    return a, min(second, limit - a)


def append_merge(existing: DataFrame, new: DataFrame, digest: Column, order: str) -> DataFrame:
    """Both tables' rows, existing ones first, without later rows of a digest."""
    both = existing.withColumn("rank__", F.struct(F.lit(0).alias("t"), F.col(order).alias("o"))).unionByName(
        new.withColumn("rank__", F.struct(F.lit(1).alias("t"), F.col(order).alias("o"))), allowMissingColumns=True
    )
    return dedup_first(both, digest, "rank__").drop("rank__")
