"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a bounded sample; rules then
run in order of rejections per second, each only on the rows that the earlier
ones left. A rule's cost is what it adds to the words, which are cut once and
shared. The verdict is the conjunction of all rules, so the order changes the time
and never the result.

Defined cases: a null text has no words, like an empty one; repeated rows are
judged one by one; a very long text is one step of its own; an empty table gives
an empty result; an input column with the name of an added one is replaced by it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import blocks

_SYMBOL = blocks._table(b"#*$%&|<>")


class Facts:
    """Counts of a column of texts, each computed when first asked for."""

    def __init__(self, texts: pa.Array | blocks.Words):
        self._words = texts if isinstance(texts, blocks.Words) else blocks.words(texts)

    def of(self, rows: np.ndarray) -> Facts:
        """The same of some rows (marked)."""
        return self if rows.all() else Facts(self._words.of(rows))

    @cached_property
    def n_words(self) -> np.ndarray:
        return self._words.counts

    @cached_property
    def word_chars(self) -> np.ndarray:
        w = self._words
        points = w.inside & ((w.data & 0xC0) != 0x80)
        return blocks.per_row(points, w.offsets)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return blocks.per_row(_SYMBOL[self._words.data], self._words.offsets)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = self._words.data, self._words.offsets
        n = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        # a row of k breaks has k + 1 lines; a line's bytes are those between its bounds
        row = np.searchsorted(offsets, breaks, "right") - 1
        starts = np.concatenate([offsets[:-1], breaks + 1])
        rows = np.concatenate([np.arange(n), row])
        order = np.lexsort((starts, rows))
        starts, rows = starts[order], rows[order]
        stops = np.concatenate([starts[1:] - 1, [0]])
        last = np.append(rows[1:] != rows[:-1], True)[: len(rows)]
        stops[last] = offsets[rows[last] + 1]
        full = np.zeros(len(data) + 1, np.int64)
        np.cumsum(blocks.SPACED[data], out=full[1:])
        worded = full[stops] > full[starts]
        kept = data != 10
        ends = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(stops - starts, out=ends[1:])
        codes, distinct = blocks.coded(blocks.binary(data[kept], ends))
        key = (rows * max(1, len(distinct)) + codes)[worded]
        rows = rows[worded]
        group, found = blocks.grouped(key)
        first = np.zeros(found, np.int64)
        first[group[::-1]] = np.arange(len(key))[::-1]
        again = first[group] != np.arange(len(key))
        return np.bincount(rows, minlength=n), np.bincount(rows[again], minlength=n)

    @property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        w = self._words
        at = w.windows(3)
        codes, distinct = w.codes
        size = max(1, len(distinct))
        pair, _ = blocks.grouped(codes[at] * size + codes[at + 1])
        triple, _ = blocks.grouped(pair * size + codes[at + 2])
        group, found = blocks.grouped(w.row[at] * max(1, len(at)) + triple)
        twice = at[np.bincount(group, minlength=found)[group] >= 2]
        hit = np.zeros(len(codes), bool)
        for k in range(3):
            hit[twice + k] = True
        return blocks.per_row(hit, w.ends)

    @cached_property
    def top_word(self) -> np.ndarray:
        w = self._words
        codes, distinct = w.codes
        group, found = blocks.grouped(w.row * max(1, len(distinct)) + codes)
        out = np.zeros(len(w.counts), np.int64)
        np.maximum.at(out, w.row, np.bincount(group, minlength=found)[group])
        return out


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], np.ndarray]


#: A document fails the base where this holds.
BASE = (
    Rule("short", lambda f: f.n_words < 50),
    Rule("repeats", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
#: The cascade's further rules.
RULES = (
    Rule("long", lambda f: f.n_words > 100_000),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("word_length", lambda f: (f.word_chars < 3 * f.n_words) | (f.word_chars > 10 * f.n_words)),
    Rule("dup_lines", lambda f: 100 * f.n_dup_lines > 30 * f.n_lines),
    Rule("top_word", lambda f: 100 * f.top_word > 30 * f.n_words),
)


def passes(facts: Facts, rules: Sequence[Rule]) -> np.ndarray:
    """Which texts no rule rejects. A rule sees the rows that all before it left."""
    kept = np.zeros(len(facts.n_words), bool)
    alive = np.arange(len(kept))
    for rule in rules:
        if not len(alive):
            break
        left = ~rule.rejects(facts)
        alive, facts = alive[left], facts.of(left)
    kept[alive] = True
    return kept


@dataclass(frozen=True)
class Seen:
    """Of a sample: seconds that each rule took, and how many rows each set of rules
    rejects (a bit for each rule)."""

    seconds: dict[str, float]
    masks: dict[int, int]


def estimate(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = 512, base: Sequence[Rule] = ()) -> Seen:
    """Costs and joint rejections of the rules over about sample_rows rows, less those
    that a base rule rejects. At most a row for each rule and each set of rules that a
    row of the sample has reaches the driver."""
    if not rules:
        return Seen({}, {})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.steps(batch, text):
                cut = blocks.words(part.column(text))
                cut.codes  # shared, like the words  # noqa: B018
                alive = np.ones(part.num_rows, bool)
                for rule in base:
                    alive &= ~rule.rejects(Facts(cut))
                mask, seconds = np.zeros(part.num_rows, np.int64), []
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    mask |= rule.rejects(Facts(cut)).astype(np.int64) << i
                    seconds.append(time.perf_counter() - began)
                found, n = np.unique(mask[alive], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*range(len(rules)), *[-1] * len(found)], pa.int32()), pa.array([0] * len(rules) + found.tolist(), pa.int64()),
                     pa.array(seconds + [0.0] * len(found)), pa.array([0] * len(rules) + n.tolist(), pa.int64())],
                    ["rule", "mask", "seconds", "n"],
                )

    made = blocks.about(docs, sample_rows).select(text).mapInArrow(blocks.frugal(measure), "rule int, mask long, seconds double, n long")
    sums = made.groupBy("rule", "mask").agg(F.sum("seconds").alias("seconds"), F.sum("n").alias("n")).collect()
    return Seen({rules[r["rule"]].name: r["seconds"] for r in sums if r["rule"] >= 0}, {r["mask"]: r["n"] for r in sums if r["rule"] < 0})


def ordered(rules: Sequence[Rule], seen: Seen) -> list[Rule]:
    """Rules by rejections per second, most first, where a rule's rejections are those
    among the rows that the rules before it left."""
    left, alive, out = list(range(len(rules))), dict(seen.masks), []
    while left:
        def score(i: int) -> float:
            return sum(n for m, n in alive.items() if m >> i & 1) / max(seen.seconds.get(rules[i].name, 0.0), 1e-9)

        best = max(left, key=lambda i: (score(i), -i))
        out.append(rules[best])
        left.remove(best)
        alive = {m: n for m, n in alive.items() if not m >> best & 1}
    return out


def quality_filter(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *RULES), text: str = "text", sample_rows: int = 512) -> DataFrame:
    """The rows that pass every rule, with all their columns."""
    blocks.small_batches(docs.sparkSession)
    docs, back, _ = blocks.apart(docs, text)
    text = "text__"
    rules = ordered(rules, estimate(docs, rules, text, sample_rows))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.steps(batch, text):
                yield part.filter(pa.array(passes(Facts(part.column(text)), rules)))

    return back(docs.mapInArrow(blocks.frugal(keep), docs.schema))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 512) -> DataFrame:
    """All columns but the text, with COUNTS, base_failed and kept: the cascade
    judges what the base let through."""
    blocks.small_batches(docs.sparkSession)
    added = [*COUNTS, "base_failed", "kept"]
    docs, back, _ = blocks.apart(docs, text, added, keep_text=False)
    text = "text__"
    rules = ordered(rules, estimate(docs, rules, text, sample_rows, BASE))
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType(rest + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.BooleanType()) for c in added[-2:]])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.steps(batch, text):
                texts = part.column(text)
                facts = Facts(texts)
                failed = np.zeros(len(texts), bool)
                for rule in BASE:
                    failed |= rule.rejects(facts)
                kept = np.zeros(len(texts), bool)
                kept[~failed] = passes(facts.of(~failed), rules)
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in rest]
                    + [pa.array(np.asarray(getattr(facts, c), np.int64)) for c in COUNTS]
                    + [pa.array(failed), pa.array(kept)],
                    schema.names,
                )

    return back(docs.select(*(f.name for f in rest), text).mapInArrow(blocks.frugal(report), schema), *added)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_report(docs)


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), tri AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM tri) WHERE c >= 2) GROUP BY doc_id
), lines AS (
  SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY doc_id
), top AS (
  SELECT doc_id, max(c) AS n FROM (
    SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS x FROM w) GROUP BY doc_id, x) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         coalesce(dup.n_lines, 0) AS n_lines, coalesce(top.n, 0) AS n_top
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN top USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 100000 AND 10 * n_symbols <= n_words
         AND word_chars BETWEEN 3 * n_words AND 10 * n_words
         AND 100 * n_dup_lines <= 30 * n_lines AND 100 * n_top <= 30 * n_words AS kept
FROM b
"""
