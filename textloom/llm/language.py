"""Language identification by Bayesian fusion of evidence.

The text gives log likelihoods per language from hashed byte trigrams, fitted on
a bounded sample of labelled texts. The page's declared markup language and its
address suffix are two more observations; how far each can be believed is counted
over all pages, against their texts' verdicts. The prior comes from the host:
counts of all its pages, smoothed towards its domain, that towards all pages. All
counts are grouped sums, and a page's own verdict is taken out of each that it is
judged by, so that its text counts once.

Defined cases: a page without trigrams has no text evidence, a null text_lang, and
is left out of all counts; a missing or unknown declaration counts as its own
value; a null url has the empty host and suffix; pages with no evidence at all get
the most common language; repeated rows are judged one by one; a very long page is
one step of its own; an empty table gives an empty result; ties go to the language
that sorts first; an input column with the name of an added one is replaced, other
columns are carried whatever their names; without labelled texts languages,
probabilities and priors are null or empty. The model knows all labels of its sample
(SLOTS numbers each).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import blocks
from textloom.llm.url_rules import host_of

#: Labelled texts, about, that the trigram model is fitted on.
SAMPLE_ROWS = 20_000
#: Slots that trigrams are hashed to.
SLOTS = 1 << 16
#: Weight of a level's parent in the host prior, as pages.
PARENT = 5.0
#: Trigrams of one text overlap; their evidence counts as this share.
TEMPER = 0.2

_DROP = re.compile(rb"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_ENTITY = re.compile(rb"&#?\w{1,10};")


def plain(html: pa.Array) -> pa.Array:
    """Text of pages: no comments, scripts, styles, tags or entities."""
    return pa.array([None if h is None else _ENTITY.sub(b" ", _DROP.sub(b" ", h.encode())) for h in html.to_pylist()], pa.binary())


def _slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the letters (blanks elsewhere, at most one between words),
    and offsets by text."""
    w = blocks.words(texts, _LETTERS, lower=True)
    sizes = w.stops - w.starts
    starts = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int((sizes + 1).sum()), 0x20, np.uint32)
    joined[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = w.data[w.inside]
    code = np.zeros(max(0, len(joined) - 2), np.uint32)
    if len(joined) > 2:
        code = (joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
    ends = np.append(starts, len(joined))[w.ends]
    return code.astype(np.int64), np.minimum(ends, len(code))


_LETTERS = blocks._table([*range(0x61, 0x7B), *range(0x80, 0x100)])


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log probability by slot and language, of about sample_rows
    labelled texts."""
    blocks.small_batches(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.steps(batch):
                slots, ends = _slots(part.column("text"))
                labels, names = blocks.coded(part.column("label").cast(pa.large_string()))
                keys, n = np.unique(np.repeat(labels, np.diff(ends)) * SLOTS + slots, return_counts=True)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(keys // SLOTS)).cast(pa.string()), pa.array(keys % SLOTS), pa.array(n.astype(np.int64))], ["lang", "slot", "n"])

    label_, text_ = blocks.quoted(label), blocks.quoted(text)
    chosen = blocks.about(labelled.where(label_.isNotNull() & text_.isNotNull()), sample_rows).select(text_.alias("text"), label_.cast("string").alias("label"))
    chosen = blocks.cut(chosen)
    sums = chosen.mapInArrow(blocks.frugal(count), "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(sums.column("lang").to_pylist()))
    n = np.full((SLOTS, len(names)), 0.5)
    if names:
        n[sums.column("slot").to_numpy(), np.searchsorted(names, sums.column("lang").to_pylist())] += sums.column("n").to_numpy()
    return names, np.log(n / n.sum(0)) if names else n


def text_evidence(pages: DataFrame, names: list[str], logs: np.ndarray, html: str = "html") -> DataFrame:
    """All columns but the html, with declared (markup language, lower case) and
    evidence (tempered log likelihoods of the text; null without a trigram)."""
    blocks.small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(logs.astype(np.float32))
    rest = [f for f in pages.schema.fields if f.name not in (html, "declared", "evidence")]
    schema = T.StructType(rest + T.StructType.fromDDL("declared string, evidence array<double>").fields)
    lang = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.I)
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in blocks.steps(batch, html):
                slots, ends = _slots(plain(part.column(html)))
                sums = np.zeros((len(slots) + 1, k))
                np.cumsum(table[slots], axis=0, dtype=np.float64, out=sums[1:])
                found = (sums[ends[1:]] - sums[ends[:-1]]) * TEMPER
                heads = [lang.search(h) if h else None for h in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in rest]
                    + [pa.array([m and m[1].lower() for m in heads], pa.string()),
                       pa.array([x if n else None for x, n in zip(found.tolist(), np.diff(ends).tolist())], pa.list_(pa.float64()))],
                    schema.names,
                )

    return pages.select(*(f.name for f in rest), html).mapInArrow(blocks.frugal(run), schema)


def _argmax(scores: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(scores, F.array_max(scores)).cast("int"))


def _counts(names: list[str]) -> list[Column]:
    """Pages of each verdict; those without one count for none."""
    return [F.count(F.when(F.col("verdict") == x, 1)).cast("double").alias(f"n{i}") for i, x in enumerate(names)]


def identify(pages: DataFrame, names: list[str], logs: np.ndarray, url: str = "url", html: str = "html", parent: float = PARENT) -> DataFrame:
    """All columns but the html, with lang, probability, text_lang, declared,
    suffix and host_prior (probabilities by language, in the order of names)."""
    rest = blocks.others(pages, html, ("lang", "probability", "text_lang", "declared", "suffix", "host_prior"))
    pages, carried = blocks.renamed(pages, rest, html)
    at = carried[[f.name for f in rest].index(url)].name
    labels = F.split("host", r"\.")
    seen = (
        text_evidence(pages, names, logs, "text__")
        .withColumn("host", host_of(F.col(at)))
        .withColumn("suffix", F.element_at(labels, -1))
        .withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
        .withColumn("declared", F.coalesce("declared", F.lit("")))
    )
    if not names:  # nothing is known of any language
        none = {"lang": "string", "probability": "double", "text_lang": "string"}
        return seen.select(*blocks.restored(rest, carried), *(F.lit(None).cast(t).alias(c) for c, t in none.items()), "declared", "suffix", F.array().cast("array<double>").alias("host_prior"))
    seen = blocks.cut(seen.withColumn("verdict", F.when(F.col("evidence").isNotNull(), _argmax(F.col("evidence"), names))))
    # counts by host and domain, by declared language and by suffix: a row each
    k = range(len(names))
    level = blocks.cut(seen.groupBy("domain", "host", "declared", "suffix").agg(*_counts(names)))

    def sums(*keys: str, name: str) -> DataFrame:
        return level.groupBy(*keys).agg(F.array(*(F.sum(f"n{i}") for i in k)).alias(name))

    whole = level.agg(F.array(*(F.sum(f"n{i}") for i in k)).alias("c"), F.countDistinct("declared").alias("declared"), F.countDistinct("suffix").alias("suffix")).first()
    counts = [x or 0.0 for x in whole["c"]]
    by_host = sums("domain", "host", name="of_host").join(sums("domain", name="of_domain"), "domain").drop("domain")
    judged = seen.join(by_host, "host").join(sums("declared", name="of_declared"), "declared").join(sums("suffix", name="of_suffix"), "suffix")
    # a page's own vote is left out of all that it is judged by
    judged = judged.withColumn("own", F.array(*(F.when(F.col("verdict") == x, 1.0).otherwise(0.0) for x in names)))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    judged = judged.withColumn("others", F.zip_with(F.array(*map(F.lit, counts)), "own", lambda x, o: x - o))
    judged = judged.withColumns({c: F.zip_with(c, "own", lambda x, o: x - o) for c in ("of_host", "of_domain", "of_declared", "of_suffix")})

    def smooth(c: str, above: str) -> Column:
        """(counts + parent * the share above) / (pages + parent)"""
        return F.zip_with(F.col(c), F.col(above), lambda x, p: (x + parent * p) / (add(F.col(c)) + parent))

    judged = judged.withColumn("overall", F.transform("others", lambda x: (x + 1.0) / (add(F.col("others")) + len(names))))
    judged = judged.withColumn("of_domain", smooth("of_domain", "overall")).withColumn("host_prior", smooth("of_host", "of_domain"))

    def likely(column: str) -> Column:
        """Log probability of the page's value in each language, add-one."""
        return F.zip_with(F.col(f"of_{column}"), F.col("others"), lambda x, n: F.log((x + 1) / (n + whole[column] + 1.0)))

    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    text = F.coalesce("evidence", F.array(*(F.lit(0.0) for _ in k)))
    logp = plus(plus(text, likely("declared")), plus(likely("suffix"), F.transform("host_prior", lambda p: F.log(p))))
    judged = judged.withColumn("logp", logp)
    weights = F.transform("logp", lambda x: F.exp(x - F.array_max("logp")))
    return judged.select(
        *blocks.restored(rest, carried), _argmax(F.col("logp"), names).alias("lang"),
        (F.lit(1.0) / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)).alias("probability"),
        F.col("verdict").alias("text_lang"), "declared", "suffix", "host_prior",
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, logs = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return identify(pages, names, logs).drop("url")
