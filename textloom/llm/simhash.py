"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that agree on some block of bits meet in a bucket, where they are
compared bit plane by bit plane (see bits.py). near_dedup decides by the exact
similarity of word shingles; there fingerprints tell which texts to compare (see
jaccard.py).

Defined cases: null and empty texts have fingerprint zero and link like any
other; repeated rows come back as often; an empty table gives an empty result;
rows without an id take part, and a component's id is its least id that is not
null (null if it has none); a very long text is one step of its own; of an input's
columns only the key is carried (near_dedup carries all).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import bits, blocks, jaccard
from textloom.llm.components import components


def fingerprints(texts: pa.Array, shingle: int, lanes: int = 1) -> np.ndarray:
    """A (rows, lanes) array of uint64: a bit is 1 if set in over half of the
    hashes of the text's shingles. Lane 0 has XXH64 with seed 42; further lanes
    have finishers of it."""
    w = blocks.words(texts, lower=True)
    sizes = w.stops - w.starts
    starts = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    joined[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = w.data[w.inside]
    text = joined.tobytes()
    per = np.where(w.counts > 0, np.maximum(w.counts - shingle + 1, 1), 0)
    ends = np.concatenate([[0], np.cumsum(per)])
    at = np.repeat(w.ends[:-1] - ends[:-1], per) + np.arange(ends[-1])
    last = np.minimum(at + shingle, np.repeat(w.ends[1:], per)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(
        (digest(text[a:b], 42) for a, b in zip(starts[at].tolist(), (starts[last] + sizes[last]).tolist())),
        np.uint64, len(at),
    )
    return bits.majority(h, per, lanes)


def exact_tables(width: int, radius: int, n: int) -> list[np.ndarray]:
    """Sets of bits such that any two fingerprints within the radius agree on all
    bits of one set: of radius + m blocks, some m are untouched. m grows with
    the rows, so that a set's values outnumber a sixteenth of them."""
    m = 2
    while m < 4 and (width * m / (radius + m)) < math.log2(max(2, n / 16)):
        m += 1
    parts = np.array_split(np.arange(width), radius + m)
    return [np.concatenate(c) for c in itertools.combinations(parts, m)]


def links(nodes: DataFrame, lanes: int, radius: int, tables: list[np.ndarray]) -> DataFrame:
    """(a, b) that connect the nodes (node long, fp binary) that meet in a table and
    lie within the radius."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                data, _ = blocks.raw(part.column(1))
                set_ = np.unpackbits(data.reshape(part.num_rows, -1), axis=1, bitorder="little")
                for t, chosen in enumerate(tables):
                    key = np.zeros((part.num_rows, 64), np.uint8)
                    key[:, : len(chosen)] = set_[:, chosen]
                    key = np.packbits(key, axis=1, bitorder="little").view(np.uint64).ravel()
                    key = blocks.mix(key) & np.uint64((1 << 48) - 1) | np.uint64(t << 48)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0), part.column(1)], ["bucket", "node", "fp"])

    dealt = nodes.mapInArrow(blocks.frugal(deal), "bucket long, node long, fp binary")
    return bits.meet(dealt, lanes, radius)


def _fingerprinted(docs: DataFrame, columns: tuple[str, ...], text: str, shingle: int, lanes: int) -> DataFrame:
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in columns] + [T.StructField("fp", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.steps(batch, text):
                fps = fingerprints(part.column(text), shingle, lanes)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * lanes), len(fps), [None, pa.py_buffer(fps.astype(">u8"))])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), raw.cast(pa.binary())], schema.names)

    return docs.select(*columns, text).mapInArrow(blocks.frugal(run), schema)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, lanes: int = 1, radius: int = 4) -> DataFrame:
    """(key, fp, component_id) of every row. Fingerprints of 64 * lanes bits link at
    `radius` differing bits or fewer, and all links are found (block pigeonhole);
    component_id is the least key reachable."""
    blocks.small_batches(docs.sparkSession)
    fps = blocks.cut(_fingerprinted(docs, (key,), text, shingle, lanes))
    # a fingerprint is a node; its id is the fingerprint where that has 64 bits
    node = F.conv(F.hex("fp"), 16, -10).cast("long") if lanes == 1 else F.xxhash64("fp")
    nodes = blocks.cut(fps.groupBy("fp").agg(F.min(key).alias("least")).withColumn("node", node))
    n = nodes.count()
    tables = exact_tables(64 * lanes, radius, n)
    roots = components(links(nodes.select("node", "fp"), lanes, radius, tables))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # materialised, so that the join shuffles both sides and a hot root can be split
    least = blocks.cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one of each group of near-duplicates left, the one with
    the least key. Similarity is the Jaccard of the texts' word shingles, and all
    pairs that have it are linked. Different texts with the same least key, or
    without any, all stay."""
    blocks.small_batches(docs.sparkSession)
    docs, back, names = blocks.apart(docs, text)
    text, key = "text__", names[key]
    return back(_near_dedup(docs, key, text, shingle, similarity))


def _near_dedup(docs: DataFrame, key: str, text: str, shingle: int, similarity: float) -> DataFrame:
    marked = docs.withColumn("mark__", F.xxhash64(text))
    texts = marked.select(F.col("mark__").alias("node"), F.col(text).alias("text"))
    roots = components(jaccard.links(texts, Fraction(str(similarity)), shingle))
    ids = blocks.cut(marked.select(key, F.col("mark__").alias("node")))
    nodes = blocks.cut(ids.groupBy("node").agg(F.min(key).alias("least")))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = blocks.cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    found = ids.join(rooted.join(least, "root").select("node", "component_id"), "node").withColumnRenamed("node", "mark__")
    keep = found.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy(key, "mark__").agg(F.count("*").alias("n__"))
    keep = blocks.cut(keep.withColumnRenamed(key, "key__").withColumnRenamed("mark__", "kept__"))
    rows = marked.join(keep, marked[key].eqNullSafe(F.col("key__")) & (F.col("mark__") == F.col("kept__")))
    rows = rows.drop("key__", "kept__", "mark__")
    if keep.where("n__ > 1").isEmpty():
        return rows.drop("n__")
    # rows that share a key: one of each text stays
    once = rows.where("n__ = 1").drop("n__")
    return once.unionByName(rows.where("n__ > 1").drop("n__").dropDuplicates([key, text]))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
