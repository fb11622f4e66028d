"""Product codes of vectors: Lloyd's rounds in integers, with Hamerly's bounds.

A vector's components become integers and are cut into equal parts; each part
position has a codebook of its own. A part keeps, next to its entry, one upper
bound of the distance to it and one lower bound of the distance to the second
nearest; both live in a stored table, and a round reads the table of the round
before. Bounds move with the entries. A part whose upper bound is strictly below
its lower bound (or below half the way from its entry to the entry nearest to
that) has a strictly nearest entry and is passed over. Otherwise the upper bound
is made exact, and if the test fails again all entries are compared, in integers,
where the lower index wins a tie. Bounds are rounded outward, so that no rounding
decides.

Vectors never move between tasks: a round is a pass that assigns and one that
sums each task's parts by entry. Sums of at most parts * entries rows reach the
driver, and codebooks of that size are broadcast.

Defined cases: rows whose vector is null, or holds a null, NaN or infinite
component, are dropped, and so are vectors without components or of another
length than the first kept one (least key; its length must be a multiple of the
parts, vectors of other lengths are not "kept"); components beyond what distances
in 64 bits allow (2 ** 28 after scaling at 16 components a part) are clamped to
that; of repeated keys the lesser vector comes first, null keys come last; with
fewer kept rows than entries the codebooks have fewer; equal labels are summed
together, nulls with nulls; a sum of errors beyond 64 bits is null; an empty
table gives an empty result; all columns but the vector are carried, and one with
the name of an added column is replaced by it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import blocks

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
ADDED = ("code", "error", "label_error", "codebooks_sha256")
#: A label with more than this share of the rows is looked up, others are joined.
HEAVY = 1024
#: Outward rounding of a bound: more than the errors of its few operations.
UP, DOWN = 1 + 2.0**-48, 1 - 2.0**-48


def most_of(width: int) -> int:
    """The greatest magnitude at which squared distances of `width` components fit
    64 bits."""
    most = 1 << 30
    while width * (2 * most) ** 2 >= 1 << 63:
        most >>= 1
    return most


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer entries. Small numbers are
    multiplied as doubles, which hold them exactly."""
    biggest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * biggest * biggest < 1 << 53:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None].astype(np.int64) - c[None, :, i]) ** 2
    return out


def own_distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - c
    return (d * d).sum(1)


@dataclass
class Step:
    """What a pass needs of one part position: its entries, how far each has moved,
    how far the others of each have moved at most, and half the way to the nearest
    other entry."""

    entries: np.ndarray
    moved: np.ndarray
    others_moved: np.ndarray
    half: np.ndarray

    @classmethod
    def after(cls, before: np.ndarray | None, entries: np.ndarray) -> Step:
        k = len(entries)
        moved = np.zeros(k) if before is None else np.sqrt(own_distance(entries, before).astype(np.float64)) * UP
        others = np.full(k, moved.max(initial=0))
        if k > 1:
            first = int(moved.argmax())
            others[first] = np.delete(moved, first).max()
        apart = distances(entries, entries)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        half = np.sqrt(apart.min(1).astype(np.float64)) / 2 * DOWN if k > 1 else np.full(k, np.inf)
        return cls(entries, moved, others, half)


def assign(x: np.ndarray, step: Step, entry: np.ndarray | None, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper, lower, rows compared with all entries) of the rows x. Without
    entries of a round before, all rows are."""
    n = len(x)
    if entry is None:
        entry, upper, lower, scan = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.arange(n)
    else:
        upper = (upper + step.moved[entry]) * UP
        # a lower bound below zero would round inward
        lower = np.maximum((lower - step.others_moved[entry]) - np.abs(lower) * (UP - 1), 0.0)
        least = np.maximum(lower, step.half[entry])
        loose = np.flatnonzero(~(upper < least))
        upper[loose] = np.sqrt(own_distance(x[loose], step.entries[entry[loose]]).astype(np.float64)) * UP
        scan = loose[~(upper[loose] < least[loose])]
    if len(scan):
        d = distances(x[scan], step.entries)
        entry, rows = entry.copy(), np.arange(len(scan))
        best = d.argmin(1)  # the first of equal ones
        upper[scan] = np.sqrt(d[rows, best].astype(np.float64)) * UP
        d[rows, best] = np.iinfo(np.int64).max
        lower[scan] = np.sqrt(d.min(1).astype(np.float64)) * DOWN if len(step.entries) > 1 else np.inf
        entry[scan] = best
    return entry, upper, lower, len(scan)


def integers(vectors: pa.Array, scale: int, most: int) -> np.ndarray:
    """(rows, components): floor(scale * x), clamped."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * scale), -most, most).astype(np.int32).reshape(len(vectors), -1)


def _blob(values: np.ndarray) -> pa.Array:
    width = values.shape[1] * values.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _unblob(column: pa.Array, kind: np.dtype) -> np.ndarray:
    data, _ = blocks.raw(column)
    return np.frombuffer(data.tobytes(), kind).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _assigned(state: DataFrame, steps: list[Step], carried: list[T.StructField], first: bool, scale: int, most: int) -> DataFrame:
    """The state (carried, v, entry, bounds) under new codebooks. The first pass
    reads vectors (column vector__) instead."""
    shared = state.sparkSession.sparkContext.broadcast(steps)
    schema = T.StructType(carried + T.StructType.fromDDL("v__ binary, entry__ binary, bounds__ binary").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            if first:
                v = integers(batch.column("vector__"), scale, most)
                old, bounds = None, np.zeros((len(v), 2 * len(now)))
            else:
                v = _unblob(batch.column("v__"), np.dtype("<i4"))
                old = _unblob(batch.column("entry__"), np.dtype("<i4")).astype(np.int64)
                bounds = _unblob(batch.column("bounds__"), np.dtype("<f8"))
            width = v.shape[1] // len(now)
            entries, made = np.zeros((len(v), len(now)), np.int32), np.zeros((len(v), 2 * len(now)))
            for p, step in enumerate(now):
                x = v[:, p * width : (p + 1) * width]
                entries[:, p], made[:, 2 * p], made[:, 2 * p + 1], _ = assign(x, step, None if old is None else old[:, p], bounds[:, 2 * p].copy(), bounds[:, 2 * p + 1].copy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c.name) for c in carried), _blob(v), _blob(entries), _blob(made)], schema.names)

    return state.mapInArrow(blocks.frugal(run), schema)


def _moved(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after an update; at most a row for each entry reaches the driver."""
    parts, (k, width) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * k, np.int64), np.zeros((parts * k, width), np.int64)
        for batch in batches:
            v = _unblob(batch.column("v__"), np.dtype("<i4")) if batch.num_rows else np.zeros((0, parts * width), np.int32)
            e = _unblob(batch.column("entry__"), np.dtype("<i4")) if batch.num_rows else np.zeros((0, parts), np.int32)
            for p in range(parts):
                np.add.at(n, e[:, p] + p * k, 1)
                np.add.at(sums, e[:, p] + p * k, v[:, p * width : (p + 1) * width].astype(np.int64))
        have = np.flatnonzero(n)
        if len(have):
            lists = pa.FixedSizeListArray.from_arrays(pa.array(sums[have].ravel()), width).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(n[have]), lists], ["slot", "n", "sums"])

    parted = state.select("v__", "entry__").mapInArrow(blocks.frugal(run), "slot long, n long, sums array<long>")
    total = parted.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums")).collect()
    out = [b.copy() for b in books]
    for r in total:
        out[r["slot"] // k][r["slot"] % k] = np.array(r["sums"], np.int64) // r["n"]
    return out


def _coded(state: DataFrame, books: list[np.ndarray], carried: list[T.StructField]) -> DataFrame:
    """The carried columns with code and error."""
    shared = state.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType(carried + T.StructType.fromDDL("code string, error long").fields)
    digits = max(2, len(f"{len(books[0]) - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        names = np.array([f"{i:0{digits}x}" for i in range(len(now[0]))])
        for batch in batches:
            if not batch.num_rows:
                continue
            v, e = _unblob(batch.column("v__"), np.dtype("<i4")), _unblob(batch.column("entry__"), np.dtype("<i4"))
            width = v.shape[1] // len(now)
            error, code = np.zeros(len(v), np.int64), np.full(len(v), "", f"<U{digits * len(now)}")
            for p, book in enumerate(now):
                error += own_distance(v[:, p * width : (p + 1) * width], book[e[:, p]])
                code = np.char.add(code, names[e[:, p]])
            yield pa.RecordBatch.from_arrays([*(batch.column(c.name) for c in carried), pa.array(code.tolist(), pa.string()), pa.array(error)], schema.names)

    return state.mapInArrow(blocks.frugal(run), schema)


def _label_errors(rows: DataFrame, label: str, n: int) -> DataFrame:
    """rows with label_error. Labels of many rows, of which there are at most HEAVY,
    are broadcast; no label that is joined by a shuffle has more than n / HEAVY rows."""
    sums = blocks.cut(rows.groupBy(F.col(label).alias("label__")).agg(F.count("*").alias("n__"), F.try_sum("error").alias("sum__")))
    heavy = sums.where(F.col("n__") * HEAVY > n).select("label__", "sum__", F.lit(True).alias("heavy__"))
    light = sums.where(F.col("n__") * HEAVY <= n).select("label__", "sum__")
    marked = rows.join(F.broadcast(heavy), F.col(label).eqNullSafe(F.col("label__")), "left").drop("label__")
    if light.isEmpty():
        return marked.withColumnRenamed("sum__", "label_error").drop("heavy__")
    rest = marked.where("heavy__ IS NULL").drop("sum__").join(light, F.col(label).eqNullSafe(F.col("label__"))).drop("label__")
    both = marked.where("heavy__").unionByName(rest)
    return both.withColumnRenamed("sum__", "label_error").drop("heavy__")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """All columns of the kept rows but the vector, with code (an entry's index for
    each part, in hexadecimal), error (squared distances to the entries), label_error
    (errors summed over equal labels; null without a label column) and a digest of
    the final codebooks."""
    if parts < 1 or entries < 1 or rounds < 0 or scale < 1:
        raise ValueError("parts, entries and scale must be positive, rounds not negative")
    spark = vectors.sparkSession
    blocks.small_batches(spark)
    fields = blocks.others(vectors, vector, ADDED)
    names = [f.name for f in fields]
    if key not in names or label is not None and label not in names:
        raise ValueError("the key and the label must be columns besides the vector and added columns")
    rows, carried = blocks.renamed(vectors, fields, vector)
    own = {f.name: c.name for f, c in zip(fields, carried)}
    kind = vectors.schema[vector].dataType.elementType
    values = F.col("text__") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col("text__").cast("array<double>")
    rows = rows.withColumn("vector__", values).drop("text__").where(usable(F.col("vector__")))
    rows = rows.where((F.size("vector__") > 0) & (F.size("vector__") % parts == 0))
    order = [F.asc_nulls_last(own[key]), F.asc("vector__")]
    first = rows.orderBy(*order).select(F.size("vector__").alias("n")).limit(1).collect()
    if not first:
        empty = rows.where("false").select(*blocks.restored(fields, carried))
        return empty.select("*", *(F.lit(None).cast(t).alias(a) for a, t in zip(ADDED, ("string", "long", "long", "string"))))
    size = first[0]["n"]
    rows = rows.where(F.size("vector__") == size)
    most, width = most_of(size // parts), size // parts
    seeds = rows.orderBy(*order).limit(entries).select("vector__").toArrow().column(0).combine_chunks()
    start = integers(seeds, scale, most).astype(np.int64)
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    folder = f"{blocks.shared_folder(spark)}/codes-{uuid.uuid4().hex}"
    blocks.remove_at_exit(spark, folder)
    before: list[np.ndarray | None] = [None] * parts
    for r in range(rounds + 1):
        steps = [Step.after(b, c) for b, c in zip(before, books)]
        state = _assigned(rows, steps, carried, r == 0, scale, most)
        state.write.parquet(f"{folder}/{r}")
        rows = spark.read.schema(state.schema).parquet(f"{folder}/{r}")
        if r:  # this round's table is whole: nothing reads the one before any more
            blocks.removed(spark, f"{folder}/{r - 1}")
        if r < rounds:
            before, books = books, _moved(rows, books)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    coded = blocks.stored(_coded(rows, books, carried))
    out = coded.withColumn("label_error", F.lit(None).cast("long")) if label is None else _label_errors(coded, own[label], coded.count())
    return out.select(*blocks.restored(fields, carried), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return compress(vectors).select("vec_id", *ADDED)


def _round(r: int) -> str:
    """One assignment and update of the SQL: a{r} from c{r}, then c{r + 1}."""
    return f"""a{r} AS (
  SELECT vec_id, part, any_value(x) AS x, min({{'d': xx - 2 * list_inner_product(x, y) + yy, 'e': e}}) AS m
  FROM p JOIN (SELECT *, list_inner_product(y, y) AS yy FROM c{r}) USING (part) GROUP BY vec_id, part
), u{r} AS (
  SELECT part, e, list(y ORDER BY i) AS y FROM (
    SELECT part, m.e AS e, i, floor(sum(x[i]) / count(*)) AS y FROM a{r}, (SELECT unnest(range(1, len(x) + 1)) AS i FROM p LIMIT (SELECT len(x) FROM p LIMIT 1)) GROUP BY ALL)
  GROUP BY part, e
), c{r + 1} AS (
  SELECT part, e, coalesce(u{r}.y, c{r}.y) AS y FROM c{r} LEFT JOIN u{r} USING (part, e)
)"""


SQL = rf"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT *, list_inner_product(x, x) AS xx FROM (SELECT vec_id, part, v[len(v) // 4 * part + 1 : len(v) // 4 * (part + 1)] AS x FROM v, range(4) t(part))
), c0 AS (
  SELECT part, e, x AS y FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p) WHERE e < 256
), {", ".join(_round(r) for r in range(ROUNDS + 1))}, r AS (
  SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id
), s AS (
  SELECT sha256(string_agg(array_to_string(list_transform(y, lambda x: x::BIGINT), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN r USING (vec_id), s
"""
