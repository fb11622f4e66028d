"""Personal data by candidate spans and boosted trees, in DataFrame functions only.

Generators with high recall propose spans of a kind: the base patterns, and looser
forms of each, which overlap with them and with each other. A candidate's format
(digits, groups, how it begins) and context (the characters around it, a cue word
before it) are small numbers that make up one cell of a bounded grid. The corpus's
candidates are counted by cell, once those that the base confirms and once all;
boosted trees are fitted to these counts, which cover every text and are at most
as many as the grid has cells. The trees do not see what confirms the base (check
digits, ranges of numbers), so that they tell how likely a span is personal from
how it looks and where it stands. On a part of the texts that the trees have not
seen, margins are calibrated by isotonic regression, and each kind gets the least
margin at which a candidate is as often confirmed as PRECISION asks. Spans beyond
it are added to the base's, best first, where they overlap none.

The trees are plain expressions; no text leaves the JVM. Matching never backtracks:
patterns are possessive and begin where a run of their characters does.

Defined cases: null and empty texts have no spans; very long texts are scanned
whole, positions come from sums in two levels; repeated rows are judged one by one;
spans with equal margins are taken from the left; with too few candidates to
calibrate nothing is added; an empty table gives an empty result; all columns but
the text are carried, and one with the name of an added column is replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import blocks

KINDS = ("email", "ip", "card", "phone")
COUNTS = tuple(f"n_{k}" for k in KINDS)
ADDED = (*COUNTS, "base_sha256", "spans")
#: Share of a margin's candidates that must be confirmed ones.
PRECISION = 0.95
TREES, DEPTH, RATE, L2 = 20, 2, 0.3, 1.0
#: One text of so many calibrates, the others fit.
FOLDS = 4

#: What the base's patterns match, written so that no try backtracks.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
}
#: Looser forms: any text around an @; dotted numbers of four or more parts; a dozen
#: digits or more, also those that other numbers follow; telephone numbers without
#: their plus, and those in brackets and hyphens that other numbers follow.
LOOSE = {
    "email": (r"""(?:\G|(?<![^\s@<>"'(),;:\[\]]))[^\s@<>"'(),;:\[\]]++@[^\s@<>"'(),;:\[\]]++""",),
    "ip": (r"[0-9](?<![0-9.][0-9])[0-9]*+(?:\.[0-9]++){3,}+",),
    "card": (r"[0-9](?<![0-9][0-9])(?<![0-9][\x20.-][0-9])(?:[\x20.-]?[0-9]){11,}+", r"[0-9](?<![0-9][0-9])[0-9]{11,18}+(?![0-9])"),
    "phone": (
        r"\(?[0-9](?<![0-9][0-9])(?<![0-9][\x20().-][0-9])(?:[\x20().-]{0,2}[0-9]){6,}+",
        r"\+[0-9]{1,3}+\x20?\([0-9]{1,4}+\)\x20?[0-9]{2,4}+(?:-[0-9]{2,4}+){1,3}+",
    ),
}
#: What a text must have for a kind to be looked for at all.
NEEDS = {"email": "@", "phone": "+"}
PERSONAL = ("tel", "phone", "mobile", "call", "fax", "mail", "email", "contact", "card", "visa", "account", "ip", "address", "from", "host")
TECHNICAL = ("version", "v", "token", "id", "key", "hash", "page", "chapter", "section", "no", "isbn", "price", "usd", "eur", "total")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def prefixes(sizes: Column) -> Column:
    """For each number of an array the sum of those before it; in runs of the root of
    the array's size, so that long arrays don't take squares."""
    def runs(s: Column) -> Column:
        wide = F.greatest(F.ceil(F.sqrt(F.size(s))).cast("int"), F.lit(1))
        begins = F.sequence(F.lit(0), F.size(s) - 1, wide)
        sums = F.transform(begins, lambda b: total(F.slice(s, b + 1, wide)))
        return let(sums, lambda t: F.transform(s, lambda _, i: total(F.slice(t, F.lit(1), F.floor(i / wide).cast("int"))) + total(F.slice(s, i - i % wide + 1, i % wide))))

    return F.when(F.size(sizes) > 0, let(sizes, runs)).otherwise(F.array().cast("array<int>"))


def found(text: Column, pattern: str) -> Column:
    """(start, stop, m, before, after) of the pattern's matches: code points, the
    match, up to 24 characters before it and one behind, not across other matches."""
    def located(m: Column) -> Column:
        def placed(gaps: Column) -> Column:
            sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.length(g) + F.length(x))
            return F.transform(
                F.arrays_zip(prefixes(sizes).alias("p"), F.slice(gaps, F.lit(1), F.size(m)).alias("g"), m.alias("m"), F.slice(gaps, F.lit(2), F.size(m)).alias("n")),
                lambda z: let(z["p"] + F.length(z["g"]), lambda at: F.struct(
                    at.alias("start"), (at + F.length(z["m"])).alias("stop"), z["m"].alias("m"),
                    F.substring(z["g"], -24, 24).alias("before"), F.substring(z["n"], 1, 1).alias("after"),
                )),
            )

        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a number's check digit is right."""
    def one(i: Column) -> Column:
        d = F.ascii(F.substring(digits, -i, F.lit(1))) - 48
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return total(F.transform(F.sequence(F.lit(1), F.length(digits)), one)) % 10 == 0


def small(part: Column) -> Column:
    """Whether a decimal number is at most 255."""
    return let(F.regexp_replace(part, "^0+", ""), lambda z: F.when(F.length(z) <= 3, F.concat(F.lit("0"), z).cast("int") <= 255).otherwise(False))


def confirmed(kind: str, m: Column) -> Column:
    """Whether the base keeps a match of its pattern."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        return let(digits_of(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits_of(m)).between(8, 15)
    return F.lit(True)


def proposed(kind: str, m: Column) -> Column:
    """Whether a match is worth a candidate; all that the base confirms are."""
    if kind == "card":
        return F.length(digits_of(m)).between(12, 19)
    if kind == "phone":
        return F.length(digits_of(m)).between(7, 15)
    return F.lit(True)


def _bins(value: Column, ups: Sequence[int]) -> Column:
    """The first bin whose upper end the value doesn't pass."""
    out = F.lit(len(ups))
    for i in reversed(range(len(ups))):
        out = F.when(value <= ups[i], i).otherwise(out)
    return out


def _beside(c: Column) -> Column:
    """What a neighbouring character is: none or a blank, letter, digit, another."""
    return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike(r"^[\p{L}_]$"), 1).when(c.rlike("^[0-9]$"), 2).otherwise(3)


#: The grid: a candidate's features and how many values each has.
GRID = (("kind", 4), ("digits", 9), ("groups", 5), ("longest", 4), ("lead", 4), ("before", 4), ("after", 4), ("cue", 3))
CELLS = math.prod(n for _, n in GRID)


def cell_of(kind: str, c: Column) -> Column:
    """The grid's cell of a candidate."""
    m = c["m"]
    word = F.lower(F.regexp_extract(c["before"], r"(?:^|[^A-Za-z])([A-Za-z]++)[^A-Za-z]*+$", 1))
    runs = F.filter(F.split(m, "[^0-9]+"), lambda x: x != "")
    features = (
        F.lit(KINDS.index(kind)),
        _bins(F.length(digits_of(m)), (0, 6, 9, 11, 14, 15, 16, 19)),
        _bins(F.size(runs), (1, 2, 3, 4)),
        _bins(F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)), (3, 4, 11)),
        F.when(m.startswith("+"), 0).when(m.startswith("("), 1).when(m.rlike("^[0-9]"), 2).otherwise(3),
        _beside(F.substring(c["before"], -1, 1)),
        _beside(c["after"]),
        F.when(word.isin(*PERSONAL), 1).when(word.isin(*TECHNICAL), 2).otherwise(0),
    )
    out = F.lit(0)
    for value, (_, n) in zip(features, GRID):
        out = out * n + value
    return out.cast("int")


def feature(cell, i: int):
    """A feature's value, of a cell's number (a column or an array)."""
    below = math.prod(n for _, n in GRID[i + 1 :])
    n = GRID[i][1]
    return F.floor(cell / below).cast("int") % n if isinstance(cell, Column) else cell // below % n


def _candidates(text: Column, kind: str, pattern: str, strict: bool) -> Column:
    """Candidates of a kind by its base pattern (strict) or a looser one; null where a
    text can have none."""
    need = NEEDS.get(kind) if strict or kind == "email" else None
    there = F.contains(text, F.lit(need)) if need else text.rlike("[0-9]")

    def made(c: Column) -> Column:
        base = confirmed(kind, c["m"]) if strict else F.lit(False)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), base.alias("base"), cell_of(kind, c).alias("cell"))

    # what the base confirms is worth a candidate too
    return F.when(there, F.transform(F.filter(found(text, pattern), lambda c: proposed(kind, c["m"])), made))


def _of_kind(spans: str, i: int) -> Column:
    return F.filter(spans, lambda c: c["kind"] == i)


def candidates(text: Column) -> Column:
    """(kind, start, stop, base, cell) of all candidates of a text, in that order; one
    of each kind and place, told by the base's pattern if that gives it too."""
    none = F.array().cast("array<struct<kind:int,start:int,stop:int,base:boolean,cell:int>>")
    patterns = [(kind, p, p is BASE[kind]) for kind in KINDS for p in (BASE[kind], *LOOSE[kind])]
    parts = [_candidates(text, *p) for p in patterns]
    every = F.concat(*(F.coalesce(p, none) for p in parts))

    def once(a: Column) -> Column:
        """Sorted by kind and place; the first of equal ones, which the base's comes as."""
        ordered = F.array_sort(F.transform(a, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), (~c["base"]).alias("extra"), c["cell"].alias("cell"))))
        return let(ordered, lambda o: F.transform(
            F.filter(o, lambda c, i: (i == 0) | F.coalesce(let(F.get(o, i - 1), lambda p: (p["kind"] != c["kind"]) | (p["start"] != c["start"]) | (p["stop"] != c["stop"])), F.lit(True))),
            lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), (~c["extra"]).alias("base"), c["cell"].alias("cell")),
        ))

    return let(every, lambda a: F.when(F.size(a) > 0, once(a)).otherwise(none))


@dataclass(frozen=True)
class Model:
    """Trees (feature, greatest value of the left side, left, right; leaves are
    numbers), what a margin starts from, and each kind's threshold."""

    start: float
    trees: tuple
    thresholds: tuple[float, ...]

    def margins(self, cells: np.ndarray) -> np.ndarray:
        out = np.full(len(cells), self.start)
        for tree in self.trees:
            out += _leaves(tree, cells)
        return out

    def margin(self, cell: Column) -> Column:
        out = F.lit(self.start)
        for tree in self.trees:
            out = out + _case(tree, cell)
        return out

    def selects(self, c: Column) -> Column:
        limit = F.lit(math.inf)
        for i, t in enumerate(self.thresholds):
            limit = F.when(c["kind"] == i, F.lit(t)).otherwise(limit)
        return self.margin(c["cell"]) >= limit


def _leaves(tree, cells: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(cells), tree)
    i, up, left, right = tree
    return np.where(feature(cells, i) <= up, _leaves(left, cells), _leaves(right, cells))


def _case(tree, cell: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    i, up, left, right = tree
    return F.when(feature(cell, i) <= up, _case(left, cell)).otherwise(_case(right, cell))


def _grow(cells: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A tree of a gradient step, by the gain of each feature's each split."""
    leaf = RATE * float(g.sum()) / (float(h.sum()) + L2)
    best = (1e-9, None)
    if depth:
        whole = g.sum() ** 2 / (h.sum() + L2)
        for i, (_, n) in enumerate(GRID):
            value = feature(cells, i)
            left_g, left_h = (np.cumsum(np.bincount(value, w, n))[:-1] for w in (g, h))
            right_g, right_h = g.sum() - left_g, h.sum() - left_h
            gain = left_g**2 / (left_h + L2) + right_g**2 / (right_h + L2) - whole
            up = int(gain.argmax())
            if gain[up] > best[0]:
                best = (float(gain[up]), (i, up))
    if best[1] is None:
        return leaf
    i, up = best[1]
    side = feature(cells, i) <= up
    return i, up, _grow(cells[side], g[side], h[side], depth - 1), _grow(cells[~side], g[~side], h[~side], depth - 1)


def boost(cells: np.ndarray, n: np.ndarray, confirmed: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Trees for the log odds of being confirmed, from counts by cell."""
    if not len(cells):
        return Model(0.0, (), (math.inf,) * len(KINDS))
    share = (confirmed.sum() + 0.5) / (n.sum() + 1)
    start = float(np.log(share / (1 - share)))
    margin, grown = np.full(len(cells), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(cells, confirmed - n * p, n * p * (1 - p), depth)
        grown.append(tree)
        margin += _leaves(tree, cells)
    return Model(start, tuple(grown), (math.inf,) * len(KINDS))


def calibrated(margin: np.ndarray, n: np.ndarray, confirmed: np.ndarray, precision: float) -> float:
    """The least margin at which the isotonic share of confirmed candidates (two more
    that are not are counted in each step) reaches the precision; infinite if none."""
    levels, at = np.unique(margin, return_inverse=True)
    steps: list[list[float]] = []  # least margin, confirmed, all; shares rise from step to step
    for m, c, k in zip(levels, np.bincount(at, confirmed), np.bincount(at, n)):
        steps.append([m, c, k])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            top = steps.pop()
            steps[-1][1] += top[1]
            steps[-1][2] += top[2]
    good = [m for m, c, k in steps if c >= precision * (k + 2)]
    return min(good, default=math.inf)


def fit(parts: DataFrame, precision: float = PRECISION) -> Model:
    """A model from texts' candidates (candidates, fold__); at most a row for each cell
    and fold reaches the driver."""
    one = parts.select("fold__", F.explode("candidates").alias("c"))
    rows = one.groupBy("c.cell", "fold__").agg(F.count("*").alias("n"), F.count_if("c.base").alias("y")).collect()
    rows = sorted((r["cell"], r["fold__"], r["n"], r["y"]) for r in rows)  # sums in one order: equal runs give equal models
    cells, held, n, y = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    fitted = held == 0
    model = boost(cells[fitted], n[fitted].astype(float), y[fitted].astype(float))
    margin, kind = model.margins(cells), feature(cells, 0)
    limits = []
    for i in range(len(KINDS)):
        own = ~fitted & (kind == i)
        limits.append(calibrated(margin[own], n[own], y[own], precision) if own.any() else math.inf)
    return Model(model.start, model.trees, tuple(limits))


def chosen(spans: Column, model: Model) -> Column:
    """(kind, start, stop) of the base's candidates and of those that the model adds:
    the greatest margin first, each where it overlaps none that is taken."""
    taken = F.filter(spans, lambda c: c["base"])
    more = F.filter(spans, lambda c: ~c["base"] & model.selects(c))
    slim = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))
    order = F.array_sort(F.transform(more, lambda c: F.struct((-model.margin(c["cell"])).alias("m"), c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind"))))
    base = F.transform(taken, slim)
    add = lambda a, c: F.when(F.exists(a, lambda t: (t["start"] < c["stop"]) & (c["start"] < t["stop"])), a).otherwise(F.concat(a, F.array(slim(c))))
    return F.when(F.size(more) > 0, F.array_sort(F.aggregate(order, base, add))).otherwise(base)


def said(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["stop"].cast("string"))), ",")


def personal_data(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> DataFrame:
    """All columns but the text, with the base's number of spans of each kind, a digest
    of the base's spans, and all spans; the model is fitted to these very texts."""
    fields = blocks.others(docs, text, ADDED)
    rows, carried = blocks.renamed(docs, fields, text)
    rows = rows.withColumn("text__", F.coalesce("text__", F.lit("")))
    fold = F.when(F.pmod(F.xxhash64("text__"), F.lit(FOLDS)) == 0, 1).otherwise(0)
    parts = blocks.stored(rows.select(*(c.name for c in carried), fold.alias("fold__"), candidates(F.col("text__")).alias("candidates")))
    model = fit(parts, precision)
    base = F.filter("candidates", lambda c: c["base"])
    out = parts.withColumn("base__", base).withColumn("all__", chosen(F.col("candidates"), model))
    return out.select(
        *blocks.restored(fields, carried),
        *(F.size(_of_kind("base__", i)).cast("long").alias(name) for i, name in enumerate(COUNTS)),
        F.sha2(said(F.col("base__")), 256).alias("base_sha256"), said(F.col("all__")).alias("spans"),
    )


def redact(docs: DataFrame, spans: Column, text: str = "text", name: str = "text") -> DataFrame:
    """docs with the text's spans (array of kind, start, stop; sorted by start and
    without overlaps) replaced by their kinds in angle brackets."""
    names = F.array(*map(F.lit, KINDS))
    whole = F.col(f"`{text}`")

    def cut(s: Column) -> Column:
        stops = F.concat(F.array(F.lit(0)), F.transform(s, lambda c: c["stop"]))
        starts = F.concat(F.transform(s, lambda c: c["start"]), F.array(F.length(whole)))
        gaps = F.zip_with(stops, starts, lambda a, b: F.substring(whole, a + 1, b - a))
        return F.array_join(F.concat(F.array(F.get(gaps, F.lit(0))), F.transform(s, lambda c, i: F.concat(F.lit("<"), F.get(names, c["kind"]), F.lit(">"), F.get(gaps, i + 1)))), "")

    return docs.withColumn(name, F.when(F.size(spans) > 0, let(spans, cut)).otherwise(whole))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
