"""Generated records: template sentences and scenario-by-format sets.

Choices come from the MD5 of seed, row and slot, so any row can be made on any
executor, and the same in every run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import uniform


def choice(values: Sequence[str], seed: int, row: Column, slot: str) -> Column:
    """One of the values, evenly, for a row's slot."""
    at = F.floor(uniform(F.lit(str(seed)), F.lit(slot), row.cast("string")) * F.lit(len(values)))
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def capitalized(c: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def sentence(row: Column, seed: int, templates: Sequence[str], slots: Mapping[str, Sequence[str]], fields: Mapping[str, Column] | None = None) -> Column:
    """The text of a numbered row: template number row modulo their number, each {slot}
    filled by a choice and each {field} by a column."""
    text = F.element_at(F.array(*map(F.lit, templates)), (row % len(templates) + 1).cast("int"))
    for slot, values in slots.items():
        text = F.replace(text, F.lit("{" + slot + "}"), choice(values, seed, row, slot))
    for field, value in (fields or {}).items():
        text = F.replace(text, F.lit("{" + field + "}"), F.coalesce(value, F.lit("")))
    return text


def sentences(spark: SparkSession, n: int, seed: int, templates: Sequence[str], slots: Mapping[str, Sequence[str]]) -> DataFrame:
    """(i, text) of n rows."""
    return spark.range(n).select(F.col("id").alias("i"), sentence(F.col("id"), seed, templates, slots).alias("text"))


def scenario_formats(scenarios: DataFrame, formats: DataFrame) -> DataFrame:
    """Every scenario in every format; both are authored lists of a few rows."""
    return scenarios.crossJoin(F.broadcast(formats))
