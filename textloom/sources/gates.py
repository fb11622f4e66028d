"""Writes that appear only if what was written passes.

The metrics of the gates are observed by the very job that writes, into a folder
beside the place; the folder is moved there if all gates hold, and is deleted
otherwise, with an error that names every gate that failed. Nothing is read twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textloom.functions.checks import positive


class GateError(ValueError):
    """What was written doesn't pass; .failed has a message for each gate."""

    def __init__(self, failed: Mapping[str, str]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in failed.items()))
        self.failed = dict(failed)


@dataclass(frozen=True)
class Gate:
    """An aggregate of the rows, whether a value of it passes, and what to say if not."""

    metric: Column
    passes: Callable[[int | float | None], bool]
    says: str


def write_gated(df: DataFrame, path: str, gates: Mapping[str, Gate], form: str = "parquet") -> dict[str, int | float | None]:
    """Writes df to a new folder and returns the gates' metrics; on a failing gate, or
    where the folder is there already, no folder is left or touched."""
    spark = df.sparkSession
    jvm = spark._jvm
    goal = jvm.org.apache.hadoop.fs.Path(path)
    system = goal.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(goal):
        raise FileExistsError(path)
    draft = jvm.org.apache.hadoop.fs.Path(goal.getParent(), f".{goal.getName()}-{uuid.uuid4().hex}")
    seen = Observation()
    try:
        df.observe(seen, *(g.metric.alias(k) for k, g in gates.items())).write.format(form).save(draft.toString())
        metrics = seen.get
        failed = {k: f"{g.says} (found {metrics[k]})" for k, g in gates.items() if not g.passes(metrics[k])}
        if failed:
            raise GateError(failed)
        if not system.rename(draft, goal):
            raise FileExistsError(path)
    finally:
        system.delete(draft, True)
    return {k: metrics[k] for k in gates}


def token_gates(tokens: str, end: int, parameters: int, least_ratio: float, length: int, epochs: int = 1) -> dict[str, Gate]:
    """A token stream's gates: two end tokens, so that it tells where documents end,
    and enough windows of `length` in all epochs for a model of so many parameters.
    Without a least ratio nothing is asked."""
    positive(parameters=parameters, length=length, epochs=epochs)
    if least_ratio <= 0:
        return {}
    n = F.coalesce(F.sum(F.size(tokens).cast("long")), F.lit(0))
    ends = F.coalesce(F.sum(F.size(F.filter(tokens, lambda t: t == end)).cast("long")), F.lit(0))
    ratio = lambda n: max(0, (n or 0) - length) * length * epochs / parameters
    return {
        "ends": Gate(ends, lambda v: v >= 2, "the stream lacks end tokens between documents"),
        "tokens": Gate(n, lambda v: ratio(v) >= least_ratio, f"fewer than {least_ratio} planned tokens a parameter"),
    }


def sample_gates(labels: str, ignored: int = -100) -> dict[str, Gate]:
    """Supervised samples' gates: one sample at least, and none without a target."""
    none = ~F.exists(labels, lambda x: x != ignored)
    return {
        "samples": Gate(F.count(F.lit(1)), lambda v: v >= 1, "there is no sample"),
        "untrained": Gate(F.count_if(F.coalesce(none, F.lit(True))), lambda v: v == 0, "samples have no trained target"),
    }


def check_base(metadata: Mapping, least_ratio: float, boundary_version: int = 1) -> float | None:
    """The training tokens a parameter that a base checkpoint records; raises where its
    metadata lacks them, was trained without document boundaries of this version, or
    with too few tokens. Without a least ratio nothing is asked."""
    if not isinstance(metadata.get("model"), Mapping) or not isinstance(metadata.get("tokenizer"), Mapping):
        raise ValueError("the checkpoint's metadata lacks its model or tokenizer")
    if least_ratio <= 0:
        return None
    training = metadata.get("training")
    tokens = training.get("total_tokens") if isinstance(training, Mapping) else None
    parameters = metadata["model"].get("parameter_count")
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    if not whole(tokens) or not whole(parameters) or parameters < 1:
        raise GateError({"recorded": "the checkpoint records no training tokens or parameters"})
    if training.get("document_eos_version") != boundary_version:
        raise GateError({"boundaries": "the checkpoint was trained without document boundaries"})
    if tokens / parameters < least_ratio:
        raise GateError({"tokens": f"{tokens / parameters:.2f} training tokens a parameter, {least_ratio} are asked"})
    return tokens / parameters
