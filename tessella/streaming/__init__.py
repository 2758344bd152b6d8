"""Steps on streams.

Steps that look at one row at a time compile unchanged on a streaming DataFrame, and a
stream can be merged with a static table. Steps that need row order, all rows or a
look at the data are refused. Windowed counts over event time are an extension.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import Context, apply_step
from tessella.relation import ORDER, Relation
from tessella.types import StepError

#: Steps that need no other row of the stream.
STATELESS = frozenset(
    {"SelectColumns", "RemoveOtherColumns", "ReorderColumns", "RemoveColumns", "Rename", "ChangeType", "AddColumn", "ConditionalColumn", "DuplicateColumn", "SplitColumn", "MergeColumns", "Filter", "RemoveErrors", "KeepErrors", "ReplaceValues", "ReplaceErrors", "TextTransform", "RoundNumbers", "ExpandJson", "Unpivot", "Append", "Merge", "Validate", "Checkpoint"}
)


def refusal(step: Mapping[str, Any]) -> str | None:
    """Why a step can't run on a stream, or None."""
    kind = step["type"]
    if kind not in STATELESS:
        return f"{kind} needs row order or all rows"
    if kind == "ChangeType" and step.get("onError") == "fail":
        return "ChangeType with fail looks at all rows"
    if kind == "SplitColumn" and step.get("mode") in (None, "each") and not step.get("count"):
        return "SplitColumn needs a count"
    if kind == "ExpandJson" and not (step.get("kind") == "array" or (step.get("fields") and step.get("types"))):
        return "ExpandJson needs fields with types, or kind array"
    if kind == "Merge" and step.get("how", "left") not in ("left", "inner", "semi"):
        return f"Merge {step.get('how')} of a stream needs all rows"
    if kind == "Validate" and (step.get("action") == "fail" or any(r.get("check") == "unique" for r in step.get("rules", []))):
        return "Validate looks at all rows for unique and for fail"
    return None


def apply_stream(stream: DataFrame, steps: Sequence[Mapping[str, Any]], context: Context | None = None) -> DataFrame:
    """The steps on a streaming DataFrame; raises StepError for a step that can't run on one."""
    if not stream.isStreaming:
        raise StepError("Not a streaming DataFrame")
    for k, s in enumerate(steps):
        if why := refusal(s):
            raise StepError(f"Step {k + 1}: {why}")
    r = Relation.of(stream, ordered=False)
    for s in steps:
        r = apply_step(r, {**s, "limitRows": False}, context)
    return r.df.drop(ORDER).select(*r.output().columns)


def windowed_counts(stream: DataFrame, time: str, every: str, keys: Sequence[str] = (), late: str = "10 minutes") -> DataFrame:
    """Rows by key and tumbling window of event time; rows later than ``late`` are dropped."""
    marked = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return marked.groupBy(F.window(time, every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "rows")
