"""Window columns.

With a partition, Spark's windows do the work. Without one they would put all rows in
one task; instead, rows get their dense position and are cut into blocks. Running
values combine a block's own with the summary of all earlier blocks; values that look
a bounded number of rows back or ahead get those rows copied into the block.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions.casts import natural_key, sort_key
from tessella.operators.base import step
from tessella.operators.rows import key_columns, sort
from tessella.relation import ORDER, Cell, running_total
from tessella.types import StepError, unique_name

LABELS = {"cumsum": "Running total", "row_number": "Row number", "rank": "Rank", "dense_rank": "Dense rank", "diff": "Difference", "cummax": "Running max", "cummin": "Running min", "pct_change": "Percent change", "rolling_sum": "Rolling sum", "rolling_min": "Rolling min", "rolling_max": "Rolling max", "rolling_std": "Rolling std", "moving_avg": "Moving average", "lag": "Previous", "lead": "Next", "pct_of_total": "Percent of total"}
RUNNING, BOUNDED = ("cumsum", "cummax", "cummin"), ("diff", "pct_change", "rolling_sum", "rolling_min", "rolling_max", "rolling_std", "moving_avg", "lag", "lead")
BLOCK_ROWS = 65_536


def _bounded(op, v, w, n):
    """An expression over at most n rows before or after, and its window."""
    frame = w.rowsBetween(-(n - 1), 0)
    if op == "lag":
        return F.lag(v, n).over(w)
    if op == "lead":
        return F.lead(v, n).over(w)
    if op == "diff":
        return v - F.lag(v, 1).over(w)
    if op == "pct_change":
        before = F.lag(v, 1).over(w)
        return F.try_divide(v - before, before)
    f = {"rolling_sum": F.sum, "rolling_min": F.min, "rolling_max": F.max, "rolling_std": F.stddev_samp, "moving_avg": F.avg}[op]
    return f(v).over(frame)


@step("Window")
def window(r, s, c):
    op = s["op"]
    if op not in LABELS:
        raise StepError(f"Unknown window function {op}")
    name = unique_name(s.get("name") or f"{LABELS[op]}{' of ' + s['col'] if s.get('col') else ''}", r.names)
    n = max(1, int(s.get("n") or 1))
    cell = r.cell(s["col"]) if s.get("col") else Cell(F.lit(1).cast("long"), "int")
    numeric = cell.type in ("number", "int")
    x = cell.value if op in ("lag", "lead", "rank", "dense_rank") else cell.value.cast("double") if numeric else F.lit(None).cast("double")
    kind = "int" if op in ("row_number", "rank", "dense_rank") else cell.type if op in ("lag", "lead") else "number"
    part = s.get("partition") or []
    r.need(part)
    if op in ("rank", "dense_rank"):
        key = natural_key(x) if cell.type in ("text", "any") and c.natural else x
        if not part:
            return _global_rank(r, op, name, key)
        w = Window.partitionBy(*key_columns(r, part)).orderBy(key.desc_nulls_last())
        return r.with_cell(name, Cell((F.rank() if op == "rank" else F.dense_rank()).over(w), "int"))
    if op == "pct_of_total":
        if part:
            total = F.sum(x).over(Window.partitionBy(*key_columns(r, part)))
            return r.with_cell(name, Cell(F.try_divide(x, total), "number"))
        total = r.df.agg(F.sum(x).alias("__total"))
        return r.build([*r.cells(), (name, Cell(F.try_divide(x, F.col("__total")), "number"))], r.df.crossJoin(F.broadcast(total)))  # one row
    if part:
        keys = [F.col(ORDER)]
        if s.get("orderBy"):
            key = sort_key(r.cell(s["orderBy"]), c.natural)
            keys = [key.desc_nulls_last() if s.get("desc") else key.asc_nulls_last(), *keys]
        w = Window.partitionBy(*key_columns(r, part)).orderBy(*keys)
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        if op == "row_number":
            value = F.row_number().over(w)
        elif op == "cumsum":
            value = F.coalesce(F.sum(x).over(run), F.lit(0.0))
        elif op in RUNNING:
            value = (F.max if op == "cummax" else F.min)(x).over(run)
        else:
            value = _bounded(op, x, w, n)
        return r.with_cell(name, Cell(value, kind))
    return _unpartitioned(r, s, c, op, name, x, kind, n)


def _unpartitioned(r, s, c, op, name, x, kind, n):
    kept = r.over(r.df.withColumn("__was", F.col(ORDER)))
    if s.get("orderBy"):
        ordered = sort(kept, {"by": [{"col": s["orderBy"], "desc": s.get("desc")}]}, c)
    else:
        ordered = kept
    df = ordered.position().withColumn("__x", x)
    cells, back = r.cells(), F.col("__was")
    if op == "row_number":
        return r.build([*cells, (name, Cell(F.col("__pos") + 1, "int"))], df, back)
    size = max(BLOCK_ROWS, n)
    df = df.withColumn("__block", F.floor(F.col("__pos") / size))
    if op in RUNNING:
        f = {"cumsum": F.sum, "cummax": F.max, "cummin": F.min}[op]
        before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        carried = df.groupBy("__block").agg(f("__x").alias("__end")).select("__block", f("__end").over(before).alias("__carry"))
        df = df.join(carried, "__block")
        own = f("__x").over(Window.partitionBy("__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0))
        both = F.coalesce(own, F.lit(0.0)) + F.coalesce("__carry", F.lit(0.0)) if op == "cumsum" else (F.greatest if op == "cummax" else F.least)(own, F.col("__carry"))
        return r.build([*cells, (name, Cell(both, "number"))], df, back)
    if op not in BOUNDED:
        raise StepError(f"Unknown window function {op}")
    ahead = op == "lead"
    near = (F.col("__pos") % size < n) & (F.col("__block") > 0) if ahead else F.col("__pos") % size >= size - n
    copies = F.explode(F.when(near, F.array(F.col("__block"), F.col("__block") + (-1 if ahead else 1))).otherwise(F.array("__block")))
    df = df.withColumn("__in", copies)
    w = Window.partitionBy("__in").orderBy("__pos")
    df = df.withColumn("__y", _bounded(op, F.col("__x"), w, n)).where(F.col("__in") == F.col("__block"))
    return r.build([*cells, (name, Cell(F.col("__y"), kind))], df, back)


def _global_rank(r, op, name, key):
    """Ranks over all rows: values are counted first, and only distinct values are ordered."""
    df = r.df.withColumn("__key", key)
    counts = df.groupBy("__key").agg((F.lit(1) if op == "dense_rank" else F.count(F.lit(1))).cast("long").alias("__n"))
    before = running_total(counts, "__n", [F.col("__key").desc_nulls_last()], "__before")
    ranks = before.select(F.col("__key").alias("__rk"), (F.col("__before") + 1).alias("__rank"))
    joined = df.join(ranks, df["__key"].eqNullSafe(ranks["__rk"]))
    return r.build([*r.cells(), (name, Cell(F.col("__rank"), "int"))], joined)


