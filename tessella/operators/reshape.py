"""Unpivot, pivot and transpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.casts import text_of
from tessella.operators.base import step
from tessella.operators.grouping import aggregate
from tessella.relation import ORDER, Cell, nested
from tessella.types import SPARK_TYPES, StepError, unique_name, unique_names

PIVOT_COLUMNS, TRANSPOSE_ROWS = 500, 5_000


@step("Unpivot")
def unpivot(r, s, c):
    ids, values = s.get("ids") or [], s.get("values") or []
    r.need(ids)
    r.need(values)
    values = values or [n for n in r.names if n not in ids]
    if s.get("values") and "ids" not in s:
        ids = [n for n in r.names if n not in values]
    kinds = {r.types[v] for v in values}
    kind = kinds.pop() if len(kinds) == 1 else "number" if kinds <= {"int", "number"} else "any"
    failing = any(v in r.errors for v in values)
    parts = []
    for v in values:
        x = r.cell(v)
        value = x.value if x.type == kind else x.value.cast("double") if kind == "number" else text_of(x)
        err = [(x.err if x.err is not None else F.lit(None).cast("string")).alias("e")] if failing else []
        parts.append(F.struct(F.lit(v).alias("n"), value.cast(SPARK_TYPES[kind]).alias("v"), *err))
    df = r.df.select("*", F.posexplode(F.array(*parts)).alias("__at", "__cell"))
    value, err = F.col("__cell.v"), F.col("__cell.e") if failing else None
    if s.get("dropNulls", True) is not False:
        df = df.where(value.isNotNull() if err is None else value.isNotNull() | err.isNotNull())
    cells = [*r.cells(ids), (s.get("var") or "Attribute", Cell(F.col("__cell.n"), "text")), (s.get("val") or "Value", Cell(value, kind, err))]
    return r.build(cells, df, nested(F.col(ORDER), F.col("__at")))


@step("Pivot")
def pivot(r, s, c):
    """New columns in the order in which their names first appear; ``keys`` saves looking for them.

    Absent cells are null, also for counts; percentile and concat take their defaults.
    """
    on, values, fn = r.cell(s["on"]), s.get("values"), s.get("agg") or "sum"
    if values:
        r.need([values])
    index = s.get("index") or [n for n in r.names if n not in (s["on"], values)]
    r.need(index)
    name = F.coalesce(text_of(on, export=True), F.lit("null") if on.err is None else F.when(on.err.isNull(), F.lit("null")).otherwise(on.err))
    df = r.df.withColumn("__on", name)
    keys = s.get("keys")
    if keys is None:
        found = df.groupBy("__on").agg(F.min(ORDER).alias("first")).orderBy("first").limit(PIVOT_COLUMNS + 1).collect()
        keys = [x["__on"] for x in found]
    if len(keys) > PIVOT_COLUMNS:
        raise StepError(f"Pivot would create more than {PIVOT_COLUMNS} columns. Filter or group `{s['on']}` first.")
    cell = r.cell(values) if values else Cell(F.lit(1).cast("long"), "int")
    made = aggregate(fn, cell, natural=c.natural)
    kind = made.type if values else "int"
    by = []
    for k, (_, x) in enumerate(r.cells(index)):
        by.append(x.value.alias(f"__k{k}"))
        if x.err is not None:
            by.append(x.err.alias(f"__e{k}"))
    cells = [(n, Cell(F.col(f"__k{k}"), x.type, None if x.err is None else F.col(f"__e{k}"))) for k, (n, x) in enumerate(r.cells(index))]
    # one aggregation to cells, a second one that deals them to columns: both with map-side combine
    flat = df.groupBy(*by, "__on").agg(made.value.alias("__v"), F.min(ORDER).alias("__first"))
    names = [f"__p{k}" for k in range(len(keys))]
    at = F.create_map(*(y for k, x in enumerate(keys) for y in (F.lit(x), F.lit(f"__p{k}")))) if keys else None
    by_names = [f"__k{k}" for k in range(len(index))] + [f"__e{k}" for k, (_, x) in enumerate(r.cells(index)) if x.err is not None]
    if not keys:
        wide = flat.groupBy(*by_names).agg(F.min("__first").alias("__first"))
    else:
        flat = flat.withColumn("__on", at[F.col("__on")])
        wide = flat.groupBy(*by_names).pivot("__on", names).agg(F.first("__v").alias("v"), F.min("__first").alias("o"))
        wide = wide.withColumn("__first", F.array_min(F.array_compact(F.array(*(F.col(f"{n}_o") for n in names)))))
    taken = list(index)
    for k, x in enumerate(keys):
        new = unique_name(x, taken)
        taken.append(new)
        cells.append((new, Cell(F.col(f"__p{k}_v"), "number" if kind == "any" else kind)))
    return r.build(cells, wide, F.col("__first"))


@step("Transpose")
def transpose(r, s, c):
    """Of small tables only. The first output column has the names; values are text."""
    header = s.get("headerCol")
    rows = r.df.orderBy(*r.by_order()).limit(TRANSPOSE_ROWS + 1).select(*(text_of(x, export=True).alias(n) for n, x in r.cells())).collect()
    if len(rows) > TRANSPOSE_ROWS:
        raise StepError(f"Transpose is limited to {TRANSPOSE_ROWS} rows")
    names = [n for n in r.names if n != header]
    heads = unique_names(["Name", *([x[header] for x in rows] if header else [f"Column{k + 1}" for k in range(len(rows))])])
    data = [(k, n, *(x[n] for x in rows)) for k, n in enumerate(names)]
    schema = ", ".join(["__at long", *(f"__c{k} string" for k in range(len(heads)))])
    df = r.df.sparkSession.createDataFrame(data, schema)
    return r.build([(h, Cell(F.col(f"__c{k}"), "text" if k == 0 else "any")) for k, h in enumerate(heads)], df, F.col("__at"))
