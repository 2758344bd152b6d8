"""Aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.casts import natural_key, text_of
from tessella.operators.base import step
from tessella.relation import ORDER, Cell
from tessella.types import StepError, unique_name

#: The aggregates with their names in default column names.
LABELS = {
    "count_rows": "Count rows",
    "count": "Count (non-empty)",
    "count_distinct": "Count distinct",
    "sum": "Sum",
    "mean": "Average",
    "median": "Median",
    "std": "Std deviation",
    "var": "Variance",
    "mode": "Mode",
    "percentile": "Percentile",
    "min": "Min",
    "max": "Max",
    "first": "First",
    "last": "Last",
    "concat": "Concatenate text",
}
SAME_TYPE = ("mode", "min", "max", "first", "last")


def default_name(a) -> str:
    label = LABELS[a["fn"]]
    if a["fn"] == "percentile":
        p = 50.0 if a.get("p") in (None, "") else float(a["p"])
        label = f"P{round(p, 2):g}"
    return f"{label} of {a['col']}" if a.get("col") else label


def share(p) -> float:
    """A percentile between 0 and 1; 50 where none is given."""
    try:
        return min(100.0, max(0.0, float(p))) / 100
    except (TypeError, ValueError):
        return 0.5


def aggregate(fn: str, cell: Cell, *, sep: str = ", ", p=None, natural: bool = True) -> Cell:
    """An aggregate of a column as a column; errors don't count, but as one distinct value."""
    v, kind = cell.value, cell.type
    number = v if kind in ("number", "int") else F.lit(None).cast("double")
    if fn == "count_rows":
        return Cell(F.count(F.lit(1)), "int")
    if fn == "count":
        return Cell(F.count(v), "int")
    if fn == "count_distinct":
        n = F.count_distinct(v)
        return Cell(n if cell.err is None else n + F.coalesce(F.max(cell.err.isNotNull().cast("int")), F.lit(0)), "int")
    if fn == "sum":
        return Cell(F.sum(number), "int" if kind == "int" else "number")
    if fn in ("mean", "std", "var", "median"):
        return Cell({"mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "median": F.median}[fn](number.cast("double")), "number")
    if fn == "percentile":
        return Cell(F.percentile(number.cast("double"), share(p)), "number")
    if fn == "mode":
        return Cell(F.mode(v, True), kind)
    if fn in ("min", "max"):
        if kind in ("text", "any") and natural:
            pick = F.min_by if fn == "min" else F.max_by
            return Cell(pick(v, F.when(v.isNotNull(), F.struct(natural_key(v), v))), kind)
        return Cell((F.min if fn == "min" else F.max)(v), kind)
    if fn in ("first", "last"):
        pick = F.min_by if fn == "first" else F.max_by
        return Cell(pick(v, F.col(ORDER)), kind, None if cell.err is None else pick(cell.err, F.col(ORDER)))
    if fn == "concat":
        ordered = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(F.col(ORDER), text_of(cell, export=True).alias("t")))))
        return Cell(F.array_join(F.transform(ordered, lambda x: x["t"]), sep), "text")
    raise StepError(f"Unknown aggregate {fn}")


@step("GroupBy")
def group_by(r, s, c):
    """Groups come in the order of their first rows; without keys there is one group, even of no rows."""
    keys, aggs = s.get("keys") or [], s.get("aggs") or []
    r.need(keys)
    key_cells = r.cells(keys)
    by: list[Column] = []
    for k, (_, x) in enumerate(key_cells):
        by.append(x.value.alias(f"__k{k}"))
        if x.err is not None:
            by.append(x.err.isNotNull().alias(f"__f{k}"))
    taken, out, columns = list(keys), [], []
    for k, (_, x) in enumerate(key_cells):
        if x.err is not None:
            columns.append(F.min(x.err).alias(f"__e{k}"))
    for k, a in enumerate(aggs):
        if a["fn"] not in LABELS:
            raise StepError(f"Unknown aggregate {a['fn']}")
        cell = Cell(F.lit(1), "int") if a["fn"] == "count_rows" else r.cell(a["col"])
        made = aggregate(a["fn"], cell, sep=", " if a.get("sep") is None else a["sep"], p=a.get("p"), natural=c.natural)
        name = unique_name(a.get("name") or default_name(a), taken)
        taken.append(name)
        columns.append(made.value.alias(f"__a{k}"))
        if made.err is not None:
            columns.append(made.err.alias(f"__b{k}"))
        out.append((name, Cell(F.col(f"__a{k}"), made.type, None if made.err is None else F.col(f"__b{k}"))))
    columns.append(F.min(ORDER).alias("__first"))
    df = (r.df.groupBy(*by) if by else r.df.groupBy()).agg(*columns)
    cells = [(n, Cell(F.col(f"__k{k}"), x.type, None if x.err is None else F.col(f"__e{k}"))) for k, (n, x) in enumerate(key_cells)]
    return r.build([*cells, *out], df, F.col("__first"))
