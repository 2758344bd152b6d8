"""Steps that change values in place."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.formula.compile import Compiler, literal
from tessella.functions.casts import cast_cell, half_up, text_of, trim
from tessella.functions.scalar import clean, fingerprint, ngram_fingerprint, proper, strip_marks
from tessella.operators.base import step
from tessella.relation import ORDER, Cell, block_of, nested
from tessella.types import StepError


def _fill(r, cols, down: bool):
    """The nearest value before (or after) in row order. Rows are dealt with in blocks of the
    scan's ids: a block gets the last value of all earlier blocks, so no task sees all rows.

    Filling up runs backwards: a frame that ends at the last row is read anew for every row."""
    r.need(cols)
    r = r.settled()
    df = r.df.withColumn("__block", block_of(F.col(ORDER)))
    cells = dict(r.cells(cols))
    pair = {n: F.when(x.value.isNotNull() | x.failed, F.struct(x.value.alias("v"), (F.lit(None).cast("string") if x.err is None else x.err).alias("e"))) for n, x in cells.items()}
    pick = F.max_by if down else F.min_by
    ends = df.groupBy("__block").agg(*(pick(F.when(p.isNotNull(), p), F.when(p.isNotNull(), F.col(ORDER))).alias(f"__end{k}") for k, p in enumerate(pair.values())))
    key = (lambda c: F.col(c).asc()) if down else (lambda c: F.col(c).desc())
    over = Window.orderBy(key("__block")).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("__block").orderBy(key(ORDER)).rowsBetween(Window.unboundedPreceding, 0)
    carried = ends.select("__block", *(F.last(f"__end{k}", True).over(over).alias(f"__carry{k}") for k in range(len(pair))))
    df = df.join(carried, "__block", "left")
    df = df.select("*", *(F.coalesce(F.last(p, True).over(within), F.col(f"__carry{k}")).alias(f"__fill{k}") for k, p in enumerate(pair.values())))
    at = {n: k for k, n in enumerate(pair)}
    return r.build([(n, Cell(F.col(f"__fill{at[n]}.v"), x.type, None if x.err is None else F.col(f"__fill{at[n]}.e")) if n in at else x) for n, x in r.cells()], df)


@step("FillDown")
def fill_down(r, s, c):
    return _fill(r, s["cols"], True)


@step("FillUp")
def fill_up(r, s, c):
    return _fill(r, s["cols"], False)


def _constant(x, kind, c):
    """A value that the user typed, in the column's type if it can be."""
    if x in (None, ""):
        return Cell(F.lit(None).cast("string"), "any")
    if kind in ("text", "any"):
        return literal(str(x))
    given = literal(x)
    cast = cast_cell(given, kind, c.locale)
    return Cell(cast.value, kind, None) if cast.err is None else Cell(cast.value, kind)


@step("ReplaceValues")
def replace_values(r, s, c):
    find, by = s.get("find"), s.get("replace")
    for name in s.get("cols", []):
        cell = r.cell(name)
        whole = s.get("wholeCell", True) is not False or cell.type != "text"
        new = _constant(by, cell.type, c).value
        if find in (None, ""):
            hit = cell.value.isNull() if cell.type not in ("text", "any") else F.coalesce(cell.value, F.lit("")) == ""
            value = F.when(hit & ~cell.failed, new).otherwise(cell.value)
        elif whole:
            hit = Compiler(r).equal(Cell(cell.value, cell.type), _constant(find, cell.type, c))
            value = F.when(hit, new).otherwise(cell.value)
        else:
            value = F.replace(cell.value, F.lit(str(find)), F.lit("" if by is None else str(by)))
        r = r.with_cell(name, Cell(value, cell.type, cell.err))
    return r


@step("ReplaceErrors")
def replace_errors(r, s, c):
    for name in s.get("cols", []):
        cell = r.cell(name)
        if cell.err is not None:
            new = _constant(s.get("value"), cell.type, c).value
            r = r.with_cell(name, Cell(F.when(cell.failed, new).otherwise(cell.value), cell.type))
    return r


TEXT_OPS = {"upper": F.upper, "lower": F.lower, "trim": trim, "clean": clean, "proper": proper}


@step("TextTransform")
def text_transform(r, s, c):
    if s.get("op") not in TEXT_OPS:
        raise StepError(f"Unknown text transform {s.get('op')}")
    for name in s.get("cols", []):
        cell = r.cell(name)
        r = r.with_cell(name, Cell(TEXT_OPS[s["op"]](text_of(cell)), "text", cell.err))
    return r


@step("RoundNumbers")
def round_numbers(r, s, c):
    digits = int(s.get("digits") or 0)
    f = 10.0**digits
    for name in s.get("cols", []):
        cell = r.cell(name)
        if cell.type in ("number", "int"):
            value = half_up(cell.value * f) / f
            kind = "int" if digits == 0 else cell.type
            r = r.with_cell(name, Cell(value.cast("long") if kind == "int" else value, kind, cell.err))
    return r


#: How many values and groups clustering looks at.
CLUSTER_VALUES, CLUSTER_GROUPS = 50_000, 500


def clusters(r, col, method="fingerprint"):
    """Variants of one value: ``key, canonical, rows, variants`` with each variant's count.

    The values are the distinct ones, in the order in which they appear, up to a
    stated number; the canonical form is the most frequent one, trimmed.
    """
    cell = r.cell(col)
    if cell.type not in ("text", "any"):
        return r.df.sparkSession.createDataFrame([], "key string, canonical string, rows long, variants array<struct<value:string,count:long>>")
    values = r.df.where(cell.value.isNotNull()).groupBy(cell.value.alias("value")).agg(F.count(F.lit(1)).alias("count"), F.min(ORDER).alias("first"))
    values = values.orderBy("first").limit(CLUSTER_VALUES)
    plain = values.withColumn("plain", strip_marks(F.col("value")))
    keyed = plain.withColumn("key", ngram_fingerprint(F.col("plain")) if method == "ngram" else fingerprint(F.col("plain"), stripped=True)).where("key <> ''")
    untidy = F.col("value") != trim(F.col("value"))
    variant = F.struct((-F.col("count")).alias("minus"), untidy.alias("untidy"), "value", "count")
    groups = keyed.groupBy("key").agg(F.array_sort(F.collect_list(variant)).alias("v"), F.sum("count").alias("rows")).where(F.size("v") > 1)
    out = groups.select("key", trim(F.col("v")[0]["value"]).alias("canonical"), "rows", F.transform("v", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias("variants"))
    return out.orderBy(F.desc("rows"), "key").limit(CLUSTER_GROUPS)


@step("ClusterValues")
def cluster_values(r, s, c):
    name = s.get("col")
    if not name:
        raise StepError("Choose a column to cluster")
    cell = r.cell(name)
    if s.get("auto"):
        pairs = clusters(r, name, s.get("method", "fingerprint")).select(F.explode("variants").alias("x"), "canonical").select(F.col("x.value").alias("__from"), F.col("canonical").alias("__to")).where("__from <> __to")
    elif s.get("pairs"):
        pairs = r.df.sparkSession.createDataFrame([tuple(p) for p in dict(s["pairs"]).items()], "__from string, __to string")
    else:
        return r
    df = r.df.join(F.broadcast(pairs), cell.value == F.col("__from"), "left")  # at most CLUSTER_VALUES rows, or a given list
    return r.build([(n, Cell(F.coalesce(F.col("__to"), x.value), x.type, x.err) if n == name else x) for n, x in r.cells()], df)


JSON_FIELDS = 2_000
"""Fields that a look at the data may turn into columns."""


@step("ExpandJson")
def expand_json(r, s, c):
    """Objects become columns, arrays become rows. ``fields`` or ``kind`` ("object" or "array") save a look at the data."""
    name = s["col"]
    cell = r.cell(name)
    text = cell.value
    kind, fields = s.get("kind"), s.get("fields")
    trimmed = trim(text)
    if kind is None:
        arrays = r.df.where(F.startswith(trimmed, F.lit("[")) & F.json_array_length(text).isNotNull()).limit(1).count()
        kind = "array" if arrays else "object"
    if kind == "array":
        items = F.when(F.startswith(trimmed, F.lit("[")), F.from_json(text, "array<string>")).otherwise(F.array(text))
        items = F.when(F.size(items) > 0, items)
        df = r.df.select("*", F.posexplode_outer(items).alias("__at", "__item"))
        order = nested(F.col(ORDER), F.coalesce("__at", F.lit(0)))
        return r.build([(n, Cell(F.col("__item"), "text", x.err) if n == name else x) for n, x in r.cells()], df, order)
    parsed = F.try_parse_json(text)
    bad = F.when(text.isNotNull() & parsed.isNull(), F.lit("Not valid JSON"))
    if not fields:
        keys = r.df.select(ORDER, F.posexplode(F.json_object_keys(text)).alias("at", "key")).groupBy("key").agg(F.min(F.struct(ORDER, "at")).alias("first"))
        fields = [x["key"] for x in keys.orderBy("first").limit(JSON_FIELDS + 1).collect()]
        if len(fields) > JSON_FIELDS:
            raise StepError(f"Column `{name}` has more than {JSON_FIELDS:,} fields", ["Name the fields to expand"])
    if not fields:
        raise StepError(f"Column `{name}` has no JSON objects to expand")
    keep = [n for n in r.names if n != name]
    kinds = {}
    sample = r.df.select(F.schema_of_variant_agg(parsed).alias("kind")).first()["kind"] if not s.get("types") else ""
    for f in fields:
        kinds[f] = (s.get("types") or {}).get(f) or _variant_type(sample or "", f)
    taken, cells = list(keep), []
    for n, x in r.cells():
        if n != name:
            cells.append((n, x))
            continue
        for f in fields:
            new = name + "." + f
            while new in taken:
                new += "_1"
            taken.append(new)
            value = F.get_json_object(text, "$['" + f.replace("'", "\\'") + "']")
            value = {"int": lambda v: v.try_cast("long"), "number": lambda v: v.try_cast("double"), "bool": lambda v: v.try_cast("boolean")}.get(kinds[f], lambda v: v)(value)
            cells.append((new, Cell(value, kinds[f], bad)))
    return r.build(cells)


def _variant_type(schema: str, field: str) -> str:
    """The logical type of a field in a variant's schema text."""
    m = re.search(rf"(?:<|, )`?{re.escape(field)}`?: (\w+)", schema)
    kind = m[1] if m else ""
    return "int" if kind in ("BIGINT", "INT", "SMALLINT", "TINYINT") else "number" if kind in ("DOUBLE", "DECIMAL", "FLOAT") else "bool" if kind == "BOOLEAN" else "text"
