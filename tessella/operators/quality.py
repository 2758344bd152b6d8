"""Validation, and aggregate views of a table's quality."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessella.functions.casts import natural_key, parse_number, text_of, trim
from tessella.operators.base import step
from tessella.relation import ORDER, Cell, Relation, ref
from tessella.types import StepError, unique_name

TOP, BINS, DISTINCT = 12, 20, 1_000


#: What a failed check of a column says; {a} and {b} are the rule's arguments, or what stands for none.
LABELS = {
    "not_null": "{col} is empty",
    "unique": "{col} is duplicated",
    "regex": "{col} does not match {a}",
    "range": "{col} outside {a}…{b}",
    "in": "{col} not in allowed list",
    "length": "{col} length outside {a}–{b}",
    "type": "{col} has a conversion error",
}
NO_LIMITS = {"range": ("−∞", "∞"), "length": ("0", "∞"), "regex": (None, None)}


def _label(rule) -> str:
    check, given = rule["check"], (rule.get("arg"), rule.get("arg2"))
    none = ("", None, 0) if check == "length" else ("", None)
    a, b = (limit if x in none and check in ("range", "length") else x for x, limit in zip(given, NO_LIMITS.get(check, given), strict=True))
    return LABELS.get(check, check).format(col=rule["col"], a=a, b=b)


def _bound(x, kind):
    if x in ("", None):
        return None
    if kind in ("date", "datetime"):
        return F.lit(str(x)).try_cast("timestamp_ntz")
    try:
        return F.lit(float(str(x).replace(",", "")))
    except ValueError:
        return None


def _passes(r: Relation, rule):
    """Whether a row passes; null passes all checks but not_null, errors pass none but those of counts."""
    cell, check = r.cell(rule["col"]), rule["check"]
    v, null = cell.value, cell.value.isNull() & ~cell.failed
    text = text_of(cell, export=True)
    if check == "not_null":
        return v.isNotNull() & (text != "")
    if check == "type":
        return ~cell.failed
    if check == "unique":
        return null | F.coalesce(F.col(f"__n_{rule['col']}") == 1, F.lit(True))
    if check == "regex":
        test = F.rlike(text, F.lit(str(rule.get("arg") or "")))
    elif check == "in":
        allowed = [x.strip() for x in str(rule.get("arg") or "").split(",") if x.strip()]
        test = text.isin(*allowed) if allowed else F.lit(False)
    elif check == "length":
        low = 0 if rule.get("arg") in ("", None) else float(rule["arg"])
        high = math.inf if rule.get("arg2") in ("", None) else float(rule["arg2"])
        test = (F.length(text) >= low) & (F.length(text) <= F.lit(high))
    elif check == "range":
        low, high = _bound(rule.get("arg"), cell.type), _bound(rule.get("arg2"), cell.type)
        x = v.cast("timestamp_ntz") if cell.type in ("date", "datetime") else v.cast("double") if cell.type in ("number", "int") else parse_number(text)
        test = x.isNotNull()
        test = test if low is None else test & (x >= low)
        test = test if high is None else test & (x <= high)
    else:
        raise StepError(f"Unknown check {check}")
    return null | (~cell.failed & F.coalesce(test, F.lit(False)))


@step("Validate")
def validate(r, s, c):
    rules = [x for x in s.get("rules", []) if x.get("col")]
    if not rules:
        raise StepError("Add at least one rule")
    r.need(x["col"] for x in rules)
    df = r.df
    for name in dict.fromkeys(x["col"] for x in rules if x["check"] == "unique"):
        # counted with map-side combine and joined back: a frequent value is no hot window
        counts = df.where(ref(name).isNotNull()).groupBy(ref(name).alias("__v")).agg(F.count(F.lit(1)).alias(f"__n_{name}")).where(F.col(f"__n_{name}") > 1)
        df = df.join(counts, ref(name) == F.col("__v"), "left").drop("__v")
    issues = F.concat_ws("; ", *(F.when(~_passes(r, x), F.lit((x.get("label") or _label(x)).replace("`", ""))) for x in rules))
    df = df.withColumn("__issues", F.when(issues != "", issues))
    name, action = s.get("name") or "Issues", s.get("action", "flag")
    if action == "keep_valid":
        return r.build(r.cells(), df.where("__issues is null"))
    if action == "keep_invalid":
        name = unique_name(name, r.names)
        return r.build([*r.cells(), (name, Cell(F.col("__issues"), "text"))], df.where("__issues is not null"))
    if action == "fail":
        bad = df.where("__issues is not null").agg(F.count(F.lit(1)).alias("n"), F.min_by("__issues", ORDER).alias("first")).first()
        if bad["n"]:
            raise StepError(f"{bad['n']} rows fail validation. First: {bad['first']}", ["Flag rows instead", "Drop invalid rows"])
        return r
    cells = [(n, Cell(F.col("__issues"), "text") if n == name else x) for n, x in r.cells()]
    if name not in r.types:
        cells.append((name, Cell(F.col("__issues"), "text")))
    return r.build(cells, df)


def _counts(cell):
    empty = cell.value.isNull() & ~cell.failed
    if cell.type in ("text", "any"):
        empty = empty | F.coalesce(cell.value == "", F.lit(False))
    return F.count_if(cell.failed), F.count_if(empty)


def quality(r: Relation):
    """A row for each column: ``column, valid, error, empty``. One pass over the data."""
    parts = []
    for n, x in r.cells():
        err, empty = _counts(x)
        parts.append(F.struct(F.lit(n).alias("column"), (F.count(F.lit(1)) - err - empty).alias("valid"), err.alias("error"), empty.alias("empty")))
    return r.df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def distinct_values(r: Relation, name: str, limit: int = DISTINCT):
    """``value, count`` in sort order, the first ``limit`` of them."""
    x = r.cell(name)
    key = natural_key(F.col("value")) if x.type in ("text", "any") else F.col("value")
    return r.df.groupBy(x.value.alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(key.asc_nulls_last(), F.col("value")).limit(limit)


def profile(r: Relation, name: str) -> dict:
    """Counts, range, moments, lengths, most frequent values and a histogram of a column."""
    x = r.cell(name)
    v, text = x.value, x.type in ("text", "any")
    err, empty = _counts(x)
    filled = F.when(v != "", v) if text else v
    aggs = [F.count(F.lit(1)).alias("rows"), err.alias("errors"), empty.alias("empty"), F.count_distinct(filled).alias("distinct")]
    number = x.type in ("number", "int")
    if number:
        aggs += [F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev")]
    elif text:
        aggs += [F.min_by(filled, natural_key(filled)).alias("min"), F.max_by(filled, natural_key(filled)).alias("max"), F.min(F.length(filled)).alias("minLength"), F.max(F.length(filled)).alias("maxLength"), F.avg(F.length(filled)).alias("meanLength")]
    else:
        aggs += [F.min(v).alias("min"), F.max(v).alias("max")]
    out = r.df.agg(*aggs).first().asDict()
    counts = r.df.where(filled.isNotNull()).groupBy(filled.alias("value")).agg(F.count(F.lit(1)).alias("count"), F.min(ORDER).alias("first"))
    out["unique"] = counts.where("count = 1").count()
    out["top"] = [(t["value"], t["count"]) for t in counts.orderBy(F.desc("count"), "first").limit(TOP).collect()]
    if number and out["min"] is not None:
        low, high = float(out["min"]), float(out["max"])
        width = (high - low) / BINS or 1.0
        bins = r.df.where(v.isNotNull()).groupBy(F.least(F.floor((v - low) / width), F.lit(BINS - 1)).alias("bin")).count().collect()
        by = {b["bin"]: b["count"] for b in bins}
        out["histogram"] = [(low + k * width, by.get(k, 0)) for k in range(BINS if high > low else 1)]
    return out


def overview(r: Relation) -> dict:
    """Cell counts, duplicate rows and a score between 0 and 100."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for k, (_, x) in enumerate(r.cells()):
        err, empty = _counts(x)
        space = F.count_if(x.value != trim(x.value)) if x.type in ("text", "any") else F.lit(0)
        aggs += [err.alias(f"e{k}"), empty.alias(f"m{k}"), space.alias(f"w{k}")]
    got = r.df.agg(*aggs).first().asDict()
    rows, n = got["rows"], len(r.names)
    columns = [{"name": name, "type": r.types[name], "valid": rows - got[f"e{k}"] - got[f"m{k}"], "error": got[f"e{k}"], "empty": got[f"m{k}"], "whitespace": got[f"w{k}"]} for k, name in enumerate(r.names)]
    err, empty, space = (sum(x[y] for x in columns) for y in ("error", "empty", "whitespace"))
    keys = [ref(x) for x in r.df.columns if x != ORDER]
    dup = rows - r.df.groupBy(*keys).agg(F.lit(1)).count() if rows else 0
    score = 100
    if rows * n:
        score = max(0, min(100, math.floor(100 * (1 - (err + 0.5 * empty + 0.25 * space) / (rows * n) - 0.5 * dup / rows) + 0.5)))
    return {"rows": rows, "cols": n, "errors": err, "empty": empty, "whitespace": space, "duplicateRows": dup, "score": score, "columns": columns}
