"""Merging and appending tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.casts import cast_cell, text_of
from tessella.operators.base import step
from tessella.relation import ERROR, ORDER, Cell, Relation, nested, ref
from tessella.types import StepError, unique_name

#: Rows that a cross join may make, and another join where ``limitRows`` asks for a limit.
CROSS_ROWS, MERGE_ROWS = 5_000_000, 20_000_000
KINDS = {"left": "left", "inner": "inner", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


def _prefixed(r: Relation, side: str) -> Relation:
    """The same relation with hidden columns that don't clash with the other side's."""
    columns = [F.lit(True).alias(f"__{side}_here")] if side == "l" else []
    columns += [ref(n).alias(f"__{side}_{n}") for n in r.names] + [ref(ERROR + n).alias(f"__{side}e_{n}") for n in r.errors] + [F.col(ORDER).alias(f"__{side}ord")]
    return Relation(r.df.select(*columns), r.types, r.errors)


def _cells(r: Relation, side: str) -> dict[str, Cell]:
    return {n: Cell(ref(f"__{side}_{n}"), t, ref(f"__{side}e_{n}") if n in r.errors else None) for n, t in r.types.items()}


def _match(a: Cell, b: Cell, cast_keys: bool):
    """Equality of keys: null and errors never match, nor do different types unless both are compared as text."""
    numeric, dates, text = ("number", "int"), ("date", "datetime"), ("text", "any")
    if cast_keys:
        return text_of(a) == text_of(b)
    if a.type == b.type or (a.type in text and b.type in text):
        return a.value == b.value
    if a.type in numeric and b.type in numeric:
        return a.value.cast("double") == b.value.cast("double")
    if a.type in dates and b.type in dates:
        return a.value.cast("timestamp_ntz") == b.value.cast("timestamp_ntz")
    return F.lit(False)


def _condition(left, right, s):
    on = s.get("on") or []
    if not on:
        raise StepError("Choose at least one key column on each side")
    condition = None
    for a, b in on:
        this = _match(left[a], right[b], bool(s.get("castKeys")))
        condition = this if condition is None else condition & this
    return condition


def _order(how):
    """Left rows in their order, each with its matches in right order; then right rows without a left one."""
    left, right = F.col("__lord"), F.col("__rord")
    return nested(F.col("__l_here").isNull(), left, right) if how in ("right", "full") else nested(left, right)


@step("Merge")
def merge(r, s, c):
    other = c.query(s["right"])
    how = s.get("how", "left")
    if how not in KINDS:
        raise StepError(f"Unknown join {how}")
    on = s.get("on") or []
    r.need(a for a, _ in on)
    other.need(b for _, b in on)
    expand = s.get("expand") or [n for n in other.names if n not in {b for _, b in on}]
    other.need(expand)
    left, right = _prefixed(r, "l"), _prefixed(other, "r")
    lc, rc = _cells(r, "l"), _cells(other, "r")
    if how == "cross":
        if s.get("limitRows", True):
            rows = r.df.count() * other.df.count()
            if rows > CROSS_ROWS:
                raise StepError(f"Cross join would produce {rows:,} rows")
        df = left.df.crossJoin(right.df)
    else:
        if s.get("limitRows") and (rows := merge_stats(r, other, s)["outputRows"]) > MERGE_ROWS:
            raise StepError(f"Merge would produce {rows:,} rows — the right-hand keys are probably not unique")
        df = left.df.join(right.df, _condition(lc, rc, s), KINDS[how])
    if how in ("semi", "anti"):
        return r.build(list(lc.items()), df, F.col("__lord"))
    partner = dict(on)
    cells = []
    for n, x in lc.items():
        if how in ("right", "full") and n in partner:
            y = rc[partner[n]]
            value = F.coalesce(x.value, y.value if y.type == x.type else cast_cell(y, x.type).value)
            x = Cell(value, x.type, x.err)
        cells.append((n, x))
    taken = list(r.names)
    for n in expand:
        name = unique_name(f"{s['prefix']}.{n}" if s.get("prefix") else n, taken)
        taken.append(name)
        cells.append((name, rc[n]))
    return r.build(cells, df, _order(how))


def merge_stats(r: Relation, other: Relation, s) -> dict:
    """What a merge would match: one aggregate over a join of key counts."""
    left, right = _prefixed(r, "l"), _prefixed(other, "r")
    lc, rc = _cells(r, "l"), _cells(other, "r")
    keys_l, keys_r = [lc[a].value for a, _ in s["on"]], [rc[b].value for _, b in s["on"]]
    a = left.df.groupBy(*keys_l).agg(F.count(F.lit(1)).alias("__ln"))
    b = right.df.groupBy(*keys_r).agg(F.count(F.lit(1)).alias("__rn"))
    both = a.join(b, _condition(lc, rc, s), "full")
    hit = F.col("__ln").isNotNull() & F.col("__rn").isNotNull()
    row = both.agg(
        F.sum(F.when(hit, F.col("__ln"))).alias("matched"),
        F.sum("__ln").alias("total"),
        F.sum(F.when(hit, F.col("__rn"))).alias("rightMatched"),
        F.sum("__rn").alias("rightTotal"),
        F.count_if(F.col("__rn") > 1).alias("duplicateKeys"),
        F.sum(F.when(hit, F.col("__ln") * F.col("__rn"))).alias("pairs"),
    ).first()
    out = {k: v or 0 for k, v in row.asDict().items()}
    how = s.get("how", "left")
    alone, right_alone = out["total"] - out["matched"], out["rightTotal"] - out["rightMatched"]
    out["outputRows"] = {"left": out["pairs"] + alone, "inner": out["pairs"], "right": out["pairs"] + right_alone, "full": out["pairs"] + alone + right_alone, "semi": out["matched"], "anti": alone}.get(how, out["total"] * out["rightTotal"])
    out["warnings"] = [f"The keys {a} and {b} have different types and never match" for a, b in s["on"] if not s.get("castKeys") and {r.types[a], other.types[b]} not in ({"int", "number"}, {"text", "any"}, {"date", "datetime"}) and r.types[a] != other.types[b]]
    return out


def append_relations(parts: list[Relation], given: list[Column] | None = None) -> Relation:
    """Rows of all tables one after another, columns by name in first-seen order.

    ``given`` are the parts' orders where these, all of one type, already say how rows
    of different parts are ordered."""
    kinds: dict[str, set[str]] = {}
    for p in parts:
        for n, t in p.types.items():
            kinds.setdefault(n, set()).add(t)
    types = {n: next(iter(k)) if len(k) == 1 else "number" if k <= {"int", "number"} else "any" for n, k in kinds.items()}
    errors = frozenset(n for p in parts for n in p.errors)
    out = None
    orders = [p.df.schema[ORDER].dataType for p in parts]
    kinds_of_order = list(dict.fromkeys(x.simpleString() for x in orders))
    ddl = {x.simpleString(): x for x in orders}
    for k, p in enumerate(parts):
        cells = []
        for n, t in types.items():
            x = p.cell(n) if n in p.types else Cell(F.lit(None).cast("string"), "any")
            if n in p.types and x.type != t:
                x = Cell(x.value.cast("double") if t == "number" else text_of(x), t, x.err)
            none = F.lit(None).cast("string")
            cells.append((n, Cell(x.value, t, (x.err if x.err is not None else none) if n in errors else None)))
        # the table's number comes first, then its rows' order in the slot for orders of that kind
        if given:
            part = p.build(cells, order=given[k])
            out = part if out is None else Relation(out.df.unionByName(part.df), types, errors)
            continue
        slots = [F.col(ORDER) if orders[k].simpleString() == x else F.lit(None).cast(ddl[x]) for x in kinds_of_order]
        part = p.build(cells, order=nested(F.lit(k), *slots))
        out = part if out is None else Relation(out.df.unionByName(part.df), types, errors)
    return out


@step("Append")
def append(r, s, c):
    others = [c.query(q) for q in s.get("others", [])]
    if s.get("mode") == "strict":
        for k, o in enumerate(others):
            missing, extra = [n for n in r.names if n not in o.types], [n for n in o.names if n not in r.types]
            if missing or extra:
                raise StepError(f"Strict append: columns differ in table {k + 2}" + (f" — missing {', '.join(missing)}" if missing else "") + (f" — extra {', '.join(extra)}" if extra else ""), ["Switch to diagonal (union by name)"])
    return append_relations([r, *others])
