"""Projections: selecting, naming, typing and adding columns."""

from __future__ import annotations

import functools
import re

from pyspark.sql import functions as F

from tessella.formula.syntax import Node
from tessella.functions.casts import cast_cell, text_of, trim
from tessella.operators.base import step
from tessella.relation import ORDER, Cell, nested
from tessella.types import StepError, unique_name


@step("SelectColumns", "RemoveOtherColumns")
def select_columns(r, s, c):
    return r.select(s["cols"])


@step("ReorderColumns")
def reorder_columns(r, s, c):
    r.need(s["cols"])
    return r.select([*s["cols"], *(n for n in r.names if n not in s["cols"])])


@step("RemoveColumns")
def remove_columns(r, s, c):
    r.need(s["cols"])
    return r.select([n for n in r.names if n not in s["cols"]])


@step("Rename")
def rename(r, s, c):
    names = {old: new for old, new in s["map"]}
    r.need(names)
    out = [names.get(n, n) for n in r.names]
    if len(set(out)) < len(out):
        twice = next(n for n in out if out.count(n) > 1)
        raise StepError(f"Two columns would be named `{twice}`")
    return r.build([(new, cell) for new, (_, cell) in zip(out, r.cells(), strict=True)])


@step("ChangeType")
def change_type(r, s, c):
    mode = s.get("onError", "error")
    for change in s.get("changes", []):
        name, kind = change["col"], change["type"]
        before = r.cell(name)
        after = cast_cell(before, kind, change.get("locale") or s.get("locale") or c.locale)
        new = None if after.err is None or after.err is before.err else F.when(~before.failed, after.err)
        if new is not None and mode == "null":
            after = Cell(after.value, kind, before.err)
        elif new is not None and mode == "fail":
            bad = r.df.where(new.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.min_by(new, ORDER).alias("message")).first()
            if bad["n"]:
                raise StepError(f"{bad['message']} (column `{name}`, {bad['n']} failing values)", ["Keep errors per cell instead", "Turn failures into nulls"])
            after = Cell(after.value, kind, before.err)
        elif mode == "keep":
            kept = F.lit(None).cast("string") if new is None else F.when(new.isNotNull(), text_of(before, export=True))
            # both columns come from the row as it was before
            cells = []
            for n, cell in r.cells():
                if n == name:
                    cells += [(n, Cell(after.value, kind, before.err)), (unique_name(f"{name}_error", r.names), Cell(kept, "text"))]
                else:
                    cells.append((n, cell))
            r = r.build(cells)
            continue
        r = r.with_cell(name, after)
    return r


def add_cell(r, name, source, cast_to, c):
    if not name:
        raise StepError("Give the new column a name")
    cell = c.formula(source or "null", r)
    if cast_to and cast_to != "auto":
        cell = cast_cell(cell, cast_to, c.locale)
    return r.with_cell(name, cell)


@step("AddColumn")
def add_column(r, s, c):
    return add_cell(r, s.get("name"), s.get("formula"), s.get("castTo"), c)


def conditional_formula(s) -> str:
    out = (s.get("else") or "").strip() or "null"
    for rule in reversed(s.get("rules", [])):
        out = f"if {rule.get('when') or 'false'} then {rule.get('then') or 'null'} else {out}"
    return out


@step("ConditionalColumn")
def conditional_column(r, s, c):
    return add_cell(r, s.get("name"), conditional_formula(s), None, c)


@step("IndexColumn")
def index_column(r, s, c):
    start, by = float(s.get("start") or 0), s.get("step", 1)
    by = 1.0 if by in ("", None) else float(by)
    name = unique_name(s.get("name") or "Index", r.names)
    df = r.position()
    whole = start.is_integer() and by.is_integer()
    value = F.col("__pos") * int(by) + int(start) if whole else F.col("__pos") * by + start
    cells = r.cells()
    cells.insert(0 if s.get("first") else len(cells), (name, Cell(value, "int" if whole else "number")))
    return r.build(cells, df)


@step("DuplicateColumn")
def duplicate_column(r, s, c):
    name = unique_name(s.get("name") or f"{s['col']} - Copy", r.names)
    return r.with_cell(name, r.cell(s["col"]), r.names.index(s["col"]) + 1)


def _positions(text, places):
    """Pieces between 0-based places; negative ones count from the end."""
    n = F.length(text)
    at = lambda p: F.lit(p) if p >= 0 else F.greatest(n + p, F.lit(0))
    ends = [*places[1:], None]
    out = []
    for s, e in zip(places, ends, strict=True):
        start, end = at(s), n if e is None else F.least(at(e), n)
        out.append(F.substr(text, start + 1, F.greatest(end - start, F.lit(0))))
    return out


@step("SplitColumn")
def split_column(r, s, c):
    cell, mode, clean = r.cell(s["col"]), s.get("mode", "each"), s.get("trim", True) is not False
    text = F.when(~cell.failed, text_of(cell, export=True))
    delimiter = s.get("delimiter") or ","
    tidy = trim if clean else (lambda x: x)
    if mode == "rows":
        parts = F.posexplode_outer(F.split(text, re.escape(delimiter), -1)).alias("__at", "__part")
        df = r.df.select("*", parts)
        order = nested(F.col(ORDER), F.coalesce("__at", F.lit(0)))
        return r.build([(n, Cell(tidy(F.col("__part")), "text") if n == s["col"] else x) for n, x in r.cells()], df, order)
    if mode == "positions":
        places = sorted(int(m[0]) for p in str(s.get("positions", "")).split(",") if (m := re.match(r"\s*[-+]?\d+", p)))
        if not places:
            raise StepError("Enter one or more character positions, e.g. 0, 3, 7")
        pieces, most = F.array(*_positions(text, places)), len(places)
    elif mode in ("first", "last"):
        n = len(delimiter)
        # the last place is the first one in the reversed text
        at = F.instr(text, delimiter) if mode == "first" else F.length(text) - F.instr(F.reverse(text), delimiter[::-1]) - n + 2
        both = F.array(F.substr(text, F.lit(1), at - 1), F.substr(text, at + n))
        pieces, most = F.when(F.contains(text, F.lit(delimiter)), both).otherwise(F.array(text)), None
    else:
        pieces, most = F.split(text, re.escape(delimiter), -1), None
    count = int(s.get("count") or 0)
    if not count:
        count = most or r.df.agg(F.max(F.size(pieces)).alias("n")).first()["n"] or 1
    count = max(1, min(count, 200))
    taken = [n for n in r.names if n != s["col"]]
    cells = []
    for n, x in r.cells():
        if n != s["col"]:
            cells.append((n, x))
            continue
        for k in range(count):
            name = unique_name(f"{n}.{k + 1}", taken)
            taken.append(name)
            cells.append((name, Cell(F.when(text.isNotNull(), tidy(F.get(pieces, F.lit(k)))), "text")))
    return r.build(cells)


@step("MergeColumns")
def merge_columns(r, s, c):
    cols = s.get("cols", [])
    r.need(cols)
    if len(cols) < 2:
        raise StepError("Pick at least two columns to merge")
    texts = [F.when(~cell.failed, text_of(cell, export=True)) for _, cell in r.cells(cols)]
    merged = F.concat_ws(s.get("sep", " "), *(F.coalesce(t, F.lit("")) for t in texts))
    keep = [n for n in r.names if n not in cols]
    cells = r.cells(keep)
    cells.insert(min(r.names.index(n) for n in cols), (unique_name(s.get("name") or "Merged", keep), Cell(merged, "text")))
    return r.build(cells)


def _tree(kind, value=None, *args):
    return Node(kind, 0, 0, value, list(args))


def _typed(x, numeric):
    """What a user typed into a condition, as a number, date or text."""
    if x in ("", None):
        return _tree("literal")
    text = str(x)
    if numeric is not False and re.fullmatch(NUMERAL_TYPED, text, re.A) and abs(n := float(text)) < float("inf"):
        return _tree("literal", int(n) if n.is_integer() else n)
    return _tree("call", "Date.From", _tree("literal", text)) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) else _tree("literal", text)


NUMERAL_TYPED = r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*"
#: The conditions of the filter builder: comparisons, and tests of a text.
COMPARISONS = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
TEXT_TESTS = {"contains": "Text.Contains", "not_contains": "Text.Contains", "starts": "Text.StartsWith", "ends": "Text.EndsWith"}


def _condition(cond):
    op, column = cond["op"], _tree("column", cond["col"])
    if op in COMPARISONS:
        return _tree("binary", COMPARISONS[op], column, _typed(cond.get("value", ""), cond.get("numeric")))
    if op in TEXT_TESTS:
        test = _tree("call", TEXT_TESTS[op], _tree("call", "Text.From", column), _tree("literal", str(cond.get("value", ""))))
    elif op in ("null", "not_null"):
        return _tree("binary", "=" if op == "null" else "<>", column, _tree("literal"))
    elif op in ("in", "not_in"):
        test = _tree("binary", "in", column, _tree("list", None, *(_tree("literal", x) for x in cond.get("values", []))))
    else:
        return None
    return _tree("unary", "not", test) if op.startswith("not_") else test


def builder_tree(b):
    """The tree of a filter that was put together from conditions, or None if all rows pass."""
    conditions = [_condition(x) for x in (b or {}).get("conds", [])]
    by = "or" if (b or {}).get("join") == "or" else "and"
    conditions = [_tree("literal", True) if x is None else x for x in conditions]
    return functools.reduce(lambda x, y: _tree("binary", by, x, y), conditions) if conditions else None
