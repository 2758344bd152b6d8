"""Steps that a look at a bounded sample suggests."""

from __future__ import annotations

import re

from tessella.relation import Relation, ref
from tessella.sources.files import detect_header, infer_type

SAMPLE_ROWS = 20_000


def suggestions(r: Relation, rows: int = SAMPLE_ROWS) -> list[dict]:
    """Each has ``reason`` and ``step``."""
    sample = r.df.orderBy(*r.by_order()).limit(rows).select(*map(ref, r.names)).toPandas()
    out: list[dict] = []

    def add(reason, **step):
        out.append({"reason": reason, "step": step})

    if not len(sample):
        return out
    if all(re.fullmatch(r"Column\d+", n) for n in r.names):
        at, sure = detect_header(sample.head(15).astype(object).where(sample.head(15).notna(), None).values.tolist())
        if sure >= 0.6:
            add(f"Row {at + 1} looks like column names", type="PromoteHeaders", row=at)
    blank = (sample.isna() | (sample == "")).all(axis=1)
    if blank.any():
        add(f"{int(blank.sum())} blank rows", type="KeepRows", mode="remove_blank")
    texts = [n for n in r.names if r.types[n] in ("text", "any")]
    changes = [{"col": n, "type": k} for n in texts if (k := infer_type(sample[n].dropna().astype(str))) != "text"]
    if changes:
        add("Columns hold values of one type", type="ChangeType", changes=changes, onError="error")
    spaced = [n for n in texts if sample[n].dropna().astype(str).map(lambda v: v != v.strip()).any()]
    if spaced:
        add("Values begin or end with spaces", type="TextTransform", op="trim", cols=spaced)
    for n in texts:
        filled = sample[n].notna()
        if len(sample) >= 6 and filled.iloc[0] and 0.1 < filled.mean() < 0.6 and sample.loc[filled, n].nunique() == filled.sum():
            add(f"{n} is filled only where it changes", type="FillDown", cols=[n])
    first = r.names[0]
    totals = sample[first].dropna().astype(str).map(lambda v: bool(re.match(r"(?i)\s*(grand |sub)?total\b", v)))
    if totals.any():
        from tessella.formula import quote_column

        add("Rows with subtotals", type="Filter", mode="advanced", formula=f'not Text.RegexMatch(Text.Lower(Coalesce(Text.From({quote_column(first)}), "")), "^\\s*(grand |sub)?total\\b")')
    failing = sorted(r.errors)
    if failing:
        add("Columns hold errors", type="ReplaceErrors", cols=failing, value="")
    return out
