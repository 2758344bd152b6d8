"""Logical types, locales, names and errors shared by the whole engine."""

from __future__ import annotations

import difflib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import types as T

#: Logical types with their labels in messages.
TYPES = {
    "any": "Any",
    "text": "Text",
    "number": "Decimal number",
    "int": "Whole number",
    "bool": "True/False",
    "date": "Date",
    "datetime": "Date/Time",
}

SPARK_TYPES = {
    "any": T.StringType(),
    "text": T.StringType(),
    "number": T.DoubleType(),
    "int": T.LongType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
}

SPARK_NAMES = {k: t.simpleString() for k, t in SPARK_TYPES.items()}


@dataclass(frozen=True)
class Locale:
    decimal: str
    day_first: bool


#: Number and date conventions.
LOCALES = {
    "en-US": Locale(".", False),
    "en-GB": Locale(".", True),
    "de-DE": Locale(",", True),
    "fr-FR": Locale(",", True),
}


def locale(name: str | None) -> Locale:
    return LOCALES.get(name or "en-US", LOCALES["en-US"])


class StepError(Exception):
    """A step can't run; ``fixes`` are suggestions to the user."""

    def __init__(self, message: str, fixes: list[str] | None = None):
        super().__init__(message)
        self.fixes = fixes or []


class FormulaError(Exception):
    """A formula is wrong at ``start:end``; ``hint`` says what to do."""

    def __init__(self, message: str, start: int = 0, end: int = 0, hint: str = ""):
        super().__init__(message)
        self.start, self.end, self.hint = start, end, hint


def closest(name: str, names: Iterable[str]) -> str | None:
    """The name most like ``name``, if any is like it at all."""
    by_lower = {n.lower(): n for n in names}
    found = difflib.get_close_matches(name.lower(), list(by_lower), 1, 0.6)
    return by_lower[found[0]] if found else None


def unique_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or ``name_1``, ``name_2`` and so on if it is taken."""
    taken, k, out = set(taken), 0, name
    while out in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def unique_names(names: Iterable[str | None]) -> list[str]:
    """Headers as column names: trimmed, blank ones numbered by place, all distinct."""
    out: list[str] = []
    for k, n in enumerate(names):
        out.append(unique_name((n or "").strip() or f"Column{k + 1}", out))
    return out


def logical_type(kind: T.DataType) -> str:
    """The logical type that a Spark column is read as."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(kind, T.StringType):
        return "text"
    return "any"
