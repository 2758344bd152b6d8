"""The formula functions: a registry of signatures and Spark builders.

A signature letter is t (text), n (number), d (date), a (anything) or L (a literal
list); ``?`` marks an optional argument, ``...`` a repeated one. A builder gets the
converted arguments and returns a column, or a pair of a column and an error message
column. Nulls and errors among the arguments are dealt with by the compiler.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessella.functions.casts import DAY_SECONDS, MONTHS, SPACE, half_up, trim
from tessella.relation import Cell


@dataclass(frozen=True)
class Function:
    name: str
    signature: tuple[str, ...]
    returns: str
    build: Callable | None


FUNCTIONS: dict[str, Function] = {}


def define(name: str, signature: str, returns: str, build: Callable | None = None) -> None:
    """Register a function; ``returns`` is a type or ``first`` (that of the first argument)."""
    FUNCTIONS[name] = Function(name, tuple(signature.split()), returns, build)


# ---- text

def _marks_stripper():
    def strip(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.category(c).startswith("M")))

    return F.pandas_udf(strip, StringType())  # a local function travels to the workers by itself


def strip_marks(text: Column) -> Column:
    """Without combining marks, after canonical decomposition (Spark has no normalisation)."""
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7f]")), _marks_stripper()(text)).otherwise(text)


def clean(t: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(t, r"[\x00-\x1f\x7f]", ""), f"{SPACE}+", " "))


def proper(t: Column) -> Column:
    """Capitals after anything that is not a letter, digit or apostrophe."""
    parts = F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}']+|[^\p{L}\p{N}']+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")


def fingerprint(t: Column, stripped: bool = False) -> Column:
    """The sorted distinct words, without case, accents and punctuation."""
    words = F.split(trim(F.regexp_replace(F.lower(t if stripped else strip_marks(t)), r"[^\p{L}\p{N}\s]+", " ")), r"\s+")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def ngram_fingerprint(t: Column, n: int = 2) -> Column:
    """The sorted distinct n-grams of text without marks: no case, punctuation and spaces."""
    s = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", "")
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda k: F.substring(s, k, F.lit(n)))
    return F.when(F.length(s) < n, s).otherwise(F.array_join(F.array_sort(F.array_distinct(grams)), ""))


def slice_text(t: Column, start: Column, count: Column | None) -> Column:
    """From a 0-based place, counted from the end if negative."""
    n = F.length(t)
    at = F.when(start < 0, F.greatest(n + start, F.lit(0))).otherwise(start)
    return F.substr(t, at + 1, F.greatest(count, F.lit(0)) if count is not None else n)


def whole(x: Column) -> Column:
    """As an int, the fraction cut off."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("int")


def pad(t: Column, n: Column, fill: Column | None, side: Callable) -> Column:
    fill = F.lit(" ") if fill is None else F.when(fill == "", F.lit(" ")).otherwise(fill)
    return side(t, F.greatest(whole(n), F.length(t)), fill)


def similarity(a: Column, b: Column) -> Column:
    a, b = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


define("Text.Upper", "t", "text", F.upper)
define("Text.Lower", "t", "text", F.lower)
define("Text.Proper", "t", "text", proper)
define("Text.Trim", "t", "text", trim)
define("Text.Clean", "t", "text", clean)
define("Text.Length", "t", "int", F.length)
define("Text.Start", "t n", "text", lambda t, n: F.when(n < 0, F.substr(t, F.lit(1), F.greatest(F.length(t) + whole(n), F.lit(0)))).otherwise(F.substr(t, F.lit(1), whole(n))))
define("Text.End", "t n", "text", lambda t, n: F.when(n <= 0, F.lit("")).otherwise(F.right(t, whole(n))))
define("Text.Middle", "t n n?", "text", lambda t, n, c=None: slice_text(t, whole(n), None if c is None else F.coalesce(whole(c), F.length(t))))
define("Text.Contains", "t t", "bool", F.contains)
define("Text.StartsWith", "t t", "bool", F.startswith)
define("Text.EndsWith", "t t", "bool", F.endswith)
define("Text.Replace", "t t t", "text", lambda t, a, b: F.when(a == "", t).otherwise(F.replace(t, a, b)))
define("Text.PadStart", "t n t?", "text", lambda t, n, f=None: pad(t, n, f, F.lpad))
define("Text.PadEnd", "t n t?", "text", lambda t, n, f=None: pad(t, n, f, F.rpad))
define("Text.BeforeDelimiter", "t t", "text", lambda t, d: F.when(d == "", F.lit("")).when(F.contains(t, d), F.substr(t, F.lit(1), F.instr(t, d) - 1)).otherwise(t))
define("Text.AfterDelimiter", "t t", "text", lambda t, d: F.when(F.contains(t, d), F.substr(t, F.instr(t, d) + F.length(d))).otherwise(F.lit("")))
define("Text.Repeat", "t n", "text", lambda t, n: F.repeat(t, F.greatest(whole(n), F.lit(0))))
define("Text.From", "a", "text")
define("Text.Combine", "a...", "text")
define("Text.RegexMatch", "t t", "bool", F.rlike)


def regex_extract(t: Column, pattern: Column, group: Column | None = None) -> Column:
    """Null without a match; a group that took no part in it is null as well."""
    group = F.lit(0) if group is None else F.coalesce(whole(group), F.lit(0))
    return F.when(F.rlike(t, pattern), F.nullif(F.call_function("regexp_extract", t, pattern, group), F.lit("")))


define("Text.RegexExtract", "t t n?", "text", regex_extract)
define("Text.RegexReplace", "t t t", "text", lambda t, p, r: F.regexp_replace(t, p, r))
define("Text.RemoveDiacritics", "t", "text", strip_marks)
define("Text.Fingerprint", "t", "text", fingerprint)
define("Text.Similarity", "t t", "number", similarity)


# ---- numbers

def half_even(x: Column, digits: Column | None = None) -> Column:
    if digits is None:
        return F.rint(x)
    f = F.pow(F.lit(10.0), F.coalesce(digits, F.lit(0.0)))
    return F.rint(x * f) / f


def guarded(good: Column, value: Column, message: str) -> tuple[Column, Column]:
    return F.when(good, value), F.when(~good, F.lit(message))


def modulo(x: Column, y: Column) -> tuple[Column, Column]:
    safe = F.nullif(y, F.lit(0.0))
    return guarded(y != 0, ((x % safe) + safe) % safe, "Division by zero")


define("Number.Round", "n n?", "number", half_even)
define("Number.RoundUp", "n", "int", lambda x: F.ceil(x))
define("Number.RoundDown", "n", "int", lambda x: F.floor(x))
define("Number.Abs", "n", "first", F.abs)
define("Number.Sign", "n", "int", lambda x: F.signum(x).cast("long"))
define("Number.Mod", "n n", "number", modulo)
define("Number.IntegerDivide", "n n", "int", lambda x, y: guarded(y != 0, F.floor(F.try_divide(x, y)), "Division by zero"))
define("Number.Power", "n n", "number", F.pow)
define("Number.Sqrt", "n", "number", lambda x: guarded(x >= 0, F.sqrt(x), "Square root of a negative number"))
define("Number.Log", "n", "number", lambda x: guarded(x > 0, F.ln(x), "Log of a non-positive number"))
define("Number.From", "a", "number")
define("Number.Clamp", "n n n", "number", lambda x, lo, hi: F.least(hi, F.greatest(lo, x)))


# ---- dates

def add_days(d: Cell, n: Column) -> Column:
    moved = F.timestamp_add("MICROSECOND", F.floor(n * (DAY_SECONDS * 1_000_000) + 0.5).cast("long"), d.value.cast("timestamp_ntz"))
    return moved.cast("date") if d.type == "date" else moved


def add_months(d: Cell, n: Column) -> Column:
    n = whole(n)
    return F.add_months(d.value, n) if d.type == "date" else F.timestamp_add("MONTH", n, d.value)


def diff_days(a: Column, b: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", a.cast("timestamp_ntz"), b.cast("timestamp_ntz"))
    return half_up(micros / float(DAY_SECONDS * 1_000_000)).cast("long")


def month_name(d: Column) -> Column:
    return F.element_at(F.array(*(F.lit(m.capitalize()) for m in MONTHS)), F.month(d))


#: Tokens of date formats, the longest first.
FORMAT_TOKENS = ("yyyy", "MMMM", "MMM", "MM", "dd", "HH", "mm", "ss")


def date_text(d: Column, fmt: Column | None, literal: str | None) -> Column:
    """Replaces the format's tokens; everything else stays as it is."""
    if not literal:
        return F.date_format(d, "yyyy-MM-dd")
    out, at, plain = [], 0, ""
    while at < len(literal):
        token = next((t for t in FORMAT_TOKENS if literal.startswith(t, at)), None)
        if token:
            out += [F.lit(plain), month_name(d) if token == "MMMM" else F.substring(month_name(d), 1, 3) if token == "MMM" else F.date_format(d, token)]
            plain, at = "", at + len(token)
        else:
            plain, at = plain + literal[at], at + 1
    return F.concat(*out, F.lit(plain))


def make_date(y: Column, m: Column, d: Column) -> Column:
    """Months and days may run over."""
    y, m, d = whole(y), whole(m), whole(d)
    y = F.when((y >= 0) & (y < 100), y + 1900).otherwise(y)
    first = F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1)
    return F.date_add(first, d - 1)


define("Date.Year", "d", "int", F.year)
define("Date.Month", "d", "int", F.month)
define("Date.Day", "d", "int", F.dayofmonth)
define("Date.Quarter", "d", "int", F.quarter)
define("Date.WeekOfYear", "d", "int", F.weekofyear)
define("Date.DayOfWeek", "d", "int", lambda d: F.weekday(d) + 1)
define("Date.MonthName", "d", "text", month_name)
define("Date.DayOfWeekName", "d", "text", lambda d: F.date_format(d, "EEEE"))
define("Date.AddDays", "d n", "first")
define("Date.AddMonths", "d n", "first")
define("Date.StartOfMonth", "d", "date", lambda d: F.trunc(d, "MM"))
define("Date.EndOfMonth", "d", "date", lambda d: F.last_day(d))
define("Date.DiffDays", "d d", "int", diff_days)
define("Date.From", "a", "date")
define("Date.ToText", "d t?", "text")
define("#date", "n n n", "date", make_date)

# ---- logic

define("Coalesce", "a...", "first")
define("Value.IsNull", "a", "bool")
define("Value.IsError", "a", "bool")
define("List.Contains", "L a", "bool")
