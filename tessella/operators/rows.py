"""Filters and row steps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import scratch
from tessella.functions.casts import sort_key, text_of
from tessella.operators.base import step
from tessella.operators.columns import builder_tree
from tessella.operators.joining import append_relations
from tessella.relation import ORDER, Cell, Relation, nested, ref
from tessella.types import StepError, unique_names


@step("Filter")
def filter_rows(r, s, c):
    source = builder_tree(s.get("builder")) if s.get("mode") == "builder" else (s.get("formula") or "true").strip()
    if source in (None, "true"):
        return r
    cell = c.formula(source, r)
    if cell.type not in ("bool", "any"):
        raise StepError("The filter must be True/False")
    # a null condition drops the row as it is: the bare predicate reaches the scan
    return r.where(cell.value)


def key_columns(r, names):
    """Grouping columns: all errors of a column are one value."""
    out = []
    for _, cell in r.cells(names):
        out.append(cell.value)
        if cell.err is not None:
            out.append(cell.err.isNotNull())
    return out


@step("Distinct")
def distinct(r, s, c):
    keys = key_columns(r, s.get("subset") or r.names)
    if not s.get("subset"):
        # whole rows: any of equal rows will do, the first one's place is kept
        df = r.df.groupBy(*map(ref, (x for x in r.df.columns if x != ORDER))).agg(F.min(ORDER).alias(ORDER))
        return r.over(df.select(*map(ref, r.df.columns)))
    # combined on the map side: a frequent value is no hot window
    first = r.df.groupBy(*keys).agg(F.min_by(F.struct(*map(ref, r.df.columns)), ORDER).alias("__row"))
    return r.over(first.select(*(F.col("__row")[x].alias(x) for x in r.df.columns)))


@step("KeepDuplicates")
def keep_duplicates(r, s, c):
    """Rows whose key occurs more than once: keys are counted on the map side, then rows look their key up."""
    keys = [k.alias(f"__k{j}") for j, k in enumerate(key_columns(r, s.get("subset") or r.names))]
    repeated = r.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    same = F.lit(True)
    for j, k in enumerate(key_columns(r, s.get("subset") or r.names)):
        same = same & k.eqNullSafe(repeated[f"__k{j}"])
    return r.over(r.df.join(repeated, same, "left_semi"))


@step("KeepRows")
def keep_rows(r, s, c):
    mode, n, offset = s.get("mode", "top"), max(0, int(s.get("n") or 0)), max(0, int(s.get("offset") or 0))
    if mode == "top":
        return r.over(r.df.orderBy(*r.by_order()).limit(n))
    if mode == "bottom":
        return r.over(r.df.orderBy(*r.by_order(desc=True)).limit(n))
    if mode == "remove_blank":
        empty = [c_.value.isNull() & ~c_.failed if c_.type not in ("text", "any") else (F.coalesce(c_.value, F.lit("")) == "") & ~c_.failed for _, c_ in r.cells()]
        all_empty = empty[0]
        for e in empty[1:]:
            all_empty = all_empty & e
        return r.where(~all_empty)
    r = r.settled()
    df, at = r.position(), F.col("__pos")
    if mode == "range":
        df = df.where((at >= offset) & (at < offset + n))
    elif mode == "remove_top":
        df = df.where(at >= n)
    elif mode == "remove_bottom":
        df = df.where(at < r.df.count() - n)
    elif mode == "alternate":
        keep, skip = max(1, int(s.get("keep") or 1)), max(1, int(s.get("skip") or 1))
        df = df.where((at >= offset) & ((at - offset) % (keep + skip) < keep))
    else:
        raise StepError(f"Unknown way to keep rows: {mode}")
    return r.over(df.drop("__pos"))


def xorshift(seed: int):
    """Uniform numbers in [0, 1) of the 32-bit xorshift generator (13, 17, 5)."""
    x = seed % (1 << 32) or 0x9E3779B9
    while True:
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        yield x / (1 << 32)


def sample_positions(n: int, k: int, seed: int) -> list[int]:
    """The first k places of a seeded shuffle of n; only the places that were exchanged are kept."""
    moved: dict[int, int] = {}
    out = []
    for i, u in zip(range(k), xorshift(seed), strict=False):
        j = i + math.floor(u * (n - i))
        out.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return out


@step("Sample")
def sample(r, s, c):
    """Exactly k rows in input order. The k places are drawn on the driver; with ``fast`` Spark samples a share."""
    if s.get("fast"):
        return r.over(r.df.sample(min(1.0, float(s.get("percent") or 0) / 100), int(s.get("seed") or 42)))
    r = r.settled()
    n = r.df.count()
    k = math.floor(n * max(0.0, min(100.0, float(s.get("percent") or 0))) / 100 + 0.5) if s.get("mode") == "percent" else max(0, int(float(s.get("n") or 0)))
    if k >= n:
        return r
    seed = s.get("seed", 42)
    places = sample_positions(n, k, 42 if seed in ("", None) else int(seed))
    chosen = r.df.sparkSession.createDataFrame([(p,) for p in places], "__pos long")
    return r.over(r.position().join(chosen, "__pos", "left_semi").drop("__pos"))


@step("PromoteHeaders")
def promote_headers(r, s, c):
    """A row becomes the names; the rows up to it go. Types stay text until they are changed."""
    at = int(s.get("row") or 0)
    r = r.settled()
    first = r.df.orderBy(ORDER).limit(at + 1).select(ORDER, *(text_of(x, export=True).alias(n) for n, x in r.cells())).collect()
    if len(first) <= at:
        raise StepError(f"There is no row {at + 1}")
    row = sorted(first, key=lambda x: x[ORDER])[at]
    names = unique_names(row[n] for n in r.names)
    below = r.where(F.col(ORDER) > F.lit(row[ORDER]))
    return below.build([(new, x) for new, (_, x) in zip(names, below.cells(), strict=True)])


@step("DemoteHeaders")
def demote_headers(r, s, c):
    names = [f"Column{k + 1}" for k in range(len(r.names))]
    body = r.build([(new, Cell(text_of(x, export=True), "any", x.err)) for new, (_, x) in zip(names, r.cells(), strict=True)])
    head = r.df.sparkSession.createDataFrame([tuple(r.names)], ", ".join(f"`{n}` string" for n in names))
    head = Relation(head.withColumn(ORDER, F.lit(0).cast("long")), dict.fromkeys(names, "any"))
    return append_relations([head, body])


def _failed(r, cols):
    failed = F.lit(False)
    for _, cell in r.cells(cols or r.names):
        if cell.err is not None:
            failed = failed | cell.err.isNotNull()
    return failed


@step("RemoveErrors")
def remove_errors(r, s, c):
    return r.where(~_failed(r, s.get("cols")))


@step("KeepErrors")
def keep_errors(r, s, c):
    return r.where(_failed(r, s.get("cols")))


@step("Checkpoint")
def checkpoint(r, s, c):
    """Buffers the rows where executors can find them again; identity."""
    return r if r.df.isStreaming else r.over(r.df.persist())


def sort_columns(r, by, c):
    """A text's order is natural; nulls and errors come last, in both directions, unless said otherwise."""
    out = []
    for b in by:
        key = sort_key(r.cell(b["col"]), c.natural)
        last = b.get("nullsLast", True) is not False
        out.append((key.desc_nulls_last() if last else key.desc_nulls_first()) if b.get("desc") else (key.asc_nulls_last() if last else key.asc_nulls_first()))
    return out


def _falling(key, kind):
    """A key that rises where ``key`` falls, or None where there is no such expression."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.bitwise_not(key)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.struct(~F.isnan(key), -key) if not isinstance(kind, T.DecimalType) else -key
    if isinstance(kind, T.BooleanType):
        return ~key
    if isinstance(kind, T.DateType):
        return F.bitwise_not(F.unix_date(key))
    if isinstance(kind, T.TimestampNTZType):
        return F.lit("1970-01-01").cast("timestamp_ntz") - key
    if kind == T.StringType():
        # code points fall as the digits of their bytes' complement rise; the end comes after every digit
        return F.concat(F.translate(F.hex(key), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    return None


@step("Sort")
def sort(r, s, c):
    """A stable range-partitioned sort; the sort keys become the first parts of the row order."""
    by = sort_columns(r, s["by"], c)
    keys = r.df.select(*(sort_key(r.cell(b["col"]), c.natural).alias(f"k{j}") for j, b in enumerate(s["by"]))).schema
    parts = []
    for b, f in zip(s["by"], keys.fields, strict=True):
        key = sort_key(r.cell(b["col"]), c.natural)
        last = b.get("nullsLast", True) is not False
        rising = _falling(key, f.dataType) if b.get("desc") else key
        parts += [key.isNull() if last else key.isNotNull(), rising]
    done = r.df.orderBy(*by, *r.by_order())
    if any(p is None for p in parts):  # a collation can't be turned round: the place is written down
        return r.over(scratch.materialize(done.withColumn(ORDER, F.monotonically_increasing_id())))
    return r.over(done.withColumn(ORDER, nested(*parts, F.col(ORDER))))


@step("Page")
def page(r, s, c):
    return keep_rows(r, {"mode": "range", "n": s.get("count", 200), "offset": s.get("offset", 0)}, c)


