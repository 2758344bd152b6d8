"""An ordered table: a DataFrame with named, typed columns, error columns and a row order.

A column that may hold cell errors has a hidden partner with the error's message
(null: no error; the value is then null). Row order is one hidden column: a long, or a
struct that is compared from left to right (sort keys, a row's place within its
parent, a table's number). Nothing is sorted until a step needs positions, and hidden
columns that no step uses are pruned by Catalyst.

Steps that read the rows twice (positions, fills, running values) need an order that
every evaluation repeats; :meth:`Relation.settled` gives one.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import scratch
from tessella.types import SPARK_NAMES, SPARK_TYPES, StepError, closest, logical_type

ORDER = "__ord"
ERROR = "__err_"
BLOCK_BITS = 16
"""Rows whose order ids agree above these bits are numbered together."""
_ROW_BITS = 33
"""Bits of a row's number within its partition, in ids that Spark deals out."""
_DEALING = ("Join", "Aggregate", "Sort", "Repartition", "Rebalance", "Window", "Limit", "Distinct", "Union", "Offset", "Sample")
"""Plan nodes below which rows may lie elsewhere when the plan runs again."""


@lru_cache(maxsize=4_096)
def _column(name: str, gateway: int) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def ref(name: str) -> Column:
    """The column of exactly this name; made once for each connection to the JVM."""
    return _column(name, id(SparkContext._gateway))


def block_of(order: Column) -> Column:
    """The block of a settled id; rows without an order come first."""
    return F.shiftright(F.coalesce(order, F.lit(0).cast("long")), BLOCK_BITS)


def running_total(df: DataFrame, value: str, keys: list[Column], name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each one, in the order of ``keys``.

    The rows are sorted by ranges and written with their ids once; ranges are summed
    apart, so that no task sees all rows.
    """
    placed = scratch.materialize(df.orderBy(*keys).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__range", F.shiftright("__at", _ROW_BITS))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__range").agg(F.sum(value).alias("__sum"))
    starts = totals.select("__range", F.coalesce(F.sum("__sum").over(before(Window.orderBy("__range"))), F.lit(0)).alias("__start"))
    own = F.coalesce(F.sum(value).over(before(Window.partitionBy("__range").orderBy("__at"))), F.lit(0))
    return placed.join(starts, "__range").withColumn(name, F.col("__start") + own).drop("__range", "__start", "__at")


def nested(*parts: Column) -> Column:
    """An order of several parts, the first one first."""
    return F.struct(*(p.alias(f"o{k}") for k, p in enumerate(parts)))


def _leaves(kind: T.DataType, at: str) -> list[str]:
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _leaves(f.dataType, f"{at}.{f.name}")]
    return [at]


def order_columns(df: DataFrame, desc: bool = False) -> list[Column]:
    """What to sort by for the row order: a struct's parts one by one, which sorts faster than the struct."""
    return [F.col(x).desc() if desc else F.col(x).asc() for x in _leaves(df.schema[ORDER].dataType, ORDER)]


def _repeatable(df: DataFrame) -> bool:
    """Whether ids that the plan deals out are the same whenever it runs: none, or right above a scan."""
    root = df._jdf.queryExecution().optimizedPlan()
    if root.deterministic():
        return True
    plans = [root]
    while plans:
        plan = plans.pop()
        if any(x in plan.nodeName() for x in _DEALING):
            return False
        below = plan.children()
        plans += [below.apply(k) for k in range(below.size())]
    return True


@dataclass(frozen=True)
class Cell:
    """A value with its error message, as columns. ``err`` is None where no error can be."""

    value: Column
    type: str
    err: Column | None = None
    stored: str | None = None
    """The name of the relation's column that the cell is, if it is one as it stands."""

    @property
    def failed(self) -> Column:
        return F.lit(False) if self.err is None else self.err.isNotNull()


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    types: dict[str, str]
    errors: frozenset[str] = frozenset()

    @classmethod
    def of(cls, df: DataFrame, ordered: bool = True, order: Column | None = None) -> Relation:
        """A DataFrame as it comes; its rows are ordered as they are read, unless ``order`` says how."""
        types = {f.name: logical_type(f.dataType) for f in df.schema.fields}
        columns = []
        for f in df.schema.fields:
            kind, c = types[f.name], ref(f.name)
            if f.dataType.typeName() in ("array", "map", "struct"):
                c = F.to_json(c)
            elif f.dataType.typeName() == "binary":
                c = F.lower(F.hex(c))
            elif f.dataType != SPARK_TYPES[kind]:
                c = c.cast(SPARK_TYPES[kind])
            columns.append(c.alias(f.name))
        if order is None:
            order = F.monotonically_increasing_id() if ordered else F.lit(0).cast("long")
        return cls(df.select(*columns, order.alias(ORDER)), types)

    @property
    def names(self) -> list[str]:
        return list(self.types)

    @property
    def order(self) -> Column:
        return F.col(ORDER)

    def need(self, names: Iterable[str]) -> None:
        for n in names:
            if n not in self.types:
                like = closest(n, self.types)
                raise StepError(f"Column `{n}` not found", [f"Did you mean `{like}`?"] if like else [])

    def cell(self, name: str) -> Cell:
        self.need([name])
        return Cell(ref(name), self.types[name], ref(ERROR + name) if name in self.errors else None, name)

    def build(self, cells: Sequence[tuple[str, Cell]], df: DataFrame | None = None, order: Column | None = None) -> Relation:
        """A relation of these columns, over ``df`` or the same rows."""
        df = self.df if df is None else df
        columns, errors = [], set()
        for name, c in cells:
            as_is = c.stored == name
            columns.append(c.value if as_is else c.value.cast(SPARK_NAMES[c.type]).alias(name))
            if c.err is not None:
                columns.append(c.err if as_is else c.err.alias(ERROR + name))
                errors.add(name)
        order = ref(ORDER) if order is None else order.alias(ORDER)
        return Relation(df.select(*columns, order), {n: c.type for n, c in cells}, frozenset(errors))

    def cells(self, names: Iterable[str] | None = None) -> list[tuple[str, Cell]]:
        return [(n, self.cell(n)) for n in (self.names if names is None else names)]

    def select(self, names: Sequence[str]) -> Relation:
        self.need(names)
        return self.build(self.cells(names))

    def with_cell(self, name: str, cell: Cell, at: int | None = None) -> Relation:
        """Replaces a column in its place, or adds one (at the end, or at a place)."""
        if (at is None or name in self.types) and (cell.err is not None or name not in self.errors):
            new = {name: cell.value.cast(SPARK_NAMES[cell.type])}
            if cell.err is not None:
                new[ERROR + name] = cell.err
            return Relation(self.df.withColumns(new), self.types | {name: cell.type}, self.errors | ({name} if cell.err is not None else set()))
        cells = [(n, cell if n == name else c) for n, c in self.cells()]
        if name not in self.types:
            cells.insert(len(cells) if at is None else at, (name, cell))
        return self.build(cells)

    def where(self, condition: Column) -> Relation:
        return Relation(self.df.where(condition), self.types, self.errors)

    def over(self, df: DataFrame) -> Relation:
        """The same columns over other rows of the same schema."""
        return Relation(df, self.types, self.errors)

    def by_order(self, desc: bool = False) -> list[Column]:
        return order_columns(self.df, desc)

    def settled(self) -> Relation:
        """The same rows, ordered by a long that every evaluation repeats.

        Places in files are such an order already. Otherwise the rows are sorted by
        ranges once and written with their ids, so that what is derived from the ids
        later, in however many plans, is about the same rows.
        """
        if isinstance(self.df.schema[ORDER].dataType, T.LongType) and _repeatable(self.df):
            return self
        placed = self.df.orderBy(*self.by_order()).withColumn(ORDER, F.monotonically_increasing_id())
        return self.over(scratch.materialize(placed))

    def position(self, name: str = "__pos") -> DataFrame:
        """The rows with their dense position from 0, without sorting all rows in one task.

        Rows fall into blocks of their settled ids; blocks are counted, their counts
        are summed, and rows are numbered within their block.
        """
        df = self.settled().df.withColumn("__block", block_of(F.col(ORDER)))
        counts = df.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
        upto = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("__block", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"))
        within = Window.partitionBy("__block").orderBy(ORDER)
        placed = df.join(starts, "__block").withColumn(name, F.col("__start") + F.row_number().over(within) - 1)
        return placed.drop("__block", "__start")

    def output(self) -> DataFrame:
        """The visible columns; errors are null."""
        return self.df.select(*map(ref, self.names))

    def ordered(self) -> DataFrame:
        """The visible columns, sorted by row order."""
        return self.df.orderBy(*self.by_order()).select(*map(ref, self.names))

    def with_errors(self) -> DataFrame:
        """The visible columns, and for columns with errors ``<name>__error``."""
        return self.df.select(*map(ref, self.names), *(ref(ERROR + n).alias(f"{n}__error") for n in self.names if n in self.errors))
