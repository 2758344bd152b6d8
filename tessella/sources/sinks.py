"""Writing relations. Folders are written by Spark's commit protocol, single files by a rename."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessella.functions.casts import text_of
from tessella.relation import Relation
from tessella.types import StepError


def export_columns(r: Relation):
    """Every column as text for delimited files: errors as #ERROR, TRUE and FALSE, ISO dates."""
    return [F.when(x.failed, F.lit("#ERROR")).otherwise(text_of(x, export=True)).alias(n) for n, x in r.cells()]


def write(r: Relation, path: str, kind: str, *, ordered: bool = False, limit: int | None = None) -> None:
    """``kind``: csv, tsv, parquet (folders), or arrow, xlsx (single files, made by the driver).

    With ``ordered`` the rows are written in row order, sorted by ranges.
    """
    df = r.df
    if limit is not None:
        df = df.orderBy(*r.by_order()).limit(limit)
    elif ordered or kind in ("arrow", "xlsx"):
        df = df.orderBy(*r.by_order())
    if kind in ("csv", "tsv"):
        out = df.select(*export_columns(r)).write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "")
        out.option("sep", "," if kind == "csv" else "\t").option("lineSep", "\r\n" if kind == "csv" else "\n").csv(path)
    elif kind == "parquet":
        r.over(df).output().write.parquet(path)
    elif kind in ("arrow", "xlsx"):
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        try:
            (_write_arrow if kind == "arrow" else _write_xlsx)(r.over(df), temporary)
            os.replace(temporary, path)
        finally:
            if os.path.exists(temporary):
                os.remove(temporary)
    else:
        raise StepError(f"Unknown file kind {kind}")


def _write_arrow(r: Relation, path: str) -> None:
    import pyarrow as pa

    table = r.output().toArrow()
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as out:
        out.write_table(table)


def _write_xlsx(r: Relation, path: str) -> None:
    from tessella.sources.excel import write_excel

    columns = [F.when(x.failed, F.lit("#ERROR")).otherwise(x.value) if x.type in ("text", "any") else x.value for _, x in r.cells()]
    write_excel(path, r.names, r.df.select(*(c.alias(f"c{k}") for k, c in enumerate(columns))))
