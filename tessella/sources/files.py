"""Files, folders and entered data as relations."""

from __future__ import annotations

import csv
import fnmatch
import io
import itertools
import json
import re
from collections.abc import Iterable, Mapping, Sequence
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.joining import append_relations
from tessella.relation import ORDER, Cell, Relation, nested, ref
from tessella.types import StepError, unique_names

#: File kinds by extension.
FILE_KINDS = {
    "xlsx": "excel", "xlsm": "excel", "csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "ndjson": "json", "jsonl": "json",
    "parquet": "parquet", "pq": "parquet", "arrow": "arrow", "feather": "arrow", "ipc": "arrow", "arrows": "arrow",
}
SNIFF_BYTES = 65_536
DELIMITERS = (",", ";", "\t", "|")


def file_kind(path: str) -> str:
    kind = FILE_KINDS.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
    if kind is None:
        raise StepError(f"Files of this kind can't be read: {path}")
    return kind


def head_bytes(spark: SparkSession, path: str, n: int = SNIFF_BYTES) -> bytes:
    """The first bytes of a file, or of a folder's first file that isn't empty, by Spark's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        inside = [f.getPath() for f in fs.listStatus(p) if f.isFile() and f.getLen() and not re.match(r"[._]", f.getPath().getName())]
        if not inside:
            return b""
        p = sorted(inside, key=lambda x: x.getName())[0]
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def all_bytes(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    if not rows:
        raise StepError(f"File not found: {path}")
    return bytes(rows[0]["content"])


def detect_encoding(data: bytes) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if data.startswith(mark):
            return name
    for cut in range(4 if len(data) >= SNIFF_BYTES else 1):  # a sample may end within a character
        try:
            data[: len(data) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "windows-1252"


def _rows(text: str, delimiter: str) -> list[list[str]]:
    return [x for x in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if x]


def sniff_csv(data: bytes) -> dict[str, Any]:
    """Delimiter, locale, header and encoding of the beginning of a file."""
    encoding = detect_encoding(data)
    text = data.decode(encoding, "replace").lstrip("﻿")
    if len(data) >= SNIFF_BYTES:
        text = text[: text.rfind("\n") + 1] or text
    best, chosen, grid = -1.0, ",", []
    for d in DELIMITERS:
        rows = _rows(text, d)[:200]
        if not rows:
            continue
        widths = [len(x) for x in rows]
        usual = max(set(widths), key=widths.count)
        score = widths.count(usual) / len(widths) * (1 + 0.1 * min(usual, 20)) if usual > 1 else 0.0
        if score > best:
            best, chosen, grid = score, d, rows
    cells = [c.strip() for row in grid[1:50] for c in row]
    commas = sum(bool(re.fullmatch(r"-?[\d.]*\d,\d+", c)) for c in cells)
    points = sum(bool(re.fullmatch(r"-?[\d,]*\d\.\d+", c)) for c in cells)
    header, confidence = detect_header(grid)
    return {"delimiter": chosen, "locale": "de-DE" if chosen != "," and commas > points else "en-US", "header": header == 0 and confidence >= 0.5, "headerRow": header, "encoding": encoding}


def detect_header(grid: Sequence[Sequence[Any]]) -> tuple[int, float]:
    """The row that most looks like column names, and how sure that is."""
    best, at = 0.0, 0
    for k, row in enumerate(grid[:10]):
        filled = [str(c).strip() for c in row if c not in (None, "") and str(c).strip()]
        if not filled or not row:
            continue
        texts = [c for c in filled if not re.fullmatch(r"[-+]?[\d.,]+%?|\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}", c)]
        below = [str(c) for r in grid[k + 1 : k + 6] for c in r if c not in (None, "")]
        change = sum(bool(re.fullmatch(r"[-+]?[\d.,]+%?|\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}.*", c)) for c in below) / max(len(below), 1)
        score = 0.4 * len(texts) / len(filled) + 0.2 * len(set(filled)) / len(filled) + 0.3 * len(filled) / max(len(row), max(map(len, grid[:10]))) + 0.1 * change
        if score > best + 0.02:
            best, at = score, k
    return at, round(best, 3)


def csv_shapes(spark: SparkSession, paths: Sequence[str], delimiter: str, name: Column | None = None) -> dict[str, dict[str, Any]]:
    """What all lines of each file are like, by one pass over all of them in parallel.

    ``width``: the most cells of a line; ``spans``: a quoted cell may span lines, as
    some line has an odd number of quotes; ``junk``: quotes stand where none belong.
    """
    lines = spark.read.text(list(paths)).select(F.col("value").alias("x"), (F.lit("") if name is None else name).alias("name"))
    quotes = F.length("x") - F.length(F.replace("x", F.lit('"'), F.lit("")))
    d = re.escape(delimiter)
    # well-formed quoted cells go; a quote that stays is out of place
    bare = F.when(quotes == 0, F.col("x")).otherwise(F.regexp_replace("x", rf'(?<=^|{d})"(?:[^"]|"")*"(?=$|{d})', ""))
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1
    found = lines.groupBy("name").agg(F.max(cells).alias("width"), F.max(quotes % 2 == 1).alias("spans"), F.max(F.contains(bare, F.lit('"'))).alias("junk"))
    return {x["name"]: x.asDict() for x in found.collect()}


#: Encodings in which the bytes of delimiters and quotes stand for nothing else.
PLAIN = ("UTF-8", "WINDOWS-1252", "ISO-8859-1", "US-ASCII")
NO_LINES = {"width": 0, "spans": False, "junk": False}


def _csv_layout(spark: SparkSession, path: str, options: Mapping[str, Any]) -> dict[str, Any]:
    """How a file is to be read, by its options and its beginning; ``first`` are its header's cells."""
    head = head_bytes(spark, path)
    found = sniff_csv(head) if not {"delimiter", "encoding"} <= options.keys() else {}
    delimiter, encoding = options.get("delimiter") or found["delimiter"], options.get("encoding") or found["encoding"]
    header, skip = bool(options.get("header", True)), int(options.get("skipRows") or 0)
    plain = encoding.upper().replace("_", "-") in PLAIN and len(delimiter) == 1 and not skip and not options.get("exact")
    first = tuple(next(iter(_rows(head.decode(encoding, "replace").lstrip("\ufeff"), delimiter)), ())) if header else ()
    return {"delimiter": delimiter, "encoding": encoding, "header": header, "skip": skip, "plain": plain, "first": first}


def _read_csv_lines(spark: SparkSession, paths: Sequence[str], layout: Mapping[str, Any], width: int, name: Column | None = None) -> Relation:
    """Files of one layout whose records are lines: one scan, split among tasks."""
    first = layout["first"]
    width = max(width, len(first), 1)
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(width)])
    reader = spark.read.schema(schema).option("sep", layout["delimiter"]).option("quote", '"').option("escape", '"').option("encoding", layout["encoding"]).option("header", layout["header"]).option("enforceSchema", True)
    cells = [F.when(ref(f"c{k}") != "", ref(f"c{k}")).alias(n) for k, n in enumerate(unique_names([*first, *[None] * (width - len(first))]))]
    df = reader.csv(list(paths))
    if name is None:
        return Relation.of(df.select(*cells))
    return Relation(df.select(*cells, nested(name, F.monotonically_increasing_id()).alias(ORDER)), dict.fromkeys(df.select(*cells).columns, "text"))


def read_csv(spark: SparkSession, path: str, options: Mapping[str, Any] | None = None) -> Relation:
    """All columns are text; '' is null; cells beyond the header become ``Column<n>``.

    The whole file decides how it is read. Where every line is a record, the reader
    splits the file among tasks; where a quoted cell may span lines, or quotes are out
    of place, an exact parser takes each file in one task.
    """
    layout = _csv_layout(spark, path, options or {})
    shape = csv_shapes(spark, [path], layout["delimiter"]).get("", NO_LINES) if layout["plain"] else None
    if shape is None or shape["spans"] or shape["junk"]:
        return _read_csv_exact(spark, path, layout["delimiter"], layout["header"], layout["encoding"], layout["skip"])
    return _read_csv_lines(spark, [path], layout, shape["width"])


def _read_csv_folder(spark: SparkSession, folder: str, files: Sequence[tuple[str, str]], options: Mapping[str, Any], column: str | None) -> Relation:
    """Files of one layout are read together, however many there are; only oddly quoted ones are read one by one."""
    base = re.escape(folder.rstrip("/").rsplit("/", 1)[-1])
    path = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    name = F.regexp_extract(F.coalesce(path, F.col("_metadata.file_path")), rf"^.*/{base}/([^/]+)", 1)
    layouts = {n: _csv_layout(spark, p, options) for n, p in files}
    shapes: dict[str, dict[str, Any]] = {}
    for d in {x["delimiter"] for x in layouts.values() if x["plain"]}:
        shapes |= csv_shapes(spark, [p for n, p in files if layouts[n]["plain"] and layouts[n]["delimiter"] == d], d, name)
    together: dict[tuple, list[tuple[str, str]]] = {}
    parts, orders = [], []
    for n, p in files:
        x, shape = layouts[n], shapes.get(n, NO_LINES)
        if not x["plain"] or shape["spans"] or shape["junk"]:
            r = _read_csv_exact(spark, p, x["delimiter"], x["header"], x["encoding"], x["skip"])
            parts.append(r.build([(column, Cell(F.lit(n), "text")), *r.cells()]) if column else r)
            orders.append(nested(F.lit(n), F.col(ORDER)))
        else:
            together.setdefault((x["delimiter"], x["header"], x["encoding"], x["first"]), []).append((n, p))
    for group in together.values():
        r = _read_csv_lines(spark, [p for _, p in group], layouts[group[0][0]], max(shapes.get(n, NO_LINES)["width"] for n, _ in group), name)
        parts.append(r.build([(column, Cell(F.col(ORDER)["o0"], "text")), *r.cells()]) if column else r)
        orders.append(F.col(ORDER))
    return append_relations(parts, orders)


def _read_csv_exact(spark, path, delimiter, header, encoding, skip) -> Relation:
    """Parses each file as a whole in one task, as quotes may span lines."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                text = io.TextIOWrapper(io.BytesIO(content), encoding="utf-8-sig" if encoding.upper() == "UTF-8" else encoding, errors="replace", newline="")
                records = itertools.islice((r for r in csv.reader(text, delimiter=delimiter) if r), skip, None)
                for at, part in zip(itertools.count(0, 10_000), iter(lambda records=records: list(itertools.islice(records, 10_000)), []), strict=False):
                    yield pd.DataFrame({"at": range(at, at + len(part)), "cells": [[c if c != "" else None for c in r] for r in part]})

    grid = files.mapInPandas(parse, "at long, cells array<string>").withColumn("__f", F.monotonically_increasing_id())
    width = grid.agg(F.max(F.size("cells")).alias("n")).first()["n"] or 0
    head: list[str | None] = [None] * width
    if header:
        first = grid.where("at = 0").limit(1).collect()
        head = list(first[0]["cells"]) if first else head
        grid = grid.where("at > 0")
    names = unique_names([*head, *[None] * (width - len(head))])
    return Relation.of(grid.select(*(F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names))))


def read_json(spark: SparkSession, path: str) -> Relation:
    """An array of objects, an object with one, or one object a line. Nested values become JSON text."""
    data = head_bytes(spark, path)
    head = data.decode("utf-8", "replace").lstrip("﻿ \t\r\n")
    if head.startswith("{") and "\n" not in head and len(data) >= SNIFF_BYTES:  # the first line is longer than the look at it
        found = spark.read.text(path).where(F.trim("value") != "").select(F.json_object_keys("value").isNotNull().alias("whole")).take(2)
        head += "}" if len(found) > 1 and found[0]["whole"] else ""
    lines = head.startswith("{") and bool(re.match(r"\{.*\}\s*(\n\s*\{|$)", head.split("\n", 1)[0] + "\n" + (head.split("\n", 1)[1] if "\n" in head else "")))
    multi = not lines
    df = spark.read.option("multiLine", multi).json(path)
    if multi and head.startswith("{"):
        arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        order = sorted(arrays, key=lambda n: head.find(json.dumps(n)))
        if order:
            df = df.select(F.inline(ref(order[0])))
    seen = {n: head.find(json.dumps(n) + ":") for n in df.columns}
    seen = {n: k if k >= 0 else head.find(json.dumps(n)) for n, k in seen.items()}
    columns = sorted(df.columns, key=lambda n: (seen[n] < 0, seen[n]))
    return Relation.of(df.select(*map(ref, columns)))


ORDERED_FILES = 256
"""Up to so many files, Parquet rows are ordered by their place in the file."""


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> Relation:
    """Rows are ordered by file name and place in the file, which filters can be pushed below.

    Where there are many files, or files of one name, ids dealt out by the scan give the order.
    """
    df = spark.read.parquet(path)
    names = sorted(unquote(f.rsplit("/", 1)[-1]) for f in df.inputFiles())
    r = None
    if 0 < len(names) <= ORDERED_FILES and len(set(names)) == len(names) and "_metadata" not in df.columns:
        at = F.col("_metadata.row_index")
        if len(names) > 1:
            table = F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k << 40))))
            at = at + F.coalesce(F.try_element_at(table, F.col("_metadata.file_name")), F.lit(0))
        r = Relation.of(df, order=at)
    r = r or Relation.of(df)
    return r.select(columns) if columns else r


def _arrow_reader(data):
    import pyarrow as pa

    return pa.ipc.open_file(data) if bytes(data[:6]) == b"ARROW1" else pa.ipc.open_stream(data)


def read_arrow(spark: SparkSession, path: str) -> Relation:
    """Arrow IPC files or streams, also as Feather. The driver reads the schema only; each file is decoded by a task.

    Files of the first Feather version, and types that Spark has no like of, are
    decoded by the driver.
    """
    import pyarrow as pa
    import pyarrow.feather as feather
    from pyspark.errors import PySparkException
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    head = head_bytes(spark, path, 1 << 20)
    try:
        # a file is a stream between marks; its schema comes first
        schema = from_arrow_schema(pa.ipc.open_stream(head[8:] if head[:6] == b"ARROW1" else head).schema, prefer_timestamp_ntz=True)
        target = to_arrow_schema(schema)
    except (pa.ArrowInvalid, PySparkException):
        return Relation.of(spark.createDataFrame(feather.read_table(pa.BufferReader(all_bytes(spark, path)))))

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                reader = _arrow_reader(content.as_buffer())
                found = reader if isinstance(reader, pa.RecordBatchStreamReader) else (reader.get_batch(k) for k in range(reader.num_record_batches))
                for part in found:
                    yield from pa.Table.from_batches([part]).cast(target).to_batches()

    files = spark.read.format("binaryFile").load(path).select("content")
    return Relation.of(files.mapInArrow(decode, schema))


def read_rows(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence[Any]]) -> Relation:
    """Entered data: text, '' is null."""
    names = unique_names(columns)
    data = [tuple(None if c in ("", None) else str(c) for c in [*row, *[None] * len(names)][: len(names)]) for row in rows]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return Relation.of(spark.createDataFrame(data, schema))


def read_file(spark: SparkSession, path: str, source: Mapping[str, Any] | None = None) -> Relation:
    source = source or {}
    kind = source.get("format") or file_kind(path)
    if kind == "csv":
        options = dict(source.get("csv") or {})
        if path.lower().endswith(".tsv"):
            options.setdefault("delimiter", "\t")
        return read_csv(spark, path, options)
    if kind == "json":
        return read_json(spark, path)
    if kind == "parquet":
        return read_parquet(spark, path, source.get("columns"))
    if kind == "arrow":
        return read_arrow(spark, path)
    from tessella.sources.excel import read_excel

    return read_excel(spark, path, source.get("item") or {}, bool(source.get("fillMerged")))


def list_files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Names and paths of a folder's files, by name."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((f.getPath().getName(), f.getPath().toString()) for f in fs.listStatus(p) if not f.getPath().getName().startswith((".", "_")))


def read_folder(spark: SparkSession, folder: str, source: Mapping[str, Any] | None = None) -> Relation:
    """All files whose names match, one after another; the first column has the file's name."""
    source = source or {}
    pattern = (source.get("pattern") or "*").lower()
    column = source.get("fileColumn", "Source.Name")
    files = [(n, p) for n, p in list_files(spark, folder) if fnmatch.fnmatchcase(n.lower(), pattern)]
    if not files:
        raise StepError(f"No file in the folder matches {pattern}")
    kind = lambda n: source.get("format") or file_kind(n)
    if all(kind(n) == "csv" and not n.lower().endswith(".tsv") for n, _ in files):
        return _read_csv_folder(spark, folder, files, source.get("csv") or {}, column)
    parts = []
    for name, path in files:
        r = read_file(spark, path, source)
        parts.append(r.build([(column, Cell(F.lit(name), "text")), *r.cells()]) if column else r)
    return append_relations(parts)


def preview(r: Relation, n: int) -> tuple[Relation, bool]:
    """The first rows of a source, and whether there are more."""
    more = r.df.orderBy(*r.by_order()).limit(n + 1).count() > n
    return r.over(r.df.orderBy(*r.by_order()).limit(n)), more


def infer_type(values: Iterable[str | None]) -> str:
    """A type for a column of text that all of a sample's values fit."""
    seen = [v.strip() for v in values if v and v.strip()]
    if not seen:
        return "text"
    tests = (
        ("bool", lambda v: v.lower() in ("true", "false", "yes", "no")),
        ("int", lambda v: re.fullmatch(r"[-+]?(\d{1,3}(,\d{3})+|\d{1,15})", v) and not re.fullmatch(r"0\d+", v)),
        ("number", lambda v: re.fullmatch(r"[-+(]?[$€£¥]?\s?(\d{1,3}(,\d{3})+|\d+)?(\.\d+)?([eE][-+]?\d+)?\)?%?", v) and re.search(r"\d", v)),
        ("date", lambda v: re.fullmatch(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}", v)),
        ("datetime", lambda v: re.fullmatch(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2})?", v)),
    )
    return next((kind for kind, ok in tests if all(ok(v) for v in seen)), "text")


def suggest_types(r: Relation, rows: int = 2_000) -> dict | None:
    """A ChangeType step for the text columns, from a bounded sample."""
    sample = r.df.limit(rows).select(*map(ref, (n for n in r.names if r.types[n] in ("text", "any")))).toPandas()
    changes = [{"col": n, "type": k} for n in sample.columns if (k := infer_type(sample[n].dropna().astype(str))) != "text"]
    return {"type": "ChangeType", "changes": changes, "onError": "error"} if changes else None


