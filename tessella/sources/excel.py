"""Spreadsheets, read and written with the standard library only."""

from __future__ import annotations

import datetime as dt
import fnmatch
import functools
import io
import itertools
import pickle
import re
import zipfile
import zlib
from collections.abc import Iterator, Mapping, Sequence
from typing import Any
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import scratch
from tessella.relation import Cell, Relation
from tessella.types import SPARK_TYPES, StepError, unique_names

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
#: Built-in number formats that show dates.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EXCEL_ROWS = 1_048_575
SCAN_ROWS = 1_000
"""Rows that a task holds as Python objects at a time."""
HEAD_ROWS = 16
"""Rows at the top among which a header is looked for."""
AT = "__at"


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def parse_range(text: str) -> tuple[str | None, int, int | None, int, int | None]:
    """``'Sheet'!$A$1:C5`` as sheet, first row, last row, first and last column; open ends are None."""
    m = re.fullmatch(r"(?:(?:'((?:[^']|'')+)'|([^'!]+))!)?\$?([A-Za-z]{1,3})?\$?(\d+)?(?::\$?([A-Za-z]{1,3})?\$?(\d+)?)?", text.strip())
    if not m or not (m[3] or m[4]):
        raise StepError(f"Not a range: {text}")
    sheet = (m[1] or "").replace("''", "'") or m[2]
    single = ":" not in text.split("!")[-1]
    r1, c1 = int(m[4] or 1), column_number(m[3]) if m[3] else 1
    r2 = r1 if single and m[4] else int(m[6]) if m[6] else None
    c2 = c1 if single and m[3] else column_number(m[5]) if m[5] else None
    return sheet, r1, r2, c1, c2


class Workbook:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        book = self._xml("xl/workbook.xml")
        rels = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        self.sheets: dict[str, str] = {}
        self.hidden: set[str] = set()
        for s in book.findall("m:sheets/m:sheet", NS):
            target = rels[s.get(f"{{{NS['r']}}}id")].lstrip("/")
            self.sheets[s.get("name")] = target if target.startswith("xl/") else f"xl/{target}"
            if s.get("state") in ("hidden", "veryHidden"):
                self.hidden.add(s.get("name"))
        self.names = {n.get("name"): n.text for n in book.findall("m:definedNames/m:definedName", NS)}
        props = book.find("m:workbookPr", NS)
        self.base = dt.datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
        self.dates: list[bool] = []
        if "xl/styles.xml" in self.zip.namelist():
            styles = self._xml("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.findall("m:numFmts/m:numFmt", NS)}
            for xf in styles.findall("m:cellXfs/m:xf", NS):
                k = int(xf.get("numFmtId", 0))
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(k, ""))
                self.dates.append(k in DATE_FORMATS or (k in own and bool(re.search(r"[ymdhs]", code, re.I))))

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    def _elements(self, name: str, tag: str, within: str) -> Iterator[ElementTree.Element]:
        """The elements ``tag`` right within ``within``, one by one; each is forgotten after its use."""
        parent = None
        with self.zip.open(name) as f:
            for event, e in ElementTree.iterparse(f, ("start", "end")):
                if event == "start" and e.tag == f"{{{NS['m']}}}{within}":
                    parent = e
                elif event == "end" and e.tag == f"{{{NS['m']}}}{tag}" and parent is not None:
                    yield e
                    parent.clear()

    @functools.cached_property
    def strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        return ["".join(t.text or "" for t in s.iter(f"{{{NS['m']}}}t")) for s in self._elements("xl/sharedStrings.xml", "si", "sst")]

    def outline(self) -> dict[str, Any]:
        """What is said of the sheets apart from their cells."""
        return {"sheets": list(self.sheets), "hidden": self.hidden, "names": self.names, "tables": self.tables()}

    def tables(self) -> dict[str, tuple[str, str, int]]:
        """Table name to sheet, range and number of totals rows."""
        out = {}
        for sheet, path in self.sheets.items():
            rels = re.sub(r"([^/]+)$", r"_rels/\1.rels", path)
            if rels not in self.zip.namelist():
                continue
            for r in self._xml(rels):
                if r.get("Type", "").endswith("/table"):
                    t = self._xml("xl/" + r.get("Target").replace("../", "").removeprefix("/xl/"))
                    out[t.get("displayName") or t.get("name")] = (sheet, t.get("ref"), int(t.get("totalsRowCount") or 0))
        return out

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, Any]]]:
        """Rows with their cells by column, both numbered from 1. An error cell is an exception object."""
        row, cell, v, t = (f"{NS['m']} {x}" for x in ("row", "c", "v", "t"))
        parser = expat.ParserCreate(namespace_separator=" ")
        parser.buffer_text = True
        done: list[tuple[int, dict[int, Any]]] = []
        columns: dict[str, int] = {}
        row_at, col_at, kind, style, value, text, cells = 0, 0, None, 0, None, None, None

        def start(tag, given):
            nonlocal row_at, col_at, kind, style, value, text, cells
            if tag == cell:
                letters = given.get("r", "").rstrip("0123456789")
                if letters not in columns:
                    m = re.match("[A-Z]+", letters)
                    columns[letters] = column_number(m[0]) if m else 0
                col_at = columns[letters] or col_at + 1
                kind, style, value, text = given.get("t", "n"), given.get("s"), None, None
            elif tag == v and value is None:
                parser.CharacterDataHandler = (value := []).append
            elif tag == t:
                text = [] if text is None else text
                parser.CharacterDataHandler = text.append
            elif tag == row:
                row_at, col_at, cells = int(given.get("r") or row_at + 1), 0, {}

        def end(tag):
            if tag in (v, t):
                parser.CharacterDataHandler = None
            elif tag == cell and cells is not None:
                found = self._value(kind, style, "".join(value) if value else None, "".join(text) if text else "")
                if found is not None:
                    cells[col_at] = found
            elif tag == row:
                done.append((row_at, cells))

        parser.StartElementHandler, parser.EndElementHandler = start, end
        with self.zip.open(self.sheets[sheet]) as f:
            while data := f.read(1 << 16):
                parser.Parse(data)
                yield from done
                done.clear()
            parser.Parse(b"", True)
        yield from done

    def whole(self, sheet: str, fill_merged: bool) -> Iterator[tuple[int, dict[int, Any]]]:
        """The same with all cells held at once: rows in order, whatever theirs in the file, and merged cells filled."""
        grid: dict[int, dict[int, Any]] = {}
        for at, cells in self.rows(sheet):
            grid.setdefault(at, {}).update(cells)
        for merge in self._elements(self.sheets[sheet], "mergeCell", "mergeCells") if fill_merged else ():
            _, r1, r2, c1, c2 = parse_range(merge.get("ref"))
            if c1 in grid.get(r1, {}):
                for r in range(r1, (r2 or r1) + 1):
                    for k in range(c1, (c2 or c1) + 1):
                        grid.setdefault(r, {}).setdefault(k, grid[r1][c1])
        yield from sorted(grid.items())

    def _value(self, kind: str, style: str | None, v: str | None, text: str) -> Any:
        if kind == "inlineStr":
            return text if text.strip() else None
        if v is None:
            return None
        if kind == "s":
            v, kind = self.strings[int(v)], "str"
        if kind == "str":
            return v if v.strip() else None
        if kind == "b":
            return v == "1"
        if kind == "e":
            return ValueError(v)
        n = float(v)
        at = int(style or 0)
        if at < len(self.dates) and self.dates[at]:
            base = self.base if self.base.year == 1904 or n >= 60 else dt.datetime(1899, 12, 31)
            return base + dt.timedelta(seconds=round(n * 86400))
        return int(n) if n.is_integer() else n


def _marked(v: Any) -> tuple[str, str | None]:
    """A cell as a mark of its kind and text."""
    if v is None:
        return " ", None
    if isinstance(v, Exception):
        return "e", str(v)
    if isinstance(v, bool):
        return "b", str(v).lower()
    if isinstance(v, int):
        return "i" if -(2**63) <= v < 2**63 else "n", str(v)
    if isinstance(v, float):
        return "n", str(v)
    if isinstance(v, dt.datetime):
        return ("d", v.date().isoformat()) if v.time() == dt.time() else ("t", v.isoformat(" "))
    return "s", v


def _unmarked(mark: str, text: str | None) -> Any:
    return {" ": lambda x: None, "e": ValueError, "b": lambda x: x == "true", "i": int, "n": float, "d": dt.datetime.fromisoformat, "t": dt.datetime.fromisoformat, "s": str}[mark](text)


LATE = -1
"""Place of a row that says that rows of the file aren't in order."""


def _scan(spark: SparkSession, path: str, sheet: str, bounds: Sequence[int | None], whole: bool, fill_merged: bool) -> DataFrame:
    """``at, marks, texts`` of the rows that hold a cell within bounds. One task reads the sheet, row by row."""
    import pyarrow as pa

    scratch.ship(spark)
    r1, r2, c1, c2 = bounds

    def parse(batches):
        held: list[tuple[int, str, list[str | None]]] = []

        def batch():
            at, marks, texts = zip(*held, strict=True) if held else ((), (), ())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(marks, pa.string()), pa.array(texts, pa.list_(pa.string()))], ["at", "marks", "texts"])

        for content in (x for b in batches for x in b.column(0)):
            book, last = Workbook(content.as_buffer().to_pybytes()), 0
            for at, cells in book.whole(sheet, fill_merged) if whole else book.rows(sheet):
                if at <= last:
                    held.append((LATE, "", []))
                    break
                last = at
                used = [k for k in cells if k >= c1 and (c2 is None or k <= c2)] if r1 <= at and (r2 is None or at <= r2) else []
                if used:
                    marks, texts = zip(*(_marked(cells.get(k)) for k in range(c1, max(used) + 1)), strict=True)
                    held.append((at, "".join(marks), list(texts)))
                if len(held) >= SCAN_ROWS:
                    yield batch()
        yield batch()

    files = spark.read.format("binaryFile").load(path).select("content")
    return scratch.materialize(files.mapInArrow(parse, "at long, marks string, texts array<string>"))


#: Types by the marks of a column's cells.
KINDS = {"b": "bool", "i": "int", "n": "number", "in": "number", "s": "text", "d": "date", "t": "datetime", "dt": "datetime"}


def _table(spark: SparkSession, path: str, sheet: str, bounds: Sequence[int | None] = (1, None, 1, None), fill_merged: bool = False, header: str | None = None) -> Relation | None:
    """A range of a sheet, up to its last row and column that hold a cell; None where no cell is.

    ``header``: the range's first row ("first") or the row that looks like one ("detect").
    """
    from tessella.sources.files import detect_header

    scan = _scan(spark, path, sheet, bounds, fill_merged, fill_merged)
    if not scan.where(F.col("at") == LATE).isEmpty():
        scan = _scan(spark, path, sheet, bounds, True, fill_merged)
    [found] = scan.agg(F.max("at").alias("last"), F.max(F.length("marks")).alias("width")).collect()
    if found["last"] is None:
        return None
    start, last, width = bounds[0], found["last"], found["width"]
    names: list[str] = [f"Column{k + 1}" for k in range(width)]
    if header:
        top = [[None] * width for _ in range(min(last - start + 1, HEAD_ROWS))]
        for x in scan.where(F.col("at") < start + HEAD_ROWS).collect():
            top[x["at"] - start][: len(x["marks"])] = map(_unmarked, x["marks"], x["texts"])
        at = detect_header(top)[0] if header == "detect" else 0
        names, start = unique_names([None if h is None else str(h) for h in top[at]]), start + at + 1
    rows = scan.where(F.col("at") >= start)
    marks = rows.select("marks").distinct().select(F.posexplode(F.split("marks", "")).alias("k", "mark")).distinct().collect()
    seen: list[set[str]] = [{x["mark"] for x in marks if x["k"] == k} for k in range(width)]
    if rows.count() < last - start + 1:  # rows without cells are rows too
        rows = spark.range(start, last + 1).withColumnRenamed("id", "at").join(rows, "at", "left")
    cells, columns = [], [F.col("at")]
    for k, n in enumerate(names):
        kind = KINDS.get("".join(sorted(seen[k] - {" ", "e", ""})), "any")
        text, failed = F.get("texts", F.lit(k)), F.substring("marks", k + 1, 1) == "e"
        columns.append((F.when(~failed, text) if "e" in seen[k] else text).cast(SPARK_TYPES[kind]).alias(f"v{k}"))
        columns.append(F.when(failed, text).alias(f"e{k}"))
        cells.append((n, Cell(F.col(f"v{k}"), kind, F.col(f"e{k}") if "e" in seen[k] else None)))
    return Relation.of(rows.select(*columns), order=F.col("at")).build(cells)


def _outline(spark: SparkSession, path: str) -> dict[str, Any]:
    scratch.ship(spark)

    def look(batches):
        import pyarrow as pa

        for content in (x for b in batches for x in b.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Workbook(content.as_buffer().to_pybytes()).outline())], pa.binary())], ["x"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(look, "x binary").collect()
    if not found:
        raise StepError(f"File not found: {path}")
    return pickle.loads(found[0]["x"])


def read_excel(spark: SparkSession, path: str, item: Mapping[str, Any], fill_merged: bool = False) -> Relation:
    """A sheet or range (no header), a table or named range, or several sheets one after another.

    Tasks read the workbook, a sheet by one; the driver sees what the sheets are called,
    the first rows and the kinds of cells in each column.
    """
    from tessella.operators.joining import append_relations

    book = _outline(spark, path)
    kind = item.get("type", "sheet")
    if kind == "sheets":
        parts, column = [], item.get("sheetColumn", "Sheet")
        for name in book["sheets"]:
            if (name in book["hidden"] and not item.get("includeHidden")) or not fnmatch.fnmatchcase(name.lower(), (item.get("pattern") or "*").lower()):
                continue
            r = _table(spark, path, name, fill_merged=fill_merged, header="detect")
            if r is not None:
                parts.append(r.build([(column, Cell(F.lit(name), "text")), *r.cells()]))
        if not parts:
            raise StepError("No sheet matches")
        return append_relations(parts)
    header, bounds = None, (1, None, 1, None)
    sheet, where = item.get("sheet"), item.get("range")
    if kind in ("table", "name"):
        name = item.get("name")
        if kind == "table" and name in book["tables"]:
            sheet, where, totals = book["tables"][name]
            _, r1, r2, c1, c2 = parse_range(where)
            where, header, bounds = None, "first", (r1, (r2 or r1) - totals, c1, c2)
        elif kind == "name" and name in book["names"]:
            where = book["names"][name]
        else:
            raise StepError(f"`{name}` not found in the workbook", [f"Tables: {', '.join(book['tables'])}", f"Names: {', '.join(book['names'])}"])
    if where:
        named, *bounds = parse_range(where)
        sheet = named or sheet
    sheet = sheet or next(n for n in book["sheets"] if n not in book["hidden"])
    if sheet not in book["sheets"]:
        raise StepError(f"Sheet `{sheet}` not found", [f"Sheets: {', '.join(book['sheets'])}"])
    r = _table(spark, path, sheet, bounds, fill_merged, header)
    return Relation.of(spark.createDataFrame([], T.StructType([]))) if r is None else r


def _cell_xml(ref: str, v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    if isinstance(v, dt.datetime):
        return f'<c r="{ref}" s="2"><v>{(v - dt.datetime(1899, 12, 30)).total_seconds() / 86400!r}</v></c>'
    if isinstance(v, dt.date):
        return f'<c r="{ref}" s="1"><v>{(v - dt.date(1899, 12, 30)).days}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>'


def _row_xml(at: int, row: Sequence[Any], letters: Sequence[str]) -> str:
    return f'<row r="{at}">{"".join(_cell_xml(f"{c}{at}", v) for c, v in zip(letters, row, strict=True))}</row>'


def write_excel(path: str, names: Sequence[str], rows: DataFrame, sheet: str = "Sheet1") -> None:
    """One sheet with typed cells, an autofilter and column widths.

    ``rows`` are in order. Tasks make their XML, in compressed pieces; the driver
    strings these together and holds one at a time.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    scratch.ship(spark)
    placed = scratch.materialize(rows.withColumn(AT, F.monotonically_increasing_id()))
    counts = sorted((x["p"], x["count"]) for x in placed.groupBy(F.shiftright(AT, 33).alias("p")).count().collect())
    starts = dict(zip((p for p, _ in counts), itertools.accumulate((n for _, n in counts), initial=0)))
    total = sum(n for _, n in counts)
    if total > EXCEL_ROWS:
        raise StepError(f"A sheet has at most {EXCEL_ROWS:,} rows")
    letters = [column_letters(k + 1) for k in range(len(names))]

    def pieces(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, SCAN_ROWS):
                *columns, at = (c.to_pylist() for c in batch.slice(k, SCAN_ROWS).columns)
                numbers = [starts[x >> 33] + (x & (1 << 33) - 1) for x in at]
                # a batch may go from one part of the table to another
                cuts = [0, *(i for i in range(1, len(numbers)) if numbers[i] != numbers[i - 1] + 1), len(numbers)]
                body = [_row_xml(n + 2, row, letters) for n, row in zip(numbers, zip(*columns, strict=True), strict=True)]
                found = [(numbers[i], zlib.compress("".join(body[i:j]).encode(), 1)) for i, j in itertools.pairwise(cuts)]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["n", "xml"])

    first = placed.orderBy(AT).limit(500).drop(AT).collect()
    widths = [min(60, max([len(n), *(len(str(r[k])) for r in first if r[k] is not None)]) + 2) for k, n in enumerate(names)]
    last = f"{column_letters(max(len(names), 1))}{total + 1}"
    cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1))
    main = NS["m"]
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{NS["r"]}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{NS["r"]}"><sheets><sheet name="{escape(sheet[:31], {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{NS["r"]}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{NS["r"]}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/><numFmt numFmtId="165" formatCode="yyyy-mm-dd hh:mm:ss"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="165" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    done = scratch.materialize(placed.mapInArrow(pieces, "n long, xml binary"))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, head + text)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(f'{head}<worksheet xmlns="{main}"><cols>{cols}</cols><sheetData>{_row_xml(1, names, letters)}'.encode())
            for x in done.orderBy("n").toLocalIterator():
                f.write(zlib.decompress(x["xml"]))
            f.write(f'</sheetData><autoFilter ref="A1:{last}"/></worksheet>'.encode())
