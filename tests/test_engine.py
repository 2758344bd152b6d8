"""Formulas, casts, order, sources, sinks, projects and streams on small tables."""

import datetime as dt
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.__main__ import main
from tessella.formula import compile_formula, parse
from tessella.functions.casts import cast_cell, number_text
from tessella.operators import Context, apply_step
from tessella.operators.rows import sample_positions
from tessella.plans import Engine, Project, Query
from tessella.relation import Cell, Relation
from tessella.sources import excel, read_file, read_folder, read_rows, write
from tessella.sources.excel import parse_range
from tessella.sources.files import detect_encoding, infer_type, sniff_csv
from tessella.streaming import apply_stream, refusal, windowed_counts
from tessella.types import FormulaError, StepError, unique_names


@pytest.fixture(scope="module")
def people(spark):
    df = spark.createDataFrame([(1, "Anna", "EU", 10), (2, "bob", "US", None), (3, "Çelik", "EU", 30), (4, None, "APAC", 5), (5, "Anna", "US", 10)], "id long, name string, region string, sales long")
    return Relation.of(df.coalesce(1))


def rows(r):
    return [tuple(x) for x in r.ordered().collect()]


def run(r, *steps, **context):
    for s in steps:
        r = apply_step(r, s, Context(**context))
    return r


def value(spark, formula, **params):
    r = Relation.of(spark.sql("SELECT 1L id, 'Ab c' t, 2.5D x, CAST(NULL AS STRING) n, DATE'2025-01-31' d, TIMESTAMP_NTZ'2025-01-31 13:30:00' ts, true b, 0L z"))
    c = compile_formula(formula, r, params)
    got = r.df.select(c.value.alias("v"), (F.lit(None).cast("string") if c.err is None else c.err).alias("e")).first()
    return f"ERROR {got['e']}" if got["e"] is not None else got["v"]


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("1 + 2 * 3", 7),
        ("7 / 2", 3.5),
        ("[id] / [z]", "ERROR Division by zero"),
        ("try [id] / [z] otherwise -1", -1),
        ("try [n] otherwise \"x\"", None),
        ("[n] = null", True),
        ("[n] <> \"a\"", True),
        ("[n] & \"x\"", "x"),
        ("[n] & null", None),
        ("null and false", False),
        ("null or true", True),
        ("not null", None),
        ("[z] = 1 and 1 / [z] > 0", False),
        ("[z] = 0 and 1 / [z] > 0", "ERROR Division by zero"),
        ("\"5\" = 5", True),
        ("10 < \"9\"", True),
        ("if null then 1 else 2", 2),
        ("[id] in @ids", True),
        ("@rate * 2", 3.0),
        ("Text.Proper(\"hello wORLD-foo don't\")", "Hello World-Foo Don't"),
        ("Text.PadEnd([t], 2)", "Ab c"),
        ("Text.RegexExtract([t], \"(A)(b)\", 2)", "b"),
        ("Text.RegexExtract([t], \"zz\")", None),
        ("Number.Round(2.5)", 2.0),
        ("Number.Round(1.015, 2)", 1.01),
        ("Number.Mod(5, 0 - 3)", -1.0),
        ("Number.Mod(5, 0)", "ERROR Division by zero"),
        ("Number.Clamp(10, 5, 2)", 2.0),
        ("Number.Sqrt(-1)", "ERROR Square root of a negative number"),
        ("Number.From(\"(1,234.5)\")", -1234.5),
        ("Number.From(\"abc\")", 'ERROR Expected a number but got "abc"'),
        ("Number.From([d])", 45688.0),
        ("Date.AddMonths([d], 1)", dt.date(2025, 2, 28)),
        ("Date.AddDays([ts], 0.5)", dt.datetime(2025, 2, 1, 1, 30)),
        ("Date.DiffDays([d], [ts])", 1),
        ("Date.From(\"12 Mar 2026\")", dt.date(2026, 3, 12)),
        ("Date.From(\"2025-02-30\")", 'ERROR Cannot convert "2025-02-30" to a date'),
        ("Date.ToText([ts], \"MMMM d, yyyy\")", "January d, 2025"),
        ("#date(2024, 14, 1)", dt.date(2025, 2, 1)),
        ("Value.IsError([id] / [z])", True),
        ("Coalesce([n], \"q\")", "q"),
        ("Text.Fingerprint(\" Zoë, the Cat the \")", "cat the zoe"),
        ("1e21 & \"\"", "1e+21"),
        ("0.1 + 0.2 & \"\"", "0.30000000000000004"),
        ("[b] & \"\"", "true"),
    ],
)
def test_formula(spark, formula, want):
    assert value(spark, formula, ids=[1, 2], rate=1.5) == want


@pytest.mark.parametrize(
    ("formula", "message"),
    [
        ("[nam]", "Column [nam] not found"),
        ("Text.Uper([name])", "Unknown function Text.Uper"),
        ("[name] + 1", "Cannot add text"),
        ("Date.Year([sales])", "Date.Year needs a date"),
        ("if [sales] then 1 else 2", "must be True/False"),
        ("Text.Start([name])", "expects 2"),
        ("[sales] in 3", "needs a list"),
        ("1 +", "ends too early"),
        ("[sales] 3", "Unexpected"),
        ("@nope", "not defined"),
    ],
)
def test_formula_errors(people, formula, message):
    with pytest.raises(FormulaError, match=message.replace("[", r"\[").replace("]", r"\]").replace("+", r"\+")):
        compile_formula(formula, people, {})


def test_hint_names_the_closest():
    assert parse('[a]]b] = "x""y" // note').args[0].value == "a]b"


@pytest.mark.parametrize(
    ("text", "kind", "locale", "want"),
    [
        ("1,234.50", "number", "en-US", 1234.5),
        ("1.234,50", "number", "de-DE", 1234.5),
        ("1 234,5", "number", "fr-FR", 1234.5),
        ("(5)", "number", None, -5.0),
        ("12%", "number", None, 0.12),
        ("$1e3", "number", None, 1000.0),
        ("NaN", "number", None, "ERROR"),
        ("1d", "number", None, "ERROR"),
        ("", "number", None, None),
        ("2.5", "int", None, 3),
        ("-2.5", "int", None, -2),
        ("Wahr", "bool", None, True),
        (" no ", "bool", None, False),
        ("maybe", "bool", None, "ERROR"),
        ("03/04/2025", "date", "en-US", dt.date(2025, 3, 4)),
        ("03/04/2025", "date", "en-GB", dt.date(2025, 4, 3)),
        ("3.4.25", "date", "de-DE", dt.date(2025, 4, 3)),
        ("1/2/49", "date", None, dt.date(2049, 1, 2)),
        ("1/2/50", "date", None, dt.date(1950, 1, 2)),
        ("2025-02-30", "date", None, "ERROR"),
        ("2025-01-31T10:30 and so on", "datetime", None, dt.datetime(2025, 1, 31, 10, 30)),
        ("March 12, 2026", "date", None, dt.date(2026, 3, 12)),
    ],
)
def test_cast(spark, text, kind, locale, want):
    c = cast_cell(Cell(F.col("t"), "text"), kind, locale)
    got = spark.createDataFrame([(text,)], "t string").select(c.value.alias("v"), (F.lit(None).cast("string") if c.err is None else c.err).alias("e")).first()
    assert ("ERROR" if got["e"] is not None else got["v"]) == want


def test_number_text(spark):
    data = [(1.0, "1"), (1e8, "100000000"), (0.001, "0.001"), (1.5e-7, "1.5e-7"), (123456789.25, "123456789.25"), (-0.5, "-0.5"), (1e300, "1e+300")]
    got = spark.createDataFrame(data, "x double, s string").select(number_text(F.col("x")).alias("t"), "s").collect()
    assert [r["t"] for r in got] == [r["s"] for r in got]


def test_change_type_modes(people):
    dirty = run(people, {"type": "AddColumn", "name": "raw", "formula": 'if [id] = 2 then "n/a" else Text.From([sales])'})
    change = {"type": "ChangeType", "changes": [{"col": "raw", "type": "int"}]}
    assert [r[-2:] for r in rows(run(dirty, change | {"onError": "keep"}))] == [(10, None), (None, "n/a"), (30, None), (5, None), (10, None)]
    with pytest.raises(StepError, match="n/a"):
        run(dirty, change | {"onError": "fail"})
    failing = run(dirty, change)
    assert [r[0] for r in rows(run(failing, {"type": "KeepErrors"}))] == [2]
    assert [r[-1] for r in rows(run(failing, {"type": "ReplaceErrors", "cols": ["raw"], "value": "-1"}))] == [10, -1, 30, 5, 10]
    assert "raw" not in run(dirty, change | {"onError": "null"}).errors
    counts = rows(run(failing, {"type": "GroupBy", "keys": [], "aggs": [{"fn": "count_distinct", "col": "raw"}, {"fn": "count", "col": "raw"}]}))
    assert counts == [(4, 4)]


def test_group_order_and_names(people):
    r = run(people, {"type": "GroupBy", "keys": ["region"], "aggs": [{"fn": "sum", "col": "sales"}, {"fn": "count_rows"}, {"fn": "percentile", "col": "sales", "p": 90}]})
    assert r.names == ["region", "Sum of sales", "Count rows", "P90 of sales"]
    assert [x[0] for x in rows(r)] == ["EU", "US", "APAC"]


def test_natural_sort(spark):
    r = Relation.of(spark.createDataFrame([(1, "item10"), (2, "Item2"), (3, None), (4, "élan"), (5, "eagle"), (6, "item2")], "i long, s string").coalesce(1))
    assert [x[0] for x in rows(run(r, {"type": "Sort", "by": [{"col": "s"}]}))] == [5, 4, 2, 6, 1, 3]
    assert [x[0] for x in rows(run(r, {"type": "Sort", "by": [{"col": "s", "desc": True}]}))] == [1, 2, 6, 4, 5, 3]


def test_sample_is_exact_and_ordered(people):
    a = rows(run(people, {"type": "Sample", "mode": "n", "n": 3, "seed": 7}))
    assert len(a) == 3 and a == sorted(a) and a == rows(run(people, {"type": "Sample", "mode": "n", "n": 3, "seed": 7}))
    order = list(range(50))
    from tessella.operators.rows import xorshift

    u = xorshift(42)
    for i in range(20):
        j = i + int(next(u) * (50 - i))
        order[i], order[j] = order[j], order[i]
    assert sample_positions(50, 20, 42) == order[:20]


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    df = spark.range(0, 5000, 1, parts).select(F.col("id"), F.when(F.col("id") % 7 == 3, F.col("id")).alias("v"))
    r = Relation.of(df)
    steps = ({"type": "FillDown", "cols": ["v"]}, {"type": "IndexColumn", "name": "ix"}, {"type": "Window", "op": "lag", "col": "id", "n": 2, "name": "p"}, {"type": "Window", "op": "cumsum", "col": "v", "name": "c"}, {"type": "KeepRows", "mode": "range", "offset": 4000, "n": 5})
    got = rows(run(r, *steps))
    last = lambda i: (i - 3) // 7 * 7 + 3 if i >= 3 else None
    total = lambda i: float(sum(last(k) or 0 for k in range(i + 1)))
    assert got == [(i, last(i), i, i - 2, total(i)) for i in range(4000, 4005)]


def test_window_blocks(spark, monkeypatch):
    from tessella.operators import windows

    monkeypatch.setattr(windows, "BLOCK_ROWS", 4)
    r = Relation.of(spark.range(0, 23, 1, 3).select("id", F.col("id").cast("double").alias("x")))
    for op, n, f in (("rolling_sum", 3, lambda i: float(sum(range(max(0, i - 2), i + 1)))), ("lead", 2, lambda i: float(i + 2) if i < 21 else None), ("cumsum", 1, lambda i: float(sum(range(i + 1)))), ("cummax", 1, float)):
        got = rows(run(r, {"type": "Window", "op": op, "col": "x", "n": n, "name": "w"}))
        assert [x[2] for x in got] == [f(i) for i in range(23)], op


def test_merge_order_and_nulls(spark):
    a = Relation.of(spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "k long, v string").coalesce(1))
    b = Relation.of(spark.createDataFrame([(2, "two"), (3, "three"), (None, "none"), (2, "deux")], "k long, w string").coalesce(1))
    on = {"type": "Merge", "right": "b", "on": [["k", "k"]]}
    get = lambda how: rows(run(a, on | {"how": how}, resolve=lambda q: b))
    assert get("left") == [(1, "x", None), (None, "y", None), (2, "z", "two"), (2, "z", "deux")]
    assert get("full") == [(1, "x", None), (None, "y", None), (2, "z", "two"), (2, "z", "deux"), (3, None, "three"), (None, None, "none")]
    assert get("right") == [(2, "z", "two"), (2, "z", "deux"), (3, None, "three"), (None, None, "none")]
    assert get("anti") == [(1, "x"), (None, "y")] and get("semi") == [(2, "z")]


def test_validate_actions(people):
    rules = [{"col": "name", "check": "not_null"}, {"col": "sales", "check": "range", "arg": 6}, {"col": "name", "check": "unique"}]
    assert [x[-1] for x in rows(run(people, {"type": "Validate", "rules": rules}))] == ["name is duplicated", None, None, "name is empty; sales outside 6…∞", "name is duplicated"]
    assert [x[0] for x in rows(run(people, {"type": "Validate", "rules": rules, "action": "keep_valid"}))] == [2, 3]
    with pytest.raises(StepError, match="3 rows fail"):
        run(people, {"type": "Validate", "rules": rules, "action": "fail"})


def test_unpivot_then_pivot_is_identity(spark):
    r = Relation.of(spark.createDataFrame([(1, 2.0, 3.0), (2, None, 5.0)], "id long, a double, b double").coalesce(1))
    got = run(r, {"type": "Unpivot", "ids": ["id"]}, {"type": "Pivot", "on": "Attribute", "values": "Value", "index": ["id"]})
    assert got.names == ["id", "a", "b"] and rows(got) == rows(r)


def test_filters_reach_the_scan(spark, small, capsys):
    r = Relation.of(spark.read.parquet(f"{small}/orders.parquet"))
    run(r, {"type": "Filter", "formula": '[o_orderkey] > 10 and [o_orderstatus] = "F"'}, {"type": "SelectColumns", "cols": ["o_orderkey"]}).output().explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(o_orderkey,10)" in plan and "o_totalprice" not in plan


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;betrag;note\r\n1;1.234,50;"x ""q"" y"\r\n2;;"two\nlines"\r\n', encoding="utf-8")
    r = read_file(spark, str(tmp_path / "a.csv"))
    assert rows(r) == [("1", "1.234,50", 'x "q" y'), ("2", None, "two\nlines")]
    (tmp_path / "b.csv").write_text("id,v\n1,2,3\n4\n", encoding="utf-8")
    assert rows(read_file(spark, str(tmp_path / "b.csv"))) == [("1", "2", "3"), ("4", None, None)]
    (tmp_path / "c.json").write_text(json.dumps([{"z": 1, "a": {"k": 2}}, {"z": 2, "b": [1]}]), encoding="utf-8")
    j = read_file(spark, str(tmp_path / "c.json"))
    assert j.names == ["z", "a", "b"] and rows(j)[0] == (1, '{"k":2}', None)
    (tmp_path / "d.ndjson").write_text('{"q": 1}\n{"q": 2}\n', encoding="utf-8")
    assert rows(read_file(spark, str(tmp_path / "d.ndjson"))) == [(1,), (2,)]
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "B.csv").write_text("k,v\n3,4\n", encoding="utf-8")
    (folder / "A.csv").write_text("k\n1\n", encoding="utf-8")
    both = read_folder(spark, str(folder), {"pattern": "*.CSV"})
    assert both.names == ["Source.Name", "k", "v"] and rows(both) == [("A.csv", "1", None), ("B.csv", "3", "4")]
    assert unique_names(["a", "a", " ", None]) == ["a", "a_1", "Column3", "Column4"]
    assert detect_encoding("é".encode("cp1252")) == "windows-1252" and sniff_csv(b"a\tb\n1\t2\n")["delimiter"] == "\t"
    assert [infer_type(v) for v in (["1", "2"], ["1.5"], ["2025-01-01"], ["true"], ["x"], ["007"])] == ["int", "number", "date", "bool", "text", "number"]


def test_round_trips(spark, people, tmp_path):
    full = run(people, {"type": "AddColumn", "name": "day", "formula": "#date(2025, 1, [id])"}, {"type": "AddColumn", "name": "x", "formula": "[id] / 4"})
    for kind in ("arrow", "parquet"):
        write(full, str(tmp_path / f"o.{kind}"), kind, ordered=True)
        back = read_file(spark, str(tmp_path / f"o.{kind}"))
        assert rows(back) == rows(full) and back.types == full.types
    write(full, str(tmp_path / "o.xlsx"), "xlsx")
    sheet = run(read_file(spark, str(tmp_path / "o.xlsx")), {"type": "PromoteHeaders"})
    assert sheet.names == full.names and [x[1] for x in rows(sheet)] == [x[1] for x in rows(full)] and rows(sheet)[0][4] == "2025-01-01"
    write(full, str(tmp_path / "o.csv"), "csv", ordered=True)
    part = next(p for p in os.listdir(tmp_path / "o.csv") if p.endswith(".csv"))
    assert (tmp_path / "o.csv" / part).read_bytes().startswith(b"id,name,region,sales,day,x\r\n1,Anna,EU,10,2025-01-01,0.25\r\n")
    assert parse_range("'My Sheet'!$B$3:H") == ("My Sheet", 3, None, 2, 8)


def test_json_lines_are_told_by_a_line_of_data(spark, tmp_path):
    # the first part of what Spark writes is empty where the first task has no row
    spark.range(0, 100, 1, 4).where("id > 60").write.json(str(tmp_path / "parts.json"))
    assert min(p.stat().st_size for p in (tmp_path / "parts.json").glob("part-00000*")) == 0
    assert sorted(rows(read_file(spark, str(tmp_path / "parts.json")))) == [(k,) for k in range(61, 100)]
    long = {"q": "x" * 70_000}
    (tmp_path / "long.ndjson").write_text(f"{json.dumps(long)}\n" * 3, encoding="utf-8")
    assert [len(q) for (q,) in rows(read_file(spark, str(tmp_path / "long.ndjson")))] == [70_000] * 3
    (tmp_path / "one.json").write_text(json.dumps({"items": [long, long]}), encoding="utf-8")
    assert [len(q) for (q,) in rows(read_file(spark, str(tmp_path / "one.json")))] == [70_000] * 2


def test_spreadsheets_are_read_and_written_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(excel.Workbook, "__init__", None)  # the driver's; tasks import their own
    n = 2_500
    df = spark.range(n, 0, -1, 5).select("id", F.concat(F.lit("<t> & é "), "id").alias("t"), F.when(F.col("id") % 2 == 0, F.col("id") / 4).alias("x"), (F.col("id") > 9).alias("b"))
    write(run(Relation.of(df), {"type": "Sort", "by": [{"col": "id"}]}), str(tmp_path / "n.xlsx"), "xlsx")
    back = read_file(spark, str(tmp_path / "n.xlsx"), {"item": {"range": "A2:D9999"}})
    assert back.types == {"Column1": "int", "Column2": "text", "Column3": "number", "Column4": "bool"}
    assert rows(back) == [(k, f"<t> & é {k}", k / 4 if k % 2 == 0 else None, k > 9) for k in range(1, n + 1)]
    # blank rows, an error, mixed kinds; then rows out of order
    row = lambda at, *cells: f'<row r="{at}">{"".join(cells)}</row>'
    cells = [row(2, '<c r="A2" t="e"><v>#N/A</v></c>', '<c r="C2"><v>1.5</v></c>'), row(5, '<c r="A5"><v>7</v></c>', '<c r="B5" t="b"><v>1</v></c>'), row(6, '<c r="B6" t="str"><v>z</v></c>')]
    with zipfile.ZipFile(tmp_path / "n.xlsx") as z:
        parts = {x: z.read(x) for x in z.namelist()}
    for k, body in enumerate((cells, cells[::-1])):
        parts["xl/worksheets/sheet1.xml"] = f'<worksheet xmlns="{excel.NS["m"]}"><sheetData>{"".join(body)}</sheetData></worksheet>'.encode()
        with zipfile.ZipFile(tmp_path / f"odd{k}.xlsx", "w") as z:
            for name, data in parts.items():
                z.writestr(name, data)
        odd = read_file(spark, str(tmp_path / f"odd{k}.xlsx"))
        assert list(odd.types.values()) == ["int", "any", "number"] and odd.errors == {"Column1"}
        assert rows(odd) == [(None,) * 3, (None, None, 1.5), (None,) * 3, (None,) * 3, (7, "true", None), (None, "z", None)]
    assert len(rows(read_file(spark, str(tmp_path / "odd1.xlsx"), {"fillMerged": True}))) == 6


def test_project(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\n1,10\n2,x\n3,30\n", encoding="utf-8")
    text = json.dumps({"format_version": 1, "params": [{"name": "low", "type": "number", "value": 15}], "queries": [
        {"name": "base", "steps": [{"type": "Source", "source": {"kind": "file", "file": "t.csv"}}, {"type": "ChangeType", "changes": [{"col": "v", "type": "int"}]}]},
        {"name": "big", "steps": [{"type": "Source", "source": {"kind": "query", "query": "base"}}, {"type": "Filter", "formula": "[v] > @low"}], "load": {"target": "parquet"}},
        {"name": "sql", "steps": [{"type": "Source", "source": {"kind": "query", "query": "big"}}, {"type": "CustomSql", "sql": "SELECT s.k, b.v FROM self s JOIN base b ON s.k = b.k"}]},
    ]})
    project = Project.from_json(text)
    assert Project.from_json(project.to_json()).to_json() == project.to_json()
    assert project.order(["sql"]) == ["base", "big", "sql"]
    e = Engine(spark, project, {"t.csv": str(tmp_path / "t.csv")})
    assert e.page("sql") == [{"k": "3", "v": 30}]
    assert e.quality("base")[1] == {"column": "v", "valid": 2, "error": 1, "empty": 0}
    assert e.relation("base") is e.relation("base")
    assert e.suggest_steps("t.csv")[0]["type"] == "Source"
    assert e.overview("base")["errors"] == 1 and e.profile("base", "v")["distinct"] == 2
    assert e.refresh_all(str(tmp_path)) == [str(tmp_path / "big.parquet")]
    project.save(str(tmp_path / "p"))
    assert Project.load(str(tmp_path / "p")).queries.keys() == project.queries.keys()
    project.queries["base"].steps.append({"type": "Append", "others": ["big"]})
    with pytest.raises(StepError, match="Circular"):
        project.order()
    with pytest.raises(StepError, match="not found"):
        run(e.tables.setdefault("x", read_rows(spark, ["a"], [["1"]])), {"type": "SelectColumns", "cols": ["b"]})


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("k,v\n1,10\n", encoding="utf-8")
    project = Project({"q": Query("q", [{"type": "Source", "source": {"kind": "file", "file": "t.csv"}}])})
    (tmp_path / "p.json").write_text(project.to_json(), encoding="utf-8")
    assert main(["inspect", str(tmp_path / "p.json"), "--data", str(tmp_path)]) == 0
    assert '"k": "text"' in capsys.readouterr().out
    assert main(["run", str(tmp_path / "none.json")]) == 3 and main(["fly"]) == 2
    assert main(["python", str(tmp_path / "p.json")]) == 0


def test_streams(spark, small, tmp_path):
    path = f"{small}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder = tmp_path / "in"
    spark.read.parquet(path).repartition(2).write.parquet(str(folder))
    stream = spark.readStream.schema(schema).parquet(str(folder))
    steps = [{"type": "Filter", "formula": "[value] > 20"}, {"type": "AddColumn", "name": "twice", "formula": "[value] * 2"}, {"type": "SelectColumns", "cols": ["event_id", "twice"]}]
    out = apply_stream(stream, steps)
    q = out.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    static = run(Relation.of(spark.read.parquet(path)), *steps).output()
    assert sorted(map(tuple, spark.table("streamed").collect())) == sorted(map(tuple, static.collect()))
    counts = windowed_counts(stream, "ts", "1 day", ["event_type"])
    q = counts.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r["rows"] for r in spark.table("counted").collect()) == spark.read.parquet(path).count()
    assert refusal({"type": "Sort", "by": []}) and refusal({"type": "Merge", "how": "full"}) and refusal({"type": "Filter"}) is None
    with pytest.raises(StepError, match="Step 1"):
        apply_stream(stream, [{"type": "FillDown", "cols": ["value"]}])


def test_exported_script_gives_the_same_rows(spark, tmp_path):
    import json

    from tessella.__main__ import export_python
    from tessella.plans import Engine, Project

    table = {"kind": "blank", "columns": ["k", "v"], "rows": [["a", "1"], ["b", "2"], ["a", "5"]]}
    queries = [
        {"name": "base", "steps": [{"type": "Source", "source": table}, {"type": "ChangeType", "changes": [{"col": "v", "type": "int"}]}]},
        {"name": "big", "steps": [{"type": "Source", "source": {"kind": "query", "query": "base"}}, {"type": "Filter", "formula": "[v] >= @least"}]},
        {"name": "both", "steps": [{"type": "Source", "source": {"kind": "query", "query": "base"}}, {"type": "Merge", "right": "big", "how": "left", "on": [["v", "v"]], "prefix": "big", "expand": ["k"]}]},
    ]
    project = Project.from_json(json.dumps({"queries": queries, "parameters": [{"name": "least", "type": "number", "value": 2}], "params": [{"name": "least", "type": "number", "value": 2}]}))
    project.params.setdefault("least", {"type": "number", "value": 2})
    script = export_python(project, "both")
    assert script.count("apply_step(r, ") == 3
    space: dict = {}
    exec(script, space)
    assert space["tables"]["both"].ordered().collect() == Engine(spark, project).relation("both").ordered().collect()
