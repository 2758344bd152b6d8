"""Row order that holds when plans are run again, and files that change shape far from their beginning."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import apply_step
from tessella.operators.base import Context
from tessella.operators.joining import append_relations
from tessella.relation import Relation
from tessella.sources.files import read_csv, read_folder, read_rows
from tessella.types import StepError

N = 60_000


@pytest.fixture
def stress(spark):
    """Many small shuffle partitions that are put together differently by each plan."""
    keep = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(k) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture
def wide(stress):
    df = stress.range(0, N, 1, 7).select(
        "id", F.pmod(F.xxhash64("id"), F.lit(5_000)).alias("k"), F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("v"), F.md5(F.col("id").cast("string")).alias("a"), F.repeat(F.col("id").cast("string"), 9).alias("b")
    )
    return Relation.of(df)


def ordered(rows):
    return sorted(rows, key=lambda r: (-r["k"], r["id"]))


SORT = {"type": "Sort", "by": [{"col": "k", "desc": True}, {"col": "id"}]}


def steps(r, *specs):
    for s in specs:
        r = apply_step(r, s, Context(collation="binary"))
    return r


def test_no_row_is_lost_or_misnumbered(wide):
    rows = ordered(wide.output().collect())
    got = {x["id"]: x for x in steps(wide, SORT, {"type": "IndexColumn", "name": "ix"}).output().collect()}
    assert len(got) == N
    assert all(got[x["id"]]["ix"] == k and got[x["id"]]["b"] == x["b"] for k, x in enumerate(rows))


def test_fill_and_running_values(wide):
    rows = ordered(wide.output().collect())
    last, total, want = None, 0.0, {}
    for x in rows:
        last = x["v"] if x["v"] is not None else last
        total += x["v"] or 0.0
        want[x["id"]] = (last, total)
    filled = {x["id"]: x["v"] for x in steps(wide, SORT, {"type": "FillDown", "cols": ["v"]}).output().collect()}
    assert filled == {i: w[0] for i, w in want.items()}
    summed = {x["id"]: x["w"] for x in steps(wide, SORT, {"type": "Window", "op": "cumsum", "col": "v", "name": "w"}).output().collect()}
    assert summed == {i: w[1] for i, w in want.items()}


def test_fill_up_is_linear(wide):
    """A frame up to the last row would be read anew for every row of a block."""
    following, want = None, {}
    for x in reversed(ordered(wide.output().collect())):
        following = x["v"] if x["v"] is not None else following
        want[x["id"]] = following
    out = steps(wide, SORT, {"type": "FillUp", "cols": ["v"]}).output()
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()
    assert {x["id"]: x["v"] for x in out.collect()} == want and None in want.values()


@pytest.mark.parametrize("keep", [{"mode": "alternate", "keep": 1, "skip": 2}, {"mode": "range", "offset": 10_000, "n": 500}, {"mode": "remove_bottom", "n": 59_000}, {"mode": "bottom", "n": 7}])
def test_rows_by_place(wide, keep):
    rows = [x["id"] for x in ordered(wide.output().collect())]
    want = {"alternate": rows[::3], "range": rows[10_000:10_500], "remove_bottom": rows[:1_000], "bottom": rows[-7:]}[keep["mode"]]
    assert [x["id"] for x in steps(wide, SORT, {"type": "KeepRows", **keep}).ordered().collect()] == want


def test_sample_after_sql_is_exact(wide):
    sql = steps(wide, {"type": "CustomSql", "sql": "SELECT k, count(*) AS n, max(a) AS a FROM self GROUP BY k ORDER BY n DESC, k"})
    got = steps(sql, {"type": "IndexColumn", "name": "ix"}).output().collect()
    want = sorted(got, key=lambda x: (-x["n"], x["k"]))
    assert [x["ix"] for x in want] == list(range(len(got)))
    assert steps(sql, {"type": "Sample", "mode": "n", "n": 77}).output().count() == 77


@pytest.mark.parametrize("op", ["rank", "dense_rank"])
def test_rank_of_all_rows(wide, op):
    got = steps(wide, {"type": "Window", "op": op, "col": "k", "name": "w"}).output().select("k", "w").collect()
    ks = sorted((x["k"] for x in got), reverse=True)
    place = {}
    for j, k in enumerate(ks):
        place.setdefault(k, j + 1 if op == "rank" else len(place) + 1)
    assert all(x["w"] == place[x["k"]] for x in got)


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "boolean", "date", "timestamp_ntz", "decimal(10,2)"])
@pytest.mark.parametrize("first", [True, False])
def test_falling_keys(stress, kind, first):
    values = {"string": ["", "a", "ab", "abc", "b", "é", "z", "日本", None], "boolean": [True, False, None], "date": ["1950-01-01", "1970-01-02", "2020-02-29", None], "timestamp_ntz": ["1950-01-01 01:02:03.5", "1970-01-02 00:00:00", None]}.get(kind, ["-5", "0", "3", "7", None] + (["NaN", "Infinity"] if kind == "double" else []))
    random.Random(3).shuffle(values)
    df = stress.createDataFrame([(k, None if v is None else str(v)) for k, v in enumerate(values)], "id long, t string").select("id", F.col("t").cast(kind).alias("x"))
    r = steps(Relation.of(df), {"type": "Sort", "by": [{"col": "x", "desc": True, "nullsLast": not first}]}, {"type": "IndexColumn", "name": "ix"})
    got = [x["id"] for x in sorted(r.output().collect(), key=lambda x: x["ix"])]
    want = [x["id"] for x in df.orderBy(F.col("x").desc_nulls_first() if first else F.col("x").desc_nulls_last()).collect()]
    assert got == want


def test_natural_order_falls_too(spark):
    r = Relation.of(spark.createDataFrame([("item10",), ("Item2",), (None,), ("élan",), ("eagle",)], "s string"))
    out = apply_step(apply_step(r, {"type": "Sort", "by": [{"col": "s", "desc": True}]}), {"type": "IndexColumn", "name": "ix"})
    assert [x["s"] for x in sorted(out.output().collect(), key=lambda x: x["ix"])] == ["item10", "Item2", "élan", "eagle", None]


def test_appends_of_appends_and_of_many(spark):
    one = lambda *xs: read_rows(spark, ["x"], [[x] for x in xs])
    twice = append_relations([append_relations([one("a", "b"), one("c", "d")]), one("e", "f")])
    mixed = append_relations([apply_step(one("z", "y"), {"type": "Sort", "by": [{"col": "x"}]}), twice])
    assert [x["x"] for x in mixed.ordered().collect()] == ["y", "z", "a", "b", "c", "d", "e", "f"]
    many = append_relations([one(str(k)) for k in range(140)])
    assert [x["x"] for x in many.ordered().collect()] == [str(k) for k in range(140)]


def test_headers_down_twice(spark):
    r = read_rows(spark, ["a"], [["1"]])
    for _ in range(2):
        r = apply_step(r, {"type": "DemoteHeaders"})
    assert [x["Column1"] for x in r.ordered().collect()] == ["Column1", "a", "1"]


def test_merge_guard(spark):
    r = read_rows(spark, ["k"], [["x"]] * 3)
    big = Relation.of(spark.range(7_000_000).select(F.lit("x").alias("k"), "id"))
    context = Context(resolve=lambda _: big)
    with pytest.raises(StepError, match="21,000,000"):
        apply_step(r, {"type": "Merge", "right": "big", "how": "left", "on": [["k", "k"]], "limitRows": True}, context)


@pytest.mark.parametrize("late", ["1,2,3,4\n", '"x ""y"", z",2\n', '5,"a\nb"\n', '6,"a"b\n'])
def test_csv_changes_far_from_its_beginning(spark, tmp_path, late):
    path = tmp_path / "late.csv"
    path.write_text("a,b\n" + "1,2\n" * 40_000 + late + "\n" + "8,9\n", newline="")
    r = read_csv(spark, str(path))
    rows = r.ordered().collect()
    assert len(rows) == 40_002 and r.names == ["a", "b", *(["Column3", "Column4"] if late.startswith("1,2,3") else [])]
    want = {"1": ("1", "2", "3", "4"), '"': ('x "y", z', "2"), "5": ("5", "a\nb"), "6": ("6", "ab")}[late[0]]
    assert tuple(rows[40_000]) == want and rows[-1][:2] == ("8", "9")


def test_folder_of_many_files(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    for k in range(131):
        extra = ",c" if k % 50 == 7 else ""
        (folder / f"f+{k:03d} x.csv").write_text(f"a,b{extra}\n{k},x{',z' if extra else ''}\n{k + 1000},\n")
    (folder / "f+131 x.csv").write_text('a,b\n131,"two\nlines"\n')
    r = read_folder(spark, str(folder))
    rows = apply_step(r, {"type": "IndexColumn", "name": "ix"}).output().orderBy("ix").collect()
    assert [x["a"] for x in rows] == [v for k in range(131) for v in (str(k), str(k + 1000))] + ["131"]
    assert [x["Source.Name"] for x in rows] == [f"f+{k:03d} x.csv" for k in range(131) for _ in (0, 1)] + ["f+131 x.csv"]
    assert rows[-1]["b"] == "two\nlines" and sum(x["c"] == "z" for x in rows) == 3


@pytest.mark.parametrize("form", ["file", "stream", "feather1", "dictionary"])
def test_arrow_forms(spark, tmp_path, form):
    import datetime as dt

    import pyarrow as pa
    import pyarrow.feather as feather

    from tessella.sources.files import read_arrow

    table = pa.table({"id": list(range(5_000)), "name": [None, "é"] * 2_500, "x": [1.5] * 5_000, "at": [dt.datetime(2020, 1, 2, 3)] * 5_000, "n": pa.array([1] * 5_000, pa.int16())})
    path = str(tmp_path / "t.arrow")
    if form == "feather1":
        table = table.drop(["at"])
        feather.write_feather(table, path, version=1)
    else:
        if form == "dictionary":
            table = table.set_column(1, "name", table["name"].dictionary_encode())
        with pa.OSFile(path, "wb") as f, (pa.ipc.new_stream if form == "stream" else pa.ipc.new_file)(f, table.schema) as out:
            out.write_table(table, max_chunksize=700)
    r = read_arrow(spark, path)
    got = r.ordered().collect()
    assert [x["id"] for x in got] == list(range(5_000)) and got[1]["name"] == "é" and got[0]["name"] is None
    assert r.types["n"] == "int" and (form == "feather1" or got[0]["at"] == dt.datetime(2020, 1, 2, 3))


def test_too_many_json_fields(spark):
    import json

    r = read_rows(spark, ["j"], [[json.dumps({f"k{k}": 1 for k in range(2_001)})]])
    with pytest.raises(StepError, match="more than 2,000 fields"):
        apply_step(r, {"type": "ExpandJson", "col": "j"})
