"""Every query of the catalogue against DuckDB."""

import math
import unicodedata

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessella.plans import catalogue


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, small, name):
    df = catalogue.queries()[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(x[names.index(c)]) for c in columns) for x in got.fetchall())
    assert rows == want


def test_pivot_and_global_aggregate_of_all_orders(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet").collect()
    counts = {}
    for o in orders:
        at = counts.setdefault(o["o_custkey"], dict.fromkeys("FOP"))
        at[o["o_orderstatus"]] = (at[o["o_orderstatus"]] or 0) + 1
    got = catalogue.queries()["pivot_count_all"](spark, small).collect()
    assert len(got) == len(counts) > 40
    assert {r["o_custkey"]: {k: r[k] for k in "FOP"} for r in got} == counts
    [total] = catalogue.queries()["group_global_all"](spark, small).collect()
    assert total["n"] == len(orders) > 0 and math.isclose(total["s"], sum(o["o_totalprice"] for o in orders), abs_tol=0.01)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similarity_of_whole_texts(spark, small, tmp_path):
    phrase = "the quick brown fox jumps over"
    texts = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert max(map(len, texts)) > 300
    texts += [phrase, phrase.upper() + "!", "", "é日本🙂 " * 40, "the quick brown fox " * 500, "x" * 60 + phrase]
    pq.write_table(pa.table({"item_id": range(len(texts)), "text": texts}), tmp_path / "benchmark.parquet")
    got = {r["item_id"]: r["s"] for r in catalogue.queries()["similarity_whole"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        t = t.lower()
        assert math.isclose(got[k], 1 - edit_distance(t, phrase) / max(len(t), len(phrase)), abs_tol=1e-9), t


def test_marks_of_whole_texts(spark, tmp_path):
    texts = ["plain " * 20 + "é", "x" * 100_000 + " Ångström", "e\u0301" * 70, "", None]
    sources = ["Web-Crawl, über  web", "a long source name of more than ten characters", "b a", "", None]
    pq.write_table(pa.table({"doc_id": range(5), "text": texts, "source": sources}), tmp_path / "documents.parquet")
    got = {r["doc_id"]: r for r in catalogue.queries()["fn_text_marks_whole"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        assert got[k]["a"] == (None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))
    assert [got[k]["b"] for k in range(5)] == ["crawl uber web", "a characters long more name of source ten than", "a b", "", None]
