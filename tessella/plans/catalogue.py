"""One query for each operator over the standard tables, with the same in SQL.

A query is a list of steps over a table; ``others`` are tables or queries that its
steps name. Doubles that depend on the order of summation are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import scratch
from tessella.operators import quality as views
from tessella.operators.joining import merge_stats
from tessella.operators.values import clusters
from tessella.plans.project import Engine, Project, Query
from tessella.relation import Relation, ref
from tessella.sources.sinks import write

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass
class Entry:
    table: str
    steps: list[dict]
    sql: str | None = None
    digits: int | None = None
    others: dict[str, list[dict]] = field(default_factory=dict)
    collation: str = "binary"
    last: Callable[[Relation, Engine], DataFrame] | None = None


def engine(spark: SparkSession, sf_dir: str, queries: dict[str, list[dict]], collation: str = "binary") -> Engine:
    """An engine whose queries start from the Parquet tables of a folder."""
    project = Project({n: Query(n, steps) for n, steps in queries.items()})
    return Engine(spark, project, {t: f"{sf_dir}/{t}.parquet" for t in TABLES}, collation)


def source(table: str) -> dict:
    return {"type": "Source", "source": {"kind": "file", "file": table, "format": "parquet"}}


def run(entry: Entry, spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = {"q": [source(entry.table), *entry.steps]}
    for name, steps in entry.others.items():
        queries[name] = steps if steps and steps[0]["type"] == "Source" else [source(name), *steps]
    e = engine(spark, sf_dir, queries, entry.collation)
    r = e.relation("q")
    df = entry.last(r, e) if entry.last else r.output()
    if entry.digits is not None:
        df = df.select(*((F.round(ref(n), entry.digits) + 0.0 if t == "double" else ref(n)).alias(n) for n, t in df.dtypes))
    return df


def step(kind: str, **fields) -> dict:
    return {"type": kind, **fields}


def add(name: str, formula: str, **more) -> dict:
    return step("AddColumn", name=name, formula=formula, **more)


def select(*cols: str) -> dict:
    return step("SelectColumns", cols=list(cols))


def where(formula: str) -> dict:
    return step("Filter", mode="advanced", formula=formula)


def group(keys: list[str], *aggs: dict) -> dict:
    return step("GroupBy", keys=keys, aggs=list(aggs))


def agg(fn: str, col: str | None = None, name: str | None = None, **more) -> dict:
    return {"fn": fn, "name": name or fn, **({"col": col} if col else {}), **more}


HOLES = add("v", "if [value] > 60 then null else [value]")
"""Events with nulls: the table itself has none."""
HOLES_SQL = "(SELECT *, CASE WHEN value > 60 THEN NULL ELSE value END AS v FROM events)"
CUST = select("c_custkey", "c_name", "c_mktsegment")
DIRTY = [
    add("raw", 'if Number.Mod([o_orderkey], 5) = 0 then "n/a" else if Number.Mod([o_orderkey], 5) = 1 then null else if Number.Mod([o_orderkey], 5) = 2 then "(1,234.5)" else if Number.Mod([o_orderkey], 5) = 3 then "12%" else "$" & Text.From([o_orderkey]) & ".25"'),
    select("o_orderkey", "raw"),
]
DIRTY_SQL = "(SELECT o_orderkey::BIGINT AS o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL WHEN 2 THEN '(1,234.5)' WHEN 3 THEN '12%' ELSE '$' || o_orderkey || '.25' END AS raw FROM orders)"
NUM = "CASE o_orderkey % 5 WHEN 2 THEN -1234.5 WHEN 3 THEN 0.12 WHEN 4 THEN o_orderkey + 0.25 END::DOUBLE"


def _entries() -> dict[str, Entry]:
    q: dict[str, Entry] = {}
    # ---- scan and project
    q["select_columns"] = Entry("orders", [select("o_orderkey", "o_totalprice")], "SELECT o_orderkey, o_totalprice FROM orders")
    q["remove_columns"] = Entry("nation", [step("RemoveColumns", cols=["n_regionkey"])], "SELECT n_nationkey::BIGINT n_nationkey, n_name FROM nation")
    q["remove_other_columns"] = Entry("nation", [step("RemoveOtherColumns", cols=["n_name"])], "SELECT n_name FROM nation")
    q["reorder"] = Entry("nation", [step("ReorderColumns", cols=["n_name"])], "SELECT n_name, n_nationkey::BIGINT n_nationkey, n_regionkey::BIGINT n_regionkey FROM nation")
    q["rename_swap"] = Entry("nation", [step("Rename", map=[["n_nationkey", "n_regionkey"], ["n_regionkey", "n_nationkey"]])], "SELECT n_nationkey::BIGINT AS n_regionkey, n_name, n_regionkey::BIGINT AS n_nationkey FROM nation")
    q["add_column_revenue"] = Entry("lineitem", [add("revenue", "[l_extendedprice] * (1 - [l_discount])"), select("l_orderkey", "l_linenumber", "l_partkey", "revenue")], "SELECT l_orderkey, l_linenumber::BIGINT l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
    q["conditional_size"] = Entry("part", [step("ConditionalColumn", name="size", rules=[{"when": "[p_size] > 40", "then": '"big"'}, {"when": "[p_size] > 15", "then": '"mid"'}], **{"else": '"small"'}), select("p_partkey", "size")], "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 15 THEN 'mid' ELSE 'small' END AS size FROM part")
    q["duplicate"] = Entry("region", [step("DuplicateColumn", col="r_name")], "SELECT r_regionkey::BIGINT r_regionkey, r_name, r_name AS \"r_name - Copy\" FROM region")
    q["index_by_event"] = Entry("events", [step("Sort", by=[{"col": "event_id", "desc": True}]), step("IndexColumn", name="ix", start=1, step=2), select("event_id", "ix")], "SELECT event_id, (row_number() OVER (ORDER BY event_id DESC) - 1) * 2 + 1 AS ix FROM events")
    # ---- filters
    q["filter_formula"] = Entry("lineitem", [where('[l_quantity] >= 30 and [l_returnflag] = "R"'), select("l_orderkey", "l_quantity", "l_returnflag")], "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_quantity >= 30 AND l_returnflag = 'R'")
    q["filter_builder_in"] = Entry("customer", [step("Filter", mode="builder", builder={"join": "and", "conds": [{"col": "c_mktsegment", "op": "in", "values": ["BUILDING", "MACHINERY"]}, {"col": "c_acctbal", "op": "gt", "value": "0"}]}), CUST], "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0")
    q["filter_null_safe_ne"] = Entry("events", [HOLES, where("[v] <> 10"), select("event_id")], f"SELECT event_id FROM {HOLES_SQL} WHERE v IS DISTINCT FROM 10")
    q["filter_three_valued"] = Entry("events", [HOLES, where("not ([v] > 20) or [user_id] < 5"), select("event_id")], f"SELECT event_id FROM {HOLES_SQL} WHERE NOT (v > 20) OR user_id < 5")
    q["filter_date_range"] = Entry("orders", [where('[o_orderdate] >= #date(1995, 1, 1) and [o_orderdate] < Date.From("1996-01-01")'), select("o_orderkey")], "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
    q["filter_like_contains"] = Entry("part", [step("Filter", mode="builder", builder={"join": "or", "conds": [{"col": "p_name", "op": "contains", "value": "1"}, {"col": "p_type", "op": "starts", "value": "S"}]}), select("p_partkey")], "SELECT p_partkey FROM part WHERE contains(p_name, '1') OR starts_with(p_type, 'S')")
    # ---- casts and errors
    q["cast_number_locale"] = Entry("orders", [add("raw", 'if Number.Mod([o_orderkey], 2) = 0 then "1.234,50" else Text.From([o_orderkey]) & ",75"'), select("o_orderkey", "raw"), step("ChangeType", locale="de-DE", onError="null", changes=[{"col": "raw", "type": "number"}])], "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1234.5::DOUBLE ELSE o_orderkey + 0.75::DOUBLE END AS raw FROM orders")
    q["cast_date_locale"] = Entry("orders", [add("raw", 'Date.ToText([o_orderdate], "dd/MM/yyyy")'), select("o_orderkey", "raw"), step("ChangeType", locale="en-GB", changes=[{"col": "raw", "type": "date"}])], "SELECT o_orderkey, o_orderdate::DATE AS raw FROM orders")
    q["cast_bool_words"] = Entry("orders", [add("raw", 'if Number.Mod([o_orderkey], 3) = 0 then "Yes" else if Number.Mod([o_orderkey], 3) = 1 then " falsch" else "perhaps"'), select("o_orderkey", "raw"), step("ChangeType", onError="null", changes=[{"col": "raw", "type": "bool"}])], "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS raw FROM orders")
    q["cast_keep_errors"] = Entry("orders", [*DIRTY, step("ChangeType", onError="keep", changes=[{"col": "raw", "type": "number"}])], f"SELECT o_orderkey, {NUM} AS raw, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' END AS raw_error FROM {DIRTY_SQL}")
    q["cast_int_half_up"] = Entry("part", [add("x", "[p_size] - 20.5"), step("ChangeType", changes=[{"col": "x", "type": "int"}]), select("p_partkey", "x")], "SELECT p_partkey, floor(p_size - 20.5::DOUBLE + 0.5)::BIGINT AS x FROM part")
    q["replace_errors"] = Entry("orders", [*DIRTY, step("ChangeType", changes=[{"col": "raw", "type": "number"}]), step("ReplaceErrors", cols=["raw"], value="0")], f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0::DOUBLE ELSE {NUM} END AS raw FROM {DIRTY_SQL}")
    q["keep_errors"] = Entry("orders", [*DIRTY, step("ChangeType", changes=[{"col": "raw", "type": "number"}]), step("KeepErrors"), select("o_orderkey")], "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
    q["remove_errors"] = Entry("orders", [*DIRTY, step("ChangeType", changes=[{"col": "raw", "type": "number"}]), step("RemoveErrors", cols=["raw"]), select("o_orderkey")], "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0")
    q["div_zero_try"] = Entry("part", [add("d", "try 100 / ([p_size] - 10) otherwise -1"), select("p_partkey", "d")], "SELECT p_partkey, coalesce(100::DOUBLE / nullif(p_size - 10, 0), -1) AS d FROM part")
    # ---- rows
    by_id = step("Sort", by=[{"col": "event_id"}])
    q["distinct_first"] = Entry("events", [by_id, step("Distinct", subset=["user_id", "event_type"]), select("event_id", "user_id", "event_type")], "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
    q["distinct_rows"] = Entry("lineitem", [select("l_returnflag", "l_linestatus"), step("Distinct")], "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
    q["keep_duplicates"] = Entry("orders", [step("KeepDuplicates", subset=["o_custkey", "o_orderstatus"]), select("o_orderkey")], "SELECT o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders) WHERE n > 1")
    q["top_n"] = Entry("orders", [step("Sort", by=[{"col": "o_totalprice", "desc": True}, {"col": "o_orderkey"}]), step("KeepRows", mode="top", n=25), select("o_orderkey", "o_totalprice")], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
    q["bottom_n"] = Entry("orders", [step("Sort", by=[{"col": "o_orderkey"}]), step("KeepRows", mode="bottom", n=10), select("o_orderkey")], "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10")
    q["range_rows"] = Entry("events", [by_id, step("KeepRows", mode="range", offset=100, n=50), select("event_id")], "SELECT event_id FROM events ORDER BY event_id LIMIT 50 OFFSET 100")
    q["remove_top_bottom"] = Entry("events", [by_id, step("KeepRows", mode="remove_top", n=10), step("KeepRows", mode="remove_bottom", n=20), select("event_id")], "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k, count(*) OVER () AS n FROM events) WHERE k > 10 AND k <= n - 20")
    q["alternate_rows"] = Entry("events", [by_id, step("KeepRows", mode="alternate", keep=2, skip=3, offset=4), select("event_id")], "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events) WHERE k >= 4 AND (k - 4) % 5 < 2")
    q["remove_blank"] = Entry("events", [HOLES, add("t", 'if [v] = null then "" else [event_type]'), select("v", "t"), step("KeepRows", mode="remove_blank")], f"SELECT v, CASE WHEN v IS NULL THEN '' ELSE event_type END AS t FROM {HOLES_SQL} WHERE v IS NOT NULL")
    q["sample_exact"] = Entry("events", [by_id, step("Sample", mode="n", n=100, seed=7), select("event_id")])
    q["promote_headers"] = Entry("region", [select("r_name"), step("DemoteHeaders"), step("PromoteHeaders", row=0)], "SELECT r_name FROM region")
    # ---- values
    q["fill_down"] = Entry("events", [HOLES, by_id, step("FillDown", cols=["v"]), select("event_id", "v")], f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM {HOLES_SQL}")
    q["fill_up"] = Entry("events", [HOLES, by_id, step("FillUp", cols=["v"]), select("event_id", "v")], f"SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM {HOLES_SQL}")
    q["replace_whole"] = Entry("orders", [step("ReplaceValues", cols=["o_orderstatus"], find="F", replace="done"), select("o_orderkey", "o_orderstatus")], "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders")
    q["replace_null"] = Entry("events", [HOLES, step("ReplaceValues", cols=["v"], find="", replace="-1"), select("event_id", "v")], f"SELECT event_id, coalesce(v, -1) AS v FROM {HOLES_SQL}")
    q["replace_sub"] = Entry("customer", [step("ReplaceValues", cols=["c_name"], find="#0", replace="-", wholeCell=False), select("c_custkey", "c_name")], "SELECT c_custkey, replace(c_name, '#0', '-') AS c_name FROM customer")
    q["text_clean"] = Entry("documents", [step("TextTransform", op="clean", cols=["text"]), step("TextTransform", op="upper", cols=["lang"]), select("doc_id", "lang", "text")], r"SELECT doc_id, upper(lang) AS lang, trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents")
    q["round_half_up"] = Entry("lineitem", [step("RoundNumbers", cols=["l_extendedprice"], digits=1), step("RoundNumbers", cols=["l_quantity"], digits=0), select("l_orderkey", "l_extendedprice", "l_quantity")], "SELECT l_orderkey, floor(l_extendedprice * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS l_extendedprice, floor(l_quantity + 0.5)::BIGINT AS l_quantity FROM lineitem")
    q["split_each"] = Entry("part", [select("p_partkey", "p_type"), step("SplitColumn", col="p_type", mode="each", delimiter=" ")], None)
    q["split_first_last"] = Entry("customer", [select("c_custkey", "c_name"), step("DuplicateColumn", col="c_name", name="d"), step("SplitColumn", col="c_name", mode="first", delimiter="0"), step("SplitColumn", col="d", mode="last", delimiter="0")], "SELECT c_custkey, CASE WHEN i = 0 THEN c_name ELSE substr(c_name, 1, i - 1) END AS \"c_name.1\", CASE WHEN i > 0 THEN substr(c_name, i + 1) END AS \"c_name.2\", CASE WHEN i = 0 THEN c_name ELSE substr(c_name, 1, length(c_name) - j) END AS \"d.1\", CASE WHEN i > 0 THEN substr(c_name, length(c_name) - j + 2) END AS \"d.2\" FROM (SELECT c_custkey, c_name, instr(c_name, '0') AS i, instr(reverse(c_name), '0') AS j FROM customer)")
    q["split_positions"] = Entry("customer", [select("c_custkey", "c_name"), step("SplitColumn", col="c_name", mode="positions", positions="0, 3, -2", trim=False)], "SELECT c_custkey, '' AS \"c_name.1\", left(c_name, 3) AS \"c_name.2\", substr(c_name, 4) AS \"c_name.3\" FROM customer")
    q["split_rows"] = Entry("part", [select("p_partkey", "p_type"), step("SplitColumn", col="p_type", mode="rows", delimiter=" ")], "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS p_type FROM part")
    q["merge_columns"] = Entry("nation", [step("MergeColumns", cols=["n_nationkey", "n_name"], sep="|", name="both")], "SELECT n_nationkey || '|' || n_name AS \"both\", n_regionkey::BIGINT n_regionkey FROM nation")
    # ---- joins
    orders3 = select("o_orderkey", "o_custkey", "o_orderstatus")
    some = [where("[c_acctbal] > 0"), add("k", "if [c_custkey] < 50 then null else [c_custkey]"), select("k", "c_name", "c_mktsegment")]
    some_sql = "(SELECT CASE WHEN c_custkey < 50 THEN NULL ELSE c_custkey END AS k, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0)"
    for how in ("left", "inner", "right", "full"):
        key = "coalesce(o_custkey, k)" if how in ("right", "full") else "o_custkey"
        q[f"merge_{how}"] = Entry("orders", [orders3, step("Merge", right="customer", how=how, on=[["o_custkey", "k"]])], f"SELECT o_orderkey, {key} AS o_custkey, o_orderstatus, c_name, c_mktsegment FROM orders {how} JOIN {some_sql} ON o_custkey = k", others={"customer": some})
    q["merge_semi"] = Entry("orders", [orders3, step("Merge", right="customer", how="semi", on=[["o_custkey", "k"]])], f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT k FROM {some_sql} WHERE k IS NOT NULL)", others={"customer": some})
    q["merge_anti"] = Entry("orders", [orders3, step("Merge", right="customer", how="anti", on=[["o_custkey", "k"]])], f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM {some_sql} WHERE k = o_custkey)", others={"customer": some})
    q["merge_cross"] = Entry("region", [step("Merge", right="nation", how="cross", expand=["n_name"])], "SELECT r_regionkey::BIGINT r_regionkey, r_name, n_name FROM region CROSS JOIN nation", others={"nation": []})
    q["merge_multi_key"] = Entry("lineitem", [select("l_orderkey", "l_partkey", "l_suppkey"), step("Distinct"), step("Merge", right="supplier", how="inner", on=[["l_suppkey", "s_suppkey"], ["l_partkey", "p"]], prefix="s")], "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, s_name AS \"s.s_name\" FROM lineitem JOIN supplier ON l_suppkey = s_suppkey AND l_partkey = s_suppkey * 7", others={"supplier": [add("p", "[s_suppkey] * 7"), select("s_suppkey", "p", "s_name")]})
    q["merge_cast_keys"] = Entry("nation", [add("t", "Text.From([n_regionkey])"), step("Merge", right="region", how="left", on=[["t", "r_regionkey"]], castKeys=True), select("n_name", "r_name")], "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey", others={"region": []})
    q["merge_type_mismatch"] = Entry("nation", [add("t", "Text.From([n_regionkey])"), step("Merge", right="region", how="left", on=[["t", "r_regionkey"]]), select("n_name", "r_name")], "SELECT n_name, NULL::VARCHAR AS r_name FROM nation", others={"region": []})

    def stats(r, e):
        got = merge_stats(r, e.relation("customer"), {"on": [["o_custkey", "k"]], "how": "left"})
        names = ("matched", "total", "rightMatched", "rightTotal", "duplicateKeys", "outputRows")
        return r.df.sparkSession.createDataFrame([tuple(int(got[n]) for n in names)], ", ".join(f"{n} long" for n in names))

    q["merge_stats"] = Entry("orders", [], f"SELECT count_if(k IS NOT NULL) AS matched, count(*) AS total, (SELECT count(*) FROM {some_sql} WHERE k IN (SELECT o_custkey FROM orders)) AS \"rightMatched\", (SELECT count(*) FROM {some_sql}) AS \"rightTotal\", (SELECT count(*) FROM (SELECT k FROM {some_sql} GROUP BY k HAVING count(*) > 1)) AS \"duplicateKeys\", count(*) AS \"outputRows\" FROM orders LEFT JOIN {some_sql} ON o_custkey = k", others={"customer": some}, last=stats)
    # ---- set operations
    q["append_diagonal"] = Entry("customer", [select("c_custkey", "c_name", "c_acctbal"), step("Rename", map=[["c_custkey", "key"], ["c_name", "name"]]), step("Append", others=["supplier"])], "SELECT c_custkey AS key, c_name AS name, c_acctbal, NULL::BIGINT AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier", others={"supplier": [step("Rename", map=[["s_suppkey", "key"], ["s_name", "name"], ["s_nationkey", "nation"]]), select("key", "name", "nation")]})
    q["append_strict"] = Entry("nation", [select("n_name"), step("Append", others=["n2"], mode="strict")], "SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 1", others={"n2": [source("nation"), where("[n_regionkey] = 1"), select("n_name")]})
    # ---- aggregation
    q["group_basic"] = Entry("lineitem", [group(["l_returnflag", "l_linestatus"], agg("sum", "l_quantity", "sum_qty"), agg("mean", "l_extendedprice", "avg_price"), agg("count_rows", name="n"), agg("count", "l_discount", "nd"))], "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n, count(l_discount) AS nd FROM lineitem GROUP BY ALL", digits=4)
    q["group_distinct"] = Entry("orders", [group(["o_orderpriority"], agg("count_distinct", "o_custkey", "customers"))], "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
    q["group_median_percentile"] = Entry("events", [HOLES, group(["event_type"], agg("median", "v", "med"), agg("percentile", "v", "p90", p=90))], f"SELECT event_type, round(median(v), 6) AS med, round(quantile_cont(v, 0.9), 6) AS p90 FROM {HOLES_SQL} GROUP BY 1", digits=6)
    q["group_std_var"] = Entry("events", [HOLES, group(["user_id"], agg("std", "v", "sd"), agg("var", "v", "vr"))], f"SELECT user_id, round(stddev_samp(v), 4) AS sd, round(var_samp(v), 4) AS vr FROM {HOLES_SQL} GROUP BY 1", digits=4)
    q["group_mode"] = Entry("orders", [group(["o_orderstatus"], agg("mode", "o_orderpriority", "m"))], "SELECT o_orderstatus, (array_agg(o_orderpriority ORDER BY n DESC, o_orderpriority))[1] AS m FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
    q["group_min_max_text"] = Entry("customer", [group(["c_mktsegment"], agg("min", "c_name", "a"), agg("max", "c_name", "z"), agg("max", "c_acctbal", "bal"))], "SELECT c_mktsegment, min(c_name) AS a, max(c_name) AS z, max(c_acctbal) AS bal FROM customer GROUP BY 1")
    q["group_first_last"] = Entry("events", [HOLES, by_id, group(["user_id"], agg("first", "v", "f"), agg("last", "event_type", "l"))], f"SELECT user_id, arg_min_null(v, event_id) AS f, arg_max(event_type, event_id) AS l FROM {HOLES_SQL} GROUP BY 1")
    q["group_concat"] = Entry("nation", [step("Sort", by=[{"col": "n_nationkey"}]), group(["n_regionkey"], agg("concat", "n_name", "names", sep="; "))], "SELECT n_regionkey::BIGINT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
    q["group_global_all"] = Entry("orders", [group([], agg("count_rows", name="n"), agg("sum", "o_totalprice", "s"))], "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders", digits=2)
    # ---- windows
    over = "PARTITION BY user_id ORDER BY event_id"
    for suffix, part, o in (("", ["user_id"], over), ("_all", None, "ORDER BY event_id")):
        base = {"partition": part} if part else {}
        lasts = lambda n, o=o: f"OVER ({o} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
        sqls = {
            "cumsum": (f"coalesce(sum(v) OVER ({o} ROWS UNBOUNDED PRECEDING), 0)", {}),
            "row_number": (f"row_number() OVER ({o})", {}),
            "diff": (f"v - lag(v) OVER ({o})", {}),
            "cummax": (f"max(v) OVER ({o} ROWS UNBOUNDED PRECEDING)", {}),
            "cummin": (f"min(v) OVER ({o} ROWS UNBOUNDED PRECEDING)", {}),
            "pct_change": (f"(v - lag(v) OVER ({o})) / nullif(lag(v) OVER ({o}), 0)", {}),
            "rolling_sum": (f"sum(v) {lasts(2)}", {"n": 3}),
            "rolling_min": (f"min(v) {lasts(2)}", {"n": 3}),
            "rolling_max": (f"max(v) {lasts(2)}", {"n": 3}),
            "rolling_std": (f"stddev_samp(v) {lasts(3)}", {"n": 4}),
            "moving_avg": (f"avg(v) {lasts(4)}", {"n": 5}),
            "lag": (f"lag(v, 2) OVER ({o})", {"n": 2}),
            "lead": (f"lead(v, 1) OVER ({o})", {"n": 1}),
            "rank": (f"rank() OVER ({'PARTITION BY user_id ' if part else ''}ORDER BY v DESC NULLS LAST)", {}),
            "dense_rank": (f"dense_rank() OVER ({'PARTITION BY user_id ' if part else ''}ORDER BY v DESC NULLS LAST)", {}),
            "pct_of_total": (f"v / nullif(sum(v) OVER ({'PARTITION BY user_id' if part else ''}), 0)", {}),
        }
        for op, (sql, more) in sqls.items():
            q[f"window_{op}{suffix}"] = Entry("events", [HOLES, by_id, step("Window", op=op, col="v", name="w", **base, **more), select("event_id", "w")], f"SELECT event_id, {sql if op in ('row_number', 'rank', 'dense_rank') else f'round({sql}, 6) + 0.0'} AS w FROM {HOLES_SQL}", digits=6)
    q["window_order_desc_nulls"] = Entry("events", [HOLES, by_id, step("Window", op="row_number", partition=["user_id"], orderBy="v", desc=True, name="w"), select("event_id", "w")], f"SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY v DESC NULLS LAST, event_id) AS w FROM {HOLES_SQL}")
    # ---- whole rows after a sort, and after several appends
    wide, keys = "* REPLACE (l_linenumber::BIGINT AS l_linenumber, l_shipdate::TIMESTAMP AS l_shipdate)", ("l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount")
    sort_lines, lines = step("Sort", by=[{"col": "l_extendedprice", "desc": True}, *({"col": k} for k in keys[1:])]), "OVER (ORDER BY l_extendedprice DESC, " + ", ".join(keys[1:])
    sort_orders, orders = step("Sort", by=[{"col": "o_totalprice"}, {"col": "o_orderkey", "desc": True}]), "OVER (ORDER BY o_totalprice, o_orderkey DESC"
    gaps = step("ReplaceValues", cols=["o_orderstatus"], find="F", replace="")
    gone = "CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END"
    q["sorted_index_orders"] = Entry("orders", [sort_orders, step("IndexColumn", name="ix")], f"SELECT *, row_number() {orders}) - 1 AS ix FROM orders")
    q["sorted_index_lineitem"] = Entry("lineitem", [sort_lines, step("IndexColumn", name="ix", start=1)], f"SELECT {wide}, row_number() {lines}) AS ix FROM lineitem")
    q["sorted_fill_orders"] = Entry("orders", [gaps, sort_orders, step("FillDown", cols=["o_orderstatus"])], f"SELECT * REPLACE (last_value({gone} IGNORE NULLS) {orders} ROWS UNBOUNDED PRECEDING) AS o_orderstatus) FROM orders")
    q["sorted_cumsum_lineitem"] = Entry("lineitem", [sort_lines, step("Window", op="cumsum", col="l_quantity", name="w")], f"SELECT {wide}, sum(l_quantity) {lines} ROWS UNBOUNDED PRECEDING) AS w FROM lineitem", digits=4)
    q["sorted_lag_orders"] = Entry("orders", [sort_orders, step("Window", op="lag", col="o_custkey", n=3, name="w")], f"SELECT *, lag(o_custkey, 3) {orders}) AS w FROM orders")
    q["sorted_alternate_lineitem"] = Entry("lineitem", [sort_lines, step("KeepRows", mode="alternate", keep=2, skip=1)], f"SELECT {wide} FROM lineitem QUALIFY (row_number() {lines}) - 1) % 3 < 2")
    q["sorted_by_text_orders"] = Entry("orders", [step("Sort", by=[{"col": "o_orderpriority", "desc": True}, {"col": "o_orderdate", "desc": True}, {"col": "o_orderkey"}]), step("IndexColumn", name="ix")], "SELECT *, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderdate DESC, o_orderkey) - 1 AS ix FROM orders")
    q["sorted_range_orders"] = Entry("orders", [sort_orders, step("KeepRows", mode="range", offset=50, n=200)], "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey DESC LIMIT 200 OFFSET 50")
    three = {"nation": [source("nation"), select("n_name")], "region": [source("region"), select("r_name"), step("Rename", map=[["r_name", "n_name"]]), step("Sort", by=[{"col": "n_name", "desc": True}])]}
    q["append_twice_in_order"] = Entry("supplier", [select("s_name"), step("Sort", by=[{"col": "s_name"}]), step("Rename", map=[["s_name", "n_name"]]), step("Append", others=["nation"]), step("Append", others=["region"]), step("IndexColumn", name="ix")], "SELECT n_name, row_number() OVER (ORDER BY t, k, n_name) - 1 AS ix FROM (SELECT s_name AS n_name, 0 AS t, 0 AS k FROM supplier UNION ALL SELECT n_name, 1, n_nationkey FROM nation UNION ALL SELECT r_name, 2, -rank() OVER (ORDER BY r_name) FROM region)", others=three)
    # ---- reshaping
    q["unpivot"] = Entry("part", [select("p_partkey", "p_size", "p_retailprice"), step("Unpivot", ids=["p_partkey"], var="attr", val="x")], "SELECT p_partkey, 'p_size' AS attr, p_size::DOUBLE AS x FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
    kinds = ("click", "error", "purchase", "signup", "view")
    sums = ", ".join(f"round(sum(value) FILTER (event_type = '{k}'), 4) AS {k}" for k in kinds)
    q["pivot_sum"] = Entry("events", [step("Pivot", on="event_type", values="value", agg="sum", index=["user_id"], keys=list(kinds))], f"SELECT user_id, {sums} FROM events GROUP BY 1", digits=4)
    q["pivot_count_all"] = Entry("orders", [step("Pivot", on="o_orderstatus", agg="count_rows", index=["o_custkey"]), select("o_custkey", "F", "O", "P")], "SELECT o_custkey, nullif(count_if(o_orderstatus = 'F'), 0) AS \"F\", nullif(count_if(o_orderstatus = 'O'), 0) AS \"O\", nullif(count_if(o_orderstatus = 'P'), 0) AS \"P\" FROM orders GROUP BY 1")
    q["pivot_text_first"] = Entry("nation", [step("Sort", by=[{"col": "n_nationkey"}]), add("side", 'if [n_nationkey] < 12 then "low" else "high"'), step("Pivot", on="side", values="n_name", agg="first", index=["n_regionkey"])], "SELECT n_regionkey::BIGINT n_regionkey, arg_min(n_name, n_nationkey) FILTER (n_nationkey < 12) AS low, arg_min(n_name, n_nationkey) FILTER (n_nationkey >= 12) AS high FROM nation GROUP BY 1")
    q["transpose_small"] = Entry("region", [step("Sort", by=[{"col": "r_regionkey"}]), step("Transpose", headerCol="r_name")], "SELECT 'r_regionkey' AS \"Name\", '0' AS \"AFRICA\", '1' AS \"AMERICA\", '2' AS \"ASIA\", '3' AS \"EUROPE\", '4' AS \"MIDDLE EAST\"")
    # ---- formula functions, by family
    q["fn_text_1"] = Entry("part", [add("a", "Text.Upper([p_name])"), add("b", "Text.Lower([p_brand])"), add("c", "Text.Length([p_name])"), add("d", "Text.Start([p_name], 4) & Text.End([p_name], 3) & Text.Middle([p_name], 2, 3)"), add("e", 'Text.Replace([p_type], " ", "_")'), add("f", 'Text.PadStart(Text.From([p_size]), 5, "0") & Text.PadEnd(Text.From([p_size]), 4, "*")'), select("p_partkey", "a", "b", "c", "d", "e", "f")], "SELECT p_partkey, upper(p_name) a, lower(p_brand) b, length(p_name) c, left(p_name, 4) || right(p_name, 3) || substr(p_name, 3, 3) d, replace(p_type, ' ', '_') e, lpad(p_size::VARCHAR, 5, '0') || rpad(p_size::VARCHAR, 4, '*') f FROM part")
    q["fn_text_2"] = Entry("pages", [add("a", 'Text.BeforeDelimiter([url], "/")'), add("b", 'Text.AfterDelimiter([url], "//")'), add("c", 'Text.RegexExtract([url], "^(\\w+)://([^/]+)", 2)'), add("d", 'Text.RegexReplace([url], "[0-9]+", "#")'), add("e", 'Text.RegexMatch([url], "[0-9]$")'), add("f", 'Text.Contains([html], "<p") and Text.StartsWith([url], "http")'), select("page_id", "a", "b", "c", "d", "e", "f")], r"SELECT page_id, split_part(url, '/', 1) a, CASE WHEN contains(url, '//') THEN substr(url, instr(url, '//') + 2) ELSE '' END b, nullif(regexp_extract(url, '^(\w+)://([^/]+)', 2), '') c, regexp_replace(url, '[0-9]+', '#', 'g') d, regexp_matches(url, '[0-9]$') e, contains(html, '<p') AND starts_with(url, 'http') f FROM pages")
    q["fn_text_3"] = Entry("nation", [add("a", "Text.Proper([n_name])"), add("b", 'Text.Repeat([n_name], 2)'), add("c", 'Text.Combine([n_name], null, "-", [n_regionkey])'), add("d", 'Text.Trim("  " & [n_name] & " ")'), add("e", 'Text.Similarity([n_name], "GERMANY")'), select("n_nationkey", "a", "b", "c", "d", "e")], "SELECT n_nationkey::BIGINT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') a, repeat(n_name, 2) b, n_name || '-' || n_regionkey c, n_name d, round(1 - levenshtein(lower(n_name), 'germany') / greatest(length(n_name), 7)::DOUBLE, 9) e FROM nation", digits=9)
    q["fn_text_marks_whole"] = Entry("documents", [add("a", "Text.RemoveDiacritics([text])"), add("b", "Text.Fingerprint([source])"), select("doc_id", "a", "b")], "SELECT doc_id, strip_accents(text) a, lower(source) b FROM documents")
    q["fn_number"] = Entry("lineitem", [add("a", "Number.Round([l_extendedprice], 1)"), add("b", "Number.RoundUp([l_tax] * 100)"), add("c", "Number.Mod([l_quantity], 7)"), add("d", "Number.IntegerDivide([l_quantity], 4)"), add("e", "Number.Sign([l_quantity] - 25)"), add("f", "Number.Clamp([l_quantity], 10, 30)"), add("g", "Number.Sqrt([l_quantity]) + Number.Power([l_quantity], 2) + Number.Abs(0 - [l_quantity])"), add("h", "Number.Log([l_quantity])"), select("l_orderkey", "a", "b", "c", "d", "e", "f", "g", "h")], "SELECT l_orderkey, round_even(l_extendedprice * 10.0::DOUBLE, 0) / 10.0::DOUBLE a, ceil(l_tax * 100)::BIGINT b, l_quantity % 7 c, floor(l_quantity / 4)::BIGINT d, sign(l_quantity - 25)::BIGINT e, least(30.0::DOUBLE, greatest(10.0::DOUBLE, l_quantity)) f, round(sqrt(l_quantity) + l_quantity * l_quantity + l_quantity, 6) g, round(ln(l_quantity), 6) h FROM lineitem", digits=6)
    q["fn_number_from"] = Entry("orders", [*DIRTY, add("n", "try Number.From([raw]) otherwise -1"), add("e", "Value.IsError(Number.From([raw]))"), select("o_orderkey", "n", "e")], f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -1::DOUBLE ELSE {NUM} END n, o_orderkey % 5 = 0 AS e FROM {DIRTY_SQL}")
    d = "o_orderdate"
    q["fn_date"] = Entry("orders", [add("y", f"Date.Year([{d}]) * 10000 + Date.Month([{d}]) * 100 + Date.Day([{d}])"), add("q", f"Date.Quarter([{d}])"), add("w", f"Date.WeekOfYear([{d}])"), add("wd", f"Date.DayOfWeek([{d}])"), add("mn", f"Date.MonthName([{d}])"), add("dn", f"Date.DayOfWeekName([{d}])"), add("som", f"Date.StartOfMonth([{d}])"), add("eom", f"Date.EndOfMonth([{d}])"), add("t", f'Date.ToText([{d}], "dd MMM yyyy")'), select("o_orderkey", "y", "q", "w", "wd", "mn", "dn", "som", "eom", "t")], f"SELECT o_orderkey, year({d}) * 10000 + month({d}) * 100 + day({d}) y, quarter({d}) q, week({d}) w, isodow({d}) wd, monthname({d}) mn, dayname({d}) dn, date_trunc('month', {d})::DATE som, last_day({d}) eom, strftime({d}, '%d %b %Y') t FROM orders")
    q["fn_date_math"] = Entry("orders", [add("a", f"Date.AddDays([{d}], 10)"), add("b", f"Date.AddMonths([{d}], 1)"), add("c", f"Date.DiffDays(#date(1995, 1, 1), [{d}])"), add("e", f"[{d}] - #date(1995, 1, 1)"), add("g", f"[{d}] + 0.5"), add("h", f"Number.From([{d}])"), select("o_orderkey", "a", "b", "c", "e", "g", "h")], f"SELECT o_orderkey, {d} + INTERVAL 10 DAY a, {d} + INTERVAL 1 MONTH b, floor(epoch({d} - TIMESTAMP '1995-01-01') / 86400 + 0.5)::BIGINT c, floor(epoch({d} - TIMESTAMP '1995-01-01') / 86400 + 0.5)::BIGINT e, {d} + INTERVAL 12 HOUR g, round(epoch({d} - TIMESTAMP '1899-12-30') / 86400, 6) h FROM orders", digits=6)
    q["fn_logic"] = Entry("events", [HOLES, add("a", "Coalesce([v], -1)"), add("b", "Value.IsNull([v])"), add("c", 'List.Contains({"click", "view"}, [event_type])'), add("e", "if [v] > 10 and [v] < 30 then 1 else 0"), add("f", "[v] = null or [v] >= 30"), select("event_id", "a", "b", "c", "e", "f")], f"SELECT event_id, coalesce(v, -1) a, v IS NULL b, event_type IN ('click', 'view') c, CASE WHEN v > 10 AND v < 30 THEN 1 ELSE 0 END::BIGINT e, v IS NULL OR v >= 30 f FROM {HOLES_SQL}")
    # ---- JSON and SQL
    q["expand_json_props"] = Entry("events", [select("event_id", "props"), step("ExpandJson", col="props")], "SELECT event_id, (props->>'$.k')::BIGINT AS \"props.k\" FROM events")
    q["expand_json_array"] = Entry("nation", [add("j", '"[" & Text.From([n_nationkey]) & ",7]"'), select("n_name", "j"), step("ExpandJson", col="j")], "SELECT n_name, unnest([n_nationkey::VARCHAR, '7']) AS j FROM nation")
    q["custom_sql_self"] = Entry("orders", [step("CustomSql", sql="SELECT o_orderstatus, count(*) AS n FROM self GROUP BY o_orderstatus")], "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
    q["custom_sql_join"] = Entry("nation", [step("CustomSql", sql="WITH r AS (SELECT * FROM region) SELECT s.n_name, r.r_name FROM self s JOIN r ON s.n_regionkey = r.r_regionkey")], "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", others={"region": []})
    # ---- quality
    rules = [{"col": "v", "check": "not_null"}, {"col": "v", "check": "range", "arg": "5", "arg2": "50"}, {"col": "event_type", "check": "in", "arg": "click, view"}, {"col": "user_id", "check": "unique"}, {"col": "event_type", "check": "length", "arg": 5}, {"col": "event_type", "check": "regex", "arg": "^[cv]"}]
    texts = "concat_ws('; ', CASE WHEN v IS NULL THEN 'v is empty' END, CASE WHEN v < 5 OR v > 50 THEN 'v outside 5…50' END, CASE WHEN event_type NOT IN ('click', 'view') THEN 'event_type not in allowed list' END, CASE WHEN count(*) OVER (PARTITION BY user_id) > 1 THEN 'user_id is duplicated' END, CASE WHEN length(event_type) < 5 THEN 'event_type length outside 5–∞' END, CASE WHEN NOT regexp_matches(event_type, '^[cv]') THEN 'event_type does not match ^[cv]' END)"
    q["validate_flag"] = Entry("events", [HOLES, step("Validate", rules=rules), select("event_id", "Issues")], f"SELECT event_id, nullif({texts}, '') AS \"Issues\" FROM {HOLES_SQL}")
    q["validate_keep_invalid"] = Entry("events", [HOLES, step("Validate", rules=rules[:3], action="keep_invalid", name="why"), select("event_id", "why")], f"SELECT event_id, why FROM (SELECT event_id, nullif({texts.split(', CASE WHEN count')[0]}), '') AS why FROM {HOLES_SQL}) WHERE why IS NOT NULL")
    q["validate_keep_valid"] = Entry("events", [HOLES, step("Validate", rules=rules[:3], action="keep_valid"), select("event_id")], f"SELECT event_id FROM {HOLES_SQL} WHERE v BETWEEN 5 AND 50 AND event_type IN ('click', 'view')")
    q["quality_table"] = Entry("events", [HOLES, select("event_id", "v")], f"SELECT 'event_id' AS \"column\", count(*) AS valid, 0::BIGINT AS error, 0::BIGINT AS empty FROM events UNION ALL SELECT 'v', count(v), 0, count(*) - count(v) FROM {HOLES_SQL}", last=lambda r, e: views.quality(r))

    def profile(r, e):
        p = views.profile(r, "v")
        names = ("rows", "errors", "empty", "distinct", "unique", "min", "max", "mean", "stdev")
        return r.df.sparkSession.createDataFrame([tuple(p[n] for n in names)], "rows long, errors long, empty long, distinct long, unique long, min double, max double, mean double, stdev double")

    q["profile_column"] = Entry("events", [HOLES], f"SELECT count(*) AS rows, 0::BIGINT AS errors, count(*) - count(v) AS empty, count(DISTINCT v) AS distinct, (SELECT count(*) FROM (SELECT v FROM {HOLES_SQL} WHERE v IS NOT NULL GROUP BY v HAVING count(*) = 1)) AS \"unique\", min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stdev FROM {HOLES_SQL}", last=profile, digits=6)
    q["distinct_values"] = Entry("orders", [], "SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1", last=lambda r, e: views.distinct_values(r, "o_orderpriority"))

    def overview(r, e):
        o = views.overview(r)
        names = ("rows", "cols", "errors", "empty", "whitespace", "duplicateRows", "score")
        return r.df.sparkSession.createDataFrame([tuple(int(o[n]) for n in names)], ", ".join(f"{n} long" for n in names))

    q["overview_score"] = Entry("events", [HOLES, select("user_id", "event_type", "v")], f"SELECT n AS rows, 3::BIGINT AS cols, 0::BIGINT AS errors, e AS empty, 0::BIGINT AS whitespace, dup AS \"duplicateRows\", floor(100 * (1 - 0.5 * e / (n * 3) - 0.5 * dup / n) + 0.5)::BIGINT AS score FROM (SELECT count(*) AS n, count(*) - count(v) AS e, count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, v FROM {HOLES_SQL})) AS dup FROM {HOLES_SQL})", last=overview)
    messy = add("c", 'if Number.Mod([o_orderkey], 4) = 0 then "New York" else if Number.Mod([o_orderkey], 4) = 1 then "new  york." else if Number.Mod([o_orderkey], 7) = 2 then "YORK, new" else "Boston"')
    messy_sql = "CASE WHEN o_orderkey % 4 = 0 THEN 'New York' WHEN o_orderkey % 4 = 1 THEN 'new  york.' WHEN o_orderkey % 7 = 2 THEN 'YORK, new' ELSE 'Boston' END"
    q["cluster_fingerprint"] = Entry("orders", [messy, step("ClusterValues", col="c", auto=True), group(["c"], agg("count_rows", name="n"))], f"SELECT CASE WHEN c = 'Boston' THEN c ELSE (SELECT c FROM (SELECT {messy_sql} AS c, count(*) AS k FROM orders GROUP BY 1) WHERE c <> 'Boston' ORDER BY k DESC, c LIMIT 1) END AS c, count(*) AS n FROM (SELECT {messy_sql} AS c FROM orders) GROUP BY 1")
    q["cluster_ngram"] = Entry("orders", [messy], None, last=lambda r, e: clusters(r, "c", "ngram").select("key", "canonical", "rows", F.size("variants").alias("n")))
    # DuckDB's levenshtein counts bytes: whole texts are compared by brute force in the tests
    q["similarity_whole"] = Entry("benchmark", [add("s", 'Text.Similarity([text], "the quick brown fox jumps over")'), select("item_id", "s")], digits=9)
    # ---- order
    q["sort_multi_nulls_last"] = Entry("events", [HOLES, step("Sort", by=[{"col": "v", "desc": True}, {"col": "event_id"}]), step("IndexColumn", name="ix", start=1), select("event_id", "ix")], f"SELECT event_id, row_number() OVER (ORDER BY v DESC NULLS LAST, event_id) AS ix FROM {HOLES_SQL}")
    q["sort_natural"] = Entry("customer", [step("Sort", by=[{"col": "c_name"}]), step("IndexColumn", name="ix", start=1), select("c_name", "ix")], None, collation="natural")
    # ---- benchmark pipelines
    q.update(BENCH)
    return q


def _tpch_like() -> dict[str, Entry]:
    """Pipelines of the shapes that published timings exist for: cast and filter, group, merge and sort, unpivot and pivot, formula and filter."""
    cast = step("ChangeType", changes=[{"col": "l_shipdate", "type": "date"}, {"col": "l_quantity", "type": "int"}, {"col": "l_extendedprice", "type": "number"}, {"col": "l_discount", "type": "number"}])
    keep = [cast, where('[l_quantity] > 5 and [l_returnflag] = "N"')]
    base = "(SELECT *, l_shipdate::DATE AS d, floor(l_quantity + 0.5)::BIGINT AS q FROM lineitem WHERE l_quantity > 5 AND l_returnflag = 'N')"
    out = {}
    out["bench_a_cast_filter"] = Entry("lineitem", [*keep, select("l_orderkey", "l_shipdate", "l_quantity", "l_extendedprice")], f"SELECT l_orderkey, d AS l_shipdate, q AS l_quantity, l_extendedprice FROM {base}")
    out["bench_b_group"] = Entry("lineitem", [*keep, group(["l_suppkey", "l_partkey"], agg("sum", "l_quantity", "qty"), agg("mean", "l_extendedprice", "price"), agg("count_rows", name="n"))], f"SELECT l_suppkey, l_partkey, sum(q)::BIGINT AS qty, round(avg(l_extendedprice), 4) AS price, count(*) AS n FROM {base} GROUP BY 1, 2", digits=4)
    out["bench_c_merge_sort"] = Entry("lineitem", [*keep, step("Merge", right="supplier", how="left", on=[["l_suppkey", "s_suppkey"]], expand=["s_name"]), step("Sort", by=[{"col": "s_name"}, {"col": "l_extendedprice", "desc": True}]), select("l_orderkey", "l_extendedprice", "s_name")], f"SELECT l_orderkey, l_extendedprice, s_name FROM {base} LEFT JOIN supplier ON l_suppkey = s_suppkey", others={"supplier": []})
    out["bench_d_unpivot_pivot"] = Entry("lineitem", [cast, group(["l_orderkey"], agg("sum", "l_quantity", "qty"), agg("sum", "l_extendedprice", "price")), step("Unpivot", ids=["l_orderkey"]), step("Pivot", on="Attribute", values="Value", agg="sum", index=["l_orderkey"])], "SELECT l_orderkey, round(sum(floor(l_quantity + 0.5)), 4) AS qty, round(sum(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1", digits=4)
    out["bench_f_formula"] = Entry("lineitem", [cast, add("revenue", "[l_quantity] * [l_extendedprice] * (1 - Coalesce([l_discount], 0))"), where("[revenue] > 500"), select("l_orderkey", "revenue")], "SELECT l_orderkey, revenue FROM (SELECT l_orderkey, floor(l_quantity + 0.5)::DOUBLE * l_extendedprice * (1 - coalesce(l_discount, 0)) AS revenue FROM lineitem) WHERE revenue > 500")
    return out


BENCH = _tpch_like()
ENTRIES = _entries()

CUSTOMER_TYPES = step("ChangeType", onError="fail", changes=[{"col": "c_custkey", "type": "int"}, {"col": "c_nationkey", "type": "int"}, {"col": "c_acctbal", "type": "number"}])
CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


def round_trip(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of customers written by a sink and read again by the source of that kind."""
    table = engine(spark, sf_dir, {"q": [source("customer")]}).relation("q")
    path = scratch.new_path(spark, f".{kind}")
    if kind == "json":
        table.output().write.json(path)
    else:
        write(table, path.removeprefix("file://") if kind in ("arrow", "xlsx") else path, kind)
    heads = [step("PromoteHeaders")] if kind == "xlsx" else []
    back = Project({"q": Query("q", [{"type": "Source", "source": {"kind": "file", "file": path, "csv": {"header": True}}}, *heads, CUSTOMER_TYPES])})
    return Engine(spark, back).relation("q").output()


def folder_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written to a folder of 130 files by ranges of the key, and read in the order of the files' names."""
    path = scratch.new_path(spark, "")
    for name, kind in (("customer", "csv"),):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumn("part", F.format_string("%03d", F.ntile(130).over(Window.orderBy("c_custkey"))))
        rows.repartition("part").sortWithinPartitions("part", "c_custkey").write.partitionBy("part").option("header", True).format(kind).save(path)
    back = Project({"q": Query("q", [{"type": "Source", "source": {"kind": "folder", "folder": path, "format": "csv", "pattern": "part=*", "csv": {"header": True}, "fileColumn": None}}, CUSTOMER_TYPES, step("IndexColumn", name="ix")])})
    return Engine(spark, back).relation("q").output()


#: Queries that need a sink first; the SQL is over the table that was written.
TRIPS = {f"round_trip_{k}": (lambda spark, sf_dir, k=k: round_trip(k, spark, sf_dir)) for k in ("csv", "tsv", "json", "parquet", "arrow", "xlsx")} | {"folder_in_order": folder_in_order}
TRIPS_SQL = {f"round_trip_{k}": CUSTOMER_SQL for k in ("csv", "tsv", "json", "parquet", "arrow", "xlsx")} | {"folder_in_order": f"SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS ix FROM ({CUSTOMER_SQL})"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, e=e: run(e, spark, sf_dir)) for n, e in ENTRIES.items()} | TRIPS


def oracle_sql() -> dict[str, str]:
    return {n: e.sql for n, e in ENTRIES.items() if e.sql} | TRIPS_SQL
