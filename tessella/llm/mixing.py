"""Mixing sources to target weights, with DataFrame functions only.

Every document gets an exponential key, scaled by a quality weight (Efraimidis and
Spirakis); in the order of keys a source's documents are a weighted sample without
replacement, and prefix sums of sizes cut it at the source's budget. Whole epochs of
a source come first, the sample fills what remains of its target.

Targets share a budget by weight; a target stops at ``most`` times its source's size
and the excess is shared again (water filling in closed form).

No task sorts a whole source. Keys fall into cells; sizes are summed by source and
cell, the cells' prefix sums show in which cell the budget ends, and only that cell's
rows are sorted. A document is then taken or not by comparing its key with its
source's bound.

Defined cases: a null text has size 0; documents without an id are told apart by their
texts; rows that share an id, or a text if they have none, are taken alike; null is a
source of its own, last; a source without words has target 0; the document across
the bound is taken if that brings the source nearer to its target; ties in the key
follow the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
CELL_ROWS, LEAST_CELLS, MOST_CELLS = 2_000, 64, 20_000
SYMBOLS = "#*$%&|<>!"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """In (0, 1]: less for texts with many symbols to a word."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>!]", ""))
    return 1.0 / (1.0 + 10.0 * symbols / F.greatest(size, F.lit(1)))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight, with u in (0, 1) from a hash of the id, or of the text where there is no id."""
    name = F.coalesce(doc_id.cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256))
    digits = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), name), 256), 1, 13), 16, 10).cast("long")
    return -F.ln((digits + 0.5) / float(1 << 52)) / weight


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, key``: what the plan needs of each document."""
    text = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), text.alias("text"))
    return sized.select("doc_id", "source", "size", sampling_key(F.col("doc_id"), F.col("text"), quality_weight(F.col("text"), F.col("size"))).alias("key"))


def _cell(scale: float) -> Column:
    return F.floor(F.ln("key") * scale).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from rows ``source, source_size``, one for each source."""
    last = F.col("source").isNull().cast("int")
    every = Window.partitionBy()
    ranked = sources.withColumn("at", F.row_number().over(Window.orderBy(last, "source")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight.cast("long")).withColumn("budget", share * F.sum("source_size").over(every))
    # sources by how soon the rising level reaches their limit; before one are those that are full
    level = Window.orderBy(F.col("source_size") / F.col("w"), "at")
    ranked = ranked.withColumn("full", F.coalesce(F.sum(most * F.col("source_size")).over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("rest", F.sum("w").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    ranked = ranked.withColumn("rise", (F.col("budget") - F.col("full")) / F.col("rest"))
    ends = F.min(F.when(F.col("rise") * F.col("w") <= most * F.col("source_size"), F.struct(F.col("source_size") / F.col("w"), "at", "rise"))).over(every)["rise"]
    return ranked.select("source", "source_size", F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce(ends * F.col("w"), F.lit(float(most)) * F.col("source_size"))).alias("target"))


def plan(rows: DataFrame, **options) -> tuple[DataFrame, float]:
    """The bound of each source, and the scale of cells.

    One row a source: ``source, source_size, target, epochs`` (whole passes over the
    source) and ``end_cell, end_key, end_id`` (the last document of the sample; null
    cell: all of them). ``rows`` is a table as :func:`keyed` makes it.
    """
    scale = float(min(MOST_CELLS, max(LEAST_CELLS, rows.count() // CELL_ROWS)))
    cells = common.materialize(rows.groupBy("source", _cell(scale).alias("cell")).agg(F.sum("size").alias("cell_size")))
    aims = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), **options)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = common.materialize(aims.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")))
    up_to = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cells.withColumn("sum", F.sum("cell_size").over(up_to)).alias("c").join(aims.alias("a"), F.col("c.source").eqNullSafe(F.col("a.source")))
    ends = (
        summed.where(F.col("sum") > F.col("left"))
        .groupBy(F.col("c.source").alias("source"))
        .agg(F.min("cell").alias("end_cell"), F.min_by(F.col("sum") - F.col("cell_size"), "cell").alias("before"), F.first("left").alias("left"))
    )
    ends = common.materialize(ends)
    r, e = rows.withColumn("cell", _cell(scale)).alias("r"), ends.alias("e")
    in_end = r.join(e, F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.cell") == F.col("e.end_cell"))).select("r.source", "doc_id", "size", "key", "before", "left")
    order = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_end = in_end.withColumn("middle", 2 * (F.col("before") + F.sum("size").over(order)) - F.col("size"))
    last = in_end.where(F.col("middle") <= 2 * F.col("left")).groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("end"))
    a, s = aims.alias("a"), last.alias("s")
    bounds = a.join(e, F.col("a.source").eqNullSafe(F.col("e.source")), "left").join(s, F.col("a.source").eqNullSafe(F.col("s.source")), "left")
    bounds = bounds.select("a.source", "source_size", "target", "epochs", "end_cell", F.col("end.key").alias("end_key"), F.col("end.doc_id").alias("end_id"))
    return common.materialize(bounds), scale


def _taken(scale: float) -> Column:
    """How often the mix takes a document: whole epochs, and once more within the sample."""
    key, cell = F.col("key"), _cell(scale)
    id_, end_id = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), F.coalesce(F.col("end_id"), F.lit(-(1 << 63)))
    within = F.col("end_key").isNotNull() & ((key < F.col("end_key")) | ((key == F.col("end_key")) & (id_ <= end_id)))
    chosen = F.col("end_cell").isNull() | (cell < F.col("end_cell")) | ((cell == F.col("end_cell")) & within)
    return F.col("epochs") + chosen.cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source, size, source_size, target, times, taken`` of every document."""
    rows = common.materialize(keyed(docs))
    bounds, scale = plan(rows, **options)
    r, b = rows.alias("r"), bounds.withColumnRenamed("source", "source_").alias("b")
    joined = r.join(b, F.col("source").eqNullSafe(F.col("source_")))  # a table of sources: Spark broadcasts it if it is small
    times = _taken(scale)
    return joined.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row as often as the mix takes it, with the columns of ``docs``."""
    own = {c: f"__doc_{k}" for k, c in enumerate(docs.columns)}
    bounds, scale = plan(common.materialize(keyed(docs)), **options)
    text = F.col(own["text"]).cast("string")
    rows = docs.select(*(F.col(c).alias(k) for c, k in own.items()))
    rows = rows.withColumn("doc_id", F.col(own["doc_id"]).cast("long")).withColumn("key", sampling_key(F.col("doc_id"), text, quality_weight(text, size_of(text))))
    joined = rows.join(bounds, F.col(own["source"]).cast("string").eqNullSafe(F.col("source")))
    times = _taken(scale).cast("int")
    return joined.withColumn("__times", times).where("__times > 0").select(F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__n"), *own.values()).select(*(F.col(k).alias(c) for c, k in own.items()))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>!]', '', 'g')) AS symbols,
         ('0x' || substr(sha256('{SEED}:' || doc_id::VARCHAR), 1, 13))::BIGINT AS h
  FROM documents
), k AS (
  SELECT doc_id, source, size,
         -ln((h + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / (1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * symbols / greatest(size, 1))) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS nth FROM k GROUP BY source
), w AS (
  SELECT *, ([3, 1, 2])[nth % 3 + 1]::BIGINT AS w, 1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS budget FROM s
), l AS (
  SELECT *, source_size::DOUBLE / w AS limit_at,
         coalesce(sum(2 * source_size) OVER (ORDER BY source_size::DOUBLE / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_size,
         (sum(w) OVER (ORDER BY source_size::DOUBLE / w, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest
  FROM w
), r AS (SELECT *, (budget - full_size) / rest AS rise FROM l
), e AS (SELECT rise AS water FROM r WHERE rise * w <= 2 * source_size ORDER BY limit_at, nth LIMIT 1
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT water FROM e) * w, 2.0::DOUBLE * source_size)) AS target FROM r
), p AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), o AS (
  SELECT k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS "left",
         (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN 2 * cum - size <= 2 * "left" THEN 1 ELSE 0 END) AS taken FROM o
"""
"""The same by DuckDB, with a window over each whole source."""
