"""Shared plumbing: shipping code, scratch tables, word splitting, components."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import scratch

WORD = r"[^\x20\x09-\x0D]+"
"""Fixed pattern: a word is a run of characters that are not ASCII white space."""

ROWS_AT_ONCE = 256
"""Rows of an Arrow batch that are turned into Python objects together."""

_scratch: list[tuple[SparkSession, str]] = []


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers of every executor, once per application.

    Rows here are whole texts, so Arrow batches get 1,024 rows at most, unless the
    session already says how many.
    """
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, "1024")
    scratch.ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="tessella-"))
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: whatever executors are lost later, the rows are read
    from the shared folder again. The table is dropped when the driver exits or
    by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _scratch.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def release() -> None:
    """Delete the scratch tables of this process. Results not yet written need them."""
    while _scratch:
        spark, path = _scratch.pop()
        jvm = SparkContext._jvm
        if jvm is None:
            return
        with contextlib.suppress(Exception):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(release)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_bucket(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a row."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterator, rows: int = ROWS_AT_ONCE) -> Iterator:
    """Small record batches, so that few Python strings live at one time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def usable_labels(labels_df: DataFrame, column: str, keep: Column) -> DataFrame:
    """``doc_id, y`` of all ids whose labels are 0 or 1 and don't contradict each other."""
    return (
        labels_df.where(keep & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(column).cast("int").alias("y"), F.max(column).cast("int").alias("top"))
        .where("y = top")
        .select("doc_id", "y")
    )


def labelled_sample(labels_df: DataFrame, column: str, keep: Column, per_class: int) -> tuple[DataFrame, list[int]]:
    """A bounded sample of usable labels: ``doc_id, y`` with at most ``per_class`` rows of each class.

    Rows whose label is not 0 or 1 and ids with contradicting labels are left out.
    The choice depends on a hash of the id only. Also returns the number of usable
    rows of each class.
    """
    usable = usable_labels(labels_df, column, keep)
    totals = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [
        usable.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(column), "doc_id"), "doc_id").limit(per_class)
        for y in (0, 1)
    ]
    return parts[0].unionByName(parts[1]), [totals.get(0, 0), totals.get(1, 0)]
