"""Tables written to the folder that driver and executors share.

Writing a table cuts its lineage: lost executors read the rows again instead of
computing them anew, and values that depend on where a row lay stay as they are.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_tables: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers of every executor, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="tessella-"))
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, ending: str = "") -> str:
    """A place in the shared folder that goes when the driver exits."""
    path = f"{shared_dir(spark)}/tessella-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}{ending}"
    _tables.append((spark, path))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again; the table goes when the driver exits."""
    spark = df.sparkSession
    path, schema = new_path(spark), df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def release() -> None:
    """Delete this process's tables. Results that aren't written yet need them."""
    while _tables:
        spark, path = _tables.pop()
        jvm = SparkContext._jvm
        if jvm is None:
            return
        with contextlib.suppress(Exception):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(release)
