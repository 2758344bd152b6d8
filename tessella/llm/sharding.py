"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the records uniformly into memory-sized buckets by a seeded
hash. Pass two Fisher-Yates shuffles each bucket (Spark's ``shuffle``) and deals the
buckets' rows, one bucket after another, round-robin to the shards: shard sizes in
rows differ by one at most, and slots have no gap.

A bucket is the only thing that one task holds, and its size does not depend on the
table's: rows scatter by their id and text, and of rows that agree in both more often
than a bucket has rows, each scatters by its place, written down once. Defined cases:
a null text has no bytes and the crc32 of none; repeated rows are dealt as separate
rows; rows without an id scatter by their text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common

SHARDS = 40
BUCKET_BYTES = 4 << 20
BUCKET_ROWS = 1024
OVERHEAD = 16
"""Bytes of a record beside its text."""
GROUP = 1024
"""Buckets whose offsets are summed together."""


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32`` of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def bucket_offsets(buckets: DataFrame) -> DataFrame:
    """``bucket, before``: the rows in all earlier buckets, from rows ``bucket, n``.

    The sums run in two levels, so that no task sorts all buckets.
    """
    buckets = buckets.withColumn("grp", F.floor(F.col("bucket") / GROUP))
    groups = buckets.groupBy("grp").agg(F.sum("n").alias("grp_n"))
    over = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("grp", F.coalesce(F.sum("grp_n").over(over), F.lit(0)).alias("grp_before"))
    within = Window.partitionBy("grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return buckets.join(groups, "grp").select("bucket", (F.col("grp_before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"))


def salted(records: DataFrame, most: int) -> DataFrame:
    """``records`` with ``__salt``: null but for rows whose id and text occur more than ``most`` times."""
    often = records.groupBy("doc_id", "text_crc32").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    if often.isEmpty():
        return records.withColumn("__salt", F.lit(None).cast("long"))
    r, o = records.alias("r"), often.alias("o")
    same = F.col("r.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("r.text_crc32") == F.col("o.text_crc32"))
    return common.materialize(r.join(o, same, "left").select("r.*", F.when(F.col("n").isNotNull(), F.monotonically_increasing_id()).alias("__salt")))


def deal(records: DataFrame, shards: int = SHARDS, *, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``records`` (with ``doc_id, size, text_crc32`` and any payload) and their ``shard`` and ``slot``.

    ``records`` is read three times and should be a table, not a long computation.
    """
    total = records.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-total["bytes"] // bucket_bytes), -(-total["rows"] // bucket_rows))
    # the hash of an id: rows with an id in common are told apart by their texts
    scattered = salted(records, bucket_rows).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "__salt"), F.lit(n))).drop("__salt")
    offsets = bucket_offsets(scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    names = records.columns
    keys = ["doc_id", "text_crc32", *(c for c in names if c not in ("doc_id", "text_crc32"))]
    shuffled = (
        scattered.repartition(min(n, 100_000), "bucket")
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("rows"))
        .sortWithinPartitions("bucket")  # the seeded generator runs over a partition's buckets in this order
        .select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    )
    place = F.col("before") + F.col("pos")
    return (
        shuffled.join(offsets, "bucket")
        .select("before", F.posexplode("rows"))
        .select(*(F.col("col")[c].alias(c) for c in names), (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))
    )


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every document."""
    return deal(common.materialize(digest(docs)), shards)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the documents as Parquet folders ``shard=N``, each in the order of ``slot``.

    A column of the documents that is itself called shard or slot gets ``_1`` added.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    record = F.struct(*(F.col(c).alias(f"{c}_1" if c.lower() in ("shard", "slot") else c) for c in docs.columns))
    records = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), record.alias("record"))
    dealt = deal(common.materialize(records), shards)
    rows = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    rows.select("record.*", "shard", "slot").write.partitionBy("shard").parquet(path)
