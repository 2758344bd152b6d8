"""Connected components of a link table, by distributed union-find and contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common


def find_roots(pairs) -> dict[int, int]:
    """Union-find with path halving; the smallest member is a set's root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _forest(batches):
    """The links of one partition, as links of each member to its set's smallest one."""
    roots = find_roots(p for batch in batches for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    rows = [(x, r) for x, r in roots.items() if x != r]
    for k in range(0, len(rows), 50_000):
        part = rows[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) for every end of a link ``a, b``.

    Each partition first reduces its links to a forest. Then each round sends every
    node to its smallest neighbour and contracts the links to those; the nodes left
    at least halve, and the rounds end when no link is left. Every round's tables are
    written to the shared folder.
    """
    common.ship(links.sparkSession)
    edges = common.materialize(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").mapInArrow(_forest, "a long, b long"))
    mapping = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up"))
        up = common.materialize(up)
        # one pointer jump, so that chains shrink faster
        top = up.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.a")).select(F.col("x.a").alias("node"), F.col("y.up").alias("top"))
        top = common.materialize(top)
        left = top.select(F.col("node").alias("a"), F.col("top").alias("ta"))
        right = top.select(F.col("node").alias("b"), F.col("top").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").where("ta <> tb").select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b"))
        edges = common.materialize(moved.distinct().mapInArrow(_forest, "a long, b long"))
        if mapping is None:
            mapping = top.select(F.col("node").alias("id"), F.col("top").alias("component"))
        else:
            step = mapping.join(top, mapping["component"] == top["node"], "left")
            mapping = common.materialize(step.select("id", F.coalesce("top", "component").alias("component")))
    if mapping is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return mapping
