"""Near-duplicate embeddings by an inverted multi-index, within each label.

Unit vectors are cut into two halves; each half has its own codebook (k-means on a
bounded sample), and pairs of codes form a grid of cells. Every vector is indexed in
its cell. To find neighbours, a vector's cells are traversed by the multi-sequence
algorithm in the order of their distance bound (distance to the cells' borders, both
halves together), until the bound exceeds the radius that belongs to the threshold:
no cell left can hold a link, so the target recall is 1. What is visited is verified by
cosine in double precision.

Finer grids have smaller cells, but a vector then has more cells within the radius. For
each vector length several grids are trained, and the cells that a vector visits are
counted on the sample; each label takes the grid by which its rows have to be sent to
the fewest places. So grids grow with a label's rows, each label by its own.

Equal vectors form classes first. A cell's rows are cut into blocks, and a task
compares one block with another: neither a cell nor a label is held by one task.
Blocks return link counts and a spanning forest of the links, not the pairs.

Defined cases: rows with a null label or id and vectors that are null, empty, zero or
hold null or non-finite components are linked with nothing; vectors of different
lengths aren't compared; repeated rows with one id count as separate vectors.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.llm.components import components, find_roots

THRESHOLD = 0.98
SAMPLE, PROBED = 16_384, 256
"""Vectors of a length that the codebooks are fitted on, and those that visits are counted on."""
BLOCK = 256
LEVELS = (2, 4, 8, 16, 32, 64, 128, 256, 512)
"""Codes of a half, of the grids to choose from."""


def prepared(table: DataFrame) -> DataFrame:
    """``vec_id, label, dim, key, vec``: the bytes of each usable vector, else null."""
    common.ship(table.sparkSession)

    def run(batches):
        for batch in common.slices(batches, 1024):
            dims, keys, vecs = [], [], []
            for i, label, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = None
                if i is not None and label is not None and v and None not in v:
                    x = np.array(v, np.float64) + 0.0  # -0.0 becomes 0.0
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                dims.append(0 if x is None else len(x))
                vecs.append(None if x is None else packed(x))
                keys.append(None if x is None else xxhash.xxh3_128_digest(vecs[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "label", "dim", "key", "vec"])

    source = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return source.mapInArrow(run, "vec_id long, label string, dim int, key binary, vec binary")


def packed(x: np.ndarray) -> bytes:
    """A vector's bytes: a letter for the precision, and single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return b"f" + single.tobytes() if np.array_equal(single.astype(np.float64), x) else b"d" + x.tobytes()


def unit(rows: list[bytes]) -> np.ndarray:
    """Packed vectors of one length as unit rows, in double precision."""
    if len({r[:1] for r in rows}) == 1:
        kind = np.float32 if rows[0][:1] == b"f" else np.float64
        x = np.frombuffer(b"".join(r[1:] for r in rows), kind).reshape(len(rows), -1).astype(np.float64)
    else:
        x = np.stack([np.frombuffer(r[1:], np.float32 if r[:1] == b"f" else np.float64).astype(np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares must not overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        for c in range(k):
            if (near == c).any():
                centres[c] = x[near == c].mean(axis=0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


@dataclass
class MultiIndex:
    """Two codebooks for vectors of one length; a cell is ``first code * number of second codes + second code``."""

    halves: tuple[np.ndarray, np.ndarray]
    cut: int

    @classmethod
    def train(cls, x: np.ndarray, codes: int) -> MultiIndex:
        cut = x.shape[1] // 2
        k = max(1, min(codes, len(x) // 8))
        return cls((kmeans(x[:, :cut], k), kmeans(x[:, cut:], k)), cut)

    def visits(self, x: np.ndarray, radius2: float) -> float:
        """How many cells a row visits on average."""
        _, _, first, second = self.bounds(x)
        return float(np.mean([len(self.visit(a, b, radius2)) for a, b in zip(first, second, strict=True)]))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The codes of each row, and for each code of a half a lower bound of the squared
        distance, in that half, between the row and anything that has that code."""
        codes, out = [], []
        for part, centres in zip((x[:, : self.cut], x[:, self.cut :]), self.halves, strict=True):
            d = distances(part, centres)
            own = d.argmin(axis=1)
            apart = np.sqrt(distances(centres, centres))[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                # distance to the plane half-way between the own centre and the other one
                gap = np.where(apart > 0, (d - d[np.arange(len(d)), own][:, None]) / (2 * apart), 0.0)
            codes.append(own)
            out.append(np.maximum(gap, 0) ** 2)
        return codes[0], codes[1], out[0], out[1]

    def visit(self, first: np.ndarray, second: np.ndarray, radius2: float) -> list[int]:
        """Cells in the order of their bounds, by the multi-sequence algorithm, up to the radius."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        cells, queue, seen = [], [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
        while queue:
            bound, i, j = heapq.heappop(queue)
            if bound > radius2:
                break
            cells.append(int(a[i]) * len(second) + int(b[j]))
            for i2, j2 in ((i + 1, j), (i, j + 1)):
                if i2 < len(a) and j2 < len(b) and (i2, j2) not in seen:
                    seen.add((i2, j2))
                    heapq.heappush(queue, (first[a[i2]] + second[b[j2]], i2, j2))
        return cells


def train_grids(rows: list[bytes], most: int, radius2: float) -> dict[int, tuple[MultiIndex, float]]:
    """Grids for the vectors of one length by their codes, with their visits, as far as ``most`` rows of a label use them."""
    x, out = unit(rows), {}
    for codes in LEVELS:
        if codes > 2 and (codes // 2) ** 2 * BLOCK / 4 > most or codes > max(2, len(x) // 8):
            break
        grid = MultiIndex.train(x, codes)
        out[codes] = (grid, grid.visits(x[:PROBED], radius2))
    return out


def best_grid(grids: dict[int, tuple[MultiIndex, float]], rows: float) -> int:
    """The codes by which ``rows`` rows of a label are sent to the fewest blocks."""
    return min(grids, key=lambda k: (grids[k][1] * max(1.0, rows / (k * k * BLOCK)), k))


def _compare(batches, threshold: float):
    """Links between the left and right rows of each group; rows come sorted by group."""

    def links(side, ids, own, m, vecs):
        left, right = side == 0, side == 1
        if not left.any() or not right.any():
            return
        x, y = unit([v for v, s in zip(vecs, left, strict=True) if s]), unit([v for v, s in zip(vecs, right, strict=True) if s])
        hit = (x @ y.T >= threshold) & (ids[left][:, None] != ids[right][None, :])
        count = {}
        a, b, a_own, ma, mb = ids[left], ids[right], own[left], m[left], m[right]
        for i, n in zip(a.tolist(), (hit * mb[None, :]).sum(1).tolist(), strict=True):
            if n:
                count[i] = count.get(i, 0) + n
        # a probe meets the cell's rows only here, so it counts for both; rows of the cell meet both ways
        for j, n in zip(b.tolist(), ((hit & ~a_own[:, None]) * ma[:, None]).sum(0).tolist(), strict=True):
            if n:
                count[j] = count.get(j, 0) + n
        i, j = np.nonzero(hit)
        roots = find_roots(zip(a[i].tolist(), b[j].tolist(), strict=True))
        for x, r in roots.items():
            yield x, r, count.get(x, 0)

    out: list[tuple[int, int, int]] = []
    held: list = []
    group = None
    for batch in common.slices(batches, 1024):
        columns = [c.to_pylist() for c in batch.columns]
        for g, *row in zip(columns[0], *columns[1:], strict=True):
            if g != group and held:
                out += _links_of(links, held)
                held = []
            group = g
            held.append(row)
        if len(out) > 20_000:
            yield _counted(out)
            out = []
    if held:
        out += _links_of(links, held)
    yield _counted(out)


def _links_of(links, held):
    side, ids, own, m, vecs = zip(*held, strict=True)
    return links(np.array(side), np.array(ids, np.int64), np.array(own), np.array(m, np.int64), vecs)


def _counted(rows):
    ids, roots, n = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])


def near_duplicate_vectors(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = table.sparkSession
    rows = common.materialize(prepared(table))
    good = rows.where("vec is not null")
    classes = common.materialize(good.groupBy("label", "dim", "key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m"), F.first("vec").alias("vec")))

    # the sample's order, and so its codebooks, depend on the vectors' bytes only
    radius2 = 2 - 2 * threshold + 1e-9
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows"))
    grids: dict[int, dict[int, tuple[MultiIndex, float]]] = {}
    for d, most in sizes.groupBy("dim").agg(F.max("rows").alias("most")).collect():
        sample = classes.where(F.col("dim") == d).select("vec").orderBy(F.xxhash64("vec"), "vec").limit(min(SAMPLE, max(4 * BLOCK, most))).collect()
        grids[d] = train_grids([bytes(x["vec"]) for x in sample], most, radius2)
    index = spark.sparkContext.broadcast({(d, k): grid for d, g in grids.items() for k, (grid, _) in g.items()})
    # the grid of a label by the power of two below its rows
    chosen = F.create_map(*(F.lit(x) for d, g in grids.items() for p in range(48) for x in (d * 64 + p, best_grid(g, 1.5 * 2**p)))) if grids else F.create_map(F.lit(0), F.lit(2))
    power = F.floor(F.log2(F.col("rows").cast("double"))).cast("int")
    sizes = sizes.select("label", "dim", F.element_at(chosen, F.col("dim") * 64 + power).alias("codes"))

    def place(batches):
        for batch in common.slices(batches, 1024):
            kinds = np.stack([batch.column(2).to_numpy(), batch.column(5).to_numpy()], axis=1)
            vecs = batch.column(4).to_pylist()
            take, cells, probe = [], [], []
            for d, k in np.unique(kinds, axis=0).tolist():
                at = np.flatnonzero((kinds == (d, k)).all(axis=1))
                multi = index.value[d, k]
                one, two, first, second = multi.bounds(unit([vecs[k] for k in at]))
                width = len(multi.halves[1])
                for k, row in enumerate(at):
                    own = int(one[k]) * width + int(two[k])
                    take.append(row)
                    cells.append(own)
                    probe.append(False)
                    for cell in multi.visit(first[k], second[k], radius2):
                        if cell > own:  # a pair of different cells is met from the smaller one
                            take.append(row)
                            cells.append(cell)
                            probe.append(True)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), batch.column(3).take(at), batch.column(4).take(at), pa.array(cells, pa.int64()), pa.array(probe, pa.bool_())], ["id", "label", "dim", "m", "vec", "cell", "probe"])

    placed = classes.join(sizes, ["label", "dim"]).select("id", "label", "dim", "m", "vec", "codes").mapInArrow(place, "id long, label string, dim int, m long, vec binary, cell long, probe boolean")
    placed = common.materialize(placed)
    where = ["label", "dim", "cell"]
    sizes = placed.groupBy(*where).agg(F.ceil(F.count_if(~F.col("probe")) / BLOCK).alias("right_n"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("left_n")).where("right_n > 0")
    dealt = placed.join(sizes, where)
    deal = lambda n: F.pmod(F.xxhash64("id"), n)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = dealt.withColumn("i", deal(F.col("left_n"))).withColumn("j", spread(F.col("right_n"))).withColumn("side", F.lit(0))
    right = dealt.where("not probe").withColumn("j", deal(F.col("right_n"))).withColumn("i", spread(F.col("left_n"))).withColumn("side", F.lit(1))
    group = F.concat_ws("|", *where, "i", "j").alias("g")
    blocks = left.unionByName(right).select(group, "side", "id", (~F.col("probe")).alias("own"), "m", "vec")
    found = blocks.repartition("g").sortWithinPartitions("g").mapInArrow(lambda b: _compare(b, threshold), "a long, b long, n long")
    found = common.materialize(found)

    groups = components(found.where("a <> b").select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    named = classes.select("label", "key", "id", "m").join(counts, F.col("id") == F.col("a"), "left").drop("a")
    named = named.join(groups.withColumnRenamed("id", "gid"), F.col("id") == F.col("gid"), "left")
    named = named.select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("vec_id", "label", "key").join(named, ["label", "key"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (SELECT vec_id AS id, vec_id AS reached FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a
), c AS (SELECT id AS vec_id, min(reached)::BIGINT AS component_id FROM r GROUP BY 1
), n AS (SELECT a AS vec_id, count(*)::BIGINT AS n_links FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
"""The same by DuckDB, with all pairs of a label."""
