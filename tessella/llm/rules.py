"""Quality rules: rule statistics of a text, judged by an isolation forest.

Base rules reject on fixed limits. Beyond them, a forest of random splits is grown:
each of ``TREES`` trees on ``SUBSAMPLE`` rows drawn from all rows labelled good, as the
method has it. Splits range over the statistics of all documents, and documents that
few splits isolate are anomalous. The threshold on the anomaly score comes from all
labelled rows that pass the base rules. Statistics are taken once and written.

Defined cases: a null text has no words, all statistics are 0 and the base rules
reject it; without usable labels of both classes the threshold is the classical
0.6 of the anomaly score with no rejection below it; an empty table gives an empty
result; repeated rows are judged one by one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.relation import running_total

TREES = 128
SUBSAMPLE = 256
KEPT_GOOD = 0.998
"""Share of good labelled documents that the threshold must keep."""
MIN_WORDS = 50
MAX_REPEATS = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "bar_share", "distinct_share", "digit_share", "stop_share")
SYMBOLS = b"#*$%&|<>"


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts and the derived features of one whole text."""
    data = (text or "").encode()
    words = data.split()  # bytes split at ASCII white space only
    n = len(words)
    # bytes that continue a code point are 0b10xxxxxx
    word_chars = len(text or "") - (len(data) - sum(map(len, words)))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen, dup, lines = set(), 0, 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, n)
    repeated = 0
    if n > 3 and len(known) < n:
        m = len(known)
        if m < 2_000_000:
            windows = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
        else:
            pairs = np.unique(ids[:-2] * m + ids[1:-1], return_inverse=True)[1]
            windows = pairs * m + ids[2:]
        _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
        hit = counts[back] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= hit
        repeated = int(covered.sum())
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    shorts = sum(len(w) <= 3 for w in words)
    size = max(word_chars, 1)
    count = max(n, 1)
    features = (math.log1p(n) / 4, min(word_chars / count, 40) / 4, n_symbols / count, dup / max(lines, 1), repeated / count, upper / size, data.count(b"!") / count, data.count(b"|") / count, len(known) / count, digits / size, shorts / count)
    return (n, word_chars, n_symbols, dup, repeated), features


def fails(base: tuple[int, ...]) -> bool:
    """The base rules: too few words, or more than half of them in repeated windows."""
    return base[0] < MIN_WORDS or 100 * base[4] > 100 * MAX_REPEATS * base[0]


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: split feature (-1: leaf), split value, children and the leaf's path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    subsample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected one): about 0.5 or less for ordinary rows, towards 1 for anomalies."""
        trees, total = len(self.feature), np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(trees):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t, at]
                if (f < 0).all():
                    break
                go_left = x[rows, np.maximum(f, 0)] < self.value[t, at]
                at = np.where(f < 0, at, np.where(go_left, self.left[t, at], self.right[t, at]))
            total += self.length[t, at]
        return 2.0 ** (-total / trees / max(expected_length(self.subsample), 1e-9))


def expected_length(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n < 2:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, around: np.ndarray | None = None, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11) -> Forest:
    """A forest on subsamples of ``x``; splits reach as far as the rows of ``around``."""
    rng = np.random.default_rng(seed)
    every = x if around is None else np.vstack([x, around])
    subsample = min(subsample, len(x))
    return grow_on([x[rng.choice(len(x), subsample, replace=False)] for _ in range(trees)], every.min(axis=0), every.max(axis=0), seed)


def grow_on(samples: list[np.ndarray], low: np.ndarray, high: np.ndarray, seed: int = 11) -> Forest:
    """A tree on each of the samples, which are of one size.

    Split values are drawn between a node's least and greatest value, as far as
    ``low`` and ``high`` reach on the outer sides of the tree: a split may then leave
    one side without rows, and what falls there is isolated at once.
    """
    rng = np.random.default_rng(seed)
    outer, trees, subsample = (low, high), len(samples), len(samples[0])
    limit = max(1, math.ceil(math.log2(max(subsample, 2))))
    width = 2 ** (limit + 1)
    feature = np.full((trees, width), -1, np.int64)
    value, length = np.zeros((trees, width)), np.zeros((trees, width))
    left, right = np.zeros((trees, width), np.int64), np.zeros((trees, width), np.int64)
    for t in range(trees):
        open_nodes, used = [(0, samples[t], 0, *outer)], 1
        while open_nodes:
            node, rows, depth, low, high = open_nodes.pop()
            spread = np.flatnonzero(high > low)
            if depth >= limit or len(rows) < 2 or not len(spread):
                length[t, node] = depth + expected_length(len(rows))
                continue
            f = rng.choice(spread)
            v = rng.uniform(low[f], high[f])
            below = rows[:, f] < v
            feature[t, node], value[t, node] = f, v
            left[t, node], right[t, node] = used, used + 1
            under, over = high.copy(), low.copy()
            under[f] = over[f] = v
            open_nodes += [(used, rows[below], depth + 1, low, under), (used + 1, rows[~below], depth + 1, over, high)]
            used += 2
    return Forest(feature, value, left, right, length, subsample)


def threshold(scores: DataFrame, good: int, bad: int, kept_good: float = KEPT_GOOD) -> float:
    """The score from which rows are rejected, by ``y, s`` of all labelled rows, so many of each class.

    Among cuts that keep ``kept_good`` of the good rows, the one with the best
    balanced accuracy; in a tie the middle of the gap. Sums before each score are
    taken by ranges, and in whole numbers.
    """
    if not good or not bad:
        return 0.6
    rows = scores.groupBy("s").agg(F.sum("y").alias("g"), F.sum(bad * F.col("y") - good * (1 - F.col("y"))).alias("gain"))
    rows = running_total(running_total(rows, "g", [F.col("s")], "good_before"), "gain", [F.col("s")], "won")
    rows = common.materialize(rows)
    rank = math.ceil(kept_good * (good - 1))
    floor = rows.where(F.col("good_before") <= rank).where("g > 0").agg(F.max("s")).first()[0]
    top = rows.agg(F.max("s")).first()[0]
    cut = rows.where(F.col("s") > floor).orderBy(F.desc("won"), "s").select("s", "won").first()
    best = cut["s"] if cut is not None and cut["won"] >= 0 else top + 1e-9
    under = rows.where(F.col("s") < best).agg(F.max("s")).first()[0]
    return best if under is None else (best + under) / 2


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed`` and the features ``x`` of every whole text."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in common.slices(batches):
            found = [statistics(t) for t in batch.column(1).to_pylist()]
            base = np.array([b for b, _ in found], np.int64)
            columns = [batch.column(0), *map(pa.array, base.T), pa.array([fails(b) for b, _ in found]), pa.array([f for _, f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", "x"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, x array<double>")


@dataclass(frozen=True)
class RuleModel:
    forest: Forest | None
    threshold: float


def _scored(rows: DataFrame, model: RuleModel, schema: str) -> DataFrame:
    """``rows`` with the anomaly score of their last column, the features, instead of these."""
    common.ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        forest = shared.value.forest
        for batch in common.slices(batches, 1024):
            *columns, x = batch.columns
            s = forest.score(np.array(x.flatten()).reshape(len(x), -1)) if forest and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s)], [*batch.schema.names[:-1], "s"])

    return rows.mapInArrow(run, f"{schema}, s double")


def _subsamples(rows: DataFrame, n: int) -> list[np.ndarray]:
    """For each tree the rows of the least hashes, out of all. Few others reach the driver."""
    size, share = min(SUBSAMPLE, n), min(1.0, 2 * SUBSAMPLE / n)
    dealt = rows.select("x", F.xxhash64("doc_id", "x").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t"))
    dealt = dealt.withColumn("h", F.shiftrightunsigned(F.xxhash64("t", "h"), 1))
    while True:
        found: list[list] = [[] for _ in range(TREES)]
        for r in dealt.where(F.col("h") <= min(2**63 - 1, int(share * 2.0**63))).toLocalIterator():
            found[r["t"]].append((r["h"], r["x"]))
        if min(map(len, found)) >= size:
            return [np.array([x for _, x in sorted(f)[:size]]) for f in found]
        share = min(1.0, 2 * share)


def _fitted(rows: DataFrame, labels: DataFrame) -> RuleModel:
    passed = rows.where("not base_failed")
    reach = [f(F.get("x", F.lit(k))).alias(f"{f.__name__}{k}") for f in (F.min, F.max) for k in range(len(FEATURES))]
    [(n, *ends)] = passed.agg(F.count(F.lit(1)), *reach).collect()
    if not n:
        return RuleModel(None, 0.6)
    labelled = common.materialize(passed.join(common.usable_labels(labels, "quality", F.lit(True)), "doc_id").select("doc_id", "y", "x"))
    counts = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    samples = _subsamples(labelled.where("y = 1"), good) if good else _subsamples(passed, n)
    forest = grow_on(samples, np.array(ends[: len(FEATURES)]), np.array(ends[len(FEATURES) :]))
    scores = common.materialize(_scored(labelled.select("y", "x"), RuleModel(forest, 0.0), "y int"))
    return RuleModel(forest, threshold(scores, good, bad))


def _judged(rows: DataFrame, model: RuleModel) -> DataFrame:
    names = ["doc_id", *BASE, "base_failed"]
    out = _scored(rows.select(*names, "x"), model, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean")
    return out.select(*names, (~F.col("base_failed") & (F.col("s") < model.threshold)).alias("kept"), F.col("s").alias("anomaly"))


def fit(docs: DataFrame, labels: DataFrame) -> RuleModel:
    """Grow the forest and set the threshold, by all documents and labels."""
    return _fitted(common.materialize(measured(docs)), labels)


def judge(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``anomaly`` and ``kept`` of every whole text."""
    return _judged(measured(docs), model)


def apply_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = common.materialize(measured(docs))
    return _judged(rows, _fitted(rows, labels))
