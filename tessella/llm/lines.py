"""Document quality from a linear-chain conditional random field over lines.

Every line gets a label, good or bad; its features describe the line and its two
neighbours. Forward-backward gives each line's marginal probability of being good,
and the marginals' mean, weighted by line length, is the document's raw quality. A
logistic curve turns it into the score.

The field is fitted on a bounded sample of labelled documents, each line taking its
document's label where the line itself is not ordinary: a bad document's lines whose
features good documents show as well are free, and the field decides on them by its
expectations (two rounds of fitting).

Defined cases: null and empty texts have no lines and get the raw quality of an even
chance, put on the curve; without usable labels of both classes the score is the
share of good labels; lines without a word are left out; repeated rows are scored
one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.llm.toxicity import logistic

EXAMPLES = 600
"""Labelled documents of each class that the field is fitted on."""
FIT_LINES = 40
"""Lines of a fitted document: all of them, if there are more, in windows of this length."""
WINDOWS = 8
"""Windows of a fitted document that the field is fitted on; the curve is fitted on whole documents."""
STEPS = 150

#: Borders of each line statistic's bins.
BINS = {
    "words": (1, 2, 4, 8, 16, 40, 120),
    "word_length": (2, 3, 4, 5, 6, 8, 12),
    "symbols": (0.01, 0.1, 0.3, 0.6, 1.0),
    "bars": (0.01, 0.1, 0.3, 0.8),
    "bangs": (0.01, 0.1, 0.3, 0.8),
    "upper": (0.005, 0.03, 0.1, 0.3, 0.6),
    "digits": (0.005, 0.03, 0.1, 0.3),
    "repeats": (0.01, 0.05, 0.2, 0.5, 0.8),
    "distinct": (0.1, 0.3, 0.5, 0.7, 0.9),
    "other": (0.01, 0.05, 0.2),
}
FLAGS = ("duplicate", "ends_sentence", "starts_upper", "first", "last")
_OFFSETS = np.cumsum([0, *(len(b) + 1 for b in BINS.values())])
LINE_FEATURES = int(_OFFSETS[-1]) + len(FLAGS)
SIZE = 3 * LINE_FEATURES + 1
"""A line's own features, those of the lines before and after it, and a constant."""

_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SYMBOL, _OTHER = b"#*$%&<>", b"{}[]\\^~_=@+`/"
_BORDERS = [np.array(b) for b in BINS.values()]


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """For each line with a word: the indexes of its own features, and its length in bytes."""
    stats, flags, sizes, seen = [], [], [], set()
    for line in (text or "").encode().split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), sum(map(len, words))
        bare = [w.rstrip(b"!$*%&#.,") for w in words]
        repeats = sum(map(bytes.__eq__, bare, bare[1:]))
        stats.append(
            (
                n,
                size / n,
                (len(line) - len(line.translate(None, _SYMBOL))) / n,
                line.count(b"|") / n,
                line.count(b"!") / n,
                (size - len(b"".join(words).translate(None, _UPPER))) / size,
                (len(line) - len(line.translate(None, _DIGIT))) / size,
                repeats / n,
                len(set(bare)) / n,
                (len(line) - len(line.translate(None, _OTHER))) / n,
            )
        )
        flags.append((line in seen, words[-1][-1:] in b".!?", 65 <= words[0][0] <= 90, False, False))
        sizes.append(size)
        seen.add(line)
    if not stats:
        return np.zeros((0, len(BINS) + len(FLAGS)), np.int64), np.zeros(0)
    x = np.array(stats)
    binned = np.stack([np.searchsorted(b, x[:, k], side="right") + _OFFSETS[k] for k, b in enumerate(_BORDERS)], 1)
    marks = np.array(flags)
    marks[0, 3] = marks[-1, 4] = True
    # a flag that is not set points at the spare last feature, whose weight stays 0
    marked = np.where(marks, _OFFSETS[-1] + np.arange(len(FLAGS)), -1)
    return np.concatenate([binned, marked], 1), np.array(sizes, float)


def scores_of(own: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The field's unary score of good against bad, for each line."""
    padded = np.append(weights[: LINE_FEATURES], 0.0), np.append(weights[LINE_FEATURES : 2 * LINE_FEATURES], 0.0), np.append(weights[2 * LINE_FEATURES : 3 * LINE_FEATURES], 0.0)
    out = padded[0][own].sum(1) + weights[-1]
    if len(own) > 1:
        out[1:] += padded[1][own[:-1]].sum(1)
        out[:-1] += padded[2][own[1:]].sum(1)
    return out


def forward_backward(unary: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good, and expectations of equal neighbours, in a chain of two labels.

    ``stay`` is the score of two neighbours having one label. Log ratios of the
    messages suffice for two labels: m' = log((e^(m+stay) + 1) / (e^m + e^stay)).
    """
    n = len(unary)
    ahead, back = [0.0] * n, [0.0] * n
    u = unary.tolist()

    def step(m: float) -> float:
        a, b = m + stay, 0.0
        c, d = m, stay
        return (max(a, b) + log1p(exp(-abs(a - b)))) - (max(c, d) + log1p(exp(-abs(c - d))))

    for k in range(1, n):
        ahead[k] = step(u[k - 1] + ahead[k - 1])
    for k in range(n - 2, -1, -1):
        back[k] = step(u[k + 1] + back[k + 1])
    total = np.clip(np.array(ahead) + np.array(back) + unary, -40, 40)
    good = 1 / (1 + np.exp(-total))
    if n < 2:
        return good, np.zeros(0)
    left = np.clip((unary + np.array(ahead))[:-1], -40, 40)
    right = np.clip((unary + np.array(back))[1:], -40, 40)
    both = np.logaddexp(left + right, 0) + stay
    one = np.logaddexp(left, right)
    return good, 1 / (1 + np.exp(one - both))


@dataclass
class LineModel:
    weights: np.ndarray | None
    stay: float
    slope: float
    offset: float
    base_rate: float

    def share(self, text: str | None) -> tuple[float, float, np.ndarray]:
        """Length of the good lines by their marginals, length of all lines, and the marginals."""
        own, sizes = line_features(text)
        if not len(own):
            return 0.0, 0.0, np.zeros(0)
        good, _ = forward_backward(scores_of(own, self.weights), self.stay)
        return float((good * sizes).sum()), float(sizes.sum()), good

    def raw(self, text: str | None) -> tuple[float, np.ndarray]:
        """Log odds of the length-weighted share of good lines, and the marginals."""
        part, total, good = self.share(text)
        if not len(good):
            return 0.0, good
        share = part / total
        return float(np.log((share + 0.01) / (1 - share + 0.01))), good

    def score(self, text: str | None) -> tuple[float, np.ndarray]:
        if self.weights is None:
            return self.base_rate, np.zeros(0)
        raw, good = self.raw(text)
        return float(1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -30, 30)))), good


def fit_field(chains: list[np.ndarray], targets: list[np.ndarray], weights: list[np.ndarray], steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and ``stay`` by gradient ascent (Adam) on the chains' log likelihood.

    ``targets`` are probabilities of good; the chains run side by side, padded to one length.
    """
    longest, n = max(map(len, chains)), len(chains)
    own = np.full((n, longest, chains[0].shape[1]), -1, np.int64)
    goal, mass = np.zeros((n, longest)), np.zeros((n, longest))
    for k, (c, t, w) in enumerate(zip(chains, targets, weights, strict=True)):
        own[k, : len(c)], goal[k, : len(c)], mass[k, : len(c)] = c, t, w
    live = mass > 0
    total = mass.sum()
    before, after = np.full_like(own, -1), np.full_like(own, -1)
    before[:, 1:], after[:, :-1] = own[:, :-1], own[:, 1:]
    spot = np.concatenate([np.where(x < 0, SIZE, x + k * LINE_FEATURES) for k, x in enumerate((own, before, after))], 2)
    beta, stay = np.zeros(SIZE + 1), 1.0
    m1, m2 = np.zeros(SIZE + 2), np.zeros(SIZE + 2)
    pair_live = live[:, 1:]
    pair_goal = goal[:, 1:] * goal[:, :-1] + (1 - goal[:, 1:]) * (1 - goal[:, :-1])
    for step in range(1, steps + 1):
        unary = np.where(live, beta[spot].sum(2) + beta[SIZE - 1], 0.0)
        ahead, back = np.zeros((n, longest)), np.zeros((n, longest))
        move = lambda m, s: np.logaddexp(m + s, 0) - np.logaddexp(m, s)
        for k in range(1, longest):
            ahead[:, k] = move(unary[:, k - 1] + ahead[:, k - 1], stay)
        for k in range(longest - 2, -1, -1):
            back[:, k] = np.where(live[:, k + 1], move(unary[:, k + 1] + back[:, k + 1], stay), 0.0)
        good = 1 / (1 + np.exp(-np.clip(unary + ahead + back, -40, 40)))
        left, right = np.clip(unary + ahead, -40, 40)[:, :-1], np.clip(unary + back, -40, 40)[:, 1:]
        same = 1 / (1 + np.exp(np.logaddexp(left, right) - np.logaddexp(left + right, 0) - stay))
        error = mass * (goal - good)
        grad = np.bincount(spot.ravel(), np.broadcast_to(error[:, :, None], spot.shape).ravel(), SIZE + 1)
        grad[SIZE - 1], grad[SIZE] = error.sum(), 0.0
        edge = (mass[:, 1:] * pair_live * (pair_goal - same)).sum()
        g = np.append(grad / total - 1e-4 * beta, edge / total - 1e-3 * stay)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        change = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        beta, stay = beta + change[:-1], float(np.clip(stay + change[-1], 0, 4))
        beta[SIZE] = 0.0
    return beta[:SIZE], stay


def fit(docs: DataFrame, labels: DataFrame, learn: Column, examples: int = EXAMPLES) -> LineModel:
    """Learn from the labels of rows where ``learn`` holds; see EXAMPLES and WINDOWS for the bounds.

    Only binned line features of the sample reach the driver, and a share for each of its documents.
    """
    common.ship(docs.sparkSession)
    sample, totals = common.labelled_sample(labels, "quality", learn, examples)
    base_rate = (totals[1] + 0.5) / (sum(totals) + 1)
    chosen = common.materialize(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    texts = common.materialize(texts)

    def run(batches):
        for batch in common.slices(batches):
            ids, ys, lines, sizes = [], [], [], []
            for i, y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, size = line_features(t)
                for k in range(0, len(own), FIT_LINES):
                    ids.append(i)
                    ys.append(y)
                    lines.append(own[k : k + FIT_LINES].astype(np.int16).tobytes())
                    sizes.append(size[k : k + FIT_LINES].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(lines, pa.binary()), pa.array(sizes, pa.list_(pa.float64()))], ["doc_id", "y", "lines", "sizes"])

    schema = "doc_id long, y int, lines binary, sizes array<double>"
    # a document with very many lines takes part with windows drawn by a hash of them
    drawn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("doc_id", "lines"), "lines", "sizes"))
    rows = texts.mapInArrow(run, schema).withColumn("drawn", drawn).where(f"drawn <= {WINDOWS}").drop("drawn").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["lines"])))
    if len({r["y"] for r in rows}) < 2:
        return LineModel(None, 0.0, 0.0, 0.0, base_rate)
    width = len(BINS) + len(FLAGS)
    chains = [np.frombuffer(bytes(r["lines"]), np.int16).astype(np.int64).reshape(-1, width) for r in rows]
    sizes = [np.array(r["sizes"]) for r in rows]
    y = np.array([r["y"] for r in rows], float)
    even = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)
    # classes weigh alike, and within a chain a line weighs by the root of its length
    mass = [e * np.sqrt(s) / np.sqrt(s).sum() for e, s in zip(even, sizes, strict=True)]
    targets = [np.full(len(c), t) for c, t in zip(chains, y, strict=True)]
    weights, stay = fit_field(chains, targets, mass)
    # lines of bad documents that look good are given the field's own view of them
    for k, c in enumerate(chains):
        if y[k] == 0:
            good, _ = forward_backward(scores_of(c, weights), stay)
            if good.min() < 0.5:
                targets[k] = np.where(good > 0.5, good, 0.0)
    weights, stay = fit_field(chains, targets, mass)
    model = LineModel(weights, stay, 1.0, 0.0, base_rate)

    def shares(batches):
        for batch in common.slices(batches):
            found = [model.share(t)[:2] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[k] for x in found], pa.float64()) for k in (0, 1))], ["doc_id", "y", "good", "size"])

    whole = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "text").mapInArrow(shares, "doc_id long, y int, good double, size double")
    whole = whole.groupBy("doc_id", "y").agg(F.sum("good").alias("good"), F.sum("size").alias("size")).where("size > 0").collect()
    whole.sort(key=lambda r: r["doc_id"])
    share = np.array([r["good"] / r["size"] for r in whole])
    label = np.array([r["y"] for r in whole], float)
    weight = np.where(label == 1, totals[1] / max((label == 1).sum(), 1), totals[0] / max((label == 0).sum(), 1))
    model.slope, model.offset = logistic(np.log((share + 0.01) / (1 - share + 0.01)), label, weight * len(label) / weight.sum())
    return model


def score_documents(docs: DataFrame, model: LineModel) -> DataFrame:
    """``doc_id, score, predicted`` and each line's marginal probability of being good."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in common.slices(batches):
            found = [shared.value.score(t) for t in batch.column(1).to_pylist()]
            score = np.array([s for s, _ in found])
            lines = pa.array([g.round(4).tolist() for _, g in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), lines], ["doc_id", "score", "predicted", "good_lines"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, predicted int, good_lines array<double>")
