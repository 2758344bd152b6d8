"""Toxicity by the nearest labelled examples.

A bounded sample of labelled rows is indexed whole: every example, and every word that
any of them has. Beginnings and 5-character pieces of words join the words where they
are associated with the label, so that disguised forms of a word meet. A term's weight
is TF-IDF, scaled by how surely the term occurs more often in toxic examples (a share
RELEVANCE at least, so that no word is without weight); cosines are exact in that space.

The inverted index keeps rare terms as postings, which are added up in full. Frequent
terms are kept by blocks of examples, with each term's largest weight in each block;
a block's rows are only completed while its upper bound reaches the nearest examples
found so far. Votes weighted by distance, put on a probability scale by a logistic
curve that is fitted with each example left out of its own vote, give the score.
Examples with the very text that is scored don't vote on it, so that no row's label
takes part in its own score.

Defined cases: null, empty and wordless texts, and those without any word of the
sample, have no neighbours and get the score of no evidence; so have all texts if the
sample lacks a class (the score is then the share of toxic labels); equal similarities
are ordered by the examples' order in the index; repeated rows are scored one by one.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

EXAMPLES = 1_600
"""Labelled documents of each class that are indexed."""
CALIBRATION = 800
"""Of these, documents of each class that the logistic curve is fitted on."""
RELEVANCE, HALFWAY = 0.12, 24.0
"""The least share of its TF-IDF that a term weighs, and the chi-squared value that is half-way to the whole."""
PIECE_CHI2, PIECE_LIFT, PIECE_DOCS = 24.0, 8.0, 3
"""Pieces of words are terms if they are so surely, and by so much, more frequent in toxic examples."""
NEIGHBOURS = 25
SHOWN = 5
"""Neighbours that are named as evidence."""
BLOCK = 64
FREQUENT = 4
"""Terms of more than this share (1 / FREQUENT) of the examples are kept by blocks."""
PIECE = 5
PREFIXES = range(4, 11)

_TO_SPACE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def normal(text: str | None) -> str:
    """Lower case, ASCII letters and digits and all other scripts kept, words between single spaces."""
    words = (text or "").lower().encode().translate(_TO_SPACE).decode().split()
    return f" {' '.join(words)} " if words else ""


def features(norm: str) -> set[str]:
    """The words, with their spaces, and the pieces of a normalised text."""
    out = set()
    for word in set(norm.split()):
        padded = f" {word} "
        out.add(padded)
        out.update(padded[k : k + PIECE] for k in range(len(padded) - PIECE + 1))
        out.update(padded[:k] for k in PREFIXES if k < len(padded))
    return out


@dataclass
class BlockMaxIndex:
    """Vectors of examples as (terms, weights); see the module's head."""

    vectors: list[tuple[np.ndarray, np.ndarray]]
    toxic: np.ndarray
    ids: np.ndarray
    size: int
    start: np.ndarray = field(init=False)
    at: np.ndarray = field(init=False)
    own: np.ndarray = field(init=False)
    row: np.ndarray = field(init=False)
    dense: np.ndarray = field(init=False)
    most: np.ndarray = field(init=False)

    def __post_init__(self):
        n = len(self.vectors)
        terms = np.concatenate([t for t, _ in self.vectors] or [np.zeros(0, np.int64)])
        weights = np.concatenate([w for _, w in self.vectors] or [np.zeros(0)])
        example = np.repeat(np.arange(n), [len(t) for t, _ in self.vectors])
        df = np.bincount(terms, minlength=self.size)
        frequent = np.flatnonzero(df > n / FREQUENT)
        self.row = np.full(self.size, -1, np.int64)
        self.row[frequent] = np.arange(len(frequent))
        blocks = max(1, -(-n // BLOCK))
        self.dense = np.zeros((blocks, len(frequent), BLOCK))
        often = self.row[terms] >= 0
        self.dense[example[often] // BLOCK, self.row[terms[often]], example[often] % BLOCK] = weights[often]
        self.most = self.dense.max(axis=2).T.copy()
        order = np.flatnonzero(~often)
        order = order[np.argsort(terms[order], kind="stable")]
        self.at, self.own = example[order].astype(np.int32), weights[order]
        self.start = np.searchsorted(terms[order], np.arange(self.size + 1))
        self.vectors = []

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int = NEIGHBOURS, without=()) -> list[tuple[float, int]]:
        """The k examples of largest cosine above 0, as (cosine, example), exactly; ``without`` are left out."""
        terms, weights = vector
        n = len(self.ids)
        if not len(terms) or not n:
            return []
        row = self.row[terms]
        scores = np.zeros((self.dense.shape[0], BLOCK))
        rare = np.flatnonzero(row < 0)
        if len(rare):
            starts, ends = self.start[terms[rare]], self.start[terms[rare] + 1]
            spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
            at = np.concatenate([self.at[s:e] for s, e in spans])
            own = np.concatenate([self.own[s:e] for s, e in spans])
            scores += np.bincount(at, own * np.repeat(weights[rare], ends - starts), scores.size).reshape(scores.shape)
        left_out = np.zeros(scores.shape, bool)
        for e in without:
            left_out[e // BLOCK, e % BLOCK] = True
        often = row >= 0
        if often.any():
            d, w = row[often], weights[often]
            bounds = w @ self.most[d] + np.where(left_out, 0, scores).max(axis=1)
            by_bound = np.argsort(-bounds, kind="stable")
            done, step, floor = 0, max(1, k // 8), 0.0
            while done < len(by_bound) and bounds[by_bound[done]] > max(floor - 1e-12, 0):
                # the blocks whose bound is over the floor, a few at first so that the floor rises
                upto = min(len(by_bound), done + step)
                some = by_bound[done:upto]
                some = some[bounds[some] > max(floor - 1e-12, 0)]
                scores[some] += w @ self.dense[some[:, None], d[None, :]]
                done, step = upto, len(by_bound)
                seen = by_bound[:done]
                found = np.where(left_out[seen], 0, scores[seen]).ravel()
                if len(found) > k:
                    floor = max(floor, float(np.partition(found, -k)[-k]))
            rest = np.ones(len(bounds), bool)
            rest[by_bound[:done]] = bounds[by_bound[:done]] <= max(floor - 1e-12, 0)
            scores[rest] = 0  # not complete, and below the floor
        scores[left_out] = 0
        flat = scores.ravel()
        top = np.flatnonzero(flat > 0)
        if len(top) > k:
            top = top[flat[top] >= np.partition(flat[top], -k)[-k]]
        top = top[np.argsort(-flat[top], kind="stable")][:k]
        return [(float(flat[e]), int(e)) for e in top]


NOTHING = (np.zeros(0, np.int64), np.zeros(0))


@dataclass
class ToxicityModel:
    """``names``: words first, then pieces; ``texts``: a digest of each example's text to its places in the index."""

    names: list[str]
    words: int
    weight: np.ndarray
    index: BlockMaxIndex | None
    slope: float
    offset: float
    base_rate: float
    texts: dict[int, list[int]] = field(default_factory=dict)
    _automaton: object = None
    _places: dict[str, int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None, "_places": None}

    def vector(self, norm: str) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of a normalised text over the model's terms, terms in order."""
        if self._places is None:
            self._places = {name: k for k, name in enumerate(self.names[: self.words])}
            self._automaton = ahocorasick.Automaton()
            for k in range(self.words, len(self.names)):
                self._automaton.add_word(self.names[k], k)
            if len(self.names) > self.words:
                self._automaton.make_automaton()
        places = self._places
        counts = Counter(map(places.get, norm.split()))
        counts.pop(None, None)
        if len(self.names) > self.words:
            counts.update(Counter(k for _, k in self._automaton.iter(norm)))
        if not counts:
            return NOTHING
        terms = np.fromiter(counts.keys(), np.int64, len(counts))
        often = np.fromiter(counts.values(), np.float64, len(counts))
        order = np.argsort(terms)
        terms = terms[order]
        raw = (1 + np.log(often[order])) * self.weight[terms]
        return terms, raw / np.sqrt((raw * raw).sum())

    def evidence(self, found: list[tuple[float, int]]) -> float:
        """Log ratio of the votes for and against, each example's vote weighing more the nearer it is."""
        votes = [0.5, 0.5]
        for cosine, e in found:
            votes[int(self.index.toxic[e])] += cosine / (0.1 + max(0.0, 1 - cosine))
        return float(np.log(votes[1] / votes[0]))

    def score(self, norm: str) -> tuple[float, list[tuple[float, int]], tuple[np.ndarray, np.ndarray]]:
        """The score of a normalised text, its neighbours and its vector."""
        if self.index is None:
            return self.base_rate, [], NOTHING
        vector = self.vector(norm)
        found = self.index.nearest(vector, without=self.texts.get(digest(norm), ()))
        z = self.slope * self.evidence(found) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), found, vector


def digest(norm: str) -> int:
    return xxhash.xxh3_64_intdigest(norm.encode())


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset by Newton's method, with smoothed targets and a slight penalty."""
    target = np.where(y == 1, (weight[y == 1].sum() + 1) / (weight[y == 1].sum() + 2), 1 / (weight[y == 0].sum() + 2))
    a = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (weight * (target - p)) - 1e-3 * beta
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, examples: int = EXAMPLES) -> ToxicityModel:
    """Learn from the labels of rows where ``learn`` holds; see EXAMPLES for the bound."""
    common.ship(docs.sparkSession)
    sample, totals = common.labelled_sample(labels, "toxic", learn, examples)
    base_rate = (totals[1] + 0.5) / (sum(totals) + 1)
    none = ToxicityModel([], 0, np.zeros(0), None, 0.0, 0.0, base_rate)
    if not all(totals):
        return none
    chosen = common.materialize(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    texts = common.materialize(texts.repartition(24, "doc_id"))

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in common.slices(batches):
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name in features(normal(text)):
                    seen.setdefault(name, [0, 0])[y] += 1
        names = list(seen)
        for k in range(0, len(names), 10_000):
            part = names[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[x][0] for x in part], pa.int64()), pa.array([seen[x][1] for x in part], pa.int64())], ["name", "clean", "toxic"])

    n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return none
    counted = texts.select("y", "text").mapInArrow(count, "name string, clean long, toxic long").groupBy("name").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
    # all words, and the pieces that the label is associated with
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    sure = F.try_divide((n0 + n1) * F.pow(a * (n0 - b) - b * (n1 - a), 2), (a + b) * (n0 + n1 - a - b) * n1 * n0)
    counted = counted.withColumn("chi2", F.when(a * n0 > b * n1, F.coalesce(sure, F.lit(0.0))).otherwise(0.0))
    word = F.startswith("name", F.lit(" ")) & F.endswith("name", F.lit(" "))
    piece = (a >= PIECE_DOCS) & (a * n0 >= PIECE_LIFT * (b + 0.5) * n1) & (F.col("chi2") >= PIECE_CHI2)
    terms = counted.where(word | piece).select(word.alias("word"), "name", F.log((1.0 + n0 + n1) / (1.0 + a + b)).alias("idf"), "chi2").orderBy(~word, "name").toArrow()
    names, is_word, chi2 = terms["name"].to_pylist(), terms["word"].to_pylist(), terms["chi2"].to_numpy()
    if not names:
        return none
    words = sum(is_word)
    weight = (terms["idf"].to_numpy() + 1) * (RELEVANCE + (1 - RELEVANCE) * chi2 / (chi2 + HALFWAY))
    model = ToxicityModel([x.strip() if w else x for x, w in zip(names, is_word, strict=True)], words, weight, None, 0.0, 0.0, base_rate)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vectors(batches):
        for batch in common.slices(batches):
            norms = [normal(t) for t in batch.column(2).to_pylist()]
            found = [shared.value.vector(x) for x in norms]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.int64(np.uint64(digest(x))) if x else None for x in norms], pa.int64()), pa.array([v for v, _ in found], pa.list_(pa.int64())), pa.array([w for _, w in found], pa.list_(pa.float64()))], ["doc_id", "y", "text", "f", "w"])

    table = texts.mapInArrow(vectors, "doc_id long, y int, text long, f array<long>, w array<double>").toArrow()
    got = [(y, i, t, np.array(f, np.int64), np.array(w)) for y, i, t, f, w in zip(*(table[c].to_pylist() for c in ("y", "doc_id", "text", "f", "w")), strict=True)]
    # like examples side by side, so that a block's largest weights say much about its rows
    got.sort(key=lambda x: (not len(x[3]), int(x[3][x[4].argmax()]) if len(x[3]) else 0, x[1], -1 if x[2] is None else x[2]))
    for e, x in enumerate(got):
        if x[2] is not None:
            model.texts.setdefault(x[2] % (1 << 64), []).append(e)
    model.index = BlockMaxIndex([(f, w) for _, _, _, f, w in got], np.array([x[0] for x in got], np.int64), np.array([x[1] for x in got], np.int64), len(names))
    xs, ys = [], []
    left = {0: CALIBRATION, 1: CALIBRATION}
    for e, (y, _, text, f, w) in sorted(enumerate(got), key=lambda x: (x[1][1] * 2654435761) % (1 << 32)):
        if left[y]:
            left[y] -= 1
            xs.append(model.evidence(model.index.nearest((f, w), without=[e] if text is None else model.texts[text % (1 << 64)])))
            ys.append(y)
    y = np.array(ys)
    weight = np.where(y == 1, totals[1] / max((y == 1).sum(), 1), totals[0] / max((y == 0).sum(), 1))
    model.slope, model.offset = logistic(np.array(xs), y, weight * len(y) / weight.sum())
    return model


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, predicted`` and the evidence: nearest example ids with cosines, strongest features."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in common.slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                score, found, (terms, weights) = model.score(normal(text))
                near = found[:SHOWN]
                top = [model.names[k].strip() for k in terms[np.argsort(-weights, kind="stable")[:SHOWN]]] if found else []
                rows.append((score, int(score >= 0.5), [int(model.index.ids[e]) for _, e in near], [c for c, _ in near], top))
            columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.float64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.string())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "score", "predicted", "near_ids", "near_cosines", "features"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, predicted int, near_ids array<long>, near_cosines array<double>, features array<string>")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; learns from all usable labels."""
    model = fit(docs, labels, F.lit(True))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.schema.fieldNames().index("text")

    def run(batches):
        for batch in common.slices(batches):
            keep = [shared.value.score(normal(t))[0] < 0.5 for t in batch.column(at).cast(pa.string()).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
