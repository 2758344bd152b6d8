"""Near-duplicates, classifiers, sharding, mixing and the pipeline against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import bpe, common, embedding_dup, lines, mixing, near_dup, rules, sharding, toxicity
from tessella.llm.components import components
from tessella.llm.queries import op1_toxicity, op7_quality, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, h long, component string"


def frame(spark, texts, sources=None):
    rows = [(k, t, "en", (sources or {}).get(k, f"s{k % 3}"), None if t is None else len(t), "x", 1, None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random.seed(4)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    want = groups([x for x in links if x[0] != x[1]], {x for p in links if p[0] != p[1] for x in p})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        common_part, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (300, 50, 50))
        x, y = near_dup.superminhash(np.concatenate([common_part, a])), near_dup.superminhash(np.concatenate([common_part, b]))
        errors.append((x == y).mean() - 0.75)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.045
    assert (near_dup.superminhash(np.array([5], np.uint64)) == near_dup.superminhash(np.array([5], np.uint64))).all()


def shingle_set(t):
    words = (t or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def copies():
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    texts = [None, "", " ", "one two", "ONE two", "one two three four five", "é é"]
    for _ in range(12):
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(random.randint(0, 6)):
            other = list(base)
            for _ in range(random.randint(0, 5)):
                other[random.randrange(len(other))] = word()
            texts.append(" ".join(other))
    passage = [word() for _ in range(60)]
    for _ in range(30):  # a passage that many documents share
        texts.append(" ".join([*(word() for _ in range(50)), *passage]))
    chain = [word() for _ in range(100)]
    for k in range(25):  # neighbours are near, ends are not
        chain[4 * k % 100] = word()
        texts.append(" ".join(chain))
    hub = [word() for _ in range(100)]
    for _ in range(60):  # near to the first one, not to each other
        other = list(hub)
        for _ in range(3):
            other[random.randrange(len(other))] = word()
        texts.append(" ".join(other))
    long = [word() for _ in range(30_000)]
    return texts + [" ".join(long), " ".join(long[:29_000]), " ".join(long[:20_000])] + texts[-3:]


@pytest.mark.parametrize("tile, split, members", [(near_dup.TILE, near_dup.SPLIT_TILES, near_dup.MEMBERS), (300, 16, 3), (200, 1, 1)])
def test_near_duplicates_by_hand(spark, tile, split, members, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", tile)
    monkeypatch.setattr(near_dup, "SPLIT_TILES", split)
    monkeypatch.setattr(near_dup, "MEMBERS", members)
    texts = copies()
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(links, range(len(texts)))
    got = near_dup.near_duplicates(frame(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {k: (len(s), want[k], want[k] == k) for k, s in enumerate(sets)}
    assert len(got) == len(texts)


@pytest.mark.parametrize("tile", [near_dup.TILE, 5])
def test_one_shared_band_is_enough_in_buckets_of_any_size(spark, tile, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", tile)
    common.ship(spark)
    sigs = np.tile(np.arange(near_dup.SLOTS, dtype=np.uint16), (2, 1))
    sigs[1, 4::4] += 1_000  # the second band on, each differs in a slot
    [h] = set(near_dup.band_hashes(sigs)[0].view(np.int64).tolist()) & set(near_dup.band_hashes(sigs)[1].view(np.int64).tolist())
    found = [np.arange(k, 100 + k, dtype=np.uint64).tobytes() for k in range(2)]
    rows = spark.createDataFrame([(h, k, k, 100) for k in range(2)], "h long, id long, comp long, n long")
    frames = [spark.createDataFrame([(k, bytearray(x[k])) for k in range(2)], f"id long, {name} binary") for name, x in (("sig", [s.tobytes() for s in sigs]), ("shingles", found))]
    assert [tuple(r) for r in near_dup.links_across(rows, *frames).collect()] in ([(0, 1)], [(1, 0)])


@pytest.mark.parametrize("tile", [near_dup.TILE, 400])
def test_sets_move_only_for_rows_that_meet_another(spark, tile, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", tile)
    common.ship(spark)
    rng = np.random.default_rng(3)
    base = np.arange(near_dup.SLOTS, dtype=np.uint16)
    sigs = [base.copy() for _ in range(12)]
    for k in range(12):  # all share the first band; 0 to 2 are near each other, 3 is of another size, 4 and 5 are one component
        sigs[k][4:] = 10_000 + k if k > 5 else sigs[k][4:]
        sigs[k][4:] = rng.permutation(sigs[k][4:]) if k in (4, 5) else sigs[k][4:]
        sigs[k][4 + k :: 16] += 1_000 if k < 3 else 0
    sigs[5] = sigs[4]
    n = [100, 100, 100, 300, *[100] * 8]
    h = int(near_dup.band_hashes(np.array(sigs))[0].view(np.int64)[0])
    rows = spark.createDataFrame([(h, k, 4 if k == 5 else k, n[k]) for k in range(12)], "h long, id long, comp long, n long")
    sig = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sigs)], "id long, sig binary")
    assert {r["id"] for r in near_dup.met(rows, sig).collect()} == {0, 1, 2}
    found = [np.arange(k, 100 + k, dtype=np.uint64).tobytes() for k in range(12)]
    found = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(found)], "id long, shingles binary")
    assert groups([(r["a"], r["b"]) for r in near_dup.links_across(rows, sig, found).collect()], range(12)) == {k: 0 if k < 3 else k for k in range(12)}


def test_near_duplicates_with_odd_ids(spark):
    a, b, c = ("one two three four five six seven eight", "nine ten eleven twelve a b c d e f", "g h i j k l m n")
    rows = [(5, a), (2, a), (2, a), (7, b), (7, c), (3, b), (9, c), (None, a), (None, None), (11, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect()}
    # 7 has two texts and joins 3 and 9
    assert got == {(5, 4): (2, False), (2, 4): (2, True), (7, 6): (3, False), (7, 4): (3, False), (3, 6): (3, True), (9, 4): (3, False), (None, 4): (None, True), (None, 0): (None, True), (11, 0): (11, True)}
    kept = near_dup.drop_near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(2, a), (2, a), (3, b), (0, a), (0, ""), (11, "")])


def test_near_duplicates_of_nothing(spark):
    docs = frame(spark, ["a b c d e f"] * 3)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [0]


def test_embeddings_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(40):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 8))):
            rows.append(((base + rng.normal(size=16) * 0.05).astype(np.float32).astype(float).tolist(), g % 3))
    hot = rng.normal(size=16)
    rows += [(hot.astype(np.float32).astype(float).tolist(), 1)] * 30
    rows += [((hot + rng.normal(size=16) * 0.02).astype(np.float32).astype(float).tolist(), 1) for _ in range(320)]  # more than a block
    rows += [(None, 1), ([0.0] * 16, 1), ([None] * 16, 1), ([float("nan")] * 16, 1), (rows[0][0], None), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([], 0)]
    data = [(k, v, label, "x") for k, (v, label) in enumerate(rows)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, cell string")

    def usable(v, label):
        return label is not None and v and None not in v and np.isfinite(v).all() and any(v)

    links = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        (x, p), (y, q) = rows[a], rows[b]
        if usable(x, p) and usable(y, q) and p == q and len(x) == len(y):
            x, y = np.array(x), np.array(y)
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.append((a, b))
    want, n = groups(links, range(len(rows))), np.bincount(np.array(links).ravel(), minlength=len(rows))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dup.near_duplicate_vectors(table).collect()}
    assert got == {k: (int(n[k]), want[k], want[k] == k) for k in range(len(rows))}
    assert embedding_dup.near_duplicate_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("levels, block", [((2,), 256), ((8,), 64), ((16,), 32), (embedding_dup.LEVELS, 8)])
def test_embeddings_on_larger_grids(spark, levels, block, monkeypatch):
    """Recall 1 on grids of many codes, with a label that holds most rows, and rows placed in proportion to rows."""
    monkeypatch.setattr(embedding_dup, "LEVELS", levels)
    monkeypatch.setattr(embedding_dup, "BLOCK", block)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(120, 24))
    x = centres[rng.integers(0, 120, 2_400)] + rng.normal(size=(2_400, 24)) * rng.choice([0.03, 0.08, 0.12, 1.0], (2_400, 1))
    label = np.where(rng.random(2_400) < 0.8, 0, rng.integers(1, 6, 2_400))
    x[2_000:2_100] = x[:100]
    label[2_000:2_100] = label[:100]
    x[300:900] = x[300:900].astype(np.float32)  # some rows need single precision only
    table = spark.createDataFrame([(int(k), v.tolist(), int(y), 1, "x") for k, (v, y) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int, dim int, key string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    want = groups([(a, b) for a, b in zip(*np.nonzero(hit), strict=True) if a < b], range(len(x)))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dup.near_duplicate_vectors(table).collect()}
    assert hit.sum() > 2_000
    assert got == {k: (int(hit[k].sum()), want[k], want[k] == k) for k in range(len(x))}


def test_grids_follow_the_rows_of_a_label():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(300, 32))
    rows = [embedding_dup.packed(v) for v in centres[rng.integers(0, 300, 6_000)] + rng.normal(size=(6_000, 32)) * 0.1]
    grids = embedding_dup.train_grids(rows, 10**7, 0.04)
    assert list(grids) == [k for k in embedding_dup.LEVELS if k <= 6_000 // 8]
    best = [embedding_dup.best_grid(grids, n) for n in (10, 10**4, 10**5, 10**6, 10**7)]
    assert best[0] == 2 and best == sorted(best) and best[-1] >= 32
    assert list(embedding_dup.train_grids(rows[:20], 10**7, 0.04)) == [2]


@pytest.mark.parametrize("terms, most", [(60, 40), (60, 8), (5_000, 60)])
def test_block_max_index_is_exact(terms, most):
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        f = np.sort(rng.choice(terms, rng.integers(0, most), replace=False))
        w = rng.random(len(f)) ** 4
        vectors.append((f, w / np.linalg.norm(w) if len(w) else w))
    grid = np.zeros((len(vectors), terms))
    for e, (f, w) in enumerate(vectors):
        grid[e, f] = w
    index = toxicity.BlockMaxIndex(list(vectors), np.zeros(700, int), np.arange(700), terms)
    for q in range(120):
        cosines = grid @ grid[q]
        cosines[q] = 0
        for k in (9, 25):
            want = sorted(((-c, e) for e, c in enumerate(cosines) if c > 0))[:k]
            got = index.nearest(vectors[q], k, without=[q])
            assert np.allclose([c for c, _ in got], [-c for c, _ in want])
            assert all(abs(cosines[e] - c) < 1e-9 for c, e in got)


def test_toxicity_equals_brute_force(spark, small):
    """Weights, vectors, neighbours, votes and scores of all documents, from the definitions."""
    docs, labels = common.documents(spark, small), common.labels(spark, small)
    model = toxicity.fit(docs, labels, F.lit(True))
    norm = {r["doc_id"]: toxicity.normal(r["text"]) for r in docs.collect()}
    examples = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] in (0, 1) and r["doc_id"] in norm}
    n1, n0 = sum(examples.values()), sum(1 - y for y in examples.values())
    assert sorted(model.index.ids.tolist()) == sorted(examples)
    terms = {w for i in examples for w in norm[i].split()}
    assert terms == set(model.names[: model.words])
    pieces = model.names[model.words :]

    def weight(has):
        a, b = (sum(has(norm[i]) for i, y in examples.items() if y == side) for side in (1, 0))
        part = (a + b) * (n0 + n1 - a - b) * n1 * n0
        chi2 = (n0 + n1) * (a * (n0 - b) - b * (n1 - a)) ** 2 / part if part and a * n0 > b * n1 else 0.0
        return (math.log((1 + n0 + n1) / (1 + a + b)) + 1) * (toxicity.RELEVANCE + (1 - toxicity.RELEVANCE) * chi2 / (chi2 + toxicity.HALFWAY))

    weights = {("word", w): weight(lambda t, w=w: f" {w} " in t) for w in terms} | {("piece", p): weight(lambda t, p=p: p in t) for p in pieces}

    def vector(t):
        counts = {("word", w): t.split().count(w) for w in set(t.split()) & terms} | {("piece", p): sum(t.startswith(p, k) for k in range(len(t))) for p in pieces if p in t}
        raw = {x: (1 + math.log(n)) * weights[x] for x, n in counts.items()}
        length = math.sqrt(sum(w * w for w in raw.values()))
        return {x: w / length for x, w in raw.items()}

    known, place = {i: vector(norm[i]) for i in examples}, {e: k for k, e in enumerate(model.index.ids.tolist())}
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    assert len(got) == len(norm)
    for i, t in norm.items():
        v = vector(t)
        cosines = sorted((-round(sum(w * known[e].get(x, 0) for x, w in v.items()), 12), place[e], e) for e in examples if norm[e] != t)
        near = [(-c, e) for c, _, e in cosines if c < 0][:25]
        assert np.allclose(got[i]["near_cosines"], [c for c, _ in near[:5]])
        votes = [0.5, 0.5]
        for c, e in near:
            votes[examples[e]] += c / (0.1 + max(0.0, 1 - c))
        z = model.slope * math.log(votes[1] / votes[0]) + model.offset
        assert math.isclose(got[i]["score"], 1 / (1 + math.exp(-max(-30, min(30, z)))), abs_tol=1e-9)
        assert bool(got[i]["near_ids"]) == bool(near)


def test_toxicity_held_out(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    rows = op1_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (__import__("zlib").crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.93 * len(held)
    assert sum(r["predicted"] for r in held if r["toxic"] == 0) <= 0.03 * len(held)


def test_toxicity_without_labels(spark, small):
    docs, labels = frame(spark, [None, "", "x y"]), spark.read.parquet(f"{small}/labels.parquet").limit(0)
    model = toxicity.fit(docs, labels, F.lit(True))
    assert [r["predicted"] for r in toxicity.score_documents(docs, model).collect()] == [int(model.base_rate >= 0.5)] * 3
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    stage = toxicity.drop_toxic(docs, spark.createDataFrame([(2, 0, 0), (1, 0, 0), (0, 1, 1)], "doc_id long, quality int, toxic int"))
    assert stage.columns == docs.columns and stage.count() == 3


def test_toxicity_of_odd_rows(spark, small):
    docs, labels = common.documents(spark, small), common.labels(spark, small)
    model = toxicity.fit(docs, labels, F.lit(True))
    text = docs.where("text is not null").first()["text"]
    odd = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text * 400), (3, "zzqx " * 50_000), (4, None), (5, "")], "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1))
    got = toxicity.score_documents(odd, model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got[:3]}) == 1 and len({r["score"] for r in got[4:]}) == 1
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(5)
    for n in range(1, 7):
        unary, stay = rng.normal(size=n), float(rng.normal())
        weights, good, same = 0.0, np.zeros(n), np.zeros(max(n - 1, 0))
        for labels in itertools.product((0, 1), repeat=n):
            x = np.array(labels)
            w = math.exp(float((unary * x).sum()) + stay * sum(a == b for a, b in itertools.pairwise(labels)))
            weights += w
            good += w * x
            same += w * (x[1:] == x[:-1])
        a, b = lines.forward_backward(unary, stay)
        assert np.allclose(a, good / weights) and np.allclose(b, same / weights)


def test_quality_held_out(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    rows = op7_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)


def test_quality_of_odd_texts(spark, small):
    docs = frame(spark, [None, "", "\n\n", "x" * 5000, "a\n" * 300])
    model = lines.fit(docs, spark.createDataFrame([(k, k % 2, 0) for k in range(5)], "doc_id long, quality int, toxic int"), F.lit(True))
    scores = [r["score"] for r in lines.score_documents(docs, model).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    none = lines.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))
    assert none.weights is None and lines.score_documents(docs.limit(0), none).count() == 0


def test_shards(spark):
    texts = [None, "", "é"] + [f"text {k % 40} " * (k % 7) for k in range(5_000)]
    docs = frame(spark, texts)
    again = [{(r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign_shards(docs).collect()} for _ in range(2)]
    assert again[0] == again[1] and len(again[0]) == len(texts)
    rows = sharding.assign_shards(docs).collect()
    by: dict[int, list[int]] = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == __import__("zlib").crc32(text.encode())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 40
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    order = [i for _, i in sorted((r["slot"] * 40 + r["shard"], r["doc_id"]) for r in rows)]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.1
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_shards_are_written(spark, tmp_path):
    docs = frame(spark, [f"t{k}" for k in range(200)]).withColumn("bucket", F.lit(1))
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and set(docs.columns) <= set(back.columns)


def test_shards_of_a_hot_row(spark, monkeypatch):
    """A third of all rows are one row, without an id: no bucket holds them all, and the law holds."""
    seen = []
    monkeypatch.setattr(sharding, "bucket_offsets", lambda b, own=sharding.bucket_offsets: seen.append(b) or own(b))
    rows = [(None, "same")] * 4_000 + [(7, "same")] * 2_000 + [(k, f"text {k}") for k in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign_shards(docs, 7).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 4_000
    per = [sorted(r["slot"] for r in got if r["shard"] == k) for k in range(7)]
    assert all(x == list(range(len(x))) for x in per) and max(map(len, per)) - min(map(len, per)) <= 1
    assert max(b["n"] for b in seen[0].collect()) < 1_300


def mix_by_hand(rows):
    """rows: (doc_id, source, size, key)."""
    sizes: dict = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, budget = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        open_ -= full
    return sizes, target


def test_mixing_by_hand(spark):
    random.seed(8)
    texts = [None, "", "  "] + [" ".join(["w"] * random.randint(0, 60)) + random.choice(["", " ### $$"]) for _ in range(900)]
    sources = {k: random.choice([None, "a", "a", "a", "b", "é", "zz"]) for k in range(len(texts))}
    docs = frame(spark, texts, sources)
    out = mixing.mix(docs).collect()
    rows = [(r["doc_id"], r["source"], r["size"], r["taken"]) for r in out]
    sizes, target = mix_by_hand(rows)
    taken: dict = {}
    for i, s, n, t in rows:
        assert n == len((texts[i] or "").split()) and t in (0, n, 2 * n)
        taken[s] = taken.get(s, 0) + t
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 40
    assert sorted(rows, key=lambda r: r[0]) == sorted(((r["doc_id"], r["source"], r["size"], r["taken"]) for r in mixing.mix(docs).collect()), key=lambda r: r[0])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert words == sum(taken.values())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mixing_without_ids(spark):
    rows = [(None, f"{'w ' * (k % 9 + 1)}{k}", "a") for k in range(400)] + [(None, None, None), (None, "x", None)] + [(3, "b c", "b")] * 50 + [(k, "b c d", "b") for k in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit(1)).withColumn("target", F.lit("x"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    for s in ("a", "b"):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 110  # 50 rows of one id are taken alike
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_pipeline_by_hand(spark, small):
    """Each stage against what it should do to its own input; the last one against the library."""
    docs = common.documents(spark, small)
    columns = docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in common.labels(spark, small).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.materialize(stage(spark, docs, small))
        assert docs.columns == columns, name
        ids, had = [r["doc_id"] for r in docs.select("doc_id").collect()], {r["doc_id"] for r in before.select("doc_id").collect()}
        assert set(ids) <= had
        if name == "toxicity":
            gone = had - set(ids)
            clean = [i for i in had if labels.get(i) == 0]
            assert sum(i in gone for i in clean) <= 0.02 * len(clean)
        if name == "near_dup":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            sets = {i: shingle_set(t) for i, t in texts.items()}
            links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            assert set(ids) == {i for i, r in groups(links, sets).items() if i == r}
        if name == "pii":
            assert len(ids) == len(had)
    out = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()}
    library = Tokenizer.from_file(tokenizer_path())
    for r in docs.collect():
        assert out[r["doc_id"]]["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
    assert corpus_pipeline.run(spark, small).count() == docs.count()


def test_pipeline_stages_take_nothing(spark, small):
    docs = common.documents(spark, small)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0, name
    assert bpe.encode_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_lines_long_documents_leave_room_for_short_ones(spark):
    good = "The river runs past the old mill.\nWe walked home after supper.\nIt was a quiet evening."
    bad = "\n".join(f"$$$ BUY {k} | NOW {k} !!! ###" for k in range(6000))
    docs = spark.createDataFrame([(0, good), (1, good + "\nRain fell."), (2, bad), (3, bad[:40_000])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 2), 0) for k in range(4)], "doc_id long, quality int, toxic int")
    model = lines.fit(docs, labels, F.lit(True), examples=2)
    assert model.weights is not None
    scores = {r["doc_id"]: r["score"] for r in lines.score_documents(docs, model).collect()}
    assert min(scores[0], scores[1]) > 0.5 > max(scores[2], scores[3])


def test_forest_rejects_what_the_rules_let_through(spark, small):
    """The whole query against scores by recursion; most labelled junk goes, good rows stay."""
    folder = small.replace("sf0.001", "sf0.01")
    docs, labels = common.documents(spark, folder), common.labels(spark, folder)
    model = rules.fit(docs, labels)
    forest = model.forest

    def path(tree, node, x):
        f = forest.feature[tree, node]
        if f < 0:
            return forest.length[tree, node]
        return path(tree, (forest.left if x[f] < forest.value[tree, node] else forest.right)[tree, node], x)

    got = {r["doc_id"]: r for r in rules.apply_rules(spark, docs, labels).collect()}
    texts, quality = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(got) == len(texts)
    trees = len(forest.feature)
    for i, t in texts.items():
        base, x = rules.statistics(t)
        score = 2 ** (-sum(path(k, 0, x) for k in range(trees)) / trees / rules.expected_length(forest.subsample))
        assert got[i]["base_failed"] == rules.fails(base)
        assert got[i]["kept"] == (not rules.fails(base) and score < model.threshold), (i, score, model.threshold)
    passed = [i for i in quality if i in got and not got[i]["base_failed"]]
    junk, good = [i for i in passed if quality[i] == 0], [i for i in passed if quality[i] == 1]
    assert junk and sum(not got[i]["kept"] for i in junk) >= 0.8 * len(junk)
    assert sum(got[i]["kept"] for i in good) >= 0.98 * len(good)
