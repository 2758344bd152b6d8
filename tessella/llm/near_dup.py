"""Near-duplicate documents by SuperMinHash signatures, banding and verification.

A document's set is that of its 5-word shingles (ASCII-lower-cased words). Documents
with equal sets form classes; from here on a class counts as one document. Each
class gets a SuperMinHash signature (for each element a random permutation of ranks,
stopped as soon as no later rank can change the signature), cut into bands. Classes
that share a band are candidates, and a pair is a link if the full sets' Jaccard
similarity reaches the threshold.

A bucket's pairs are not all formed. First every class is compared with its bucket's
smallest one, which joins groups of copies in a linear number of pairs. After
union-find, only buckets that still hold several components go on; there, the sets of
different components are compared: by signature, then, where those look near enough
and the components are still apart, exactly, and in the bucket of the first band that
the pair shares only. Sets move only for classes that have such a pair to compare. Of
a bucket's links a forest is returned. A bucket is cut into
tiles of a bounded number of shingles, each pair of tiles being a group of its own,
whatever the bucket's size: a pair that shares but one band is compared there. The
smallest document id names the component.

With 40 bands of 4, a pair of similarity 0.75 shares none with probability 3e-7. Estimates from 160 slots are within 0.035, and
pairs are dropped by estimate only from 0.16 below the threshold.

Defined cases: null or wordless texts have an empty set and are linked with nothing;
a text of fewer than five words is one shingle; rows without an id are linked with
nothing; rows that share an id are one document, which is linked if any of its texts
is, and stays or goes as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.llm.components import components

WIDTH = 5
SLOTS, BANDS = 160, 40
SHARE = (75, 100)
"""Threshold as a fraction: links have 100 * intersection >= 75 * union."""
SLACK = 0.16
TILE = 1 << 17
"""Shingles that a tile of a bucket holds; a task compares two tiles at a time."""
SPLIT_TILES = 16
"""Without effect: buckets of any size are compared alike. Tests still set it."""
MEMBERS = 1_024
"""Classes that are compared with their bucket's smallest one together."""

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, SLOTS + 1, dtype=np.uint64) * _GOLDEN  # arrays wrap around without a warning
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(w) < width:
        return mix(np.array([(w * _ODD[: len(w)]).sum() + np.uint64(len(w))], np.uint64))
    n = len(w) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += w[k : k + n] * _ODD[k % len(_ODD)]
    return np.unique(mix(total))


def superminhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of distinct element hashes: for each slot 16 bits of the fraction that has the least rank."""
    least = np.full(slots, np.iinfo(np.uint32).max, np.uint32)
    n = len(elements)
    rows, ranks = np.arange(n), None
    for j in range(slots):
        z = mix(elements + _STEPS[j])
        k = (j + ((z >> np.uint64(40)) * np.uint64(slots - j) >> np.uint64(24)).astype(np.int64)).astype(np.int64)
        if j == 0:
            slot, first = k, k
        else:
            if ranks is None:  # a permutation for each element, after its first exchange
                ranks = np.tile(np.arange(slots, dtype=np.uint8), (n, 1))
                ranks[rows, first] = 0
                ranks[:, 0] = first
            slot = ranks[rows, k]
            ranks[rows, k] = ranks[:, j]
            ranks[:, j] = slot
        np.minimum.at(least, slot, (np.uint32(j << 25) | (z & np.uint64(0x1FFFFFF)).astype(np.uint32)))
        if least.max() < (j + 1) << 25:
            break  # all later ranks are larger than anything in the signature
    return least.astype(np.uint16)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each signature."""
    n = len(signatures)
    parts = signatures.reshape(n, BANDS, -1).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN, (n, BANDS)).copy()
    for k in range(parts.shape[2]):
        total = mix(total ^ parts[:, :, k]) + _GOLDEN
    return total


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n, key`` (of the set; null if empty) and ``sig`` of every whole text."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in common.slices(batches):
            n, keys, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                n.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append(superminhash(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n", "key", "sig"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, key binary, sig binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SLOTS)


def _bands(batches):
    for batch in common.slices(batches, 2048):
        ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        hashes = band_hashes(_matrix(batch.column(2))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.ravel()), pa.array(np.repeat(ids, BANDS)), pa.array(np.repeat(n, BANDS))], ["h", "id", "n"])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or SHARE[1] * len(a) < SHARE[0] * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return SHARE[1] * both >= SHARE[0] * (len(a) + len(b) - both)


def sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``id, shingles`` (sorted hashes) of the candidate classes ``id, doc_id, key``, written once for all comparisons.

    Candidates are a share of the corpus that does not shrink as it grows, so the join
    is planned as a shuffle, whatever the size: the texts move once.
    """

    def run(batches):
        at, done = None, set()
        for batch in common.slices(batches):
            ids, out = [], []
            for doc, i, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc != at:  # rows come sorted by document
                    at, done = doc, set()
                if i not in done and xxhash.xxh3_128_digest(bytes_ := shingles(text).tobytes()) == key:
                    done.add(i)
                    ids.append(i)
                    out.append(bytes_)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.hint("merge").join(chosen, "doc_id").select("doc_id", "id", "key", "text").mapInArrow(run, "id long, shingles binary")


def _groups(batches, keys: int):
    """Runs of rows that agree in the first columns, as lists of the other columns' values; rows come sorted."""
    group, held = None, []
    for batch in common.slices(batches, 512):
        columns = [c.to_pylist() for c in batch.columns]
        for g, row in zip(zip(*columns[:keys], strict=True), zip(*columns[keys:], strict=True), strict=True):
            if g != group:
                if held:
                    yield group, held
                group, held = g, []
            held.append(row)
    if held:
        yield group, held


def _with_lead(batches):
    """Links of the members of each group with its lead, which comes first."""
    for (lead, _), rows in _groups(batches, 2):
        first = np.frombuffer(rows[0][2], np.uint64)
        hit = [i for side, i, found in rows if side and _linked(np.frombuffer(found, np.uint64), first)]
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array([lead] * len(hit), pa.int64())], ["a", "b"])


def links_with_leads(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of the pairs ``a, lead`` that are links. A lead with many members meets them in several groups."""
    counts = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("salts"))
    members = pairs.join(counts, "lead").select("lead", F.pmod(F.xxhash64("a"), "salts").alias("salt"), F.lit(1).alias("side"), F.col("a").alias("id"))
    leads = counts.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("lead").alias("id"))
    rows = members.unionByName(leads).join(found, "id").select("lead", "salt", "side", "id", "shingles")
    return rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "side").mapInArrow(_with_lead, "a long, b long")


def _meeting(h: int, apart: bool, tile: np.ndarray, comp: np.ndarray, n: np.ndarray, sigs: np.ndarray):
    """For rows in order of components: each row's place and those of the later ones that are to be compared with it here.

    Those lie in other components (``apart``: and in the other tile), have sizes that
    allow a link, signatures that look near enough, and share ``h`` as their first band.
    """
    least = SHARE[0] / SHARE[1] - SLACK
    bands = band_hashes(sigs)
    for k in range(len(comp)):
        after = int(np.searchsorted(comp, comp[k], side="right"))
        if after >= len(comp):
            break
        small, large = np.minimum(n[k], n[after:]), np.maximum(n[k], n[after:])
        fit = SHARE[1] * small >= SHARE[0] * large
        if apart:
            fit &= tile[after:] != tile[k]
        rest = after + np.flatnonzero(fit)
        rest = rest[(sigs[rest] == sigs[k]).mean(axis=1) >= least]
        if not len(rest):
            continue
        shared = bands[rest] == bands[k]
        mine = bands[k].view(np.int64)[shared.argmax(axis=1)] == h
        if mine.any():
            yield k, rest[mine]


_MET = "h long, i long, j long, tile long, id long, comp long, n long, sig binary"


def _met(batches):
    """The rows of each group that have a pair to be compared there: only their sets are needed."""
    for (h, i, j), rows in _groups(batches, 3):
        rows.sort(key=lambda r: (r[2], r[1]))
        tile, _, comp, n, sig = zip(*rows, strict=True)
        sigs = np.frombuffer(b"".join(sig), np.uint16).reshape(-1, SLOTS)
        hit = np.zeros(len(rows), bool)
        for k, others in _meeting(h, i != j, np.array(tile), np.array(comp), np.array(n), sigs):
            hit[k] = True
            hit[others] = True
        met = [(h, i, j, *rows[k]) for k in np.flatnonzero(hit).tolist()]
        if met:
            columns = [*(pa.array(c, pa.int64()) for c in list(zip(*met, strict=True))[:-1]), pa.array([r[-1] for r in met], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "i", "j", "tile", "id", "comp", "n", "sig"])


def _across(batches):
    """A forest of the links between different components, of the pairs of tiles in each group.

    Where ``i`` and ``j`` differ, rows of one tile are compared with those of another;
    otherwise the group holds one tile, whose rows are compared with each other.
    """
    for (h, i, j), rows in _groups(batches, 3):
        rows.sort(key=lambda r: (r[2], r[1]))
        tile, ids, comp, n, sig, found = zip(*rows, strict=True)
        sigs = np.frombuffer(b"".join(sig), np.uint16).reshape(-1, SLOTS)
        parent: dict[int, int] = {}

        def root(x: int, parent=parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        out: list[tuple[int, int]] = []
        for k, others in _meeting(h, i != j, np.array(tile), np.array(comp), np.array(n), sigs):
            a = np.frombuffer(found[k], np.uint64)
            for other in others.tolist():
                x, y = root(comp[k]), root(comp[other])
                if x != y and _linked(a, np.frombuffer(found[other], np.uint64)):
                    parent[max(x, y)] = min(x, y)
                    out.append((ids[k], ids[other]))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])


def met(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """``h, i, j, tile, id, comp, n, sig`` of the rows that have a pair to be compared in tiles ``i`` and ``j`` of bucket ``h``."""
    # the buckets that hold several components, with the tiles they are cut into
    sizes = rows.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.ceil(F.sum("n") / TILE).alias("tiles"))
    sizes = common.materialize(sizes.where("x < y").select("h", "tiles"))
    dealt = rows.join(sizes, "h").join(sigs, "id").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    dealt = dealt.select("h", "i", "j", "tile", "id", "comp", "n", "sig")
    return dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(_met, _MET)


def links_across(rows: DataFrame, sigs: DataFrame, found: DataFrame) -> DataFrame:
    """Links between different components of buckets. ``rows``: ``h, id, comp, n``; ``sigs``: ``id, sig``.

    Signatures alone say which rows meet another; sets move for those only.
    """
    dealt = common.materialize(met(rows, sigs)).join(found, "id").select("h", "i", "j", "tile", "id", "comp", "n", "sig", "shingles")
    return dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(_across, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    sigs = common.materialize(signatures(docs))
    named = sigs.where("key is not null and doc_id is not null")
    classes = named.groupBy("key").agg(F.min(F.struct("doc_id", "n", "sig")).alias("c"))
    classes = common.materialize(classes.select("key", F.monotonically_increasing_id().alias("id"), "c.doc_id", "c.n", "c.sig"))
    # the classes of a document with several texts belong together
    several = named.groupBy("doc_id").agg(F.min("key").alias("k"), F.max("key").alias("l")).where("k <> l")
    own = several.select("doc_id", F.explode(F.array("k", "l")).alias("key"))
    if not several.isEmpty():
        own = named.join(several, "doc_id", "left_semi").select("doc_id", "key").distinct()
    own = own.join(classes.select("key", "id"), "key").groupBy("doc_id").agg(F.min("id").alias("a"), F.collect_set("id").alias("b")).select("a", F.explode("b").alias("b")).where("a <> b")

    bands = classes.select("id", "n", "sig").mapInArrow(_bands, "h long, id long, n long")
    buckets = bands.groupBy("h").agg(F.min("id").alias("lead"), F.min_by("n", "id").alias("lead_n"), F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = common.materialize(bands.join(common.materialize(buckets), "h"))
    chosen = classes.select("id", "doc_id", "key").join(rows.select("id").distinct(), "id", "left_semi")
    found = common.materialize(sets(docs, chosen))
    fits = f"{SHARE[1]} * least(n, lead_n) >= {SHARE[0]} * greatest(n, lead_n)"
    pairs = rows.where(f"id <> lead and {fits}").select(F.col("id").alias("a"), "lead").distinct()
    links = common.materialize(links_with_leads(pairs, found).unionByName(own))
    groups = components(links)

    # buckets of three or more that still hold several components
    rows = rows.where("m > 2").select("h", "id", "n").join(groups, "id", "left").select("h", "id", F.coalesce("component", "id").alias("comp"), "n")
    more = common.materialize(links_across(common.materialize(rows), classes.select("id", "sig"), found))
    if not more.isEmpty():
        groups = components(links.unionByName(more))
    members = groups.join(classes.select("id", "key", "doc_id"), "id")
    least = members.groupBy("component").agg(F.min("doc_id").alias("least"))
    grouped = members.join(least, "component").select("key", "least")
    alone = classes.join(groups, "id", "left_anti").select("key", F.col("doc_id").alias("least"))
    out = sigs.select("doc_id", "n", "key").join(grouped.unionByName(alone), "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component.isNull() | (F.col("doc_id") == component)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest id."""
    out = common.materialize(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__dropped")).distinct())
    return docs.join(out, docs["doc_id"].cast("long") == out["__dropped"], "left_anti")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles
  FROM w
), n AS (SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM s
), e AS (SELECT s.doc_id, n_shingles, hash(unnest(shingles)) AS h FROM s JOIN n USING (doc_id)
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n_shingles) AS na, any_value(b.n_shingles) AS nb
  FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id
   AND 100 * least(a.n_shingles, b.n_shingles) >= 75 * greatest(a.n_shingles, b.n_shingles)
  GROUP BY 1, 2
), l AS (SELECT a, b FROM both_ WHERE 100 * k >= 75 * (na + nb - k)
), d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS id, doc_id AS reached FROM n UNION SELECT r.id, d.b FROM r JOIN d ON r.reached = d.a
), c AS (SELECT id AS doc_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""
"""The same by DuckDB, with all pairs that share a shingle."""
