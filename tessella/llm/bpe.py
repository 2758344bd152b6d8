"""Byte-level BPE encoding and decoding with a published vocabulary.

Encoding keeps the symbols of a piece in a doubly linked list and the possible
merges in a priority queue of ranks; an entry whose symbols have changed since it
was queued is stale and skipped. A piece of n bytes takes O(n log n), however
long it is. Decoding concatenates the vocabulary's strings.

Defined cases: a null text encodes as the empty text (no ids); the text of a
special token becomes that token's id, as in the tokenizers library; bytes that
are not UTF-8 after decoding become U+FFFD; rows with equal ids stay separate
rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

#: Fixed pattern of the vocabulary's pre-tokenizer.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHE_PIECES = 80_000
"""Pieces whose encoding a Python worker remembers, and as many used before those."""

CACHE_CHARS = 40
"""Longer pieces are encoded each time."""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def latin_piece() -> str:
    """PIECE for texts of code points below 256, with its classes written out."""
    chars = [chr(c) for c in range(256)]
    letters, numbers, spaces = ("".join(f"\\x{ord(c):02x}" for c in chars if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s"))
    classes = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": spaces, r"\S": f"[^{spaces}]"}
    out = PIECE.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    for k in (r"\p{L}", r"\p{N}", r"\s"):
        out = out.replace(k, f"[{classes[k]}]")
    return out.replace(r"\S", classes[r"\S"])


class ByteBpe:
    """An encoder and decoder over a vocabulary, its merges and its special tokens."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        symbols = byte_symbols()
        back = {ord(s): b for b, s in enumerate(symbols)}
        size = 1 + max([*vocab.values(), *special.values()])
        self.size = size
        self.first = [vocab[s] for s in symbols]
        self.rank = {vocab[a] * size + vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.joined = [vocab[a + b] for a, b in merges]
        self.piece_of: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.piece_of[i] = bytes(back[ord(c)] for c in text) if all(ord(c) in back for c in text) else text.encode()
        for text, i in special.items():
            self.piece_of[i] = text.encode()
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.split_any = regex.compile(PIECE).findall
        self.split_latin = re.compile(latin_piece()).findall
        self.young: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {}

    def split(self, text: str) -> list[str]:
        """The pieces of a text; the standard library's engine is faster where it suffices."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    @classmethod
    def from_json(cls, text: str) -> ByteBpe:
        """From the JSON of a byte-level BPE tokenizer; its truncation and padding are not used."""
        tokenizer = json.loads(text)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in tokenizer["model"]["merges"]]
        return cls(tokenizer["model"]["vocab"], merges, {t["content"]: t["id"] for t in tokenizer["added_tokens"]})

    def encode_piece(self, data: bytes) -> list[int]:
        symbols = [self.first[b] for b in data]
        n = len(symbols)
        if n < 2:
            return symbols
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank_of, size, joined = self.rank.get, self.size, self.joined
        # ranks[i]: rank of the merge of the symbol at i with its successor, -1 if there is none
        ranks = [rank_of(a * size + b, -1) for a, b in pairwise(symbols)]
        ranks.append(-1)
        queue = [r * n + at for at, r in enumerate(ranks) if r >= 0]
        heapq.heapify(queue)
        while queue:
            rank, at = divmod(heapq.heappop(queue), n)
            if ranks[at] != rank:
                continue  # stale: one of the two symbols has been merged since
            gone = after[at]
            symbols[at], ranks[gone] = joined[rank], -1
            after[at] = nxt = after[gone]
            if nxt >= 0:
                before[nxt] = at
                ranks[at] = r = rank_of(symbols[at] * size + symbols[nxt], -1)
                if r >= 0:
                    heapq.heappush(queue, r * n + at)
            else:
                ranks[at] = -1
            prev = before[at]
            if prev >= 0:
                ranks[prev] = r = rank_of(symbols[prev] * size + symbols[at], -1)
                if r >= 0:
                    heapq.heappush(queue, r * n + prev)
        out, at = [], 0
        while at >= 0:
            out.append(symbols[at])
            at = after[at]
        return out

    def pieces(self, text: str) -> Iterator[list[int]]:
        """Ids of one piece after another."""
        for k, part in enumerate(self.cut(text) if self.cut else [text]):
            if k % 2:
                yield [self.special[part]]
            else:
                for piece in self.split(part):
                    yield self.encode_piece(piece.encode())

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.pieces(text or "") for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.piece_of.__getitem__, ids)).decode("utf-8", "replace")

    def _remember(self, piece: str) -> tuple[str, int, bytes]:
        found = self.old.get(piece)
        if found is None:
            ids = self.encode_piece(piece.encode())
            found = (",".join(map(str, ids)), len(ids), b"".join(map(self.piece_of.__getitem__, ids)))
        if len(piece) <= CACHE_CHARS:
            if len(self.young) >= CACHE_PIECES:
                self.young, self.old = {}, self.young
            self.young[piece] = found
        return found

    def round_trip(self, text: str | None) -> tuple[int, str, bytes]:
        """Number of ids, the ids as comma-joined decimals, and the bytes that they decode to."""
        learn, found = self._remember, []
        for k, part in enumerate(self.cut(text or "") if self.cut else [text or ""]):
            if k % 2:
                found.append((str(self.special[part]), 1, self.piece_of[self.special[part]]))
            else:
                known = self.young
                for piece in self.split(part):
                    got = known.get(piece)
                    if got is None:
                        got = learn(piece)
                        known = self.young
                    found.append(got)
        if not found:
            return 0, "", b""
        ids, counts, data = zip(*found, strict=True)
        return sum(counts), ",".join(ids), b"".join(data)


_loaded: dict[str, ByteBpe] = {}


def _coder(shared: _Model) -> ByteBpe:
    if shared.id not in _loaded:  # a worker reads it once, not for each task
        _loaded.clear()
        _loaded[shared.id] = ByteBpe.from_json(shared.value)
    return _loaded[shared.id]


class _Model:
    """The vocabulary file as a broadcast value: its size is fixed, whatever the corpus."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            self.shared = spark.sparkContext.broadcast(f.read())
        self.id = uuid.uuid4().hex

    def __getstate__(self):
        return {"shared": self.shared, "id": self.id}

    @property
    def value(self) -> str:
        return self.shared.value


def encode_documents(docs: DataFrame, tokenizer_path: str, *, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text.

    With ``keep_ids`` the ids themselves, ``ids array<int>``, stand in the place of
    their digest. ``tokenizer_path`` is read by the driver and broadcast.
    """
    spark = docs.sparkSession
    common.ship(spark)
    model = _Model(spark, tokenizer_path)
    kind, name = (pa.list_(pa.int32()), "ids") if keep_ids else (pa.string(), "ids_sha256")

    def run(batches):
        coder = _coder(model)
        for batch in common.slices(batches, 64 if keep_ids else common.ROWS_AT_ONCE):
            counts, encoded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                n, ids, data = coder.round_trip(text)
                counts.append(n)
                encoded.append((np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32)) if keep_ids else hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(data.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, kind), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", name, "decoded_sha256"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id long, n_tokens long, {'ids array<int>' if keep_ids else 'ids_sha256 string'}, decoded_sha256 string")


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids decode to the empty text."""
    spark = encoded.sparkSession
    common.ship(spark)
    model = _Model(spark, tokenizer_path)

    def run(batches):
        coder = _coder(model)
        for batch in common.slices(batches):
            texts = [coder.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
