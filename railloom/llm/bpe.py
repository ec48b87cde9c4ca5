"""Byte-level BPE encoding and decoding by two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token in one probe.
Tier two: a pre-token that is no vocabulary entry is merged, lowest rank first, with a heap over
its linked bytes.

Null and empty texts encode to no ids and decode to no bytes. Repeated rows give repeated results.
Texts of any length are taken whole. A column of the input that clashes with an output name is
replaced by the output.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from railloom.llm.common import arrow_map, text_groups, whole_text
from railloom.llm.pieces import PATTERN, splitter

#: Pieces that a worker remembers before it starts afresh: about 100 MB.
MEMO_PIECES = 400_000
_MASK = (1 << 64) - 1


def _slot(h: int, seed: int, n: int) -> int:
    x = (h ^ (seed * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
    return (x >> 32) % n


class PerfectHash:
    """Minimal perfect hash from n byte strings to 0..n-1, by hash and displace.

    Buckets of several keys search a seed that sends all of them to free slots, largest bucket
    first; a bucket of one key is sent to a free slot outright, written as a negative seed.
    """

    def __init__(self, keys: Iterable[bytes]):
        keys = list(keys)
        self.n = n = len(keys)
        self.buckets = max(1, n // 4)
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            groups[h % self.buckets].append((h, key))
        self.seeds = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        order = sorted((b for b in range(self.buckets) if groups[b]), key=lambda b: -len(groups[b]))
        singles = len(order)
        for at, b in enumerate(order):
            if len(groups[b]) == 1:
                singles = at
                break
            seed = 0
            while True:
                seed += 1
                slots = [_slot(h, seed, n) for h, _ in groups[b]]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                if seed > 1 << 24:
                    raise ValueError("the keys hold a repeated entry")
            self.seeds[b] = seed
            for s, (_, key) in zip(slots, groups[b], strict=True):
                self.keys[s] = key
        free = (s for s in range(n) if self.keys[s] is None)
        for b in order[singles:]:
            s = next(free)
            self.seeds[b] = -s - 1
            self.keys[s] = groups[b][0][1]

    def find(self, key: bytes) -> int:
        """The slot of ``key``, or -1 if it is no key."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.buckets]
        s = -seed - 1 if seed < 0 else _slot(h, seed, self.n)
        return s if self.keys[s] == key else -1


class BytePairCodec:
    """Encoder and decoder of one vocabulary of byte strings with ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pattern = pattern
        self.hash = PerfectHash(ranks)
        self.ids = [ranks[key] for key in self.hash.keys]
        self.words: dict[int, bytes] = {i: key for key, i in ranks.items()}
        self._ready()

    @classmethod
    def from_file(cls, path: str, pattern: str = PATTERN) -> BytePairCodec:
        """A codec from lines of a base64 token and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}, pattern)

    def _ready(self) -> None:
        self.split = splitter(self.pattern)
        self.bytes = [self.rank(bytes([b])) for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        self.memo = _Memo(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "bytes", "pairs", "memo")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def rank(self, piece: bytes) -> int:
        """The id of a vocabulary entry, -1 if it is none."""
        s = self.hash.find(piece)
        return self.ids[s] if s >= 0 else -1

    def piece_ids(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.rank(piece)
        return [whole] if whole >= 0 else self._merge(piece)

    def _pair(self, left: int, right: int) -> int:
        found = self.pairs.get((left, right))
        if found is None:
            found = self.rank(self.words[left] + self.words[right])
            if len(self.pairs) > MEMO_PIECES:
                self.pairs.clear()
            self.pairs[left, right] = found
        return found

    def _merge(self, piece: bytes) -> list[int]:
        ids = [self.bytes[b] for b in piece]
        n = len(ids)
        if n > 1 and min(ids) < 0:
            raise ValueError("the vocabulary lacks a single byte")
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self._pair
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(ids[i], ids[i + 1])) >= 0]
        heapify(heap)
        while heap:
            r, i, left, right = heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has merged with another since
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := pair(r, ids[k])) >= 0:
                    heappush(heap, (x, i, r, ids[k]))
            if (h := before[i]) >= 0 and (x := pair(ids[h], r)) >= 0:
                heappush(heap, (x, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids, as ``encode`` gives them, stand for."""
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Memo(dict):
    """Packed ids by piece, found on first use; emptied when full, so that memory stays bounded."""

    def __init__(self, codec: BytePairCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_PIECES:
            self.clear()
        made = np.array(self.codec.piece_ids(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = made
        return made


def _over_texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, list[str]]]:
    texts = batch.column(batch.schema.get_field_index(name)).to_pylist()
    for start, end in text_groups(texts, 4 << 20):
        yield start, end, texts[start:end]


def encode_documents(docs: DataFrame, codec: BytePairCodec, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Replace the text column by ``out_col``: the ids as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    keep = [c for c in docs.columns if c not in (text_col, out_col)]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{out_col}` binary"])

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for start, end, texts in _over_texts(batch, text_col):
            part = batch.slice(start, end - start)
            yield {c: part.column(i) for i, c in enumerate(keep)} | {out_col: [shared.value.encode(t) for t in texts]}

    return arrow_map(docs.select(*(f"`{c}`" for c in keep), whole_text(text_col).alias(text_col)), schema, work)


def decode_documents(encoded: DataFrame, codec: BytePairCodec, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Replace ids, as ``encode_documents`` writes them, by text; bytes that are no UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec)
    keep = [c for c in encoded.columns if c not in (ids_col, out_col)]
    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep), f"`{out_col}` string"])

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
        yield {c: batch.column(i) for i, c in enumerate(keep)} | {out_col: [shared.value.decode(x or b"").decode("utf-8", "replace") for x in ids]}

    return arrow_map(encoded.select(*(f"`{c}`" for c in keep), f"`{ids_col}`"), schema, work)


def round_trip_digests(docs: DataFrame, codec: BytePairCodec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both.

    One row per input row: ``id_col``, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers) and decoded_sha256 (of the decoded bytes), in lowercase hex.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        both = shared.value
        for start, end, texts in _over_texts(batch, "__text"):
            rows = []
            for text in texts:
                ids = both.encode(text)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(both.decode(ids)).hexdigest()))
            n, ids_sha, decoded_sha = zip(*rows, strict=True)
            yield {id_col: batch.column(0).slice(start, end - start), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}

    return arrow_map(docs.select(f"`{id_col}`", whole_text(text_col).alias("__text")), schema, work)
