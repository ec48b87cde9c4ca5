"""Token-id files of bit-plane shuffled chunks.

A written set of files holds, in ascending document order, chunks of a fixed number of ids. Within
a chunk the ids are transposed: plane p holds byte p (or bit p) of every id, so that the mostly
zero high planes and the skewed low ones compress apart. Each plane is one zstandard frame. The
chunk index stores for each chunk its shard, position, number of ids and the documents that begin
in it, so a reader seeks to any document without unpacking others.

A shard is one range of documents. Chunks are rows of Parquet files: Spark's writers commit them
whole or not at all, wherever the files live, and a lost executor only repeats its own shards.

Null and empty texts hold the end id alone. Documents of the same id stand side by side, ordered
by the hash of their text; a null id comes first. An empty table makes no chunk. Extra columns of
the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railloom.llm.common import arrow_map, arrow_schema, text_groups, to_batch, whole_text
from railloom.llm.pieces import PATTERN, splitter
from railloom.workspace import Workspace

CHUNK_IDS = 1 << 16
#: Distinct pieces that a worker remembers, about 150 MB; what comes later is asked for again.
MEMO_PIECES = 600_000
_HEAD = struct.Struct("<4sBBHI")
_MAGIC = b"RLBP"

CHUNK_SCHEMA = "shard int, chunk int, n_ids int, first_doc long, head_ids int, doc_ids array<long>, doc_starts array<int>, doc_tokens array<long>, payload binary"


def pack(ids: np.ndarray, bits: bool = False, level: int = 1) -> bytes:
    """One chunk: header, plane lengths, and each plane of the 32-bit ids as a zstandard frame."""
    ids = np.ascontiguousarray(ids, "<u4")
    octets = ids.view(np.uint8).reshape(-1, 4)
    planes = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1) if bits else octets.T
    squeeze = zstandard.ZstdCompressor(level=level)
    frames = [squeeze.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    return b"".join([_HEAD.pack(_MAGIC, 1, int(bits), len(frames), len(ids)), struct.pack(f"<{len(frames)}I", *map(len, frames)), *frames])


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a chunk."""
    magic, version, bits, n_planes, n = _HEAD.unpack_from(payload)
    if magic != _MAGIC or version != 1:
        raise ValueError("not a token chunk")
    sizes = struct.unpack_from(f"<{n_planes}I", payload, _HEAD.size)
    at, planes, expand = _HEAD.size + 4 * n_planes, [], zstandard.ZstdDecompressor()
    for size in sizes:
        planes.append(np.frombuffer(expand.decompress(payload[at : at + size]), np.uint8))
        at += size
    octets = np.empty((n, n_planes if not bits else 4), np.uint8)
    if bits:
        octets[:] = np.packbits(np.unpackbits(np.stack(planes), axis=1, count=n).T, axis=1, bitorder="little")
    else:
        for p, plane in enumerate(planes):
            octets[:, p] = plane
    return octets.view("<u4").reshape(-1)


class LibraryEncoder:
    """Whole texts to ids with a tokenizers JSON file.

    A byte-level tokenizer encodes each piece of its own pre-tokenizer's pattern on its own, so the
    library is asked once for each distinct piece and its answers are kept. Texts that name an
    added token, and tokenizers of any other kind, go to the library whole.
    """

    def __init__(self, spec: str):
        import json

        self.spec = spec
        told = json.loads(spec)
        self.added = [t["content"] for t in told.get("added_tokens") or []]
        pre, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
        self.by_piece = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not told.get("normalizer")
            and not told.get("truncation") and not told.get("padding") and model.get("type") == "BPE" and not model.get("dropout")
        )
        self._ready()

    def _ready(self) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(self.spec)
        self.split = splitter(PATTERN)
        self.memo: dict[str, bytes] = {}
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_id = line[0] if len(line) == 1 else None

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("spec", "added", "by_piece")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The library's ids of each piece. Pieces that hold no line feed are asked for many to a text, a line each.

        A line feed is a piece of its own between pieces that are no white space, so it ends every
        piece and parts the ids; where the parts do not come out right, pieces are asked for one by one.
        """
        out: list[bytes] = []
        for start in range(0, len(pieces), 2048):
            own = pieces[start : start + 2048]
            found = array("I", self.tokenizer.encode_batch_fast(["\n".join(own)], add_special_tokens=False)[0].ids)
            ids = np.frombuffer(found, np.uint32)
            ends = np.flatnonzero(ids == self.line_id)
            if len(ends) != len(own) - 1:
                out += self._library(own)
                continue
            raw, edges = found.tobytes(), (4 * ends).tolist()
            out += [raw[a:b] for a, b in zip([0, *(e + 4 for e in edges)], [*edges, len(raw)], strict=True)]
        return out

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        spaces = [p for p in new if p.isspace()]
        words = [p for p in new if not p.isspace()]
        found = dict(zip(words, self._pieces(words), strict=True)) if self.line_id is not None else dict(zip(words, self._library(words), strict=True))
        found.update(zip(spaces, self._library(spaces), strict=True))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.by_piece or any(a in t for a in self.added)]
        for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = ids
        rest = [i for i in range(len(texts)) if out[i] is None]
        for start, end in text_groups([texts[i] for i in rest], 1 << 14):
            pieces = [self.split(texts[i]) for i in rest[start:end]]
            parts = [list(map(self.memo.get, own)) for own in pieces]
            holes = [[at for at, ids in enumerate(own) if ids is None] for own in parts]
            found = self._learn({own[at] for own, ats in zip(pieces, holes, strict=True) for at in ats})
            self.memo.update(found)
            for i, own, ids, ats in zip(rest[start:end], pieces, parts, holes, strict=True):
                for at in ats:
                    ids[at] = found[own[at]]
                out[i] = b"".join(ids)
            if len(self.memo) > MEMO_PIECES:  # what came first stays, the common pieces among it
                for p in found:
                    del self.memo[p]
        return out


def write_chunks(
    docs: DataFrame, encode: Callable[[list[str]], list[bytes]], workspace: Workspace, end_id: int, name: str = "chunks",
    chunk_ids: int = CHUNK_IDS, bits: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode every document, append ``end_id`` to each, and write the chunks; returns the written table.

    ``encode`` turns texts into packed ids. The documents are dealt out by ranges of their id, so
    shards in ascending order are documents in ascending order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(encode)
    end = np.array([end_id], "<u4").tobytes()
    schema = arrow_schema(CHUNK_SCHEMA)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    texts = texts.withColumn("tie", F.xxhash64("text"))
    ordered = texts.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk, n_docs = TaskContext.get().partitionId(), 0, 0
        held = bytearray()  # ids not yet written; less than a chunk between documents
        head, first, ids, starts, tokens = 0, 0, [], [], []

        def cut(size: int) -> pa.RecordBatch:
            nonlocal chunk, head, first, ids, starts, tokens
            payload = pack(np.frombuffer(bytes(held[: 4 * size]), "<u4"), bits)
            row = {"shard": [shard], "chunk": [chunk], "n_ids": [size], "first_doc": [first], "head_ids": [head], "doc_ids": [ids], "doc_starts": [starts], "doc_tokens": [tokens], "payload": [payload]}
            del held[: 4 * size]
            chunk, first, ids, starts, tokens = chunk + 1, n_docs, [], [], []
            return to_batch(row, schema)

        for batch in batches:
            all_ids, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_groups(all_texts, 4 << 20):
                for doc_id, own in zip(all_ids[a:b], shared.value.encode(all_texts[a:b]), strict=True):
                    own += end
                    ids.append(doc_id)
                    starts.append(len(held) // 4)
                    tokens.append(len(own) // 4)
                    n_docs += 1
                    held += own
                    while len(held) >= 4 * chunk_ids:
                        yield cut(chunk_ids)
                        # what is held now all belongs to the last document
                        head = min(len(held) // 4, chunk_ids)
        if held:
            yield cut(len(held) // 4)

    # the planes are compressed already
    return workspace.table(ordered.mapInArrow(work, CHUNK_SCHEMA), name, "uncompressed")


def _layout(chunks: DataFrame) -> tuple[DataFrame, int]:
    """The first position of each shard, and the ids of a full chunk.

    One row for each shard comes to the driver, and shards are partitions of a write: their number
    is set by the cluster, not by the documents.
    """
    totals = chunks.groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")), F.max("n_ids")).orderBy("shard").collect()
    bases, at = [], 0
    for shard, n, _ in totals:
        bases.append((shard, at))
        at += n
    return chunks.sparkSession.createDataFrame(bases, "shard int, base long"), max((full for *_, full in totals), default=0)


def chunk_index(chunks: DataFrame) -> DataFrame:
    """The index of a written set of files: everything but the payload, and each chunk's first position."""
    bases, full = _layout(chunks)
    start = F.col("base") + F.col("chunk").cast("long") * full
    return chunks.drop("payload").join(F.broadcast(bases), "shard").withColumn("start", start).drop("base")


def write_index(chunks: DataFrame, workspace: Workspace, name: str = "chunk_index") -> DataFrame:
    """The chunk index as a table of its own beside the chunks."""
    return workspace.table(chunk_index(chunks), name)


def read_documents(chunks: DataFrame, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of the documents whose ids ``wanted`` (doc_id) holds: ids as little-endian unsigned 32-bit integers.

    The index says which chunks hold them; no other chunk is unpacked. Documents that share an id all
    come out; null ids are not found.
    """
    full = index.agg(F.max("n_ids")).first()[0] or 1
    entry = F.explode(F.arrays_zip("doc_ids", "doc_starts", "doc_tokens", F.sequence(F.lit(0), F.size("doc_ids") - 1).alias("nth")))
    begun = index.where(F.size("doc_ids") > 0).select("shard", "chunk", "first_doc", F.col("start").alias("base"), entry.alias("e"))
    begun = begun.select("shard", "chunk", (F.col("first_doc") + F.col("e.nth")).alias("doc"), "base", F.col("e.doc_ids").alias("doc_id"), F.col("e.doc_starts").alias("begin"), F.col("e.doc_tokens").alias("n"))
    found = begun.join(wanted.select("doc_id").distinct(), "doc_id")
    end = F.col("begin") + F.col("n")
    spans = found.select("*", F.explode(F.sequence(F.col("chunk").cast("long"), F.col("chunk") + F.expr(f"(begin + n - 1) div {full}"))).alias("at"))
    first = (F.col("at") - F.col("chunk")) * full
    spans = spans.select("shard", F.col("at").cast("int").alias("chunk"), "doc", "doc_id", (F.col("base") + F.col("begin")).alias("start"), F.greatest(F.col("begin").cast("long") - first, F.lit(0)).alias("from"), F.least(end - first, F.lit(full)).alias("to"))
    by_chunk = spans.groupBy("shard", "chunk").agg(F.collect_list(F.struct("doc", "doc_id", "start", "from", "to")).alias("spans"))

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        for row in batch.to_pylist():
            raw = memoryview(unpack(row["payload"])).cast("B")
            own = row["spans"]
            yield {
                "shard": [row["shard"]] * len(own), "chunk": [row["chunk"]] * len(own), "doc": [s["doc"] for s in own], "doc_id": [s["doc_id"] for s in own],
                "start": [s["start"] for s in own], "part": [bytes(raw[4 * s["from"] : 4 * s["to"]]) for s in own],
            }

    met = chunks.select("shard", "chunk", "payload").join(by_chunk, ["shard", "chunk"])
    parts = arrow_map(met, "shard int, chunk int, doc long, doc_id long, start long, part binary", cut)
    whole = parts.groupBy("shard", "doc").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("p"))
    joined = F.aggregate(F.col("p.part"), F.lit(b""), lambda a, b: F.concat(a, b))
    return whole.select("doc_id", "start", joined.alias("ids"))


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo CRC-32's, bits reversed."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        b = (b << 1) & 0xFFFFFFFF
        a = (a >> 1) ^ (_POLY if a & 1 else 0)
    return out


def crc32_join(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two byte strings one after the other, from their own."""
    power, square, n = 0x80000000, 0x00800000, second_bytes  # 1 and x^8
    while n:
        if n & 1:
            power = _times(square, power)
        square = _times(square, square)
        n >>= 1
    return _times(power, first) ^ second


def read_digests(chunks: DataFrame) -> DataFrame:
    """Read written files back: doc_id, start, n_tokens and ids_crc32 for each document.

    Chunks are read on their own, each by any task; checksums of a document's stretches in several
    chunks are joined afterwards.
    """

    def stretches(batch: pa.RecordBatch) -> Iterator[dict]:
        cols = {name: [] for name in ("shard", "doc", "chunk", "crc", "n", "doc_id", "start", "n_tokens")}
        for row in batch.to_pylist():
            raw = memoryview(unpack(row["payload"])).cast("B")
            spans = [(row["first_doc"] - 1, 0, row["head_ids"], None, None, None)] if row["head_ids"] else []
            edges = [*row["doc_starts"], row["n_ids"]]
            spans += [(row["first_doc"] + i, edges[i], edges[i + 1], row["doc_ids"][i], edges[i], row["doc_tokens"][i]) for i in range(len(row["doc_ids"]))]
            for doc, a, b, doc_id, start, tokens in spans:
                values = (row["shard"], doc, row["chunk"], zlib.crc32(raw[4 * a : 4 * b]), 4 * (b - a), doc_id, start, tokens)
                for name, v in zip(cols, values, strict=True):
                    cols[name].append(v)
        yield cols

    parts = arrow_map(chunks, "shard int, doc long, chunk int, crc long, n long, doc_id long, start int, n_tokens long", stretches)

    whole = parts.groupBy("shard", "doc").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "crc", "n"))).alias("s"),
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(F.col("n_tokens").isNotNull(), F.col("chunk"))).alias("chunk"),
        F.max("start").alias("start"),
        F.max("n_tokens").alias("n_tokens"),
    )
    bases, full = _layout(chunks)
    placed = whole.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("chunk").cast("long") * full + F.col("start")).alias("start"), "n_tokens", F.col("s.crc").alias("crcs"), F.col("s.n").alias("sizes")
    )

    def join(batch: pa.RecordBatch) -> Iterator[dict]:
        doc_id, start, tokens, crcs, sizes = batch.columns
        first = crcs.offsets.to_numpy()[:-1]
        count = crcs.value_lengths().to_numpy(zero_copy_only=False)
        flat, lengths = crcs.values.to_numpy(), sizes.values.to_numpy()
        out = flat[first].copy()
        for i in np.flatnonzero(count > 1):  # the few documents that several chunks share
            for at in range(first[i] + 1, first[i] + count[i]):
                out[i] = crc32_join(int(out[i]), int(flat[at]), int(lengths[at]))
        yield {"doc_id": doc_id, "start": start, "n_tokens": tokens, "ids_crc32": out}

    return arrow_map(placed, "doc_id long, start long, n_tokens long, ids_crc32 long", join)
