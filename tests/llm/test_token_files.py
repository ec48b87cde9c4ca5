import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from railloom.llm import token_files
from railloom.workspace import Workspace

TEXTS = [None, "", "a", "word " * 400, "été 漢字 \x1c\x85 x  \n\n y", "a <|endoftext|> b", "Thint er ththe. " * 90] + [f"Doc {i} has ereth {i * 7919} words" for i in range(40)]


@pytest.fixture(scope="module")
def spec():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(1).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    assert token_files.unpack(token_files.pack(ids, bits)).tolist() == ids.tolist()


def test_joined_checksums():
    a, b = b"one stretch" * 99, b"another" * 1234
    assert token_files.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_files.crc32_join(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


def test_pieces_give_the_library_ids(spec):
    library, own = Tokenizer.from_str(spec), token_files.LibraryEncoder(spec)
    texts = [t or "" for t in TEXTS]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("chunk_ids, bits", [(64, True), (1 << 16, False)])
def test_files_match_brute_force(spark, spec, chunk_ids, bits):
    library = Tokenizer.from_str(spec)
    rows = [((i * 31) % 101, t, "s") for i, t in enumerate(TEXTS)] + [(None, "nobody", "s"), (5000, "same", "s"), (5000, "same", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string").repartition(5)
    chunks = token_files.write_chunks(docs, token_files.LibraryEncoder(spec), Workspace(spark, "t5"), 2, chunk_ids=chunk_ids, bits=bits)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_digests(chunks).collect())
    want, at = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((at, doc_id, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    index = token_files.chunk_index(chunks).orderBy("start").collect()
    assert [r.start for r in index] == [sum(x.n_ids for x in index[:i]) for i in range(len(index))]

    # the stored index leads to single documents, in one chunk or several
    asked = [r[0] for r in rows[::3]] + [5000, 4711, None]
    stored = token_files.write_index(chunks, Workspace(spark, "t5"))
    read = token_files.read_documents(chunks, stored, spark.createDataFrame([(i,) for i in asked], "doc_id long")).collect()
    assert sorted((r.start, r.doc_id, len(r.ids) // 4, zlib.crc32(r.ids)) for r in read) == [w for w in want if w[1] in asked and w[1] is not None]


def test_empty_table(spark, spec):
    docs = spark.createDataFrame([], "doc_id long, text string")
    chunks = token_files.write_chunks(docs, token_files.LibraryEncoder(spec), Workspace(spark, "t5"), 2)
    assert chunks.count() == 0 and token_files.read_digests(chunks).collect() == []
