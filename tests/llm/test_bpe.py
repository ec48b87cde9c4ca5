import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from railloom.llm import bpe
from railloom.llm.pieces import PATTERN, splitter

NASTY = [None, "", " ", "\n\n  x", "a" * 5000, "  the the\tthe", "été naïve — 漢字 \U0001f600", "'s 's'll 12 ½ ́a\x1c\x85\xa0b", "x" * 3 + "\r\n" + "y" * 70]


@pytest.fixture(scope="module")
def codec():
    return bpe.BytePairCodec.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_public_one():
    assert PATTERN == public_tokenizers.PATTERN


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"k{i}".encode() for i in range(5000)]
    made = bpe.PerfectHash(keys)
    assert sorted(made.find(k) for k in keys) == list(range(5000))
    assert all(made.find(f"m{i}".encode()) == -1 for i in range(2000))
    assert bpe.PerfectHash([]).find(b"a") == -1
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"])


def test_same_ids_as_the_library(codec, library):
    random.seed(5)
    pool = [chr(c) for c in range(0x250)] + list(" \n\t漢字 　́\U0001f600") * 8
    texts = [t or "" for t in NASTY] + ["".join(random.choices(pool, k=random.randint(1, 30))) for _ in range(3000)]
    for text in texts:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_other_pattern_is_used_as_given():
    assert splitter(r"\S+|\s+")("ab  c") == ["ab", "  ", "c"]


def test_digests_and_round_trip_over_frames(spark, codec, library):
    rows = [(i, t, "x", 7) for i, t in enumerate(NASTY)] + [(1, "twice", "x", 7)] * 2 + [(None, "no id", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = bpe.round_trip_digests(docs, codec).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    back = bpe.decode_documents(bpe.encode_documents(docs, codec), codec)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t, *_ in rows)
    assert bpe.round_trip_digests(docs.limit(0), codec).collect() == []
