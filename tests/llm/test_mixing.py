import re
from collections import defaultdict

import pytest

from railloom.llm import mixing
from railloom.workspace import Workspace

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_targets(sizes, weights, total, cap):
    """Water level by bisection, a plainer way to the same targets."""
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap * s, mid * w) for s, w in zip(sizes, weights)) < total else (low, mid)
    return [min(cap * s, low * w) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 50, 0, 7], [5], [0, 0], [100] * 20, [10**6, 1, 1, 1]])
def test_water_fill(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = mixing.water_fill(sizes, weights, 1.5 * sum(sizes), 2)
    assert got == pytest.approx(brute_targets(sizes, weights, 1.5 * sum(sizes), 2), rel=1e-9, abs=1e-6)
    assert sum(got) == pytest.approx(1.5 * sum(sizes))


def documents():
    rows = [(i, "w " * (i * 37 % 91), f"s{i % 4}") for i in range(400)]
    rows += [(1000 + i, "long " * 3000 if i == 0 else "mid " * 20, "hot") for i in range(300)]
    rows += [(5000 + i, "none of them", None) for i in range(9)]
    rows += [(7000, None, "s1"), (7001, "", "s1"), (7002, "\x0b \x1c a b", "s2"), (7003, None, "empty"), (8000, "same twice", "s3"), (8000, "same twice", "s3"), (None, "a b c", "s3")]
    return rows


def test_mix_meets_targets(spark):
    rows = [(*r, 1.5) for r in documents()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    run = lambda parts: mixing.mix(docs.repartition(parts), Workspace(spark, "t3"), lambda i: (5, 2, 1)[i % 3]).collect()
    got = run(3)
    size_of = lambda t: len(WORD.findall(t or ""))
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += size_of(text)
        largest[source] = max(largest[source], size_of(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, brute_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2)))
    by_doc = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size_of(t)) for i, t, *_ in rows)
    for r in got:
        source = by_doc[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source], abs=1e-4)
        assert 0 <= r.repeats <= 2 and r.taken == r.size * r.repeats
        taken[source] += r.taken
    for source in order:
        assert abs(taken[source] - target[source]) <= max(2, 0.02 * target[source]), source
    key = lambda r: (str(r.doc_id), r.taken)
    assert sorted(map(key, run(7))) == sorted(map(key, got))


def test_empty_table_and_all_empty_texts(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema), Workspace(spark, "t3"), lambda i: 1).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema), Workspace(spark, "t3"), lambda i: 1).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_kept_columns_ride_along(spark):
    docs = spark.createDataFrame(documents()[:50], "doc_id long, text string, source string")
    got = mixing.mix(docs, Workspace(spark, "t3"), lambda i: 1, keep=("text", "source")).collect()
    assert sorted((r.doc_id, r.text, r.source) for r in got) == sorted(documents()[:50])


def test_columns_of_any_name_pass_by(spark):
    names = ["goal", "target", "bin", "place", "whole", "one", "try", "now", "rounds", "source_size", "size", "repeats", "taken", "__source", "__id", "a.b"]
    docs = spark.createDataFrame([(*r, *range(i, i + len(names))) for i, r in enumerate(documents()[:60])], ["doc_id", "text", "source", *names])
    got = mixing.repeated(docs, Workspace(spark, "t3"), lambda i: 1)
    assert got.columns == docs.columns
    rows = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in got.collect()} <= rows
    decided = mixing.mix(docs, Workspace(spark, "t3"), lambda i: 1, keep=docs.columns).collect()
    assert len(decided) == 60 and sum(r.repeats for r in decided) == got.count() and all(r.goal == r.bin - 2 for r in decided)


def test_many_sources_meet_by_merging(spark, monkeypatch):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, source string")
    run = lambda: sorted((str(r.doc_id), r.taken) for r in mixing.mix(docs, Workspace(spark, "t3"), lambda i: (5, 2, 1)[i % 3]).collect())
    few = run()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(mixing, "BIN_ROWS", 1)
    assert run() == few
