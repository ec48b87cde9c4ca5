import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from railloom.llm import ego_join, graph, topk
from railloom.workspace import Workspace

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rep int, cell string").repartition(5)


def vectors(n=700, d=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, d))
    m = centres[rng.integers(0, 25, n)] + rng.normal(size=(n, d)) * rng.choice([0.02, 0.25, 0.45, 1.5], n)[:, None]
    m[: n // 3] = m[0]  # a third are copies of one
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(int(i) * 7 % 5003, [float(x) for x in v]) for i, v in zip(rng.permutation(n), m.astype(np.float32))]
    rows += [(6000, None), (6001, [0.0] * d), (6002, [NAN] + [1.0] * (d - 1)), (6003, [None] + [1.0] * (d - 1)), (6004, [INF] * d), (6005, []), (6006, rows[5][1][:10]), (6050, rows[5][1][:10] + [0.0] * 3), (rows[3][0], rows[3][1]), (None, rows[3][1])]
    rows += [(7000, [x * 3 for x in rows[9][1]]), (7050, [1e-30] * d), (7100, [3e30] * d)]
    return rows


def usable(v, zero=True):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def padded(rows, zero=True):
    """By row number."""
    d = max(len(v) for _, v in rows if v)
    return {i: np.array([*v, *[0.0] * (d - len(v))], np.float32).astype(float) for i, (_, v) in enumerate(rows) if usable(v, zero)}


def brute_links(rows, threshold):
    good = padded(rows, zero=False)
    ids = sorted(good)
    m = np.array([good[i] / np.abs(good[i]).max() for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= threshold
    np.fill_diagonal(link, False)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(link)):
        x, y = find(ids[a]), find(ids[b])
        root[max(x, y)] = min(x, y)
    n = dict(zip(ids, link.sum(1).tolist()))
    smallest = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            smallest[find(i)] = min(vec_id, smallest.get(find(i), vec_id))
    out = [(vec_id, n.get(i, 0), smallest.get(find(i))) for i, (vec_id, _) in enumerate(rows)]
    return sorted(((*r, r[0] == r[2]) for r in out), key=str)


@pytest.mark.parametrize("block, threshold", [(16, 0.9), (1024, 0.9), (16, 0.99999), (64, 0.5)])
def test_links_match_brute_force(spark, monkeypatch, block, threshold):
    monkeypatch.setattr(ego_join, "BLOCK", block)
    monkeypatch.setattr(ego_join, "FAN", 4)
    monkeypatch.setattr(ego_join, "LEAF", 8)
    rows = vectors()
    got = ego_join.near_duplicates(table(spark, rows), Workspace(spark, "t1"), threshold)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=str) == brute_links(rows, threshold)


def test_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(ego_join, "BLOCK", 16)
    boxes = spark.createDataFrame([(i, [float(i)], [i + 0.5]) for i in range(40)], "block long, low array<double>, high array<double>")
    got = sorted(map(tuple, ego_join.interval_pairs(boxes, 40, 0.7, Workspace(spark, "t1")).collect()))
    assert got == [(i, j) for i in range(40) for j in range(i, min(40, i + 2))]


def clustered(n=4000, d=32, clusters=60):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(clusters, d)) / np.sqrt(np.arange(1, d + 1))
    m = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, d)) * 0.02
    return [(i, [float(x) for x in v]) for i, v in enumerate((m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32))]


def test_clustered_vectors_skip_blocks_and_leaves(spark, monkeypatch):
    monkeypatch.setattr(ego_join, "BLOCK", 64)
    seen = []
    real = ego_join.interval_pairs
    monkeypatch.setattr(ego_join, "interval_pairs", lambda boxes, n, eps, ws: seen.append((n, real(boxes, n, eps, ws))) or seen[-1][1])
    rows = clustered()
    got = ego_join.near_duplicates(table(spark, rows), Workspace(spark, "t1"), 0.98)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=str) == brute_links(rows, 0.98)
    n, pairs = seen[0]
    assert n >= 50 and pairs.count() < 0.5 * n * (n + 1) / 2
    # within two blocks, leaves that are far apart in dimensions that the boxes do not know are skipped too
    m = np.array([v for _, v in rows[:512]], float)
    m = m[np.argsort(m[:, 0])]
    blind = np.zeros((1, m.shape[1]))
    monkeypatch.setattr(ego_join, "LEAF", 4)
    near = ego_join.Bounds(m, blind).near(ego_join.Bounds(m, blind), 0.2)
    assert 0 < near.sum() < 0.9 * near.size
    link = m @ m.T >= 1 - 0.2**2 / 2
    assert (ego_join._linked(m, m, near, 1 - 0.2**2 / 2) == link).all()


def test_a_block_travels_once_for_each_band(spark, monkeypatch):
    monkeypatch.setattr(ego_join, "BAND", 4)
    monkeypatch.setattr(ego_join, "TILES", 0)
    blocks = spark.createDataFrame([(i, b"", b"", 1, "<f4", b"") for i in range(16)], "block long, ids binary, sizes binary, width int, kind string, cells binary")
    pairs = spark.createDataFrame([(i, j) for i in range(16) for j in range(i, 16)], "i long, j long")
    rows = ego_join._tiles(pairs, blocks, 16).collect()
    assert sum(r.j < 0 for r in rows) == 16 * 4 and sum(r.j >= 0 for r in rows) == 136


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 0.0])]])
def test_tiny_tables(spark, rows):
    got = ego_join.near_duplicates(table(spark, rows), Workspace(spark, "t1")).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [(1, 0, 1, True)] * len(rows)
    assert topk.top_k(table(spark, rows), Workspace(spark, "t7"), F.col("vec_id") >= 0).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 9), (9, 8), (3, 3)]
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "tg")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 560)}, 7: 7, 8: 7, 9: 7}


def brute_top(rows, k=5):
    whole = {i: [math.floor(256 * float(x)) for x in v] for i, v in padded(rows).items()}
    out = []
    for q in (i for i in whole if rows[i][0] is not None and rows[i][0] % 50 == 0):
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], whole[i])))), rows[i][0] is None, rows[i][0]) for i in whole if i != q)
        out += [(rows[q][0], r, i, -s) for r, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("q_block, c_block, slices", [(1024, 4096, 2), (3, 50, 2), (5, 64, 5), (2, 3, 1)])
def test_top_k_matches_brute_force(spark, monkeypatch, q_block, c_block, slices):
    monkeypatch.setattr(topk, "QUERY_BLOCK", q_block)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", c_block)
    monkeypatch.setattr(topk, "QUERY_BAND", 2 * q_block)
    rows = vectors(n=300)
    got = topk.top_k(table(spark, rows), Workspace(spark, "t7"), F.col("vec_id") % 50 == 0, slices=slices)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows)


def test_fewer_candidates_than_k(spark):
    got = topk.top_k(table(spark, [(0, [1.0, 0.5]), (1, [-1.0, 0.0]), (2, [1.0])]), Workspace(spark, "t7"), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2, 65536), (0, 2, 1, -65536)]
