"""Exact top-k search by a three-phase uniform threshold.

The dimensions are cut into slices; a slice's inner product is a vector's local score, and the score
is the sum over slices. Queries and candidates meet in tiles, a band of queries with a part of the
candidates, so that a candidate travels once for every band and a query once for every part.

1. Each tile gives, per query and slice, the k best local scores; their vectors, scored in full, are
   the first candidates. The k-th best score of a query is a safe cutoff.
2. The cutoff over the number of slices goes back to every tile: a vector whose score reaches the
   cutoff has at least one local score that reaches its even share. Only such entries are taken up.
3. Entries whose slices are not all known are scored exactly, and the k best of each query stay.

Components become floor(scale * x) as integers, so scores are exact. Products beyond 2^53 are
computed in integers without bound and saturate at the ends of a long.

Every row is a vector of its own, whatever its id: rows that share an id are queries of their own
and candidates of each other. A null id is no query's and comes last in ties. Vectors that are null,
empty, or hold null or non-finite components take no part; a zero vector does. Shorter vectors end in
zeros. Ties go to the smaller id. Queries without candidates have no row, nor has an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railloom.llm.common import arrow_schema, to_batch
from railloom.llm.vectors import finite, matrix, numbered, pack, same_width, unpack
from railloom.workspace import Workspace

#: Queries of a band and of a block, and candidates of a block.
QUERY_BAND, QUERY_BLOCK, CANDIDATE_BLOCK = 16384, 1024, 4096
#: Tiles for each core that the cluster has, if there are candidates enough.
TILES = 3
#: Below this size of a component, sums of up to 4096 products are exact in double precision.
EXACT = float(1 << 20)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_BLOCK = "band int, part int, side int, rows binary, ids binary, width int, kind string, cells binary, tau binary"
_HITS = "query_row long, query_id long, row long, vec_id long, score long"
#: Stands for a null id within blocks.
_NO_ID = _HIGH


def _blocks(rows: DataFrame, side: int, size: int, scale: float) -> DataFrame:
    """Rows (band, part, row, vec_id, vector, s) in blocks of up to ``size`` of one band and part, vectors as integers."""
    schema = arrow_schema(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def cut() -> pa.RecordBatch:
            width = max(h[2].shape[1] for h in held)
            cells = np.concatenate([np.pad(h[2], ((0, 0), (0, width - h[2].shape[1]))) for h in held])
            kind, packed = pack(cells)
            own = [np.concatenate([h[i] for h in held]) for i in (0, 1, 3)]
            held.clear()
            return to_batch({"band": [now[0]], "part": [now[1]], "side": [side], "rows": [own[0].tobytes()], "ids": [own[1].tobytes()], "width": [width], "kind": [kind], "cells": [packed], "tau": [own[2].tobytes()]}, schema)

        for batch in batches:
            band, part, row = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            ids = batch.column(3).fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            cells = np.floor(scale * matrix(batch.column(4)))
            tau = np.array([-np.inf if x is None else _below(x) for x in batch.column(5).to_pylist()])
            place = band * (1 << 31) + part
            edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(row)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b and held and now != (int(band[a]), int(part[a])):
                    yield cut()
                while a < b:
                    now = int(band[a]), int(part[a])
                    room = min(b - a, size - sum(len(h[0]) for h in held))
                    held.append((row[a : a + room], ids[a : a + room], cells[a : a + room], tau[a : a + room]))
                    a += room
                    if sum(len(h[0]) for h in held) >= size:
                        yield cut()
        if held:
            yield cut()

    return rows.select("band", "part", "row", "vec_id", "vector", "s").mapInArrow(run, _BLOCK)


def _below(x: int) -> float:
    """The double nearest to an integer, the next one down if doubles cannot hold it."""
    return float(x) if abs(x) < 1 << 53 else float(np.nextafter(float(x), -np.inf))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of integer rows, exactly."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < EXACT and a.shape[1] <= 4096:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, _LOW, _HIGH)


def _score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows side by side, exactly."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < EXACT and a.shape[1] <= 4096:
        return np.einsum("ij,ij->i", a, b)
    return np.array([int(_products(x[None], y[None])[0, 0]) for x, y in zip(a, b, strict=True)], np.int64)


def _cut(width: int, slices: int) -> list[slice]:
    edges = np.linspace(0, width, slices + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


class _Queries:
    """A block of queries, and the k best (score, id, row) of each so far, ties to smaller ids."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, cells: np.ndarray, tau: np.ndarray, k: int):
        self.rows, self.ids, self.cells, self.tau, self.k = rows, ids, cells, tau, k
        self.q, self.v, self.r, self.s = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, q: np.ndarray, v: np.ndarray, r: np.ndarray, s: np.ndarray) -> None:
        """Entries of queries q: candidate ids v, rows r and scores s."""
        q, v, r, s = (np.concatenate([old, new.astype(np.int64)]) for old, new in ((self.q, q), (self.v, v), (self.r, r), (self.s, s)))
        order = np.lexsort((r, v, ~s, q))  # ~s falls as s rises, without overflow
        q, v, r, s = q[order], v[order], r[order], s[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])
        q, v, r, s = q[fresh], v[fresh], r[fresh], s[fresh]
        stay = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.q, self.v, self.r, self.s = q[stay], v[stay], r[stay], s[stay]

    def found(self) -> dict:
        return {"query_row": self.rows[self.q], "query_id": self.ids[self.q], "row": self.r, "vec_id": pa.array(self.v, mask=self.v == _NO_ID), "score": self.s}


def _first_lists(own: _Queries, rows: np.ndarray, ids: np.ndarray, others: np.ndarray, slices: int) -> None:
    """Phase 1: per query and slice the k best local scores of a block, scored in full."""
    cells, others = same_width(own.cells, others)
    n = others.shape[0]
    most = min(n, own.k + 1)  # one of them may be the query itself
    q = np.repeat(np.arange(len(own.rows)), most)
    for part in _cut(cells.shape[1], slices):
        local = _products(cells[:, part], others[:, part])
        near = np.argpartition(-local, most - 1, axis=1)[:, :most] if most < n and local.dtype != object else np.argsort(-local, axis=1, kind="stable")[:, :most]
        c = near.ravel()
        good = rows[c] != own.rows[q]
        own.add(q[good], ids[c[good]], rows[c[good]], _score(cells[q[good]], others[c[good]]))


def _resolve(own: _Queries, rows: np.ndarray, ids: np.ndarray, others: np.ndarray, slices: int) -> None:
    """Phases 2 and 3: entries with a local score at an even share of the cutoff, scored exactly."""
    cells, others = same_width(own.cells, others)
    parts = _cut(cells.shape[1], slices)
    share = (own.tau / len(parts))[:, None]
    taken = np.zeros((len(cells), len(rows)), bool)
    for part in parts:
        taken |= (_products(cells[:, part], others[:, part]) >= share).astype(bool)
    taken &= rows[None, :] != own.rows[:, None]
    q, c = np.nonzero(taken)
    for i in range(0, len(q), 1 << 16):
        a, b = q[i : i + (1 << 16)], c[i : i + (1 << 16)]
        score = _score(cells[a], others[b])
        hit = score >= own.tau[a]
        own.add(a[hit], ids[b[hit]], rows[b[hit]], score[hit])


def _over_tiles(tiles: DataFrame, step, k: int, slices: int) -> DataFrame:
    """Run a phase over tiles, whose queries come first; k rows per query and tile at most."""
    schema = arrow_schema(_HITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):  # a block at a time, not a batch of them
                r = batch.slice(at, 1).to_pylist()[0]
                if (r["band"], r["part"]) != now:
                    for own in held:
                        yield to_batch(own.found(), schema)
                    now, held = (r["band"], r["part"]), []
                rows, ids, cells = np.frombuffer(r["rows"], "<i8"), np.frombuffer(r["ids"], "<i8"), unpack(r["kind"], r["width"], r["cells"])
                if r["side"] == 0:
                    held.append(_Queries(rows, ids, cells, np.frombuffer(r["tau"], np.float64), k))
                    continue
                for own in held:
                    step(own, rows, ids, cells, slices)
        for own in held:
            yield to_batch(own.found(), schema)

    return tiles.mapInArrow(run, _HITS)


def _best_of(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row"))
    return hits.dropDuplicates(["query_row", "row"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(table: DataFrame, workspace: Workspace, is_query: Column, k: int = 5, scale: float = 256.0, slices: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best candidates of each query: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``vec_id``; every other row is a candidate of a query. The queries
    are a stated set: bands of queries meet parts of the candidates, not rows meet rows.
    """
    rows = workspace.table(numbered(table, id_col, vector_col, workspace).where(finite()), "usable")
    queries, total = rows.where(F.coalesce(is_query, F.lit(False))), rows.count()
    bands = max(1, -(-queries.count() // QUERY_BAND))
    cores = table.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-TILES * cores // bands), -(-total // CANDIDATE_BLOCK)))
    placed = lambda df, column, number: df.withColumn(column, F.pmod(F.xxhash64("row"), F.lit(number)).cast("int")).repartition(number, column).sortWithinPartitions(column)
    none, nothing = F.lit(0), F.lit(None).cast("long")
    dealt = placed(rows, "part", parts).withColumn("band", none).withColumn("s", nothing)
    candidates = workspace.table(_blocks(dealt, 1, CANDIDATE_BLOCK, scale), "candidates")
    spread = lambda df, column, number: df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(number - 1))))

    def tiles(with_cutoff: DataFrame, name: str) -> DataFrame:
        own = placed(with_cutoff, "band", bands).withColumn("part", none)
        own = workspace.table(_blocks(own, 0, QUERY_BLOCK, scale), name)
        met = spread(own, "part", parts).unionByName(spread(candidates, "band", bands))
        return met.repartition(bands * parts, "band", "part").sortWithinPartitions("band", "part", "side")

    first = _best_of(_over_tiles(tiles(queries.withColumn("s", nothing), "queries"), _first_lists, k, slices), k)
    cutoffs = first.groupBy("query_row").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k)
    cutoffs = workspace.table(cutoffs.select(F.col("query_row").alias("row"), "s"), "cutoffs")
    hits = _over_tiles(tiles(queries.join(cutoffs, "row", "left"), "queries_with_cutoff"), _resolve, k, slices)
    return _best_of(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
