"""Embedding near-dedup by an epsilon grid order join.

Vectors of one direction within an angle of each other lie, as unit vectors, within epsilon =
sqrt(2 - 2 * threshold). They are sorted by the cells of an epsilon grid on their leading principal
directions, and the sorted sequence is cut into blocks. The join goes down a tree of sequence
intervals: two intervals whose boxes on those directions lie more than epsilon apart are skipped
whole, others are split, until blocks meet blocks. Within a pair of blocks it goes on down to leaves of
``LEAF`` vectors, which are skipped by their boxes or by the distance of their centres less their radii in
all dimensions. What is left is compared in double precision.

Blocks meet in tiles, a band of the sequence with a band of it, so that a block travels once for every
band that it meets something of and not once for every block. Where vectors are spread evenly over
many dimensions no bound can tell blocks apart, and all of them meet; clustered ones mostly do not.

Exact copies collapse into one representative first and count by their number; copies are never
expanded into pairs. A tile reports, per representative, the number of linked vectors and one tree of
links within each pair of blocks, so that neither degrees nor components lose a link.

Every row is a vector of its own, whatever its id; a null id is no component's smallest. Vectors that
are null, empty, zero or hold null or non-finite components link with nothing and are returned as
their own component. Shorter vectors end in zeros. An empty table gives no rows. Other columns are left
out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railloom.llm.common import arrow_schema, join_with_hot, to_batch
from railloom.llm.graph import connected_components
from railloom.llm.vectors import finite, matrix, numbered, pack, unpack
from railloom.workspace import Workspace

#: Vectors in a block and in a leaf, and children of an interval.
BLOCK, LEAF, FAN = 1024, 64, 8
#: Blocks of a band at most; and tiles for each core that the cluster has, if there are blocks enough.
BAND, TILES = 32, 3
#: Principal directions of the grid, and the vectors that they are fitted to. They steer the order only.
DIRECTIONS, FIT_ROWS = 8, 4096
#: Room for rounding when boxes are compared.
SLACK = 1e-6
_SEQUENCE = "part int, number int, ids binary, sizes binary, width int, kind string, cells binary, low array<double>, high array<double>"
_FOUND = "rep long, linked long, root long"


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither huge nor tiny components overflow."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _directions(reps: DataFrame) -> np.ndarray:
    """Leading principal directions of a bounded sample, the vectors of the smallest hashes."""
    sample = reps.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(FIT_ROWS).select("vector").toArrow()
    if not sample.num_rows:
        return np.zeros((0, 1))
    unit = _unit(matrix(sample.column(0).combine_chunks()))
    _, _, directions = np.linalg.svd(unit - unit.mean(axis=0), full_matrices=False)
    return directions[:DIRECTIONS]


def _project(unit: np.ndarray, directions: np.ndarray) -> np.ndarray:
    width = min(unit.shape[1], directions.shape[1])
    return unit[:, :width] @ directions[:, :width].T


def _with_cells(reps: DataFrame, directions: np.ndarray, eps: float) -> DataFrame:
    """Add ``cell``: the grid cell on the principal directions."""
    schema = arrow_schema("rep long, size long, vector array<double>, cell array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.floor(_project(_unit(matrix(batch.column(2))), directions) / eps).astype(np.int32)
                yield to_batch({"rep": batch.column(0), "size": batch.column(1), "vector": batch.column(2), "cell": list(cells)}, schema)

    return reps.select("rep", "size", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "rep long, size long, vector array<double>, cell array<int>")


def _blocks(ordered: DataFrame, directions: np.ndarray) -> DataFrame:
    """Consecutive rows of each partition as blocks with the box of their projections."""
    schema = arrow_schema(_SEQUENCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def cut() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            raw = matrix(table.column("vector").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64())))
            seen = _project(_unit(raw), directions)
            number += 1
            kind, cells = pack(raw)
            return to_batch({
                "part": [part], "number": [number - 1], "ids": [table.column("rep").to_numpy().astype("<i8").tobytes()], "sizes": [table.column("size").to_numpy().astype("<i8").tobytes()],
                "width": [raw.shape[1]], "kind": [kind], "cells": [cells], "low": [seen.min(axis=0)], "high": [seen.max(axis=0)],
            }, schema)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                room = BLOCK - sum(b.num_rows for b in held)
                held.append(batch.slice(at, room))
                at += room
                if sum(b.num_rows for b in held) >= BLOCK:
                    yield cut()
        if held:
            yield cut()

    return ordered.mapInArrow(run, _SEQUENCE)


def _numbered(blocks: DataFrame) -> DataFrame:
    """Add ``block``: the place in the whole sequence. A row per partition comes to the driver."""
    counts = blocks.groupBy("part").count().orderBy("part").collect()
    firsts, at = [], 0
    for part, n in counts:
        firsts.append((part, at))
        at += n
    firsts = blocks.sparkSession.createDataFrame(firsts, "part int, first long")
    return blocks.join(F.broadcast(firsts), "part").withColumn("block", F.col("first") + F.col("number")).drop("first")


def _apart(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    """Squared distance of two boxes."""
    gaps = F.zip_with(
        F.zip_with(F.col(low_a), F.col(high_b), lambda x, y: x - y), F.zip_with(F.col(low_b), F.col(high_a), lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)


def interval_pairs(boxes: DataFrame, n_blocks: int, eps: float, workspace: Workspace) -> DataFrame:
    """(i, j) with i <= j: the blocks that the recursive interval join lets meet.

    ``boxes`` has block, low and high. Level by level, a pair of intervals becomes the pairs of
    their children; pairs whose boxes are farther apart than ``eps`` go no further.
    """
    depth = max(0, math.ceil(math.log(max(n_blocks, 1), FAN) - 1e-9))
    levels = [boxes.select(F.col("block").alias("node"), "low", "high")]
    n_dims = len(boxes.select("low").first()[0]) if n_blocks else 0
    for _ in range(depth):
        up = levels[-1].groupBy(F.expr(f"node div {FAN}").alias("node")).agg(
            F.array(*(F.min(F.col("low")[d]) for d in range(n_dims))).alias("low"), F.array(*(F.max(F.col("high")[d]) for d in range(n_dims))).alias("high")
        )
        levels.append(up)
    pairs = boxes.sparkSession.createDataFrame([(0, 0)] if n_blocks else [], "i long, j long")
    for level in range(depth - 1, -1, -1):
        child = F.sequence(F.lit(0), F.lit(FAN - 1))
        split = pairs.select(F.col("i"), F.col("j"), F.explode(child).alias("x")).select((F.col("i") * FAN + F.col("x")).alias("i"), "j", F.explode(child).alias("y"))
        split = split.select("i", (F.col("j") * FAN + F.col("y")).alias("j")).where(F.col("i") <= F.col("j"))
        a = levels[level].select(F.col("node").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"))
        b = levels[level].select(F.col("node").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
        near = split.join(a, "i").join(b, "j").where(_apart("low_i", "high_i", "low_j", "high_j") <= (eps + SLACK) ** 2)
        pairs = workspace.table(near.select("i", "j"), f"interval_pairs_{level}")
    return pairs


class Bounds:
    """Leaves of a block of unit vectors: the box of each on the directions, its centre and its radius."""

    def __init__(self, unit: np.ndarray, directions: np.ndarray):
        self.starts = np.arange(0, len(unit), LEAF)
        sizes = np.diff(np.append(self.starts, len(unit)))
        seen = _project(unit, directions)
        self.low, self.high = np.minimum.reduceat(seen, self.starts), np.maximum.reduceat(seen, self.starts)
        self.centres = np.add.reduceat(unit, self.starts) / sizes[:, None]
        away = unit - np.repeat(self.centres, sizes, axis=0)
        self.radii = np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", away, away), self.starts))

    def near(self, other: Bounds, eps: float) -> np.ndarray:
        """Which leaves may hold vectors within ``eps`` of each other's."""
        width = min(self.centres.shape[1], other.centres.shape[1])
        a, b = self.centres, other.centres
        squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a[:, :width] @ b[:, :width].T
        gaps = np.maximum(0, np.maximum(self.low[:, None] - other.high[None], other.low[None] - self.high[:, None]))
        apart = np.sqrt(np.maximum(0, squares)) - self.radii[:, None] - other.radii[None, :]
        return (apart <= eps + SLACK) & ((gaps * gaps).sum(axis=2) <= (eps + SLACK) ** 2)


def _linked(a: np.ndarray, b: np.ndarray, near: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two blocks are linked; leaves that are not near are skipped."""
    width = max(a.shape[1], b.shape[1])
    pad = lambda m: m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
    a, b = pad(a), pad(b)
    if near.mean() > 0.25:  # one product of all is quicker than many of few, and the same
        return a @ b.T >= threshold
    out = np.zeros((len(a), len(b)), bool)
    for i in np.flatnonzero(near.any(axis=1)):
        rows = slice(i * LEAF, (i + 1) * LEAF)
        cols = np.flatnonzero(np.repeat(near[i], LEAF)[: len(b)])
        out[rows, cols] = a[rows] @ b[cols].T >= threshold
    return out


def _compare(ids_a, sizes_a, ids_b, sizes_b, linked: np.ndarray, same: bool) -> dict:
    """Links between two blocks: per representative the vectors linked, and a root that its links lead to."""
    if same:
        np.fill_diagonal(linked, False)
    rows, cols = linked.any(axis=1), linked.any(axis=0)
    if not rows.any():
        return {}
    linked = linked[rows][:, cols]
    ids_a, ids_b = ids_a[rows], ids_b[cols]
    count_a, count_b = linked @ sizes_b[cols], linked.T @ sizes_a[rows]
    # The smallest id in reach within this pair, by passing minima to and fro.
    far = np.iinfo(np.int64).max
    root_a, root_b = ids_a.copy(), ids_b.copy()
    while True:
        new_b = np.minimum(root_b, np.where(linked, root_a[:, None], far).min(axis=0))
        new_a = np.minimum(root_a, np.where(linked, new_b[None, :], far).min(axis=1))
        if (new_a == root_a).all() and (new_b == root_b).all():
            break
        root_a, root_b = new_a, new_b
    if same:  # every link stands in both halves; count one
        return {"rep": ids_a, "linked": count_a, "root": root_a}
    return {"rep": np.concatenate([ids_a, ids_b]), "linked": np.concatenate([count_a, count_b]), "root": np.concatenate([root_a, root_b])}


def _tiles(pairs: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Rows by tile: first the blocks that it needs, each once, then the pairs of them that meet."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    bands = max(-(-n_blocks // BAND), min(n_blocks, math.ceil(math.sqrt(2 * TILES * cores))), 1)
    width = max(1, -(-n_blocks // bands))
    tile = [F.expr(f"i div {width}").alias("ti"), F.expr(f"j div {width}").alias("tj")]
    met = pairs.select(*tile, "i", "j")
    needed = met.select("ti", "tj", F.explode(F.array("i", "j")).alias("block")).distinct()
    load = needed.join(blocks.select("block", "ids", "sizes", "width", "kind", "cells"), "block").withColumn("j", F.lit(-1).cast("long")).withColumnRenamed("block", "i")
    rows = load.unionByName(met, allowMissingColumns=True)
    number = bands * (bands + 1) // 2
    return rows.repartition(number, "ti", "tj").sortWithinPartitions("ti", "tj", "j", "i").select("ti", "tj", "i", "j", "ids", "sizes", "width", "kind", "cells")


def _join_tiles(tiles: DataFrame, directions: np.ndarray, eps: float, threshold: float) -> DataFrame:
    schema = arrow_schema(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for at in range(batch.num_rows):  # a block at a time, not a batch of them
                r = batch.slice(at, 1).to_pylist()[0]
                if (r["ti"], r["tj"]) != now:
                    now, held = (r["ti"], r["tj"]), {}
                if r["j"] < 0:
                    unit = _unit(unpack(r["kind"], r["width"], r["cells"]))
                    held[r["i"]] = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["sizes"], "<i8"), unit, Bounds(unit, directions)
                    continue
                (ids_a, sizes_a, a, near_a), (ids_b, sizes_b, b, near_b) = held[r["i"]], held[r["j"]]
                near = near_a.near(near_b, eps)
                if near.any() and (found := _compare(ids_a, sizes_a, ids_b, sizes_b, _linked(a, b, near, threshold), r["i"] == r["j"])):
                    yield to_batch(found, schema)

    return tiles.mapInArrow(run, _FOUND)


def near_duplicates(table: DataFrame, workspace: Workspace, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    n_links counts the other vectors with a cosine of at least ``threshold``; component_id is the
    smallest id that links reach; kept tells whether that is the vector's own.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    vectors = numbered(table, id_col, vector_col, workspace)
    usable = finite() & F.exists("vector", lambda x: x != 0)
    # two hashes stand for a vector where its copies meet, so that no long array is sorted
    good = vectors.where(usable).withColumn("key", F.struct(F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")))
    copies = good.groupBy("key").agg(F.min("row").alias("rep"), F.count("*").alias("size"), F.min_by("vector", "row").alias("vector"))
    reps = workspace.table(copies, "reps")
    directions = _directions(reps)
    celled = workspace.table(_with_cells(reps, directions, eps if eps > 0 else SLACK), "celled")
    ordered = celled.repartitionByRange("cell", "rep").sortWithinPartitions("cell", "rep").select("rep", "size", "vector")
    blocks = _numbered(workspace.table(_blocks(ordered, directions), "blocks"))
    n_blocks = blocks.count()
    pairs = interval_pairs(blocks.select("block", "low", "high"), n_blocks, eps, workspace)
    found = workspace.table(_join_tiles(_tiles(pairs, blocks, n_blocks), directions, eps, threshold), "found")

    linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), workspace).withColumnRenamed("node", "rep")
    classes = reps.select("key", "rep", "size").join(linked, "rep", "left").join(components, "rep", "left")
    classes = classes.select("key", "size", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    members = join_with_hot(good.select("row", "vec_id", "key"), workspace.table(classes, "classes"), "key", "size")
    members = workspace.table(members.select("vec_id", "n_links", "component"), "members")
    smallest = workspace.table(members.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("n")), "smallest")
    joined = join_with_hot(members, smallest, "component", "n").select("vec_id", "n_links", "component_id")
    alone = vectors.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
