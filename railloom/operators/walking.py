"""Walking graphs: building, snapping stops to nodes, bounded walks, and transfers over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railloom.functions import columns as C
from railloom.operators import indexes as I
from railloom.operators.places import _around, _cells, nearest_one
from railloom.operators.search import shortest_paths
from railloom.workspace import Workspace

SNAP_CELL, RINGS, MOST_M, NEAR_K = 0.01, 3, 250.0, 4


def walk_edges(ways: DataFrame) -> DataFrame:
    """(src, dst, seconds): the shortest walk between neighbouring nodes, in both directions; ``ways``: a, b, meters."""
    seconds = F.greatest(F.lit(1), (F.col("meters") / C.WALK_SPEED).cast("bigint")).alias("seconds")
    there = ways.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), seconds)
    back = there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "seconds")
    return there.unionByName(back).groupBy("src", "dst").agg(F.min("seconds").alias("seconds"))


def snap(stops: DataFrame, nodes: DataFrame, workspace: Workspace, cell: float = SNAP_CELL, rings: int = RINGS) -> DataFrame:
    """(k, node): the nearest node in the first ring of cells around a stop that has any; beyond ``rings`` the nearest of all."""
    located = stops.where("lat IS NOT NULL AND lon IS NOT NULL")
    own = _cells(located.select("k", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), "p_lat", "p_lon", cell).withColumnsRenamed({"r": "own_r", "c": "own_c"})
    placed = _cells(nodes.select("node", "lat", "lon"), "lat", "lon", cell)
    # cells look for the first ring that has nodes, and stops meet those of that ring only
    around = _around(own.select("own_r", "own_c", F.col("own_r").alias("r"), F.col("own_c").alias("c")).distinct(), rings, rings)
    around = around.join(placed.select("r", "c").distinct(), ["r", "c"])
    first = F.min("ring").over(Window.partitionBy("own_r", "own_c"))
    around = around.withColumn("first", first).where("ring = first").select("own_r", "own_c", "r", "c")
    met = own.join(workspace.table(around, "around"), ["own_r", "own_c"]).join(placed, ["r", "c"])
    meters = C.haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    best = met.groupBy("k").agg(F.min(F.struct(F.round(meters, 6).alias("m"), "node")).alias("best")).select("k", "best.node")
    best = workspace.table(best, "snapped")
    far = located.join(best, "k", "left_anti").select(F.col("k").alias("point"), "lat", "lon")
    rest = nearest_one(far, nodes.withColumnRenamed("node", "k"), workspace)
    return best.unionByName(rest.select(F.col("point").alias("k"), F.col("k").alias("node")))


def bounded_walks(nodes: DataFrame, edges: DataFrame, workspace: Workspace, most: int) -> DataFrame:
    """(source, node, seconds, path): shortest walks of at most ``most`` seconds from each of ``nodes``, once per node."""
    starts = nodes.select(F.col("node").alias("source"), "node").distinct()
    return shortest_paths(starts, edges, workspace, most=most).select("source", "node", "seconds", "path")


def targets(stops: DataFrame, most_m: float = MOST_M, most: int = NEAR_K) -> DataFrame:
    """(src, dst): for each stop the nearest others within a distance by cells as wide, and those of its station."""
    order = Window.partitionBy("k_a").orderBy(F.round("m", 6), "stop_id_b")
    near = I.near_pairs(stops, most_m, most_m / 111_320).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    key = C.station_key(F.col("stop_id"))
    own = stops.select("k", key.alias("station"))
    same = own.withColumnRenamed("k", "src").join(own.withColumnRenamed("k", "dst"), "station").where("src <> dst").select("src", "dst")
    return near.select(F.col("k_a").alias("src"), F.col("k_b").alias("dst")).unionByName(same).distinct()


def walk_transfers(pairs: DataFrame, snapped: DataFrame, walks: DataFrame, most: int, least: int = C.MIN_WALK_S) -> DataFrame:
    """(src, dst, seconds): walks between the nodes of candidate pairs; stops of one node are ``least`` seconds apart."""
    side = lambda k, n: snapped.select(F.col("k").alias(k), F.col("node").alias(n))
    met = pairs.join(side("src", "source"), "src").join(side("dst", "node"), "dst").join(walks.select("source", "node", "seconds"), ["source", "node"])
    return met.where(F.col("seconds") <= most).select("src", "dst", F.greatest(F.col("seconds"), F.lit(least)).alias("seconds"))


def straight_transfers(stops: DataFrame, most_m: float = MOST_M, most: int = NEAR_K, cell: float = 0.02) -> DataFrame:
    """(src, dst, seconds): the nearest stops as the crow flies; stops of one station are always 30 seconds apart."""
    order = Window.partitionBy("k_a").orderBy(F.round("m", 6), "stop_id_b")
    near = I.near_pairs(stops, most_m, cell).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    near = near.select(F.col("k_a").alias("src"), F.col("k_b").alias("dst"), C.walk_seconds(F.col("m")).alias("seconds"))
    own = stops.select("k", C.station_key(F.col("stop_id")).alias("station"))
    same = own.withColumnRenamed("k", "src").join(own.withColumnRenamed("k", "dst"), "station").where("src <> dst").select("src", "dst", F.lit(C.MIN_WALK_S).cast("bigint").alias("seconds"))
    return near.join(same, ["src", "dst"], "left_anti").unionByName(same)
