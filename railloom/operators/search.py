"""Search by rounds: boardings, static shortest paths, hop paths and label rounds, for many requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railloom.workspace import Workspace

SCAN, HOP_S, WALK_S, MOST_TRANSFERS = 6, 180, 600, 4


def boardings(sources: DataFrame, routes: DataFrame, scan: int = SCAN) -> DataFrame:
    """The trips that leave each source's stop at or after its departure: (from_k, departure, trip_id, seq, board_t).

    Of each pattern and position the first ``scan`` trips, or all where times are not monotonic.
    """
    at = sources.join(routes, F.col("from_k") == F.col("k")).where(F.col("t") >= F.col("departure"))
    first = Window.partitionBy("from_k", "departure", "pattern", "seq").orderBy("t", "trip_id")
    taken = at.withColumn("n", F.row_number().over(first)).where((F.col("n") <= scan) | ~F.col("monotonic"))
    return taken.select("from_k", "departure", "trip_id", "seq", F.col("t").alias("board_t"))


def alightings(boarded: DataFrame, routes: DataFrame) -> DataFrame:
    """Every later stop of each boarded trip."""
    later = routes.select("trip_id", F.col("seq").alias("seq_to"), "k", F.col("t").alias("arr"))
    return boarded.join(later, "trip_id").where("seq_to > seq").select("from_k", "departure", "trip_id", "board_t", "k", "arr")


def shortest_paths(sources: DataFrame, edges: DataFrame, workspace: Workspace, rounds: int | None = None, by_hops: bool = False, most: int | None = None) -> DataFrame:
    """(source, node, hops, seconds, path): least seconds, or least hops and then seconds; ties go to the smaller path.

    ``sources``: (source, node). Each round extends only what the round before improved, until
    nothing does, or for ``rounds`` edges, and not beyond ``most`` seconds. Every node keeps one
    label, by partial minima.
    """
    labels = sources.select("source", "node", F.lit(0).alias("hops"), F.lit(0).cast("bigint").alias("seconds"), F.col("node").cast("string").alias("path"))
    frontier = labels
    order = ("hops", "seconds", "path") if by_hops else ("seconds", "hops", "path")
    key = lambda prefix="": F.struct(*(F.col(prefix + c).alias(c) for c in order))
    i = 0
    while rounds is None or i < rounds:
        step = frontier.join(edges.select("src", "dst", F.col("seconds").alias("w")), frontier["node"] == edges["src"])
        step = step.select("source", F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops"), (F.col("seconds") + F.col("w")).alias("seconds"), F.concat("path", F.lit(">"), F.col("dst").cast("string")).alias("path"))
        if most is not None:
            step = step.where(F.col("seconds") <= most)
        best = step.groupBy("source", "node").agg(F.min(key()).alias("m")).select("source", "node", "m.hops", "m.seconds", "m.path")
        old = labels.select("source", "node", *(F.col(c).alias(f"old_{c}") for c in order))
        better = best.join(old, ["source", "node"], "left").where(F.col("old_hops").isNull() | (key() < key("old_")))
        frontier = workspace.table(better.select(labels.columns), f"frontier_{i}")
        if frontier.isEmpty():
            break
        labels = workspace.table(labels.join(frontier, ["source", "node"], "left_anti").unionByName(frontier), f"labels_{i}")
        if i:
            workspace.drop(f"labels_{i - 1}")
            workspace.drop(f"frontier_{i - 1}")
        i += 1
    return labels


def label_rounds(sources: DataFrame, routes: DataFrame, factors: DataFrame, walks: DataFrame, workspace: Workspace, penalty: int = 3600, most: int = 4, scan: int = SCAN) -> DataFrame:
    """(from_k, departure, k, transfers, cost, walk, arr, path): the best label of every stop, by transfers, cost, walk, arrival.

    Round r settles the stops that r transfers first reach. Boarding takes the first ``scan`` trips
    of each pattern at a stop, or all where times are not monotonic; a ride reaches all its later
    stops; stops reached by a ride are walked from. Ties go to the smaller path, which lists stops
    and between them ``walk`` or trip:position-position. A source all of whose stops are settled
    goes no further.
    """
    own = ["from_k", "departure"]
    served = routes.select("k").distinct()
    stops = workspace.table(served.unionByName(walks.join(served, walks["src"] == served["k"], "left_semi").select(F.col("dst").alias("k"))).distinct(), "stops")
    all_stops = stops.count()
    short = walks.where(F.col("seconds") <= HOP_S)
    buffer = min(10, penalty // 60)
    start = sources.select(*own, F.col("from_k").alias("k"), (F.col("departure") * 1000).alias("cost"), F.lit(0).cast("bigint").alias("walk"), F.col("departure").alias("arr"), F.col("from_k").cast("string").alias("path"))
    settled = start.withColumn("transfers", F.lit(0))
    access = _walk(start, short, penalty)
    frontier, rides_with = start.unionByName(access), routes.join(factors.select("trip_id", "cost_factor"), "trip_id")
    later = routes.select("trip_id", F.col("seq").alias("seq_to"), F.col("k").alias("to"), F.col("t").alias("at"))
    for r in range(most + 1):
        ready = F.col("arr") + (buffer if r else 0)
        at = frontier.join(rides_with.select("trip_id", "pattern", "seq", F.col("k").alias("bk"), "t", "cost_factor", "monotonic"), F.col("k") == F.col("bk")).where(F.col("t") >= ready)
        first = Window.partitionBy(*own, "k", "pattern", "seq").orderBy("t", "trip_id")
        at = at.withColumn("n", F.row_number().over(first)).where((F.col("n") <= scan) | ~F.col("monotonic"))
        board = at.select(*own, "trip_id", "seq", F.col("t").alias("bt"), "cost_factor", (F.col("cost") + (F.col("t") - ready) * 1000 + (penalty * 1000 if r else 0)).alias("cost"), "walk", "path")
        ride = board.join(later, "trip_id").where("seq_to > seq").select(
            *own, F.col("to").alias("k"), (F.col("cost") + F.greatest(F.lit(0), F.col("at") - F.col("bt")) * F.col("cost_factor")).alias("cost"), "walk", F.col("at").alias("arr"),
            F.concat("path", F.lit(">"), "trip_id", F.lit(":"), F.col("seq"), F.lit("-"), F.col("seq_to"), F.lit(">"), F.col("to").cast("string")).alias("path"),
        )
        reached = ride.withColumn("rode", F.lit(True))
        reached = _least(reached.unionByName(access.withColumn("rode", F.lit(False))) if r == 0 else reached)
        fresh = workspace.table(reached.join(settled.select(*own, "k"), [*own, "k"], "left_anti"), f"reached_{r}")
        walked = _walk(fresh.where("rode"), short, penalty).withColumn("rode", F.lit(False))
        both = _least(fresh.unionByName(walked)).join(settled.select(*own, "k"), [*own, "k"], "left_anti")
        both = workspace.table(both, f"settled_{r}")
        # a stop that only an access walk has reached was boarded from in round 0
        frontier = both.drop("rode") if r else both.join(access.select(*own, "k", F.col("path").alias("p0")), [*own, "k"], "left").where("p0 IS NULL OR p0 <> path").drop("rode", "p0")
        settled = settled.unionByName(both.drop("rode").withColumn("transfers", F.lit(r)))
        if both.isEmpty():
            break
        full = settled.join(stops, "k", "left_semi").groupBy(*own).count().where(F.col("count") >= all_stops)
        frontier = frontier.join(full, own, "left_anti")
    return settled


def _walk(labels: DataFrame, walks: DataFrame, penalty: int) -> DataFrame:
    far = labels.join(walks, labels["k"] == walks["src"]).where(F.col("walk") + F.col("seconds") <= WALK_S)
    cost = F.col("cost") + F.expr("(seconds * 3 + 1) div 2") * 1000 + penalty * 1000
    return far.select("from_k", "departure", F.col("dst").alias("k"), cost.alias("cost"), (F.col("walk") + F.col("seconds")).alias("walk"), (F.col("arr") + F.col("seconds")).alias("arr"), F.concat("path", F.lit(">walk>"), F.col("dst").cast("string")).alias("path"))


def _least(labels: DataFrame) -> DataFrame:
    best = labels.groupBy("from_k", "departure", "k").agg(F.min(F.struct("cost", "walk", "arr", "path", "rode")).alias("m"))
    return best.select("from_k", "departure", "k", "m.cost", "m.walk", "m.arr", "m.path", "m.rode")
