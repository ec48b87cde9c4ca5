"""Names of the queries over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railloom.functions import columns as C
from railloom.operators import indexes as I
from railloom.operators import ingest as G
from railloom.operators import journeys as J
from railloom.operators import search as S
from railloom.plans.oracles import ORACLES
from railloom.sources import timetable as T
from railloom.workspace import Workspace

def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n_events"))


def parse_time_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = (
        F.when(key % 6 == 0, F.concat(key % 30, F.lit(":0"), key % 7)).when(key % 6 == 1, F.concat(F.lit("25:10:0"), key % 9))
        .when(key % 6 == 2, key.cast("string")).when(key % 6 == 3, F.concat(F.lit("x"), key)).when(key % 6 == 5, F.lit(" 7:5 "))
    )
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(key, C.parse_time_seconds(text).alias("seconds"))


def departure_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    value = F.when(key % 2 == 0, key + 1_738_580_100).otherwise(key * 17 % 90_000)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(key, C.departure_seconds(value).alias("seconds"))


def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of every two stops that a trip visits one after the other."""
    a, b = I._pair(T.stops(spark, sf_dir))
    pairs = I.hops(T.stop_times(spark, sf_dir)).select(F.col("src").alias("k_a"), F.col("dst").alias("k_b")).distinct()
    meters = C.haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return pairs.join(a, "k_a").join(b, "k_b").select(F.col("k_a").alias("src"), F.col("k_b").alias("dst"), F.round(meters, 3).alias("meters"))


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stops(spark, sf_dir).select("k", F.floor(F.col("lat") / I.CELL).alias("r"), F.floor(F.col("lon") / I.CELL).alias("c"))


def station_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stops(spark, sf_dir).select("k", C.station_key(F.col("stop_id")).alias("station"))


def stop_text_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", C.normalize_text(F.col("p_name")).alias("name"))


def incoming_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = I.ride_edges(T.stop_times(spark, sf_dir))
    return edges.groupBy(F.col("dst").alias("k")).agg(F.array_join(F.array_sort(F.collect_set("src")).cast("array<string>"), ",").alias("sources"))


def two_hop_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = I.ride_edges(T.stop_times(spark, sf_dir)).select(F.col("src").alias("k"), F.col("dst").alias("near"))
    both = edges.unionByName(edges.select(F.col("near").alias("k"), F.col("k").alias("near"))).distinct()
    second = both.select(F.col("k").alias("near"), F.col("near").alias("far"))
    return both.join(second, "near").select("k", F.col("far").alias("near")).unionByName(both).distinct()


def route_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.patterns(T.stop_times(spark, sf_dir), "event_type").groupBy("pattern").agg(F.count("*").alias("n_trips"), F.min("dep0").alias("first_dep"))


def pattern_trips_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("pattern").orderBy("dep0", "trip_id")
    return I.patterns(T.stop_times(spark, sf_dir), "event_type").select("trip_id", "pattern", F.row_number().over(order).alias("nth"))


def trip_avg_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.trip_speeds(T.stop_times(spark, sf_dir), T.stops(spark, sf_dir)).select("trip_id", F.round("speed", 6).alias("speed"))


def network_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.network_profile(I.trip_factors(T.stop_times(spark, sf_dir), T.stops(spark, sf_dir)))


def station_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = T.stops(spark, sf_dir).groupBy(C.station_key(F.col("stop_id")).alias("station"))
    return stations.agg(F.round(F.avg("lat"), 9).alias("lat"), F.round(F.avg("lon"), 9).alias("lon"))


def _station_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.station_edges(T.stop_times(spark, sf_dir), T.stops(spark, sf_dir))


def boardings_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.boardings(T.sources(T.requests(spark, sf_dir)), I.routes(T.stop_times(spark, sf_dir)))


def ride_alightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = I.routes(T.stop_times(spark, sf_dir))
    return S.alightings(S.boardings(T.sources(T.requests(spark, sf_dir)), routes), routes)


def static_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least ride times from every stop that a request starts from, whatever the timetable."""
    edges = I.ride_edges(T.stop_times(spark, sf_dir)).select("src", "dst", "seconds")
    starts = T.requests(spark, sf_dir).select(F.col("from_k").alias("source"), F.col("from_k").alias("node")).distinct()
    return S.shortest_paths(starts, edges, Workspace(spark, "static"))


def station_hop_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least hops, then least time, between stations, for up to two hops more than transfers are allowed."""
    edges = _station_edges(spark, sf_dir)
    starts = edges.select(F.col("src").alias("source"), F.col("src").alias("node")).distinct()
    return S.shortest_paths(starts, edges, Workspace(spark, "hops"), S.MOST_TRANSFERS + 2, True)


#: What the labels of a request depend on.
SOURCE = ["from_k", "departure"]


def labels_from(spark: SparkSession, sf_dir: str, sources: DataFrame, most: int = S.MOST_TRANSFERS, scan: int = S.SCAN) -> DataFrame:
    """The labels of ``sources`` (from_k, departure) over the trips of all users."""
    workspace = Workspace(spark, "labels")
    st = workspace.table(T.stop_times(spark, sf_dir), "stop_times")
    routes = workspace.table(I.routes(st), "routes")
    factors = workspace.table(I.trip_factors(st, T.stops(spark, sf_dir)), "factors")
    walks = workspace.table(I.transfer_edges(T.stops(spark, sf_dir)), "walks")
    return S.label_rounds(workspace.table(sources, "sources"), routes, factors, walks, workspace, most=most, scan=scan)


def raptor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best labels of all stops, with their paths, for every source that a request has."""
    return labels_from(spark, sf_dir, T.sources(T.requests(spark, sf_dir)))


def reliability_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of requests whose destination has a label, and of those that only the static search answers."""
    asked = T.requests(spark, sf_dir)
    labels = raptor_labels(spark, sf_dir).select(*SOURCE, F.col("k").alias("to_k"), F.lit(1).alias("found"))
    static = static_shortest_path(spark, sf_dir).select(F.col("source").alias("from_k"), F.col("node").alias("to_k"), F.lit(1).alias("reached"))
    pairs = asked.groupBy(*SOURCE, "to_k").agg(F.count("*").alias("n")).join(labels, [*SOURCE, "to_k"], "left").join(static, ["from_k", "to_k"], "left")
    late = F.when(F.col("found").isNull() & F.col("reached").isNotNull(), F.col("n")).otherwise(0)
    share = lambda x: F.round(F.sum(x) / F.sum("n"), 6)
    any_ = F.when(F.coalesce("found", "reached").isNotNull(), F.col("n")).otherwise(0)
    return pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_requests"), share(any_).alias("found_rate"), share(late).alias("fallback_rate"))


def stop_bbox_quantiles(spark: SparkSession, sf_dir: str, margin_m: float = 500.0) -> DataFrame:
    """The box of all stops with a margin: of their middle 99 % where there are 100 or more, else of all."""
    at = G.with_coordinates(T.stops(spark, sf_dir))
    shares = (0.005, 0.995) if at.count() >= 100 else (0.0, 1.0)
    workspace = Workspace(spark, "box")
    (south, north), (west, east) = (G.quantiles(at, c, shares, workspace) for c in ("lat", "lon"))
    if south is None:
        return spark.createDataFrame([], "lat_low double, lat_high double, lon_low double, lon_high double")
    up = margin_m / 111_320
    out = margin_m / (111_320 * max(1e-6, math.cos(math.radians((south + north) / 2))))
    return spark.createDataFrame([tuple(round(x, 9) for x in (south - up, north + up, west - out, east + out))], "lat_low double, lat_high double, lon_low double, lon_high double")


QUERIES = {
    "event_counts": event_counts,
    "timetable_stop_times": T.stop_times,
    "parse_time_seconds": parse_time_seconds,
    "departure_seconds": departure_seconds,
    "haversine_pairs": haversine_pairs,
    "grid_cells": grid_cells,
    "station_keys": station_keys,
    "stop_text_normalized": stop_text_normalized,
    "ride_edges": lambda s, d: I.ride_edges(T.stop_times(s, d)),
    "incoming_edges": incoming_edges,
    "two_hop_expansion": two_hop_expansion,
    "route_patterns": route_patterns,
    "pattern_trips_ranked": pattern_trips_ranked,
    "board_monotonic": lambda s, d: I.board_monotonic(T.stop_times(s, d), "event_type"),
    "same_station_transfers": lambda s, d: I.same_station_transfers(T.stops(s, d)),
    "nearby_transfers": lambda s, d: I.nearby_transfers(T.stops(s, d)),
    "transfer_edges": lambda s, d: I.transfer_edges(T.stops(s, d)),
    "trip_avg_speed": trip_avg_speed,
    "trip_cost_factor": lambda s, d: I.trip_factors(T.stop_times(s, d), T.stops(s, d)),
    "network_profile": network_profile,
    "station_centroids": station_centroids,
    "station_edges": _station_edges,
    "station_degrees": lambda s, d: I.station_degrees(_station_edges(s, d)),
    "hub_stations": lambda s, d: I.hubs(I.station_degrees(_station_edges(s, d))),
    "boardings_asof": boardings_asof,
    "ride_alightings": ride_alightings,
    "static_shortest_path": static_shortest_path,
    "station_hop_path": station_hop_path,
    "raptor_labels": raptor_labels,
    "reliability_rates": reliability_rates,
    "stop_bbox_quantiles": stop_bbox_quantiles,
}
FLAGSHIP = "ride_alightings"
