"""Index tables over stop times: edges, patterns, transfers, stations and cost factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railloom.functions.columns import haversine_m, route_type_factor, speed_factor, station_key, walk_seconds

SAME_STATION_M, NEAR_M, NEAR_K, CELL = 250.0, 120.0, 4, 120.0 / 111_320


HALF_HOUR = 1800


def hops(st: DataFrame) -> DataFrame:
    """Consecutive stops of each trip: (trip_id, src, dst, seq, dep, arr)."""
    trip = Window.partitionBy("trip_id").orderBy("seq")
    nxt = st.select("trip_id", "seq", F.col("k").alias("src"), F.lead("k").over(trip).alias("dst"), F.col("t").alias("dep"), F.lead("t").over(trip).alias("arr"))
    return nxt.where("dst IS NOT NULL")


def ride_edges(st: DataFrame) -> DataFrame:
    """Shortest ride between stops and its first trip."""
    best = hops(st).where("arr >= dep").groupBy("src", "dst").agg(F.min(F.struct((F.col("arr") - F.col("dep")).alias("w"), "trip_id")).alias("m"))
    return best.select("src", "dst", F.col("m.w").alias("seconds"), F.col("m.trip_id").alias("trip_id"))


def patterns(st: DataFrame, stop: str) -> DataFrame:
    """(trip_id, pattern, dep0): the sequence of stops of each trip."""
    trips = st.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col(stop).cast("string").alias("s")))).alias("x"), F.min_by("t", "seq").alias("dep0"))
    return trips.select("trip_id", F.array_join("x.s", ">").alias("pattern"), "dep0")


def board_monotonic(st: DataFrame, stop: str) -> DataFrame:
    """Per pattern and position, whether times never fall from trip to trip.

    Trips are looked at by half hours of departure, and only the first and last time of each half
    hour meet those of the next, so that no frequent pattern gathers all its trips in one task.
    """
    rows = st.join(patterns(st, stop), "trip_id").withColumn("half", F.expr(f"dep0 div {HALF_HOUR}"))
    key = ["pattern", "seq"]
    order = F.struct("dep0", "trip_id")
    fell = F.col("t") < F.lag("t").over(Window.partitionBy(*key, "half").orderBy("dep0", "trip_id"))
    halves = rows.select(*key, "half", order.alias("o"), "t", F.coalesce(fell, F.lit(False)).alias("fell")).groupBy(*key, "half")
    halves = halves.agg(F.bool_or("fell").alias("fell"), F.min_by("t", "o").alias("first"), F.max_by("t", "o").alias("last"), F.count("*").alias("n"))
    between = F.coalesce(F.col("first") < F.lag("last").over(Window.partitionBy(*key).orderBy("half")), F.lit(False))
    return halves.withColumn("fell", F.col("fell") | between).groupBy(*key).agg((~F.bool_or("fell")).alias("monotonic"), F.sum("n").alias("n_trips"))


def routes(st: DataFrame) -> DataFrame:
    """Stop times with what boarding needs: a hash of the pattern, and whether times never fall at the pattern's position."""
    flags = board_monotonic(st, "k").select("pattern", "seq", "monotonic")
    rows = st.join(patterns(st, "k").select("trip_id", "pattern"), "trip_id")
    return rows.join(flags, ["pattern", "seq"]).select("trip_id", F.xxhash64("pattern").alias("pattern"), "seq", "k", "t", "monotonic")


def _pair(stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    side = lambda s: stops.select(*(F.col(c).alias(f"{c}_{s}") for c in ("k", "stop_id", "lat", "lon")))
    return side("a"), side("b")


def same_station_transfers(stops: DataFrame) -> DataFrame:
    a, b = _pair(stops)
    meters = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    pairs = a.join(b, (station_key(F.col("stop_id_a")) == station_key(F.col("stop_id_b"))) & (F.col("k_a") != F.col("k_b")))
    return pairs.where(meters <= SAME_STATION_M).select(F.col("k_a").alias("src"), F.col("k_b").alias("dst"), walk_seconds(meters).alias("seconds"))


def near_pairs(stops: DataFrame, most_m: float, cell: float) -> DataFrame:
    """Pairs within a distance by grid cells: each stop meets those of its nine cells only."""
    a, b = _pair(stops)
    a = a.withColumns({"r": F.floor(F.col("lat_a") / cell), "c": F.floor(F.col("lon_a") / cell)})
    b = b.withColumns({"r": F.floor(F.col("lat_b") / cell), "c": F.floor(F.col("lon_b") / cell)})
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = a.withColumn("n", F.explode(around)).withColumns({"r": F.col("r") + F.col("n.i"), "c": F.col("c") + F.col("n.j")})
    meters = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return a.join(b, ["r", "c"]).withColumn("m", meters).where((F.col("m") > 0) & (F.col("m") <= most_m))


def nearby_transfers(stops: DataFrame) -> DataFrame:
    nearest = Window.partitionBy("k_a").orderBy(F.round("m", 6), "stop_id_b")
    ranked = near_pairs(stops, NEAR_M, CELL).withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= NEAR_K)
    return ranked.select(F.col("k_a").alias("src"), F.col("k_b").alias("dst"), walk_seconds(F.col("m")).alias("seconds"))


def transfer_edges(stops: DataFrame) -> DataFrame:
    both = same_station_transfers(stops).unionByName(nearby_transfers(stops))
    return both.groupBy("src", "dst").agg(F.min("seconds").alias("seconds"))


def trip_speeds(st: DataFrame, stops: DataFrame) -> DataFrame:
    """Mean speed of each trip over hops that move; null where none does."""
    a, b = _pair(stops)
    moved = hops(st).join(a.select(F.col("k_a").alias("src"), "lat_a", "lon_a"), "src").join(b.select(F.col("k_b").alias("dst"), "lat_b", "lon_b"), "dst")
    moved = moved.withColumn("m", haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))).where("arr > dep AND m > 0")
    speeds = moved.groupBy("trip_id").agg((F.sum("m") / F.sum(F.col("arr") - F.col("dep"))).alias("speed"))
    return st.select("trip_id", "route_type").distinct().join(speeds, "trip_id", "left")


def trip_factors(st: DataFrame, stops: DataFrame) -> DataFrame:
    made = trip_speeds(st, stops)
    factor = F.when(F.col("route_type") == -1, speed_factor(F.col("speed"))).otherwise(route_type_factor(F.col("route_type")))
    return made.select("trip_id", "route_type", factor.cast("bigint").alias("cost_factor"))


def station_edges(st: DataFrame, stops: DataFrame) -> DataFrame:
    """Shortest time between successive stations, from the arrival at the first stop of a station's run."""
    trip = Window.partitionBy("trip_id").orderBy("seq")
    named = st.join(stops.select("k", station_key(F.col("stop_id")).alias("station")), "k")
    heads = named.withColumn("before", F.lag("station").over(trip)).where("before IS NULL OR before <> station")
    legs = heads.select("station", F.lead("station").over(trip).alias("dst"), (F.lead("t").over(trip) - F.col("t")).alias("s"))
    return legs.where("dst IS NOT NULL AND s >= 0").groupBy(F.col("station").alias("src"), "dst").agg(F.min("s").alias("seconds"))


def station_degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("station")).agg(F.countDistinct("dst").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("station")).agg(F.countDistinct("src").alias("in_degree"))
    both = out.join(into, "station", "full")
    return both.select("station", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def hubs(degrees: DataFrame, most: int = 512) -> DataFrame:
    total = (F.col("out_degree") + F.col("in_degree")).alias("degree")
    return degrees.select("station", total).orderBy(F.col("degree").desc(), "station").limit(most)
