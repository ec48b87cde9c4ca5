"""Stops near points, stations of stops, hubs and backbones, and stops by name."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railloom.functions import columns as C
from railloom.operators.ingest import with_coordinates
from railloom.workspace import Workspace

RADIUS_M, MOST, ORIGIN_SEEDS, DESTINATION_SEEDS, TIERS = 1000.0, 12, 2, 6, 4
DEGREE_M = 111_320
#: Cells of a radius along each axis, by which stops are summed up.
CELLS = 8
#: From this distance on, stops of the nearest stations are tried beside the nearest stops.
LONG_M = 35_000.0
#: A degree of longitude is at least this share of one of latitude where cells are laid; beyond it cells are widened.
_POLAR = 0.01


def _cells(df: DataFrame, lat: str, lon: str, cell: float) -> DataFrame:
    return df.withColumns({"r": F.floor(F.col(lat) / cell), "c": F.floor(F.col(lon) / cell)})


def _around(df: DataFrame, reach: int, wide: int) -> DataFrame:
    """Each row once for every cell up to ``reach`` rows and ``wide`` columns away, with ring, the larger distance."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-wide, wide + 1)))
    moved = df.withColumn("s", F.explode(steps)).withColumns({"r": F.col("r") + F.col("s.i"), "c": F.col("c") + F.col("s.j")})
    return moved.withColumn("ring", F.greatest(F.abs("s.i"), F.abs("s.j"))).drop("s")


def within(points: DataFrame, stops: DataFrame, radius: float, lat_bound: float = 60.0) -> DataFrame:
    """(point, k, m): stops within ``radius`` meters of each point, by cells as wide as the radius.

    ``points``: point, lat, lon. Columns of cells cover the radius up to ``lat_bound`` degrees of latitude.
    """
    cell = radius / DEGREE_M
    wide = max(1, int(1 / max(_POLAR, math.cos(math.radians(lat_bound)))) + 1)
    own = _around(_cells(points.select("point", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), "p_lat", "p_lon", cell), 1, wide).drop("ring")
    found = own.join(_cells(with_coordinates(stops).select("k", "lat", "lon"), "lat", "lon", cell), ["r", "c"])
    meters = C.haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    return found.select("point", "k", meters.alias("m")).where(F.col("m") <= radius)


def _far(lat: Column, lon: Column, low: str, high: str) -> Column:
    """Meters from a place to the farthest corner of a box, with room for rounding and the globe's bend."""
    corner = lambda a, o: C.haversine_m(lat, lon, F.col(a), F.col(o))
    return F.greatest(*(corner(f"{a}_lat", f"{o}_lon") for a in (low, high) for o in (low, high))) * 1.01 + 1


def _hopeful(points: DataFrame, stops: DataFrame, most: int, radius: float, globe: bool) -> DataFrame:
    """(point, k, m): stops that may be among the ``most`` nearest within ``radius`` of each point.

    Stops are summed up by cells of an eighth of the radius, as number and box. A point takes the cells
    in the order of their farthest corner until they hold enough; no cell whose nearest possible place is
    beyond that corner can hold a nearer stop, and only stops of the other cells are looked at.
    """
    cell = radius / DEGREE_M / CELLS
    placed = _cells(with_coordinates(stops).select("k", "lat", "lon"), "lat", "lon", cell).withColumnRenamed("r", "cr").withColumnRenamed("c", "cc")
    box = [f(c).alias(f"{name}_{c}") for name, f in (("low", F.min), ("high", F.max)) for c in ("lat", "lon")]
    cells = placed.groupBy("cr", "cc").agg(F.count("*").alias("n"), *box)
    own = points.select("point", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    if globe:  # what is left has too few stops within a large part of the globe
        met = cells.join(own, F.lit(True))
    else:
        wide = max(1, int(1 / max(_POLAR, math.cos(math.radians(60.0)))) + 1)
        met = _around(_cells(own, "p_lat", "p_lon", cell * CELLS), 1, wide).drop("ring").join(
            cells.withColumns({"r": F.floor(F.col("cr") / CELLS), "c": F.floor(F.col("cc") / CELLS)}), ["r", "c"]
        )
    lat, lon = F.col("p_lat"), F.col("p_lon")
    within_box = lambda x, c: F.greatest(F.col(f"low_{c}"), F.least(F.col(f"high_{c}"), x))
    # north and south alone are a lower bound at any longitude; both together only where cells are small
    apart = F.abs(lat - within_box(lat, "lat")) * (math.pi / 180 * C.EARTH_M)
    near = apart if globe else F.greatest(apart, C.haversine_m(lat, lon, within_box(lat, "lat"), within_box(lon, "lon")) * 0.8)
    met = met.withColumns({"near": near - 1, "far": _far(lat, lon, "low", "high")})
    upto = F.sum("n").over(Window.partitionBy("point").orderBy("far", "cr", "cc"))
    bound = met.withColumn("upto", upto).where(F.col("upto") >= most).groupBy("point").agg(F.min("far").alias("bound"))
    kept = met.join(bound, "point", "left").where(F.col("bound").isNull() | (F.col("near") <= F.col("bound"))).select("point", "p_lat", "p_lon", "cr", "cc")
    return kept.join(placed, ["cr", "cc"]).select("point", "k", C.haversine_m(lat, lon, F.col("lat"), F.col("lon")).alias("m"))


def nearest(points: DataFrame, stops: DataFrame, most: int, workspace: Workspace, radius: float = RADIUS_M) -> DataFrame:
    """(point, k, m, n): the ``most`` nearest stops of each point, however far, ties to the smaller k.

    Points that have not enough stops within a radius look again within four times it, up to the whole
    globe, so that only they go farther.
    """
    done, left, step = None, points, 0
    number = min(most, with_coordinates(stops).count())
    nearest_first = Window.partitionBy("point").orderBy(F.round("m", 6), "k")
    while number:
        globe = radius * 3 >= DEGREE_M * 60
        near = _hopeful(left, stops, number, radius, globe)
        near = near if globe else near.where(F.col("m") <= radius)
        ranked = near.withColumn("n", F.row_number().over(nearest_first)).where(F.col("n") <= number)
        ranked = workspace.table(ranked, f"nearest_{step}")
        enough = ranked.groupBy("point").count().where(F.col("count") >= number).select("point")
        now = ranked.join(enough, "point", "left_semi")
        done = now if done is None else done.unionByName(now)
        left = workspace.table(left.join(enough, "point", "left_anti"), f"left_{step}")
        if left.isEmpty() or globe:
            break
        radius, step = radius * 4, step + 1
    return points.sparkSession.createDataFrame([], "point long, k int, m double, n int") if done is None else done


#: Degrees of the smallest cells of a descent, cells along each axis of the next larger one, and how often they grow.
LEAF, FAN, LEVELS = 0.005, 4, 7


def nearest_one(points: DataFrame, stops: DataFrame, workspace: Workspace) -> DataFrame:
    """(point, k): the nearest stop of each point, however far, ties to the smaller k.

    Points and stops are summed up by cells, as boxes in space. Cells of points go down through ever
    smaller cells of stops and keep those that are no farther than the farthest corner of another one;
    only the stops of the smallest cells that are left meet the points of a cell.
    """
    axes = ("x", "y", "z")

    def placed(df: DataFrame) -> DataFrame:
        lat, lon = F.radians("lat"), F.radians("lon")
        return _cells(df, "lat", "lon", LEAF).withColumns({"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)})

    def boxes(low: str = "", high: str = "") -> list[Column]:
        return [f(side + a).alias(f"{name}_{a}") for name, f, side in (("low", F.min, low), ("high", F.max, high)) for a in axes]

    def pruned(met: DataFrame, own: list[str], low: str, high: str) -> DataFrame:
        """Of each ``own`` the boxes that may hold the nearest stop; ``low`` and ``high`` begin the names of its own ends."""
        apart = lambda a: F.greatest(F.lit(0.0), F.col(f"low_{a}") - F.col(high + a), F.col(low + a) - F.col(f"high_{a}"))
        across = lambda a: F.greatest(F.col(f"high_{a}") - F.col(low + a), F.col(high + a) - F.col(f"low_{a}"))
        length = lambda f: F.sqrt(sum((f(a) * f(a) for a in axes), F.lit(0.0)))
        bound = F.min(length(across)).over(Window.partitionBy(*own))
        return met.withColumn("bound", bound).where(length(apart) <= F.col("bound") + 1e-9)  # some millimeters for rounding

    there = workspace.table(placed(with_coordinates(stops).select("k", "lat", "lon")), "nearest_stops")
    own = workspace.table(placed(points.select("point", "lat", "lon")).withColumnsRenamed({"r": "own_r", "c": "own_c"}), "nearest_points")
    leaves = workspace.table(there.groupBy("r", "c").agg(*boxes()), "nearest_leaves")
    group = ["own_r", "own_c"]
    at = own.groupBy(group).agg(*(f(a).alias(f"{name}_{a}") for name, f in (("from", F.min), ("to", F.max)) for a in axes))
    found = None
    for level in range(LEVELS, -1, -1):
        wide = FAN**level
        cells = leaves if not level else leaves.withColumns({"r": F.floor(F.col("r") / wide), "c": F.floor(F.col("c") / wide)}).groupBy("r", "c").agg(*boxes("low_", "high_"))
        if found is None:
            met = at.crossJoin(cells)
        else:
            cells = cells.withColumns({"up_r": F.floor(F.col("r") / FAN), "up_c": F.floor(F.col("c") / FAN)})
            met = found.join(cells, ["up_r", "up_c"])
        found = pruned(met, group, "from_", "to_").select(*at.columns, F.col("r").alias("up_r"), F.col("c").alias("up_c"))
    found = workspace.table(found.select(*group, F.col("up_r").alias("r"), F.col("up_c").alias("c")), "nearest_cells")
    near = found.join(there, ["r", "c"]).select(*group, "k", "lat", "lon", *axes)
    kept = own.groupBy(group).cogroup(near.groupBy(group)).applyInPandas(_about_nearest, "point long, k long, p_lat double, p_lon double, lat double, lon double")
    meters = C.haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    best = F.min(F.struct(F.round(meters, 6).alias("m"), "k")).alias("best")
    kinds = points.schema["point"].dataType, stops.schema["k"].dataType
    return kept.groupBy("point").agg(best).select(F.col("point").cast(kinds[0]).alias("point"), F.col("best.k").cast(kinds[1]).alias("k"))


def _about_nearest(points: pd.DataFrame, stops: pd.DataFrame) -> pd.DataFrame:
    """Pairs of points with the stops that are nearest but for rounding, by the distance through the globe."""
    own, there, found = points[["x", "y", "z"]].to_numpy(), stops[["x", "y", "z"]].to_numpy(), []
    step = max(1, (1 << 22) // max(1, len(there)))
    for start in range(0, len(own) if len(there) else 0, step):
        apart = np.sqrt(sum((own[start : start + step, None, i] - there[None, :, i]) ** 2 for i in range(3)))
        i, j = np.nonzero(apart <= apart.min(axis=1, keepdims=True) + 1e-9)
        a, b = points.iloc[i + start].reset_index(drop=True), stops.iloc[j].reset_index(drop=True)
        found.append(pd.DataFrame({"point": a["point"], "k": b["k"], "p_lat": a["lat"], "p_lon": a["lon"], "lat": b["lat"], "lon": b["lon"]}))
    return pd.concat(found) if found else pd.DataFrame({c: [] for c in ("point", "k", "p_lat", "p_lon", "lat", "lon")})


def candidates(points: DataFrame, stops: DataFrame, workspace: Workspace, degrees: DataFrame | None = None, radius: float = RADIUS_M, most: int = MOST, seeds: int = DESTINATION_SEEDS, far: bool = False) -> DataFrame:
    """(point, k, n, seed, penalty): stops that a point's journeys may begin or end at.

    The nearest ``most`` within ``radius``, or with ``far`` the nearest of all where there are none.
    With ``degrees`` (k, degree) they are ranked by what they connect to, 600 seconds for each pattern
    position, less the walk; else by distance. The first ``seeds`` are tried first; ``penalty`` is the
    walk in seconds.
    """
    by_distance = Window.partitionBy("point").orderBy(F.round("m", 6), "k")
    near = within(points, stops, radius).withColumn("n", F.row_number().over(by_distance)).where(F.col("n") <= most)
    if far:
        near = workspace.table(near, "near")
        lonely = points.join(near.select("point").distinct(), "point", "left_anti")
        near = near.unionByName(nearest(lonely, stops, most, workspace, radius).select("point", "k", "m", "n"))
    if degrees is not None:
        utility = F.coalesce("degree", F.lit(0)) * 600.0 - F.round(F.col("m"), 6) / C.WALK_SPEED
        ranked = Window.partitionBy("point").orderBy(F.round(utility, 6).desc(), F.round("m", 6), "k")
        near = near.join(degrees, "k", "left").withColumn("n", F.row_number().over(ranked))
    return near.select("point", "k", "n", (F.col("n") <= seeds).alias("seed"), (F.col("m") / C.WALK_SPEED).cast("bigint").alias("penalty"))


def augmented(near: DataFrame, more: DataFrame, points: DataFrame, stops: DataFrame) -> DataFrame:
    """(point, k, penalty): candidates and further stops of their points, each once, with the walk to all of them in seconds.

    ``near`` and ``more``: point, k.
    """
    both = near.select("point", "k").unionByName(more.select("point", "k")).distinct()
    met = both.join(points.select("point", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), "point").join(with_coordinates(stops).select("k", "lat", "lon"), "k")
    meters = C.haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    return met.select("point", "k", (meters / C.WALK_SPEED).cast("bigint").alias("penalty"))


def appended(near: DataFrame, more: DataFrame) -> DataFrame:
    """(point, k, n, seed, penalty): candidates, and further stops (point, k, penalty) that are none yet, ranked after the last one by their walk."""
    counts = near.groupBy("point").agg(F.max("n").alias("last"))
    order = Window.partitionBy("point").orderBy("penalty", "k")
    new = more.select("point", "k", "penalty").distinct().join(near, ["point", "k"], "left_anti").join(counts, "point", "left")
    n = (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).cast("int")
    return near.unionByName(new.select("point", "k", n.alias("n"), F.lit(False).alias("seed"), "penalty"))


def far_apart(a: DataFrame, b: DataFrame, least_m: float = LONG_M) -> DataFrame:
    """(point): the points whose other end is at least ``least_m`` away. ``a`` and ``b``: point, lat, lon."""
    other = b.select("point", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    return a.join(other, "point").where(C.haversine_m(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b")) >= least_m).select("point")


def connection_degrees(routes: DataFrame) -> DataFrame:
    """(k, degree): in how many positions of patterns a stop stands."""
    return routes.select("pattern", "seq", "k").distinct().groupBy("k").agg(F.count("*").alias("degree"))


def tier_sizes(count: Column, start: Column, tiers: int = TIERS) -> Column:
    """Sizes of growing candidate sets: doubling from ``start``, the last one all of them."""
    grown = [F.least(count, start * (1 << i)) for i in range(tiers - 1)]
    made = F.array_distinct(F.array(*grown, count))
    return F.when((count <= 0) | (start <= 0), F.array().cast("array<bigint>")).otherwise(made.cast("array<bigint>"))


def stations(stops: DataFrame) -> DataFrame:
    """(station, lat, lon): the mean place of each station's stops."""
    key = C.station_key(F.col("stop_id"))
    return stops.groupBy(key.alias("station")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def stop_stations(stops: DataFrame) -> DataFrame:
    """(k, station): a stop without a station key is a station of its own."""
    key = C.station_key(F.col("stop_id"))
    return stops.select("k", F.when(key != "", key).otherwise(F.coalesce("stop_id", F.lit(""))).alias("station"))


def nearest_hubs(stations_: DataFrame, hubs: DataFrame, workspace: Workspace) -> DataFrame:
    """(station, hub): a hub is its own, others go to the nearest hub by place, without a place to the first."""
    named = hubs.select(F.col("station").alias("hub")).join(stations_, F.col("hub") == F.col("station"), "left").select("hub", "lat", "lon")
    order = Window.orderBy("hub")  # at most 512 hubs
    named = named.withColumn("k", F.row_number().over(order))
    first = named.agg(F.min("hub")).first()[0]
    points = stations_.join(hubs.select("station"), "station", "left_anti").withColumnRenamed("station", "point")
    near = nearest(with_coordinates(points), named, 1, workspace).join(named.select("k", "hub"), "k").select(F.col("point").alias("station"), "hub")
    own = hubs.select("station", F.col("station").alias("hub"))
    rest = points.select(F.col("point").alias("station")).join(near, "station", "left").withColumn("hub", F.coalesce("hub", F.lit(first)))
    return own.unionByName(rest)


def backbone(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, station): the stations of each path, what they lead to, and the path's ends.

    ``paths``: query_id, path (station>station>...), start, end.
    """
    on = paths.select("query_id", F.explode(F.split("path", ">")).alias("station")).distinct()
    after = on.join(edges.select(F.col("src").alias("station"), "dst"), "station").select("query_id", F.col("dst").alias("station"))
    ends = paths.select("query_id", F.explode(F.array("start", "end")).alias("station"))
    return on.unionByName(after).unionByName(ends).distinct()


def off_path(segments: DataFrame, whitelist: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, off_path, follows): how many stations of rides are off the backbone; walks do not count."""
    rides = segments.where("trip_id <> 'TRANSFER'").select("query_id", "station").distinct()
    off = rides.join(whitelist, ["query_id", "station"], "left_anti").groupBy("query_id").agg(F.count("*").alias("off"))
    every = segments.select("query_id").distinct().join(off, "query_id", "left").withColumn("off_path", F.coalesce("off", F.lit(0)))
    return every.select("query_id", "off_path", (F.col("off_path") <= most).alias("follows"))


#: Texts of a block; longest first letters by which a word is looked up within others.
BLOCK, HELD = 2048, 4


def _blocks(texts: DataFrame, column: str, name: str, workspace: Workspace) -> DataFrame:
    """Distinct texts in order of length, ``BLOCK`` to a row."""
    schema = pa.schema([(column, pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).slice(start, BLOCK).to_pylist()], schema[0].type)], schema=schema)

    return workspace.table(texts.distinct().orderBy(F.length(column), column).mapInArrow(run, f"{column} array<string>"), name)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and code of every letter, the code counting how often it came before, and the lengths of the texts."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer("".join(texts).encode("ascii"), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((data, owner))
    told = owner[order] * 256 + data[order]
    place = np.arange(len(told))
    fresh = np.concatenate([[True], told[1:] != told[:-1]])[: len(told)]
    before = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return owner[order], data[order] + 256 * before, sizes


def _alike(asked: list[str], labels: list[str], least: float) -> list[tuple[str, str, float]]:
    """Pairs whose ratio of matching characters is at least ``least``, but those that contain or begin alike.

    No more characters match than both have, which one product of matrices tells for all pairs.
    """
    (own, code, sizes), (other, code_b, sizes_b) = _letters(asked), _letters(labels)
    known, at = np.unique(code, return_inverse=True)
    x, y = np.zeros((len(asked), len(known) + 2), np.float32), np.zeros((len(labels), len(known) + 2), np.float32)
    x[own, at], x[:, -2], x[:, -1] = 1, -least * sizes / 2, -least / 2
    to = np.minimum(np.searchsorted(known, code_b), len(known) - 1)
    shared = known[to] == code_b
    y[other[shared], to[shared]], y[:, -2], y[:, -1] = 1, 1, sizes_b
    slack = -1e-3 - 1e-5 * max(sizes.max(), sizes_b.max())
    top = y.max(axis=0)
    top[-1] = sizes_b.min()
    rows = np.flatnonzero(x @ top > slack)
    found = []
    for i, j in zip(*np.nonzero(x[rows] @ y.T > slack)):
        a, b = asked[rows[i]], labels[j]
        if a in b or all(any(p.startswith(w) for p in b.split(" ")) for w in a.split(" ")):
            continue
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        if ratio >= least:
            found.append((a, b, ratio))
    return found


def _ratios(open_: DataFrame, labels: DataFrame, least: float, workspace: Workspace) -> DataFrame:
    """(norm, l_norm, score) by the ratio of matching characters; blocks of both meet."""
    tasks = open_.sparkSession.sparkContext.defaultParallelism * 4
    met = _blocks(labels, "l_norm", "label_blocks", workspace).repartition(tasks).crossJoin(_blocks(open_, "norm", "asked_blocks", workspace))
    schema = pa.schema([("norm", pa.string()), ("l_norm", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, others in zip(batch.column("norm"), batch.column("l_norm"), strict=True):
                found = _alike(asked.as_py(), others.as_py(), least)
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(schema.types)], schema=schema)

    return met.mapInArrow(run, "norm string, l_norm string, score double")


def _sure(open_: DataFrame, labels: DataFrame, workspace: Workspace) -> DataFrame:
    """(norm, l_norm, score) of labels that contain a text, or a beginning of a word for each of its words.

    Each text is looked up by the one of its words that fits the fewest labels: its last word begins a
    word of a label that contains it, its first one ends one, and a single one is within one.
    """
    words = workspace.table(labels.distinct().select("l_norm", F.explode(F.array_distinct(F.split("l_norm", " "))).alias("v")), "label_words")
    told = open_.distinct().select("norm", F.size(F.split("norm", " ")).alias("n"), F.posexplode(F.split("norm", " ")).alias("i", "w"))
    how = F.when(F.col("n") == 1, F.array(F.lit("holds"))).otherwise(F.array(F.lit("starts"), F.when(F.col("i") == 0, "ends").otherwise("starts")))
    tokens = told.select("norm", "w", F.posexplode(how).alias("mode", "kind"))
    key = F.when(F.col("kind") == "holds", F.substr("w", F.lit(1), F.lit(HELD))).otherwise(F.col("w"))
    tokens = workspace.table(tokens.withColumn("key", key), "tokens")
    asked = tokens.select("kind", "key", "w").distinct()
    long = F.col("size")
    keys = F.when(F.col("kind") == "starts", F.array(F.substr("v", F.lit(1), long))).when(F.col("kind") == "ends", F.array(F.substr("v", F.length("v") - long + 1, long)))
    keys = keys.otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("v") - long + 1), lambda i: F.substr("v", i, long))))
    vocabulary = words.groupBy("v").agg(F.count("*").alias("df")).join(F.broadcast(asked.select("kind", F.length("key").alias("size")).distinct()), F.length("v") >= long)
    fits = vocabulary.select("v", "df", "kind", F.explode(keys).alias("key")).join(asked, ["kind", "key"]).where(F.contains("v", "w")).select("kind", "w", "v", "df")
    fits = workspace.table(fits, "fits")
    cost = fits.groupBy("kind", "w").agg(F.sum("df").alias("cost"))
    fewest = F.min(F.struct(F.coalesce("cost", F.lit(0)).alias("cost"), "kind", "w")).alias("m")
    chosen = tokens.join(cost, ["kind", "w"], "left").groupBy("norm", "mode").agg(fewest).select("norm", "m.kind", "m.w")
    met = chosen.join(fits, ["kind", "w"]).select("norm", "v").distinct().join(words, "v").select("norm", "l_norm").distinct()
    begins = F.forall(F.split("norm", " "), lambda w: F.exists(F.split("l_norm", " "), lambda part: part.startswith(w)))
    return met.withColumn("score", F.when(F.contains("l_norm", "norm"), 0.97).when(begins, 0.95)).where("score IS NOT NULL")


def find_stops(asked: DataFrame, named: DataFrame, least: float = 0.86, close: float = 0.02) -> DataFrame:
    """(query, match_type, k, confidence): the stop that a text names; null where none does or two do.

    ``asked``: query. ``named``: k, stop_id, name. In turn: the id, the id in any case, the normalized id
    or name (the smallest stop of several), then the best of: contained in an id or name 0.97, each word
    the beginning of one of its words 0.95, or the ratio of matching characters if that is 0.80 or more.
    Of equal scores the shorter label is better. Scores below ``least`` do not count, nor does a best
    one when another stop's is within ``close`` of it. Only what is still open is searched for: by words,
    and for the ratio in blocks of questions and labels.
    """
    asked = asked.select("query", F.trim("query").alias("raw")).distinct().where("raw <> ''").withColumn("norm", C.normalize_text(F.col("raw")))
    labels = named.select("k", F.col("stop_id").alias("label")).unionByName(named.select("k", F.col("name").alias("label")).where("label IS NOT NULL"))
    labels = labels.withColumn("l_norm", C.normalize_text(F.col("label"))).where("l_norm <> ''")
    ids = named.groupBy("stop_id").agg(F.max("k").alias("k_id"))
    lower = named.groupBy(F.lower("stop_id").alias("l_id")).agg(F.max("k").alias("k_lower"))
    # ids come before names
    first = named.withColumn("l_norm", C.normalize_text(F.col("stop_id"))).groupBy("l_norm").agg(F.min("k").alias("k0")).unionByName(
        named.where("name IS NOT NULL").withColumn("l_norm", C.normalize_text(F.col("name"))).groupBy("l_norm").agg((F.min("k") + (1 << 40)).alias("k0"))
    ).groupBy("l_norm").agg(F.min("k0").alias("k0")).select("l_norm", F.pmod("k0", F.lit(1 << 40)).alias("k_norm"))
    direct = asked.join(ids, asked["raw"] == ids["stop_id"], "left").join(lower, F.lower("raw") == F.col("l_id"), "left").join(first, asked["norm"] == first["l_norm"], "left")
    kind = F.when(F.col("k_id").isNotNull(), "exact_stop_id").when(F.col("k_lower").isNotNull(), "casefold_stop_id").when((F.col("norm") != "") & F.col("k_norm").isNotNull(), "normalized_exact")
    direct = direct.select("query", "norm", kind.alias("match_type"), F.coalesce(F.col("k_id").cast("long"), F.col("k_lower").cast("long"), F.col("k_norm")).alias("k"))
    settled = direct.where("match_type IS NOT NULL").select("query", "match_type", "k", F.lit(1.0).alias("confidence"))

    open_ = direct.where("match_type IS NULL AND norm <> ''").select("query", "norm")
    workspace = Workspace(asked.sparkSession, "names")
    open_ = workspace.table(open_, "open")
    if open_.isEmpty():
        return asked.select("query").join(settled, "query", "left")
    labels = workspace.table(labels, "labels")
    norms, l_norms = open_.select("norm"), labels.select("l_norm")
    # scores below ``least`` do not count
    pairs = _sure(norms, l_norms, workspace).unionByName(_ratios(norms, l_norms, max(least, 0.8), workspace))
    scored = pairs.join(labels, "l_norm").join(open_, "norm")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.length("label"), "k")
    ranked = scored.select("query", "k", "label", "score", F.row_number().over(best).alias("n"), F.lead("score").over(best).alias("s2"), F.lead("k").over(best).alias("k2")).where("n = 1")
    clear = (F.col("score") >= least) & ~F.coalesce((F.col("s2") >= least) & (F.col("score") - F.col("s2") < close) & (F.col("k2") != F.col("k")), F.lit(False))
    fuzzy = ranked.where(clear).select("query", F.lit("fuzzy").alias("match_type"), F.col("k").cast("long").alias("k"), F.round("score", 4).alias("confidence"))
    return asked.select("query").join(settled.unionByName(fuzzy), "query", "left")


def stops_like(named: DataFrame, texts: list[str], most: int = 100) -> DataFrame:
    """(text, k, name): up to ``most`` stops whose name holds each text in any case, names that equal it first."""
    rows = None
    for text in texts:
        own = named.where(F.contains(F.lower("name"), F.lit(text.lower()))).withColumn("exact", F.lower("name") == text.lower())
        own = own.orderBy(F.col("exact").desc(), "name", "k").limit(most).select(F.lit(text).alias("text"), "k", "name")
        rows = own if rows is None else rows.unionByName(own)
    return rows
