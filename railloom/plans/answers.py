"""Queries over raw rows, places, walking graphs and whole journeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railloom.functions import columns as C
from railloom.operators import indexes as I
from railloom.operators import ingest as G
from railloom.operators import journeys as J
from railloom.operators import places as P
from railloom.operators import search as S
from railloom.operators import walking as W
from railloom.plans import registry as R
from railloom.sources import timetable as T
from railloom.workspace import Workspace

#: Hubs of the station queries, fewer than the operator's 512 so that not every station is one.
HUBS = 8
WALK_MOST_S = 300


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _pick(key: Column, *values: Column | str | None) -> Column:
    """The value at the key modulo the number of values."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(key % len(values) == i, F.lit(v) if v is None or isinstance(v, str) else v).otherwise(out)
    return out


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw timetable rows, with times, sequence numbers, places and types as they come in from outside."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    h, m, s = (f("ts").cast("string") for f in (F.hour, F.minute, F.second))
    clock = F.concat(h, F.lit(":"), m, F.lit(":"), s)
    seconds = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("string")
    return e.select(
        F.concat(F.lit("ST"), F.floor(k / 4), F.lit(":"), k % 4).alias("stop_id"), F.concat("user_id", F.lit("@"), F.col("ts").cast("date").cast("string")).alias("trip_id"),
        _pick(key, clock, seconds, F.concat(F.lit(" "), h, F.lit(":"), m, F.lit(" ")), None, F.concat(F.lit("x"), seconds), clock, clock).alias("arrival_time"),
        F.when(key % 11 == 0, None).when(key % 13 == 0, "n/a").otherwise((key % 1000).cast("string")).alias("stop_sequence"),
        F.when(key % 3 == 0, None).when(key % 3 == 1, float("nan")).otherwise(F.lit(46.5) + (k % 10) * F.lit(0.0009)).alias("stop_lat"),
        F.when(key % 5 == 0, None).otherwise(F.lit(6.6) + F.floor(k / 10) * F.lit(0.0009)).alias("stop_lon"),
        _pick(key, "rail", "Tram ", "bus", "7", "", None, "x", "2.7", "-1").alias("route_type"),
    )


def ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.good_rows(raw_rows(spark, sf_dir))


def stop_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dense_keys(ingest_rows(spark, sf_dir), "stop_id", Workspace(spark, "keys"), "stop_id")


def clean_start_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("o_orderkey") % 7, F.col("o_custkey") % 5
    ids = F.array(F.concat(F.lit(" "), a, F.lit(" ")), b.cast("string"), F.lit(""), F.lit("  "), a.cast("string"))
    return _orders(spark, sf_dir).select("o_orderkey", ids.alias("ids")).select("o_orderkey", F.array_join(G.clean_ids("ids"), ",").alias("ids"))


def departure_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = _pick(key, F.concat(F.lit(" "), key % 90_000), (key + 1_738_580_100).cast("string"), F.concat(F.lit("2024-05-0"), key % 9 + 1, F.lit("T0"), key % 10, F.lit(":1"), key % 10, F.lit(":30")), F.concat(F.lit("soon "), key), None, F.concat(F.lit("-"), key % 50))
    return _orders(spark, sf_dir).select("o_orderkey", C.departure_text(text).alias("seconds"))


def walk_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", C.walk_score_penalty(F.col("o_orderkey") % 2500 - 100).alias("penalty"), C.walking_speed_kmh(F.col("o_custkey") % 300 * 1.0, F.col("o_orderkey") % 7 * 30).alias("kmh"))


def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made from orders, most of them wrong in some way, and what is wrong."""
    key = F.col("o_orderkey")
    made = _orders(spark, sf_dir).select(
        "o_orderkey", F.when(key % 19 == 0, " ").otherwise(F.concat(F.lit("ST"), key % 40, F.lit(":1"))).alias("start_stop_id"), F.when(key % 17 == 0, None).otherwise(F.concat(F.lit("ST"), key % 23, F.lit(":2"))).alias("end_stop_id"),
        _pick(key, "raptor", "RAPTOR", "dijkstra", "bfs", "").alias("algorithm"), _pick(key, "28800", "noon", "2024-01-01T08:00:00").alias("departure_time"),
        _pick(key, "4", None, "-1", "many", "2", "3", "0").alias("max_transfers"), _pick(key, "3", "0", None, "2").alias("option_count"), _pick(key, None, "10", "-5").alias("offset_minutes"),
    )
    stops = T.stops(spark, sf_dir).select("stop_id", F.lit(True).alias("known"))
    side = lambda c, name: stops.select(F.col("stop_id").alias(c), F.col("known").alias(name))
    both = made.join(side("start_stop_id", "from_known"), "start_stop_id", "left").join(side("end_stop_id", "to_known"), "end_stop_id", "left")
    code = J.request_error(F.coalesce("from_known", F.lit(False)), F.coalesce("to_known", F.lit(False)))
    return both.select("o_orderkey", code.alias("error"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point, lat, lon): a place for every supplier; every tenth is far from any stop."""
    s = F.col("s_suppkey")
    lat = F.lit(46.5) + (s * 37 % 100) * F.lit(0.00009) + F.when(s % 10 == 9, F.lit(1.0)).otherwise(F.lit(0.0))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(s.cast("long").alias("point"), lat.alias("lat"), (F.lit(6.6) + (s * 53 % 100) * F.lit(0.0001)).alias("lon"))


def destination_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.candidates(points(spark, sf_dir), T.stops(spark, sf_dir), Workspace(spark, "ends"), radius=300.0, far=True)


def origin_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    degrees = P.connection_degrees(I.routes(T.stop_times(spark, sf_dir)))
    return P.candidates(points(spark, sf_dir), T.stops(spark, sf_dir), Workspace(spark, "starts"), degrees, radius=300.0, seeds=P.ORIGIN_SEEDS)


def candidate_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = P.tier_sizes(F.col("o_orderkey") % 40, F.col("o_orderkey") % 7)
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(sizes.cast("array<string>"), ",").alias("tiers"))


def tier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stops of every growing set of a point's nearest ones."""
    near = P.nearest(points(spark, sf_dir), T.stops(spark, sf_dir), P.MOST, Workspace(spark, "tiers"))
    size = F.explode(P.tier_sizes(F.lit(P.MOST), F.lit(P.ORIGIN_SEEDS)))
    return near.select("point", "k", "n", size.alias("tier")).where(F.col("n") <= F.col("tier")).select("point", "tier", "k", "n")


def _numbered_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations with the smallest of their stops as number."""
    stops = T.stops(spark, sf_dir)
    first = P.stop_stations(stops).groupBy("station").agg(F.min("k").alias("k"))
    return P.stations(stops).join(first, "station")


def nearest_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest stations of each point and the first six stops of each."""
    near = P.nearest(points(spark, sf_dir), _numbered_stations(spark, sf_dir), 3, Workspace(spark, "stations"))
    named = near.join(_numbered_stations(spark, sf_dir).select("k", "station"), "k").select("point", "station", "n")
    members = P.stop_stations(T.stops(spark, sf_dir)).groupBy("station").agg(F.slice(F.array_sort(F.collect_list("k")), 1, 6).alias("stops"))
    return named.join(members, "station").select("point", "station", "n", F.explode("stops").alias("k"))


def augmented_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of each point and the stops of the stations nearest to it."""
    return P.augmented(destination_candidates(spark, sf_dir), nearest_stations(spark, sf_dir), points(spark, sf_dir), T.stops(spark, sf_dir))


def static_path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.static_segments(R.static_shortest_path(spark, sf_dir), I.ride_edges(T.stop_times(spark, sf_dir)))


def _hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.hubs(I.station_degrees(R._station_edges(spark, sf_dir)), HUBS)


def nearest_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.nearest_hubs(P.stations(T.stops(spark, sf_dir)), _hubs(spark, sf_dir), Workspace(spark, "hubs"))


def _hub_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The hub path of each journey, and the station edges."""
    workspace = Workspace(spark, "backbone")
    edges = workspace.table(R._station_edges(spark, sf_dir), "edges")
    hubs = workspace.table(P.nearest_hubs(P.stations(T.stops(spark, sf_dir)), I.hubs(I.station_degrees(edges), HUBS), workspace), "hubs")
    named = P.stop_stations(T.stops(spark, sf_dir)).join(hubs, "station")
    side = lambda k, name, hub: named.select(F.col("k").alias(k), F.col("station").alias(name), F.col("hub").alias(hub))
    asked = T.journeys(spark, sf_dir).join(side("from_k", "start", "source"), "from_k").join(side("to_k", "end", "node"), "to_k")
    asked = workspace.table(asked, "asked")
    labels = S.shortest_paths(asked.select("source", F.col("source").alias("node")).distinct(), edges, workspace, S.MOST_TRANSFERS + 2, True)
    return asked.join(labels, ["source", "node"]).select("query_id", "path", "start", "end"), edges


def station_backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.backbone(*_hub_paths(spark, sf_dir))



def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(p.cast("int").alias("k"), F.concat(F.lit("P"), p).alias("stop_id"), F.concat("p_name", F.lit(" "), p).alias("name"))


def fuzzy_stop_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every supplier: ids, names in other letters, parts of names, beginnings of words, misspelt names."""
    named = _named(spark, sf_dir)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("int").alias("k")).join(named, "k")
    words = F.split("name", " ")
    begun = F.array_join(F.transform(words, lambda w, i: F.when(i < 2, F.substr(w, F.lit(1), F.lit(3))).otherwise(w)), " ")
    text = _pick(F.col("k"), F.col("stop_id"), F.lower("stop_id"), F.concat(F.upper("name"), F.lit("!")), F.substr("name", F.lit(3)), begun, F.concat(F.lit("z"), F.substr("name", F.lit(2))), F.concat(F.lit("nowhere "), "k"))
    return P.find_stops(s.select(text.alias("query")), named)


LIKE = ("widget", "BOLT 7", "blue rod")


def stops_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stops_like(_named(spark, sf_dir), list(LIKE))


def walk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, lat, lon): a crossing for every part, 45 to a row."""
    p = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(p.cast("long").alias("node"), (F.lit(46.4995) + (p % 45) * F.lit(0.0009)).alias("lat"), (F.lit(6.5995) + F.floor(p / 45) * F.lit(0.0009)).alias("lon"))


def walk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = walk_nodes(spark, sf_dir)
    beside = F.when(F.col("node") % 45 < 44, F.array(F.col("node") + 1, F.col("node") + 45)).otherwise(F.array(F.col("node") + 45))
    a = nodes.select(F.col("node").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.explode(beside).alias("b"))
    b = nodes.select(F.col("node").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    meters = F.round(C.haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")), 6)
    return W.walk_edges(a.join(b, "b").select("a", "b", meters.alias("meters")))


def walk_snap_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.snap(T.stops(spark, sf_dir), walk_nodes(spark, sf_dir), Workspace(spark, "snap"))


def _walks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    workspace = Workspace(spark, "walks")
    snapped = workspace.table(walk_snap_nodes(spark, sf_dir), "stops")
    edges = workspace.table(walk_edges(spark, sf_dir), "edges")
    return snapped, W.bounded_walks(snapped, edges, workspace, WALK_MOST_S)


def walk_sssp_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walks(spark, sf_dir)[1]


def walk_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapped, walks = _walks(spark, sf_dir)
    return W.walk_transfers(W.targets(T.stops(spark, sf_dir)), snapped, walks, WALK_MOST_S)


def _search(spark: SparkSession, sf_dir: str, asked: DataFrame, **how) -> DataFrame:
    """(query_id, departure, k, transfers, cost, walk, arr, path): labels of all stops for each request."""
    labels = R.labels_from(spark, sf_dir, T.sources(asked), **how)
    return asked.select("query_id", "from_k", "departure").join(labels, R.SOURCE)


def _answers(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """(query_id, departure, transfers, arr, path) of the requests that have a path."""
    met = _search(spark, sf_dir, asked).join(asked.select("query_id", "departure", F.col("to_k").alias("k")), ["query_id", "departure", "k"])
    return met.select("query_id", "departure", "transfers", "arr", "path")


def _everywhere(spark: SparkSession, sf_dir: str, workspace: Workspace) -> DataFrame:
    """Answers from every journey's start to all stops; query_id is the journey's times 100,000 plus the stop."""
    made = _search(spark, sf_dir, T.journeys(spark, sf_dir))
    return workspace.table(made.select((F.col("query_id") * 100_000 + F.col("k")).alias("query_id"), "departure", "transfers", "arr", "path"), "everywhere")


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    workspace = Workspace(spark, "segments")
    answers = _everywhere(spark, sf_dir, workspace)
    made = J.segments(answers, T.stop_times(spark, sf_dir), I.transfer_edges(T.stops(spark, sf_dir)))
    return answers, workspace.table(made, "segments")


def raptor_itineraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)[1]


def segment_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = J.segment_payload(_segments(spark, sf_dir)[1], T.stops(spark, sf_dir))
    return made.select("query_id", "pos", "trip_id", "from_stop_id", "stop_id", "arrival", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def walk_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, made = _segments(spark, sf_dir)
    rows = J.walk_legs(J.segment_payload(made, T.stops(spark, sf_dir)), answers)
    line = F.array_join(F.transform(F.flatten("geometry"), lambda x: F.round(x * 1_000_000).cast("bigint").cast("string")), ",")
    return rows.select("query_id", "pos", "from_stop_id", "stop_id", "kind", "seconds", "meters", "routing", "kmh", line.alias("line"))


def itinerary_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = T.stop_times(spark, sf_dir)
    return J.profiles(_segments(spark, sf_dir)[1], I.trip_factors(st, T.stops(spark, sf_dir)))


def transfer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of trip in every journey, walks aside."""
    return itinerary_profile(spark, sf_dir).select("query_id", "changes")


def backbone_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each journey keeps to its station backbone."""
    asked, workspace = T.journeys(spark, sf_dir), Workspace(spark, "check")
    answers = workspace.table(_answers(spark, sf_dir, asked), "answers")
    made = J.segments(answers, T.stop_times(spark, sf_dir), I.transfer_edges(T.stops(spark, sf_dir))).join(P.stop_stations(T.stops(spark, sf_dir)), "k")
    return P.off_path(made, station_backbone(spark, sf_dir))


def raptor_transfer_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys with one change at most."""
    asked = T.journeys(spark, sf_dir)
    met = _search(spark, sf_dir, asked, most=1).join(asked.select("query_id", F.col("to_k").alias("k")), ["query_id", "k"])
    return asked.select("query_id").join(met.select("query_id", "transfers", "arr"), "query_id", "left")


def _ends(spark: SparkSession, sf_dir: str, workspace: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Journeys between places beside their stops: requests, starts and ends."""
    asked, stops = T.journeys(spark, sf_dir), T.stops(spark, sf_dir)
    place = lambda c: asked.join(stops, asked[c] == stops["k"]).select(F.col("query_id").alias("point"), (F.col("lat") + 0.0002).alias("lat"), (F.col("lon") + 0.0003).alias("lon"))
    degrees = P.connection_degrees(I.routes(T.stop_times(spark, sf_dir)))
    starts = P.candidates(place("from_k"), stops, workspace, degrees, seeds=P.ORIGIN_SEEDS)
    ends = P.candidates(place("to_k"), stops, workspace)
    named = lambda rows, name: workspace.table(rows.withColumnRenamed("point", "query_id"), name)
    return asked, named(starts, "starts"), named(ends, "ends")


def best_od_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best journey of each request over its starts and ends."""
    workspace = Workspace(spark, "od")
    asked, starts, ends = _ends(spark, sf_dir, workspace)
    own = workspace.table(J.pairs(starts.where("seed"), ends.where("seed")).join(asked.select("query_id", "departure"), "query_id"), "pairs")
    labels = R.labels_from(spark, sf_dir, T.sources(own))
    return J.best(own, labels, S.MOST_TRANSFERS).select("query_id", "transfers", "arr", "walks", "score", "egress", "from_k", "to_k", "access", "path")


def direct_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the chosen journey stands to the earliest one: the seconds that fewer transfers cost."""
    workspace = Workspace(spark, "direct")
    asked, starts, ends = _ends(spark, sf_dir, workspace)
    own = workspace.table(J.pairs(starts.where("seed"), ends.where("seed")).join(asked.select("query_id", "departure"), "query_id"), "pairs")
    labels = workspace.table(R.labels_from(spark, sf_dir, T.sources(own)), "all")
    chosen = J.best(own, labels, S.MOST_TRANSFERS).select("query_id", "transfers", "arr")
    first = own.join(labels.withColumnRenamed("k", "to_k"), ["from_k", "departure", "to_k"]).groupBy("query_id").agg(F.min("arr").alias("earliest"))
    return chosen.join(first, "query_id").select("query_id", "transfers", (F.col("arr") - F.col("earliest")).alias("later"))


def soonest_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark, "soonest")
    asked, starts, _ = _ends(spark, sf_dir, workspace)
    own = starts.select("query_id", F.col("k").alias("from_k")).join(asked.select("query_id", "departure", "to_k"), "query_id")
    own = workspace.table(own, "asked")
    return J.soonest(own, R.labels_from(spark, sf_dir, T.sources(own)))


def multi_departure_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every journey at each of the fixed offsets."""
    offset = F.explode(F.array(*map(F.lit, J.OFFSETS)))
    asked = T.journeys(spark, sf_dir).select("query_id", "from_k", "to_k", "departure", offset.alias("minutes")).withColumn("departure", F.col("departure") + F.col("minutes") * 60)
    labels = R.labels_from(spark, sf_dir, T.sources(asked)).withColumnRenamed("k", "to_k")
    return asked.join(labels, [*R.SOURCE, "to_k"], "left").select("query_id", "minutes", "departure", "transfers", "arr", (F.col("arr") - F.col("departure")).alias("seconds"))


def option_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark, "signatures")
    return J.signatures(_everywhere(spark, sf_dir, workspace), T.stop_times(spark, sf_dir)).select("query_id", "trip_id", "stop")


def next_departure_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark, "options")
    st = workspace.table(T.stop_times(spark, sf_dir), "times")
    return J.next_options(T.journeys(spark, sf_dir), lambda rows: _answers(spark, sf_dir, rows), st, workspace)


def resolved_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every journey by the steps tried in turn, then by static paths; the reason where nothing is found."""
    workspace = Workspace(spark, "resolve")
    asked, starts, ends = _ends(spark, sf_dir, workspace)
    edges = workspace.table(I.ride_edges(T.stop_times(spark, sf_dir)), "edges")
    begin = starts.select(F.col("k").alias("source"), F.col("k").alias("node")).distinct()
    static = S.shortest_paths(begin, edges, Workspace(spark, "resolve_static"))
    return J.resolve(asked, starts, ends, lambda sources, a: R.labels_from(spark, sf_dir, sources, most=a.transfers, scan=a.scan), static, workspace)


def merged_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    runs = _orders(spark, sf_dir).select(F.col("o_custkey").alias("query_id"), key.alias("run"), F.expr("shiftleft(8, cast(o_orderkey % 4 AS int))").alias("cap"), (key % 9).cast("int").alias("rounds_used"), (key % 5 == 0).alias("full"))
    return J.merged_diagnostics(runs)


def path_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, made = _segments(spark, sf_dir)
    return J.responses(answers, J.segment_payload(made, T.stops(spark, sf_dir)))


def transfer_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walks that follow the last ride of every journey that ends with one."""
    answers = _everywhere(spark, sf_dir, Workspace(spark, "expansion"))
    rode = answers.where(F.get(F.split("path", ">"), F.size(F.split("path", ">")) - 2) != "walk")
    rode = rode.select("query_id", "arr", F.element_at(F.split("path", ">"), -1).cast("int").alias("k"))
    walks = I.transfer_edges(T.stops(spark, sf_dir)).where(F.col("seconds") <= S.HOP_S)
    return rode.join(walks, rode["k"] == walks["src"]).select("query_id", "k", F.col("dst").alias("to_k"), (F.col("arr") + F.col("seconds")).alias("arr"), F.expr("(seconds * 3 + 1) div 2").alias("weighted"))


QUERIES = {
    "ingest_rows": ingest_rows,
    "stop_index": stop_index,
    "stop_first_coords": lambda s, d: G.stop_table(ingest_rows(s, d)),
    "trip_route_types": lambda s, d: G.trip_table(ingest_rows(s, d)),
    "clean_start_ids": clean_start_ids,
    "departure_texts": departure_texts,
    "walk_penalties": walk_penalties,
    "request_errors": request_errors,
    "destination_candidates": destination_candidates,
    "origin_candidates": origin_candidates,
    "candidate_tiers": candidate_tiers,
    "tier_candidates": tier_candidates,
    "nearest_stations": nearest_stations,
    "augmented_candidates": augmented_candidates,
    "static_path_segments": static_path_segments,
    "stop_stations": lambda s, d: P.stop_stations(T.stops(s, d)),
    "nearest_hubs": nearest_hubs,
    "station_backbone": station_backbone,
    "backbone_check": backbone_check,
    "fuzzy_stop_match": fuzzy_stop_match,
    "stops_like": stops_like,
    "walk_edges": walk_edges,
    "walk_snap_nodes": walk_snap_nodes,
    "walk_sssp_bounded": walk_sssp_bounded,
    "walk_targets": lambda s, d: W.targets(T.stops(s, d)),
    "walk_transfers": walk_transfers,
    "precomputed_transfers": lambda s, d: W.straight_transfers(T.stops(s, d)),
    "raptor_itineraries": raptor_itineraries,
    "segment_payload": segment_payload,
    "walk_legs": walk_legs,
    "itinerary_profile": itinerary_profile,
    "transfer_counts": transfer_counts,
    "raptor_transfer_cap": raptor_transfer_cap,
    "best_od_option": best_od_option,
    "direct_preference": direct_preference,
    "soonest_start": soonest_start,
    "multi_departure_options": multi_departure_options,
    "option_signature": option_signature,
    "next_departure_options": next_departure_options,
    "resolved_journeys": resolved_journeys,
    "merged_diagnostics": merged_diagnostics,
    "path_responses": path_responses,
    "transfer_expansion": transfer_expansion,
}
