"""Operators over places, walks and journeys on small tables whose outcomes are known."""

import difflib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from railloom.functions import columns as C
from railloom.operators import indexes, ingest, journeys, places, search, walking
from railloom.plans import answers
from railloom.sources import store
from railloom.workspace import Workspace

SF = "/root/testdata/sf0.001"


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text, kind", [(" Rail ", 2), ("s-bahn", 2), ("light_rail", 0), ("coach", 3), ("boat", 4), ("lift", 6), ("-3", -3), ("2.7", 2), ("", -1), ("zeppelin", -1), (None, -1), ("1e99", -1)]
)
def test_route_types(spark, text, kind):
    assert one(spark, text, "string", C.route_type) == kind


def test_times_and_numbers(spark):
    assert [one(spark, x, "string", C.departure_text) for x in ("1738580100", " 300 ", "2025-02-03T10:55:00", "2025-02-03 07:00:01", "soon", None, "-5")] == [39300, 300, 39300, 25201, None, None, -5]
    assert one(spark, 1738580100, "long", lambda x: C.departure_seconds(x, 3600)) == 42900 and one(spark, 12.9, "double", C.time_number) == 12
    assert [one(spark, x, "long", C.walk_score_penalty) for x in (101, 2000, -5)] == [50, 450, 0]
    assert [one(spark, x, "string", lambda c: C.number_or(c, 7.0)) for x in ("1.5", "x", None)] == [1.5, 7.0, 7.0]
    assert [one(spark, x, "double", C.known) for x in (float("nan"), 2.0, None)] == [None, 2.0, None]
    assert [one(spark, x, "double", lambda c: C.walking_speed_kmh(c, F.lit(60))) for x in (84.0, 0.0)] == [5.04, None]


def test_clean_ids(spark):
    assert one(spark, [" B ", "A", "", "B"], "array<string>", lambda x: ingest.clean_ids("x")) == ["B", "A"]


def test_dense_keys(spark):
    rows = spark.createDataFrame([(f"s{i % 37:02d}",) for i in range(500)], "s string").repartition(7)
    got = sorted(map(tuple, ingest.dense_keys(rows, "s", Workspace(spark, "t"), "s").collect()))
    assert got == [(f"s{i:02d}", i) for i in range(37)]


@pytest.mark.parametrize("count, start, tiers", [(12, 2, [2, 4, 8, 12]), (2, 1, [1, 2]), (3, 6, [3]), (0, 2, []), (100, 3, [3, 6, 12, 100])])
def test_tiers(spark, count, start, tiers):
    assert spark.range(1).select(places.tier_sizes(F.lit(count), F.lit(start)).alias("t")).first().t == tiers


def test_nearest_however_far(spark):
    stops = spark.createDataFrame([(i, f"S{i}", 46.5 + i * 0.01, 6.6) for i in range(30)] + [(99, "x", None, None), (98, "y", float("nan"), 1.0)], "k int, stop_id string, lat double, lon double")
    points = spark.createDataFrame([(1, 46.5, 6.6), (2, 47.9, 6.6), (3, -33.0, 151.0), (4, 46.55, 6.6004)], "point long, lat double, lon double")
    got = {}
    for r in places.nearest(points, stops, 3, Workspace(spark, "t")).orderBy("n").collect():
        got.setdefault(r.point, []).append(r.k)
    assert got[1] == [0, 1, 2] and got[2] == [29, 28, 27] and got[4][0] == 5 and set(got[4]) == {4, 5, 6} and len(got[3]) == 3
    far = places.candidates(points, stops, Workspace(spark, "t"), radius=1200.0, far=True, seeds=1).collect()
    assert {r.point for r in far} == {1, 2, 3, 4} and sum(r.point == 2 for r in far) == 12 and {(r.k, r.penalty) for r in far if r.point == 1 and r.seed} == {(0, 0)}
    near = places.candidates(points, stops, Workspace(spark, "t"), radius=1200.0)
    assert {r.point for r in near.collect()} == {1, 4}


def test_connections_outrank_distance_at_the_origin(spark):
    stops = spark.createDataFrame([(0, "A", 46.5, 6.6), (1, "B", 46.501, 6.6)], "k int, stop_id string, lat double, lon double")
    points = spark.createDataFrame([(1, 46.5, 6.6)], "point long, lat double, lon double")
    degrees = spark.createDataFrame([(1, 2)], "k int, degree long")
    ranked = places.candidates(points, stops, Workspace(spark, "t"), degrees, seeds=1).orderBy("n").collect()
    assert [(r.k, r.seed) for r in ranked] == [(1, True), (0, False)]


def test_snapping_rings_and_beyond(spark):
    stops = spark.createDataFrame([(0, 46.505, 6.605), (1, 46.505, 6.699), (2, 10.0, 10.0), (3, None, None)], "k int, lat double, lon double")
    nodes = spark.createDataFrame([(7, 46.5099, 6.6099), (8, 46.5101, 6.605), (9, 46.505, 6.6901 - 0.03)], "node long, lat double, lon double")
    got = dict(map(tuple, walking.snap(stops, nodes, Workspace(spark, "t")).collect()))
    assert got[0] == 7 and got[1] == 9 and set(got) == {0, 1, 2}  # the ring of the cell counts before the distance


def test_far_stops_snap_to_the_nearest_of_all_in_time(spark):
    # a long row of stops far from a block of nodes, and stops all over the globe
    rng = random.Random(5)
    stops = [(i, 46.5 + i % 10 * 0.0009, 7.0 + i // 10 * 0.0009) for i in range(8000)]
    stops += [(10_000 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    nodes = [(i, 46.4995 + i % 45 * 0.0009, 6.5995 + i // 45 * 0.0009) for i in range(9000)] + [(20_000, -85.0, -179.9), (20_001, 89.0, 100.0), (20_002, 0.0, 179.9)]
    began = time.perf_counter()
    made = walking.snap(spark.createDataFrame(stops, "k int, lat double, lon double"), spark.createDataFrame(nodes, "node long, lat double, lon double"), Workspace(spark, "t"))
    got = dict(map(tuple, made.collect()))
    assert time.perf_counter() - began < 60 and len(got) == len(stops)

    def meters(a, b):
        half = lambda x, y: math.sin(math.radians(y - x) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(math.sqrt(half(a[1], b[1]) + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * half(a[2], b[2])))

    by_id = {n[0]: n for n in nodes}
    for s in stops[5000:8000:250] + stops[8000:]:
        assert meters(s, by_id[got[s[0]]]) <= min(meters(s, n) for n in nodes) + 1e-5


def test_walks_over_a_graph(spark):
    ways = spark.createDataFrame([(1, 2, 70.0), (2, 1, 140.0), (2, 3, 0.5), (3, 3, 5.0), (3, 4, 1400.0)], "a long, b long, meters double")
    edges = walking.walk_edges(ways)
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 50), (2, 1, 50), (2, 3, 1), (3, 2, 1), (3, 4, 1000), (4, 3, 1000)]
    walks = walking.bounded_walks(spark.createDataFrame([(1,), (1,)], "node long"), edges, Workspace(spark, "t"), 600)
    assert sorted((r.node, r.seconds, r.path) for r in walks.collect()) == [(1, 0, "1"), (2, 50, "1>2"), (3, 51, "1>2>3")]
    pairs = spark.createDataFrame([(10, 11), (10, 12), (10, 13)], "src int, dst int")
    snapped = spark.createDataFrame([(10, 1), (11, 3), (12, 4), (13, 1)], "k int, node long")
    assert sorted(map(tuple, walking.walk_transfers(pairs, snapped, walks, 600).collect())) == [(10, 11, 51), (10, 13, 30)]


def named(spark):
    return spark.createDataFrame([(0, "A1", "Lausanne Gare"), (1, "A2", "Lausanne Ours"), (2, "A3", "Echallens Gare"), (3, "b4", None), (4, "B4", "Zoo")], "k int, stop_id string, name string")


@pytest.mark.parametrize(
    "query, kind, k", [("A1", "exact_stop_id", 0), (" a2 ", "casefold_stop_id", 1), ("LAUSANNE-gare", "normalized_exact", 0), ("lausanne our", "fuzzy", 1), ("echalens gare", "fuzzy", 2), ("lausanne", None, None), ("zzzz impossible stop", None, None), ("b4", "exact_stop_id", 3)]
)
def test_stops_by_name(spark, query, kind, k):
    got = places.find_stops(spark.createDataFrame([(query,)], "query string"), named(spark)).first()
    assert (got.match_type, got.k) == (kind, k)


def test_lookup_matches_plain_loops(spark):
    rows = answers._named(spark, SF).collect()
    asked = [r.query for r in answers.fuzzy_stop_match(spark, SF).collect()]
    got = {r.query: (r.match_type, r.k) for r in answers.fuzzy_stop_match(spark, SF).collect()}
    norm = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    ids = {r.stop_id: r.k for r in rows}
    labels = [(norm(x), r.k, x) for r in rows for x in (r.stop_id, r.name)]
    assert len(asked) == len(set(asked)) == 10
    for q in asked:
        want = (None, None)
        if q in ids:
            want = "exact_stop_id", ids[q]
        elif q.lower() in {i.lower(): k for i, k in ids.items()}:
            want = "casefold_stop_id", {i.lower(): k for i, k in ids.items()}[q.lower()]
        elif norm(q) in {x for x, _, _ in labels}:
            want = "normalized_exact", min(k for x, k, _ in labels if x == norm(q))
        else:
            scored = []
            for x, k, label in labels:
                s = 0.97 if norm(q) in x else 0.95 if all(any(p.startswith(w) for p in x.split(" ")) for w in norm(q).split(" ")) else difflib.SequenceMatcher(None, norm(q), x).ratio()
                if s >= 0.8:
                    scored.append((-s, len(label), k))
            scored.sort()
            if scored and -scored[0][0] >= 0.86 and not (len(scored) > 1 and -scored[1][0] >= 0.86 and scored[1][0] - scored[0][0] < 0.02 and scored[1][2] != scored[0][2]):
                want = "fuzzy", scored[0][2]
        assert got[q] == want, q


def test_many_names_are_looked_up_in_time(spark):
    # as many pairs as brute force takes minutes for
    names = [(i, f"P{i}", f"{'red blue cold'.split()[i % 3]} {'bolt ring gear plate'.split()[i % 4]} {i}") for i in range(20_000)]
    asked = [(("z" + n[1:]) if k % 2 else n[2:],) for k, _, n in names[:3000]]
    began = time.perf_counter()
    made = places.find_stops(spark.createDataFrame(asked, "query string"), spark.createDataFrame(names, "k int, stop_id string, name string"))
    got = {r.query: (r.match_type, r.k) for r in made.collect()}
    assert time.perf_counter() - began < 90 and len(got) == len(set(asked))
    assert got["zlue ring 2101"] == ("fuzzy", 2101)


def line(spark, n=14):
    times = [x for i in range(n - 1) for x in ((f"T{i}", i, 1000 + 120 * i, 1), (f"T{i}", i + 1, 1060 + 120 * i, 2))]
    return spark.createDataFrame(times, "trip_id string, k int, t long, seq int")


def searcher(spark, st, most=4):
    factors = st.select("trip_id").distinct().withColumn("cost_factor", F.lit(1000).cast("long")).withColumn("route_type", F.lit(3))
    walks = spark.createDataFrame([], "src int, dst int, seconds long")
    return lambda sources, m=most, scan=6: search.label_rounds(sources, indexes.routes(st), factors, walks, Workspace(spark, "t"), most=m, scan=scan)


def test_attempts_widen_until_one_answers(spark):
    st = line(spark)
    find = searcher(spark, st)
    asked = spark.createDataFrame([(1, 0, 5, 900), (2, 0, 7, 900), (3, 0, 13, 900), (4, 5, 0, 900)], "query_id long, from_k int, to_k int, departure long")
    ends = lambda c: asked.select("query_id", F.col(c).alias("k"), F.lit(1).alias("n"), F.lit(0).cast("long").alias("penalty"))
    static = search.shortest_paths(asked.select(F.col("from_k").alias("source"), F.col("from_k").alias("node")).distinct(), indexes.ride_edges(st), Workspace(spark, "t"))
    got = {r.query_id: r for r in journeys.resolve(asked, ends("from_k"), ends("to_k"), lambda s, a: find(s, a.transfers, a.scan), static, Workspace(spark, "t")).collect()}
    assert (got[1].attempt, got[1].transfers, got[1].runs) == ("seeds", 4, 1) and (got[2].attempt, got[2].transfers, got[2].runs) == ("transfers", 6, 4)
    assert got[3].fallback_used and got[3].resolver == "dijkstra" and got[3].arr == 900 + 13 * 60
    assert got[4].resolver is None and got[4].reason == "no_path_within_candidate_budget" and not got[4].fallback_used


def test_options_begin_with_other_rides(spark):
    times = [x for i in range(6) for x in ((f"T{i}", 0, 1000 + 700 * i, 1), (f"T{i}", 1, 1100 + 700 * i, 2))]
    st = spark.createDataFrame(times, "trip_id string, k int, t long, seq int")
    find = searcher(spark, st)

    def answer(rows):
        labels = find(rows.select("from_k", "departure").distinct())
        return rows.select("query_id", "from_k", "departure", F.col("to_k").alias("k")).join(labels, ["from_k", "departure", "k"]).select("query_id", "departure", "transfers", "arr", "path")

    asked = spark.createDataFrame([(1, 0, 1, 900)], "query_id long, from_k int, to_k int, departure long")
    got = [(r.option, r.departure, r.arr) for r in journeys.next_options(asked, answer, st, Workspace(spark, "t")).orderBy("option").collect()]
    assert got == [(1, 900, 1100), (2, 1200, 1800), (3, 2100, 2500)]


def test_segments_list_every_stop(spark):
    st = spark.createDataFrame([("T", 0, 1000, 1), ("T", 1, 1100, 2), ("T", 2, 1200, 3), ("U", 3, 1300, 1), ("U", 4, 1400, 2)], "trip_id string, k int, t long, seq int")
    walks = spark.createDataFrame([(9, 0, 40), (2, 3, 50), (4, 5, 60)], "src int, dst int, seconds long")
    asked = spark.createDataFrame([(1, 900, "9>walk>0>T:1-3>2>walk>3>U:1-2>4>walk>5"), (2, 900, "7")], "query_id long, departure long, path string")
    made = journeys.segments(asked, st, walks)
    got = [(r.pos, r.trip_id, r.source, r.k, r.arrival) for r in made.orderBy("pos").collect()]
    assert got == [(1, "TRANSFER", 9, 0, 940), (2, "T", 0, 1, 1100), (3, "T", 1, 2, 1200), (4, "TRANSFER", 2, 3, 1250), (5, "U", 3, 4, 1400), (6, "TRANSFER", 4, 5, 1460)]
    stops = spark.createDataFrame([(k, f"S{k}", 46.5 + k * 0.001, 6.6) for k in range(10)], "k int, stop_id string, lat double, lon double")
    feet = journeys.walk_legs(journeys.segment_payload(made, stops), asked).orderBy("pos").collect()
    assert [(r.kind, r.seconds) for r in feet] == [("access", 40), ("transfer", 50), ("egress", 60)] and feet[0].geometry == [[6.6, 46.5 + 9 * 0.001], [6.6, 46.5]]
    factors = spark.createDataFrame([("T", 3, 2000), ("U", -1, 1500)], "trip_id string, route_type int, cost_factor long")
    p = journeys.profiles(made, factors).first()
    assert (p.ride_segments, p.trips, p.changes, p.walks, p.unknown_share, p.route_type, p.cost_factor) == (3, 2, 1, 3, 0.5, "-1:1,3:1", "1500:1,2000:1")
    signed = {r.query_id: (r.trip_id, r.stop) for r in journeys.signatures(asked, st).collect()}
    assert signed == {1: ("T", 1), 2: ("NONE", None)}


def test_the_best_candidate(spark):
    schema = "query_id long, departure long, from_k int, to_k int, access long, egress long, order struct<n_a: int, n_b: int>"
    asked = spark.createDataFrame([(1, 900, 0, 5, 0, 0, (1, 1)), (1, 900, 0, 6, 0, 800, (1, 2)), (1, 900, 1, 5, 0, 0, (2, 1))], schema)
    labels = spark.createDataFrame([(0, 900, 5, 1, 1000, "0>a:1-2>3>b:1-2>5"), (0, 900, 6, 0, 1700, "0>a:1-3>6"), (1, 900, 5, 5, 950, "x")], "from_k int, departure long, k int, transfers int, arr long, path string")
    got = journeys.best(asked, labels, 4).first()
    assert (got.transfers, got.arr, got.to_k, got.score) == (0, 1700, 6, 1700 + 400)
    assert journeys.soonest(asked, labels).first().arr == 1700


def test_round_budgets():
    assert journeys.round_budgets(3) == (8, 16, 24) and journeys.round_budgets(10_000) == (8, 16, 32, 64) and journeys.round_budgets(900) == (8, 16, 32, 38)


def test_index_store(spark, tmp_path):
    _, stops = store.mock_network(spark)
    built = []
    build = lambda: built.append(1) or indexes.transfer_edges(stops)
    kept = store.IndexStore(spark, str(tmp_path))
    want = sorted(map(tuple, build().collect()))
    assert want == [(0, 1, 52), (1, 0, 52), (1, 2, 61), (2, 1, 61)]
    for _ in range(2):
        assert sorted(map(tuple, kept.ensure("transfers", build, stops, "v1").collect())) == want
    assert len(built) == 2
    assert kept.load("transfers", stops, "v2") is None and kept.load("transfers", stops.where("k > 0"), "v1") is None and kept.load("none", stops) is None
    assert kept.load("transfers", stops, "v1", max_age=-1) is None and kept.load("transfers", stops, "v1", max_age=600) is not None
    asked = []
    work = lambda keys: asked.append(1) or keys.select("k", (F.col("k") * 2).alias("double"))
    for _ in range(2):
        assert sorted(map(tuple, kept.resume("doubled", stops, "k", work, stops, parts=3).collect())) == [(0, 0), (1, 2), (2, 4)]
    assert len(asked) == 3
    name, table = store.first_of([("cache", lambda: kept.load("none", stops)), ("graph", lambda: 1 / 0), ("mock", lambda: stops)])
    assert name == "mock" and table.count() == 3
    with pytest.raises(ValueError, match="graph: division"):
        store.first_of([("graph", lambda: 1 / 0)])


def test_settings():
    assert [store.flag(x, True) for x in ("yes", " OFF ", "", None, "maybe")] == [True, False, True, True, True]
    assert store.whole(" 7 ", 1) == 7 and store.whole("x", 1) == 1 and store.positive("2.5", 1) == 2.5 and store.positive("-1", 1) == 1
    there = lambda p: p == "/old"
    assert [store.choose_path("V", c, "/old", there, e) for c, e in (("/c", {"V": "/v"}), ("/c", {}), (None, {}))] == ["/v", "/c", "/old"]
    assert store.choose_path("V", None, "/new", there, {}) is None


def test_quantiles_and_ranks(spark):
    values = [float((i * 37) % 101) for i in range(101)] + [5.0] * 30
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(5)
    import numpy as np

    want = np.quantile(values, [0, 0.005, 0.3, 0.995, 1]).tolist()
    assert ingest.quantiles(df, "x", [0, 0.005, 0.3, 0.995, 1], Workspace(spark, "t")) == pytest.approx(want)
    assert ingest.quantiles(df.where("x IS NULL"), "x", [0.5], Workspace(spark, "t")) == [None]


def test_monotonic_across_half_hours(spark):
    def flag(*times):
        st = spark.createDataFrame([x for i, (a, b) in enumerate(times) for x in ((f"T{i}", "A", a, 1), (f"T{i}", "B", b, 2))], "trip_id string, k string, t long, seq int")
        return {r.seq: (r.monotonic, r.n_trips) for r in indexes.board_monotonic(st, "k").collect()}

    assert flag((0, 100), (1700, 1900), (1900, 1950)) == {1: (True, 3), 2: (True, 3)}
    assert flag((0, 100), (1700, 2500), (1900, 2400)) == {1: (True, 3), 2: (False, 3)}
    assert flag((0, 100), (10, 90), (4000, 4100)) == {1: (True, 3), 2: (False, 3)}


def test_further_stops_rank_after_the_candidates(spark):
    near = spark.createDataFrame([(1, 4, 1, True, 0), (1, 5, 2, False, 30)], "point long, k int, n int, seed boolean, penalty long")
    more = spark.createDataFrame([(1, 9, 80), (1, 5, 30), (1, 8, 60), (1, 9, 80), (2, 7, 5)], "point long, k int, penalty long")
    got = sorted((r.point, r.n, r.k, r.seed) for r in places.appended(near, more).collect())
    assert got == [(1, 1, 4, True), (1, 2, 5, False), (1, 3, 8, False), (1, 4, 9, False), (2, 1, 7, False)]
    here = spark.createDataFrame([(1, 46.5, 6.6), (2, 46.5, 6.6)], "point long, lat double, lon double")
    there = spark.createDataFrame([(1, 46.6, 6.6), (2, 46.9, 6.6)], "point long, lat double, lon double")
    assert [r.point for r in places.far_apart(here, there).collect()] == [2]


def test_a_long_journey_finds_its_station(spark):
    st = line(spark, 4)
    find = searcher(spark, st)
    asked = spark.createDataFrame([(1, 900)], "query_id long, departure long")
    one_stop = lambda k: spark.createDataFrame([(1, k, 1, True, 0)], "point long, k int, n int, seed boolean, penalty long")
    more = spark.createDataFrame([(1, 0, 200)], "point long, k int, penalty long")
    starts = places.appended(one_stop(77), more).withColumnRenamed("point", "query_id")
    ends = one_stop(3).withColumnRenamed("point", "query_id")
    nothing = spark.createDataFrame([], "source int, node int, seconds long")
    steps = (journeys.Attempt("seeds", 1, 1), *journeys.LONG_ATTEMPTS, journeys.LAST_ATTEMPT)
    got = journeys.resolve(asked, starts, ends, lambda s, a: find(s, a.transfers, a.scan), nothing, Workspace(spark, "t"), steps).first()
    assert (got.attempt, got.from_k, got.transfers, got.runs) == ("hubs", 0, 2, 2)
