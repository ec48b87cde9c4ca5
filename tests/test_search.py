"""Search rounds on small networks whose outcomes are known."""

import pytest
from pyspark.sql import functions as F

from railloom.operators import indexes, search
from railloom.workspace import Workspace


def labels(spark, times, kinds, walks, start, departure, penalty=3600, most=4):
    """times: (trip, stop, t, seq)."""
    st = spark.createDataFrame([(t, ord(s[0]) if len(s) == 1 else int(s[1:]), at, seq) for t, s, at, seq in times], "trip_id string, k int, t long, seq int")
    trips = indexes.routes(st)
    factors = spark.createDataFrame(list(kinds.items()), "trip_id string, cost_factor long")
    edges = spark.createDataFrame([(ord(a), ord(b), s) for a, b, s in walks], "src int, dst int, seconds long")
    asked = spark.createDataFrame([(ord(start[0]) if len(start) == 1 else int(start[1:]), departure)], "from_k int, departure long")
    made = search.label_rounds(asked, trips, factors, edges, Workspace(spark, "t"), penalty, most)
    return {(chr(r.k) if len(start) == 1 else f"S{r.k}"): (r.transfers, r.cost, r.walk, r.arr) for r in made.collect()}


MOCK = [("T1", "A", 1000, 1), ("T1", "B", 1050, 2), ("T2", "B", 1060, 1), ("T2", "C", 1100, 2)]
MOCK_WALKS = [("A", "B", 52), ("B", "A", 52), ("B", "C", 61), ("C", "B", 61)]


@pytest.mark.parametrize("penalty, cost", [(300, 1426000), (3600, 4726000)])
def test_walk_then_ride(spark, penalty, cost):
    # every walk pays the penalty, the one at the start too; boarding in the first round does not
    got = labels(spark, MOCK, {"T1": 2000, "T2": 1000}, MOCK_WALKS, "A", 900, penalty)
    assert got["C"][0] == 0 and got["C"][2:] == (52, 1100)
    assert got["A"] == (0, 900000, 0, 900) and got["C"] == (0, cost, 52, 1100)


def linear(n):
    return [x for i in range(n - 1) for x in ((f"T{i}", f"S{i}", 1000 + 120 * i, 1), (f"T{i}", f"S{i + 1}", 1060 + 120 * i, 2))]


def test_transfer_cap_on_a_line(spark):
    kinds = {f"T{i}": 1000 for i in range(13)}
    assert labels(spark, linear(14), kinds, [], "S0", 900, most=12)["S13"] == (12, 45580000, 0, 2500)
    capped = labels(spark, linear(14), kinds, [], "S0", 900, most=2)
    assert "S13" not in capped and capped["S3"][0] == 2
    assert set(labels(spark, linear(14), kinds, [], "S0", 5000)) == {"S0"}


def test_cheaper_mode_wins(spark):
    times = [("BUS", "A", 1000, 1), ("BUS", "C", 1200, 2), ("TRAIN", "A", 1030, 1), ("TRAIN", "C", 1250, 2)]
    assert labels(spark, times, {"BUS": 2000, "TRAIN": 1000}, [], "A", 900)["C"] == (0, 1250000, 0, 1250)


def test_shuttle_after_train(spark):
    times = [("TR", "A", 900, 1), ("TR", "B", 1000, 2), ("BUS", "B", 1100, 1), ("BUS", "C", 1200, 2)]
    assert labels(spark, times, {"TR": 1000, "BUS": 2000}, [], "A", 850)["C"] == (1, 4890000, 0, 1200)


def test_static_paths_on_the_mock(spark):
    edges = spark.createDataFrame([("A", "B", 50), ("B", "C", 40), ("A", "C", 200)], "src string, dst string, seconds long")
    start = spark.createDataFrame([("A", "A")], "source string, node string")
    by_time = {r.node: (r.hops, r.seconds) for r in search.shortest_paths(start, edges, Workspace(spark, "t"), 5).collect()}
    by_hops = {r.node: (r.hops, r.seconds) for r in search.shortest_paths(start, edges, Workspace(spark, "t"), 5, True).collect()}
    assert by_time == {"A": (0, 0), "B": (1, 50), "C": (2, 90)} and by_hops["C"] == (1, 200)
    assert {r.node: r.path for r in search.shortest_paths(start, edges, Workspace(spark, "t")).collect()}["C"] == "A>B>C"
    assert {r.node for r in search.shortest_paths(start, edges, Workspace(spark, "t"), most=60).collect()} == {"A", "B"}


def test_registered_labels_reach_destinations(spark):
    from railloom.plans import registry

    row = registry.QUERIES["reliability_rates"](spark, "/root/testdata/sf0.001").first()
    assert row.n_requests > 0 and row.found_rate >= 0.95 and row.fallback_rate <= 0.8
    assert registry.QUERIES["raptor_labels"](spark, "/root/testdata/sf0.001").where(F.col("transfers") > 0).count() > 0
