"""The registered labels against plain loops over all events."""

import heapq
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from railloom.operators import indexes
from railloom.plans import registry
from railloom.sources import timetable

SMOKE = "/root/testdata/sf0.001"


class Plain:
    """Label rounds of one source at a time, over dicts."""

    def __init__(self, spark, st, sf, penalty=3600, most=4, scan=6):
        self.penalty, self.most, self.scan, self.buffer = penalty, most, scan, min(10, penalty // 60)
        self.trips, self.boards, self.walks = defaultdict(list), defaultdict(lambda: defaultdict(list)), defaultdict(list)
        for r in sorted(st.select("trip_id", "seq", "k", "t").collect()):
            self.trips[r.trip_id].append((r.seq, r.k, r.t))
        for trip, own in self.trips.items():
            for seq, k, t in own:
                self.boards[k][tuple(x[1] for x in own), seq].append((t, trip))
        self.monotonic = {}
        for at in self.boards.values():
            for (pattern, seq), times in at.items():
                ranked = [t for _, trip, t in sorted((self.trips[trip][0][2], trip, t) for t, trip in times)]
                self.monotonic[pattern, seq] = all(a <= b for a, b in zip(ranked, ranked[1:]))
        self.factors = {r.trip_id: r.cost_factor for r in indexes.trip_factors(st, timetable.stops(spark, sf)).collect()}
        for r in indexes.transfer_edges(timetable.stops(spark, sf)).where("seconds <= 180").collect():
            self.walks[r.src].append((r.dst, r.seconds))

    def walk(self, k, label, penalty):
        cost, walked, arr, path = label
        for dst, s in self.walks[k]:
            if walked + s <= 600:
                yield dst, (cost + (s * 3 + 1) // 2 * 1000 + penalty * 1000, walked + s, arr + s, f"{path}>walk>{dst}")

    def labels(self, source, departure):
        start = (departure * 1000, 0, departure, str(source))
        access = dict(self.walk(source, start, self.penalty))
        settled, frontier = {source: (0, *start)}, {source: start} | access
        for r in range(self.most + 1):
            reached = {k: (*label, False) for k, label in access.items()} if r == 0 else {}
            for k, (cost, walked, arr, path) in frontier.items():
                ready = arr + (self.buffer if r else 0)
                for (pattern, seq), times in self.boards[k].items():
                    for t, trip in sorted(x for x in times if x[0] >= ready)[: self.scan if self.monotonic[pattern, seq] else None]:
                        on = cost + (t - ready) * 1000 + (self.penalty * 1000 if r else 0)
                        for to_seq, to, at in self.trips[trip][seq:]:
                            new = (on + max(0, at - t) * self.factors[trip], walked, at, f"{path}>{trip}:{seq}-{to_seq}>{to}", True)
                            reached[to] = min(new, reached.get(to, new))
            both = fresh = {k: x for k, x in reached.items() if k not in settled}
            both = dict(both)
            for k, x in fresh.items():
                for to, label in self.walk(k, x[:4], self.penalty) if x[4] else ():
                    if to not in settled:
                        both[to] = min((*label, False), both.get(to, (*label, False)))
            frontier = {k: x[:4] for k, x in both.items() if r or k not in access or x[3] != access[k][3]}
            settled |= {k: (r, *x[:4]) for k, x in both.items()}
            if not both:
                break
        return settled


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The smallest tables, their users counted from 15 on."""
    made = str(tmp_path_factory.mktemp("labels"))
    spark.read.parquet(f"{SMOKE}/events.parquet").withColumn("user_id", F.col("user_id") + 15).write.parquet(f"{made}/events.parquet")
    for name in ("orders", "customer"):
        spark.read.parquet(f"{SMOKE}/{name}.parquet").write.parquet(f"{made}/{name}.parquet")
    return made


@pytest.fixture(scope="module")
def plain(spark, sf_dir):
    return Plain(spark, timetable.stop_times(spark, sf_dir).cache(), sf_dir)


@pytest.fixture(scope="module")
def made(spark, sf_dir):
    return registry.QUERIES["raptor_labels"](spark, sf_dir).cache()


def test_labels_use_the_trips_of_all_users_for_every_order(spark, sf_dir, plain, made):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    asked = {o.o_orderkey: (o.o_custkey % 100, o.o_orderkey * 7 % 100, 28800 + o.o_orderkey % 8 * 1800) for o in orders}
    asked = {q: x for q, x in asked.items() if x[0] != x[1]}
    want = {source: plain.labels(*source) for source in {(a, dep) for a, _, dep in asked.values()}}
    got = defaultdict(dict)
    for r in made.collect():
        assert r.k not in got[r.from_k, r.departure]
        got[r.from_k, r.departure][r.k] = (r.transfers, r.cost, r.walk, r.arr, r.path)
    assert got == want
    rate = registry.QUERIES["reliability_rates"](spark, sf_dir).first()
    static = {(r.source, r.node) for r in registry.QUERIES["static_shortest_path"](spark, sf_dir).collect()}
    found = sum(to in want[a, dep] or (a, to) in static for a, to, dep in asked.values())
    late = sum(to not in want[a, dep] and (a, to) in static for a, to, dep in asked.values())
    assert (rate.n_requests, rate.found_rate, rate.fallback_rate) == (len(asked), pytest.approx(found / len(asked), abs=1e-6), pytest.approx(late / len(asked), abs=1e-6))


def test_static_paths_match_dijkstra(spark, sf_dir):
    edges = defaultdict(list)
    for r in registry.QUERIES["ride_edges"](spark, sf_dir).collect():
        edges[r.src].append((r.dst, r.seconds))
    got = defaultdict(dict)
    for r in registry.QUERIES["static_shortest_path"](spark, sf_dir).collect():
        got[r.source][r.node] = r.seconds
        legs = [int(x) for x in r.path.split(">")]
        assert legs[0] == r.source and legs[-1] == r.node and len(legs) == r.hops + 1
        assert sum(min(s for d, s in edges[a] if d == b) for a, b in zip(legs, legs[1:])) == r.seconds
    for source, labels in got.items():
        best, heap = {}, [(0, source)]
        while heap:
            seconds, node = heapq.heappop(heap)
            if node not in best:
                best[node] = seconds
                for dst, s in edges[node]:
                    heapq.heappush(heap, (seconds + s, dst))
        assert labels == best
