"""From labels to journeys: segments, profiles, the choice between candidates, options, and the steps tried in turn."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railloom.functions import columns as C
from railloom.workspace import Workspace

TRANSFER_S, WALK_SEGMENT_S = 3600, 900
OFFSETS = (0, 10, 20, 30, 40)
#: Seconds after the last option at which the next one is looked for: steps that double up to half an hour, for an hour and a half.
PROBES = (300, 900, 2100, 3900)
_RIDE = r"^(.*):(\d+)-(\d+)$"


def legs(answers: DataFrame) -> DataFrame:
    """The legs of each path, in order: query_id, departure, leg, source, target, and trip, board and alight of rides."""
    tokens = F.split("path", ">")
    n = (F.size(tokens) - 1) / 2
    numbers = F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = answers.select("query_id", "departure", tokens.alias("t"), F.explode(numbers).alias("leg"))
    what = F.element_at("t", F.col("leg") * 2)
    part = lambda i: F.when(what != "walk", F.regexp_extract(what, _RIDE, i))
    return rows.select(
        "query_id", "departure", "leg", F.element_at("t", F.col("leg") * 2 - 1).cast("int").alias("source"), F.element_at("t", F.col("leg") * 2 + 1).cast("int").alias("target"),
        part(1).alias("trip_id"), part(2).cast("int").alias("board"), part(3).cast("int").alias("alight"),
    )


def segments(answers: DataFrame, stop_times: DataFrame, walks: DataFrame) -> DataFrame:
    """(query_id, pos, leg, trip_id, source, k, arrival): every stop that a journey reaches; walks are TRANSFER.

    ``answers``: query_id, departure, path. A ride lists all stops from the one after boarding.
    """
    made = legs(answers)
    st = stop_times.select("trip_id", "seq", F.col("k").alias("stop"), "t")
    rides = made.where("trip_id IS NOT NULL").join(st, "trip_id").where("seq > board AND seq <= alight")
    rides = rides.select("query_id", "departure", "leg", "seq", "trip_id", F.col("stop").alias("k"), F.col("t").alias("arrival"))
    ends = rides.groupBy("query_id", "leg").agg(F.max_by("arrival", "seq").alias("left_at")).withColumn("leg", F.col("leg") + 1)
    on_foot = made.where("trip_id IS NULL").join(walks, (F.col("source") == walks["src"]) & (F.col("target") == walks["dst"])).join(ends, ["query_id", "leg"], "left")
    on_foot = on_foot.select("query_id", "departure", "leg", F.lit(0).alias("seq"), F.lit("TRANSFER").alias("trip_id"), F.col("target").alias("k"), (F.coalesce("left_at", "departure") + F.col("seconds")).alias("arrival"))
    order = Window.partitionBy("query_id").orderBy("leg", "seq")
    begins = answers.select("query_id", F.split("path", ">")[0].cast("int").alias("begin"))
    rows = rides.unionByName(on_foot).join(begins, "query_id")
    return rows.select("query_id", F.row_number().over(order).alias("pos"), "leg", "trip_id", F.coalesce(F.lag("k").over(order), F.col("begin")).alias("source"), "k", "arrival")


def static_segments(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, node, pos, k, trip_id, seconds): every stop of a static path, the trip that is quickest to it, and the seconds until then.

    ``paths``: source, node, path. ``edges``: src, dst, seconds, trip_id.
    """
    stops = paths.select("source", "node", F.split("path", ">").alias("t"), F.posexplode(F.split("path", ">")).alias("pos", "k")).where("pos > 0")
    steps = stops.select("source", "node", "pos", F.element_at("t", F.col("pos")).cast("int").alias("src"), F.col("k").cast("int").alias("k"))
    met = steps.join(edges.withColumnRenamed("dst", "k"), ["src", "k"])
    upto = F.sum("seconds").over(Window.partitionBy("source", "node").orderBy("pos"))
    return met.select("source", "node", "pos", "k", "trip_id", upto.alias("seconds"))


def segment_payload(made: DataFrame, stops: DataFrame) -> DataFrame:
    """Segments with the ids and places of their stops; places that are not known are null."""
    at = stops.select("k", "stop_id", C.known(F.col("lat")).alias("lat"), C.known(F.col("lon")).alias("lon"))
    origin = at.select(F.col("k").alias("source"), F.col("stop_id").alias("from_stop_id"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"))
    return made.join(at, "k", "left").join(origin, "source", "left")


def walk_legs(payload: DataFrame, answers: DataFrame) -> DataFrame:
    """The walks of each journey: kind by place in the journey, seconds, meters and line as the crow flies, speed."""
    order = Window.partitionBy("query_id").orderBy("pos")
    rows = payload.join(answers.select("query_id", "departure"), "query_id")
    rows = rows.withColumns({"before": F.coalesce(F.lag("arrival").over(order), F.col("departure")), "last": F.max("pos").over(Window.partitionBy("query_id"))}).where("trip_id = 'TRANSFER'")
    meters = C.haversine_m(F.col("from_lat"), F.col("from_lon"), F.col("lat"), F.col("lon"))
    kind = F.when(F.col("pos") == 1, "access").when(F.col("pos") == F.col("last"), "egress").otherwise("transfer")
    seconds = F.col("arrival") - F.col("before")
    line = F.array(F.array("from_lon", "from_lat"), F.array("lon", "lat"))
    return rows.select(
        "query_id", "pos", "from_stop_id", "stop_id", kind.alias("kind"), seconds.alias("seconds"), F.round(meters, 3).alias("meters"), F.lit("straight_line").alias("routing"),
        C.walking_speed_kmh(F.round(meters, 3), seconds).alias("kmh"), line.alias("geometry"),
    )


def _counted(rows: DataFrame, column: str) -> DataFrame:
    """(query_id, column): how often each value occurs, most often first, as value:times."""
    counts = rows.groupBy("query_id", column).count()
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), F.col(column).alias("v"))))
    return counts.groupBy("query_id").agg(F.array_join(F.transform(ranked, lambda x: F.concat(x["v"].cast("string"), F.lit(":"), (-x["c"]).cast("string"))), ",").alias(column))


def profiles(made: DataFrame, factors: DataFrame) -> DataFrame:
    """Per journey: ride segments, trips, changes of trip, walks, and its trips by route type and cost factor."""
    order = Window.partitionBy("query_id").orderBy("pos")
    rides = made.where("trip_id <> 'TRANSFER'").withColumn("changed", (F.col("trip_id") != F.lag("trip_id").over(order)).cast("int"))
    counts = rides.groupBy("query_id").agg(F.count("*").alias("ride_segments"), F.countDistinct("trip_id").alias("trips"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changes"))
    walks = made.groupBy("query_id").agg(F.count_if(F.col("trip_id") == "TRANSFER").alias("walks"))
    trips = rides.select("query_id", "trip_id").distinct().join(factors, "trip_id")
    unknown = trips.groupBy("query_id").agg(F.round(F.avg((F.col("route_type") == C.UNKNOWN_TYPE).cast("int")), 6).alias("unknown_share"))
    made = walks.join(counts, "query_id", "left").join(unknown, "query_id", "left")
    made = made.join(_counted(trips, "route_type"), "query_id", "left").join(_counted(trips, "cost_factor"), "query_id", "left")
    return made.select("query_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("ride_segments", "trips", "changes")), "walks", F.coalesce("unknown_share", F.lit(0.0)).alias("unknown_share"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("route_type", "cost_factor")))


def network_profile(factors: DataFrame, most: int = 8) -> DataFrame:
    """One row: trips, the share of unknown types, and the most frequent types and factors as value:trips."""
    def top(column: str) -> DataFrame:
        counts = factors.groupBy(column).count().orderBy(F.col("count").desc(), column).limit(most)
        listed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), F.col(column).alias("v"))))
        return counts.agg(F.array_join(F.transform(listed, lambda x: F.concat(x["v"].cast("string"), F.lit(":"), (-x["c"]).cast("string"))), ",").alias(f"{column}s"))

    total = factors.agg(F.count("*").alias("trips"), F.round(F.coalesce(F.avg((F.col("route_type") == C.UNKNOWN_TYPE).cast("int")), F.lit(0.0)), 6).alias("unknown_share"))
    return total.join(F.broadcast(top("route_type"))).join(F.broadcast(top("cost_factor")))


def walks_in(path: Column) -> Column:
    return F.size(F.split(path, ">walk>")) - 1


def score(arrival: Column, access: Column, egress: Column, transfers: Column, walks: Column) -> Column:
    """What a journey costs its rider: the arrival, half of the walks at its ends, and fixed sums for changes and walks."""
    return arrival + C.walk_score_penalty(access) + C.walk_score_penalty(egress) + transfers * TRANSFER_S + walks * WALK_SEGMENT_S


def pairs(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(query_id, from_k, to_k, access, egress, order): every start of a request with every end of it, in the order they are tried."""
    a = starts.select("query_id", F.col("k").alias("from_k"), F.col("penalty").alias("access"), F.col("n").alias("n_a"))
    b = ends.select("query_id", F.col("k").alias("to_k"), F.col("penalty").alias("egress"), F.col("n").alias("n_b"))
    return a.join(b, "query_id").select("query_id", "from_k", "to_k", "access", "egress", F.struct("n_a", "n_b").alias("order"))


def best(asked: DataFrame, labels: DataFrame, most_transfers: int) -> DataFrame:
    """The best candidate of each request: fewest transfers, then arrival, walks, score and egress, then the first one tried.

    ``asked``: query_id, departure and the columns of ``pairs``. Journeys without any transfer are
    preferred to those with some by the first of these alone, however much later they arrive.
    """
    met = asked.join(labels.withColumnRenamed("k", "to_k"), ["from_k", "departure", "to_k"]).where(F.col("transfers") <= most_transfers)
    walked = walks_in(F.col("path"))
    total = score(F.col("arr"), F.col("access"), F.col("egress"), F.col("transfers"), walked)
    key = F.struct("transfers", "arr", walked.alias("walks"), total.alias("score"), "egress", "order", "from_k", "to_k", "access", "path")
    chosen = met.groupBy("query_id", "departure").agg(F.min(key).alias("m"))
    return chosen.select("query_id", "departure", *(F.col(f"m.{c}").alias(c) for c in ("transfers", "arr", "walks", "score", "egress", "from_k", "to_k", "access", "path")))


def soonest(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """The plainer choice over several starts: fewest transfers, then arrival."""
    met = asked.join(labels.withColumnRenamed("k", "to_k"), ["from_k", "departure", "to_k"])
    chosen = met.groupBy("query_id").agg(F.min(F.struct("transfers", "arr", "from_k")).alias("m"))
    return chosen.select("query_id", "m.transfers", "m.arr", "m.from_k")


def signatures(answers: DataFrame, stop_times: DataFrame) -> DataFrame:
    """(query_id, departure, trip_id, stop): the first ride of a journey and the first stop it reaches; TRANSFER_ONLY or NONE without."""
    first = legs(answers).where("trip_id IS NOT NULL").groupBy("query_id", "departure").agg(F.min(F.struct("leg", "trip_id", "board")).alias("m"))
    at = stop_times.select("trip_id", F.col("seq").alias("s"), F.col("k").alias("stop"))
    first = first.select("query_id", "departure", "m.trip_id", (F.col("m.board") + 1).alias("s")).join(at, ["trip_id", "s"]).drop("s")
    rest = F.when(F.contains("path", F.lit(">")), "TRANSFER_ONLY").otherwise("NONE")
    made = answers.select("query_id", "departure", rest.alias("rest")).join(first, ["query_id", "departure"], "left")
    return made.select("query_id", "departure", F.coalesce("trip_id", "rest").alias("trip_id"), "stop")


def next_options(asked: DataFrame, search: Callable[[DataFrame], DataFrame], stop_times: DataFrame, workspace: Workspace, count: int = 3, probes: Sequence[int] = PROBES) -> DataFrame:
    """(query_id, option, departure, transfers, arr, path): up to ``count`` journeys that begin with different rides.

    ``search`` answers (query_id, from_k, to_k, departure). After each option all probes are searched
    together, and the earliest that begins with another ride is the next option.
    """
    def answered(rows: DataFrame, name: str) -> DataFrame:
        made = workspace.table(search(rows), f"answers_{name}")
        signed = signatures(made, stop_times).select("query_id", "departure", F.concat_ws("@", "trip_id", F.col("stop").cast("string")).alias("sign"))
        return workspace.table(made.join(signed, ["query_id", "departure"]), f"signed_{name}")

    last = answered(asked, "0").withColumn("option", F.lit(1))
    options = last
    ends = asked.select("query_id", "from_k", "to_k")
    for i in range(2, count + 1):
        again = last.select("query_id", "departure", F.col("sign").alias("was")).join(ends, "query_id")
        probing = again.withColumn("departure", F.explode(F.array(*(F.col("departure") + p for p in probes))))
        found = answered(probing.drop("was"), str(i)).join(again.select("query_id", "was"), "query_id").where("sign <> was")
        first = Window.partitionBy("query_id").orderBy("departure")
        found = found.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "was")
        last = workspace.table(found.withColumn("option", F.lit(i)), f"option_{i}")
        options = options.unionByName(last)
    return options.select("query_id", "option", "departure", "transfers", "arr", "path")


@dataclass(frozen=True)
class Attempt:
    """One step of a search that gets wider: which starts and ends, how many transfers, how many trips at a boarding."""

    name: str
    starts: int
    ends: int
    transfers: int = 4
    scan: int = 6


#: The steps in turn: the seeds, all destinations, all origins, more transfers, more trips.
ATTEMPTS = (Attempt("seeds", 2, 6), Attempt("destinations", 2, 12), Attempt("origins", 12, 12), Attempt("transfers", 12, 12, 6), Attempt("scan", 12, 12, 6, 18))


#: What follows for journeys that are long: candidates with the stops of the nearest stations after them, then more
#: transfers; and at last the 36 nearest stops of either end. ``places.appended`` ranks what these add.
LONG_ATTEMPTS = (Attempt("hubs", 30, 30), Attempt("hub_transfers", 30, 30, 7))
LAST_ATTEMPT = Attempt("nearest", 36, 36, 7)


def resolve(asked: DataFrame, starts: DataFrame, ends: DataFrame, search: Callable[[DataFrame, Attempt], DataFrame], static: DataFrame, workspace: Workspace, attempts: Sequence[Attempt] = ATTEMPTS) -> DataFrame:
    """(query_id, resolver, attempt, fallback_used, from_k, to_k, transfers, arr, runs, reason).

    Each attempt is made for what the ones before left open. What no attempt answers falls back to
    static paths (``static``: source, node, seconds), whose arrivals heed no timetable; what is open even
    then has the reason why.
    """
    open_, made = asked, None
    for i, attempt in enumerate(attempts):
        own = pairs(starts.where(F.col("n") <= attempt.starts), ends.where(F.col("n") <= attempt.ends)).join(open_.select("query_id", "departure"), "query_id")
        labels = search(own.select("from_k", "departure").distinct(), attempt)
        found = best(own, labels, attempt.transfers).select("query_id", F.lit("raptor").alias("resolver"), F.lit(attempt.name).alias("attempt"), F.lit(False).alias("fallback_used"), "from_k", "to_k", "transfers", "arr", F.lit(i + 1).alias("runs"))
        found = workspace.table(found, f"attempt_{i}")
        made = found if made is None else made.unionByName(found)
        open_ = workspace.table(open_.join(found, "query_id", "left_anti"), f"open_{i}")
        if open_.isEmpty():
            break
    widest = attempts[-1]
    own = pairs(starts.where(F.col("n") <= widest.starts), ends.where(F.col("n") <= widest.ends)).join(open_.select("query_id", "departure"), "query_id")
    met = own.join(static.select(F.col("source").alias("from_k"), F.col("node").alias("to_k"), "seconds"), ["from_k", "to_k"])
    chosen = met.groupBy("query_id").agg(F.min(F.struct((F.col("departure") + F.col("seconds")).alias("arr"), "order", "from_k", "to_k")).alias("m"))
    runs = F.lit(len(attempts))
    late = chosen.select("query_id", F.lit("dijkstra").alias("resolver"), F.lit("static").alias("attempt"), F.lit(True).alias("fallback_used"), "m.from_k", "m.to_k", F.lit(None).cast("int").alias("transfers"), "m.arr", runs.alias("runs"))
    made = made.unionByName(late) if made is not None else late
    sized = lambda rows, c: rows.groupBy("query_id").agg(F.count("*").alias(c))
    every = asked.select("query_id").join(made, "query_id", "left").join(sized(starts, "n_starts"), "query_id", "left").join(sized(ends, "n_ends"), "query_id", "left")
    grew = lambda c, name: F.size(F.array_distinct(F.array(*(F.least(F.coalesce(c, F.lit(0)), F.lit(getattr(a, name))) for a in attempts)))) > 1
    reason = F.when(F.coalesce(F.col("n_starts"), F.lit(0)) * F.coalesce(F.col("n_ends"), F.lit(0)) == 0, "no_attempt").when(grew(F.col("n_ends"), "ends"), "no_path_after_destination_expansion")
    reason = reason.when(grew(F.col("n_starts"), "starts"), "no_path_after_origin_expansion").otherwise("no_path_within_candidate_budget")
    return every.select("query_id", "resolver", "attempt", F.coalesce("fallback_used", F.lit(False)).alias("fallback_used"), "from_k", "to_k", "transfers", "arr", F.coalesce("runs", runs).alias("runs"), F.when(F.col("resolver").isNull(), reason).alias("reason"))


def round_budgets(stops: int, least: int = 8, most: int = 64) -> tuple[int, ...]:
    """Rounds that a search is given in turn: doubling, up to a cap that grows with the root of the stops."""
    cap = min(most, max(least, 24, int(max(1, stops) ** 0.5) + 8))
    made = [least << i for i in range(16) if least << i < cap]
    return (*made, cap)


def merged_diagnostics(runs: DataFrame) -> DataFrame:
    """Per request: its runs in order, the caps tried, whether any reached its most rounds, and the most rounds used.

    ``runs``: query_id, run, cap, rounds_used, full.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("run", "cap"))), lambda x: F.concat(x["run"].cast("string"), F.lit(":"), x["cap"].cast("string")))
    return runs.groupBy("query_id").agg(
        F.array_join(ordered, ",").alias("runs"), F.array_join(F.array_sort(F.collect_set("cap")).cast("array<string>"), ",").alias("attempt_caps"),
        F.bool_or("full").alias("max_rounds_reached"), F.coalesce(F.max("rounds_used"), F.lit(0)).alias("rounds_used_max"),
    )


def responses(answers: DataFrame, payload: DataFrame, algorithm: str = "raptor") -> DataFrame:
    """(query_id, response): the whole answer as JSON; a request without a path has no segments."""
    segment = F.struct("trip_id", "stop_id", "from_stop_id", "arrival")
    listed = payload.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", segment.alias("s")))), lambda x: x["s"]).alias("segments"))
    rows = answers.join(listed, "query_id", "left")
    return rows.select("query_id", F.to_json(F.struct(
        F.lit(algorithm).alias("algorithm"), F.col("transfers"), (F.col("arr") - F.col("departure")).alias("duration_seconds"), F.coalesce("segments", F.array().cast(payload_type(payload))).alias("segments"),
    )).alias("response"))


def payload_type(payload: DataFrame) -> str:
    fields = ", ".join(f"{c}: {payload.schema[c].dataType.simpleString()}" for c in ("trip_id", "stop_id", "from_stop_id", "arrival"))
    return f"array<struct<{fields}>>"


def request_error(known_from: Column, known_to: Column) -> Column:
    """The code of what is wrong with a request, null if nothing is; the first that applies, in this order."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    number = lambda c: F.trim(c).try_cast("int")
    bad = lambda c, low: F.col(c).isNotNull() & (number(c).isNull() | (number(c) < low))
    return (
        F.when((text("start_stop_id") == "") | (text("end_stop_id") == ""), "invalid_stop_id").when(text("algorithm") == "", "invalid_algorithm")
        .when(C.departure_text(F.col("departure_time")).isNull(), "invalid_departure_time").when(bad("max_transfers", 0), "invalid_max_transfers")
        .when(bad("option_count", 1), "invalid_option_count").when(~known_from | ~known_to, "unknown_stop_id")
        .when(~F.lower(text("algorithm")).isin("raptor", "astar", "dijkstra"), "unsupported_algorithm").when(bad("offset_minutes", 0), "invalid_offset_minutes")
    )
