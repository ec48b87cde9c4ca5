"""SQL that states the queries over raw rows, places and journeys again."""

from railloom.plans import oracles as O

_RAW = r"""raw AS (SELECT *, hour(ts)::VARCHAR || ':' || minute(ts)::VARCHAR || ':' || second(ts)::VARCHAR AS clock, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::VARCHAR AS secs, regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER AS k FROM events),
text AS (SELECT 'ST' || (k // 4)::VARCHAR || ':' || (k % 4)::VARCHAR AS stop_id, user_id::VARCHAR || '@' || strftime(ts, '%Y-%m-%d') AS trip_id,
  trim(CASE event_id % 7 WHEN 0 THEN clock WHEN 1 THEN secs WHEN 2 THEN ' ' || hour(ts)::VARCHAR || ':' || minute(ts)::VARCHAR || ' ' WHEN 3 THEN NULL WHEN 4 THEN 'x' || secs ELSE clock END) AS time_text,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'n/a' ELSE (event_id % 1000)::VARCHAR END AS sequence,
  CASE WHEN event_id % 3 = 2 THEN 46.5::DOUBLE + (k % 10) * 0.0009::DOUBLE END AS lat, CASE WHEN event_id % 5 <> 0 THEN 6.6::DOUBLE + (k // 10) * 0.0009::DOUBLE END AS lon,
  lower(trim(['rail', 'Tram ', 'bus', '7', '', NULL, 'x', '2.7', '-1'][(event_id % 9 + 1)::INTEGER])) AS kind_text FROM raw),
good AS (SELECT * FROM (SELECT stop_id, trip_id, CASE WHEN regexp_full_match(time_text, '[0-9]+') THEN time_text::BIGINT WHEN regexp_full_match(time_text, '[0-9]+:[0-9]+(:[0-9]+)?') THEN split_part(time_text, ':', 1)::BIGINT * 3600 + split_part(time_text, ':', 2)::BIGINT * 60 + coalesce(nullif(split_part(time_text, ':', 3), '')::BIGINT, 0) END AS arrival,
  try_cast(sequence AS INTEGER) AS seq, CASE WHEN kind_text = 'rail' THEN 2 WHEN kind_text = 'tram' THEN 0 WHEN kind_text = 'bus' THEN 3 ELSE coalesce(trunc(try_cast(kind_text AS DOUBLE))::INTEGER, -1) END AS kind, lat, lon FROM text) WHERE arrival IS NOT NULL AND seq IS NOT NULL)"""
_POINTS = "points AS (SELECT s_suppkey::BIGINT AS point, 46.5::DOUBLE + (s_suppkey * 37 % 100) * 0.00009::DOUBLE + CASE WHEN s_suppkey % 10 = 9 THEN 1.0::DOUBLE ELSE 0 END AS lat, 6.6::DOUBLE + (s_suppkey * 53 % 100) * 0.0001::DOUBLE AS lon FROM supplier)"
_STATIONS = "stations AS (SELECT station, avg(lat) AS lat, avg(lon) AS lon, min(k) AS k FROM stops GROUP BY station)"


def _met(points: str, places: str, name: str) -> str:
    """Every point with every place, and the distance."""
    return f"{name} AS (SELECT a.point, b.k, {O._M} AS m FROM {points} a, {places} b)"


_NEAREST = "row_number() OVER (PARTITION BY point ORDER BY round(m, 6), k)"
_DEGREES = "degrees_k AS (SELECT k, count(*) AS degree FROM (SELECT DISTINCT pattern, seq, k FROM routes) GROUP BY k)"


def _candidates(met: str, name: str, radius: float, seeds: int, connected: bool) -> str:
    """Ranked candidates of each point within a radius."""
    ranked = f"SELECT *, {_NEAREST} AS by_m FROM {met} WHERE m <= {radius}"
    order = "round(coalesce(degree, 0) * 600.0::DOUBLE - round(m, 6) / 1.4::DOUBLE, 6) DESC, round(m, 6), k" if connected else "round(m, 6), k"
    return f"""{name} AS (SELECT point, k, n, n <= {seeds} AS seed, trunc(m / 1.4::DOUBLE)::BIGINT AS penalty FROM (
  SELECT *, row_number() OVER (PARTITION BY point ORDER BY {order})::INTEGER AS n FROM ({ranked}) {"LEFT JOIN degrees_k USING (k)" if connected else ""} WHERE by_m <= 12))"""


_JOURNEYS = """journeys AS (SELECT * FROM (SELECT n_nationkey::BIGINT AS query_id, (n_nationkey * 4 % 100)::INTEGER AS from_k, ((n_nationkey * 13 % 100 + 37) % 100)::INTEGER AS to_k,
  (CASE WHEN n_nationkey % 6 = 5 THEN 86280 + n_nationkey ELSE 28800 + n_nationkey % 8 * 1800 END)::BIGINT AS departure FROM nation) WHERE from_k <> to_k),
src AS (SELECT DISTINCT from_k, departure FROM journeys)"""
_ALL = f"{O.NETWORK},\n{_JOURNEYS},\n{O.label_tables()}"
_ANSWERS = "answers AS (SELECT query_id * 100000 + k AS query_id, j.departure, transfers, arr, path FROM journeys j JOIN lab l ON l.from_k = j.from_k AND l.departure = j.departure)"
_OWN = "answers AS (SELECT query_id, j.departure, transfers, arr, path FROM journeys j JOIN lab l ON l.from_k = j.from_k AND l.departure = j.departure AND l.k = j.to_k)"
_LEGS = r"""tok AS (SELECT query_id, departure, string_split(path, '>') AS t FROM answers),
journey_legs AS (SELECT query_id, departure, leg, t[leg * 2 - 1]::INTEGER AS source, t[leg * 2 + 1]::INTEGER AS target, CASE WHEN t[leg * 2] <> 'walk' THEN regexp_extract(t[leg * 2], '^(.*):(\d+)-(\d+)$', 1) END AS trip_id,
  CASE WHEN t[leg * 2] <> 'walk' THEN regexp_extract(t[leg * 2], '^(.*):(\d+)-(\d+)$', 2)::INTEGER END AS board, CASE WHEN t[leg * 2] <> 'walk' THEN regexp_extract(t[leg * 2], '^(.*):(\d+)-(\d+)$', 3)::INTEGER END AS alight
  FROM (SELECT *, unnest(range(1, len(t) // 2 + 1))::INTEGER AS leg FROM tok))"""
_SEGMENTS = _LEGS + """,
rides AS (SELECT query_id, departure, leg, seq, l.trip_id, s.k, s.t AS arrival, alight FROM journey_legs l JOIN st s ON s.trip_id = l.trip_id AND s.seq > board AND s.seq <= alight),
foot AS (SELECT l.query_id, l.departure, l.leg, 0 AS seq, 'TRANSFER' AS trip_id, target AS k, coalesce(r.arrival, l.departure) + seconds AS arrival FROM journey_legs l JOIN transfers w ON w.src = l.source AND w.dst = l.target LEFT JOIN (SELECT * FROM rides WHERE seq = alight) r ON r.query_id = l.query_id AND r.leg = l.leg - 1 WHERE l.trip_id IS NULL),
segs AS (SELECT x.query_id, row_number() OVER o AS pos, leg, trip_id, coalesce(lag(k) OVER o, b.t[1]::INTEGER) AS source, k, arrival FROM (SELECT query_id, leg, seq, trip_id, k, arrival FROM rides UNION ALL SELECT query_id, leg, seq, trip_id, k, arrival FROM foot) x JOIN tok b ON b.query_id = x.query_id WINDOW o AS (PARTITION BY x.query_id ORDER BY leg, seq))"""
_PAYLOAD = "payload AS (SELECT s.*, b.stop_id, b.lat, b.lon, a.stop_id AS from_stop_id, a.lat AS from_lat, a.lon AS from_lon FROM segs s LEFT JOIN stops b ON b.k = s.k LEFT JOIN stops a ON a.k = s.source)"
_PROFILE = """rode AS (SELECT *, (trip_id <> lag(trip_id) OVER (PARTITION BY query_id ORDER BY pos))::INTEGER AS changed FROM segs WHERE trip_id <> 'TRANSFER'),
counted AS (SELECT query_id, count(*) AS ride_segments, count(DISTINCT trip_id) AS trips, coalesce(sum(changed), 0)::BIGINT AS changes FROM rode GROUP BY query_id),
typed AS (SELECT DISTINCT query_id, trip_id, route_type, cost_factor FROM rode JOIN factors USING (trip_id)),
by_type AS (SELECT query_id, string_agg(route_type::VARCHAR || ':' || n::VARCHAR, ',' ORDER BY n DESC, route_type) AS route_type FROM (SELECT query_id, route_type, count(*) AS n FROM typed GROUP BY ALL) GROUP BY query_id),
by_factor AS (SELECT query_id, string_agg(cost_factor::VARCHAR || ':' || n::VARCHAR, ',' ORDER BY n DESC, cost_factor) AS cost_factor FROM (SELECT query_id, cost_factor, count(*) AS n FROM typed GROUP BY ALL) GROUP BY query_id),
profile AS (SELECT w.query_id, coalesce(ride_segments, 0) AS ride_segments, coalesce(trips, 0) AS trips, coalesce(changes, 0) AS changes, walks, coalesce(unknown_share, 0) AS unknown_share, coalesce(route_type, '') AS route_type, coalesce(cost_factor, '') AS cost_factor
  FROM (SELECT query_id, count(*) FILTER (WHERE trip_id = 'TRANSFER') AS walks FROM segs GROUP BY query_id) w LEFT JOIN counted USING (query_id) LEFT JOIN (SELECT query_id, round(avg((route_type = -1)::INTEGER), 6) AS unknown_share FROM typed GROUP BY query_id) USING (query_id) LEFT JOIN by_type USING (query_id) LEFT JOIN by_factor USING (query_id))"""
_SIGNED = "signed AS (SELECT a.query_id, a.departure, a.transfers, a.arr, a.path, coalesce(f.trip_id, CASE WHEN contains(a.path, '>') THEN 'TRANSFER_ONLY' ELSE 'NONE' END) AS trip_id, s.k AS stop FROM answers a LEFT JOIN (SELECT query_id, departure, m.trip_id AS trip_id, m.board AS board FROM (SELECT query_id, departure, min({'leg': leg, 'trip_id': trip_id, 'board': board}) AS m FROM journey_legs WHERE trip_id IS NOT NULL GROUP BY query_id, departure)) f ON f.query_id = a.query_id AND f.departure = a.departure LEFT JOIN st s ON s.trip_id = f.trip_id AND s.seq = f.board + 1)"
_HUBS = f"{O._STATION_EDGES},\n{O._DEGREES},\n{_STATIONS},\nhub AS (SELECT station, row_number() OVER (ORDER BY station) AS k FROM (SELECT station FROM degrees ORDER BY out_degree + in_degree DESC, station LIMIT 8))"
_TO_HUB = f"""hub_at AS (SELECT h.station, h.k, s.lat, s.lon FROM hub h JOIN stations s USING (station)),
to_hub AS (SELECT station, station AS hub FROM hub UNION ALL SELECT station, hub FROM (SELECT a.station, b.station AS hub, row_number() OVER (PARTITION BY a.station ORDER BY round({O._M}, 6), b.k) AS n FROM stations a, hub_at b WHERE a.station NOT IN (SELECT station FROM hub)) WHERE n = 1)"""
_HUB_LAST, _HUB_ROUNDS = O.relaxed(6, "SELECT DISTINCT source, source AS node FROM asked", "sedges", O.BY_HOPS, name="hop")
_BACKBONE = f"""asked AS (SELECT query_id, a.station AS start, b.station AS "end", x.hub AS source, y.hub AS node FROM journeys j JOIN stops a ON a.k = from_k JOIN stops b ON b.k = to_k JOIN to_hub x ON x.station = a.station JOIN to_hub y ON y.station = b.station),
{_HUB_ROUNDS},
hub_path AS (SELECT query_id, path, start, "end" FROM asked JOIN {_HUB_LAST} USING (source, node)),
on_path AS (SELECT DISTINCT query_id, unnest(string_split(path, '>')) AS station FROM hub_path),
spine AS (SELECT * FROM on_path UNION SELECT query_id, dst FROM on_path JOIN sedges ON src = station UNION SELECT query_id, start FROM hub_path UNION SELECT query_id, "end" FROM hub_path)"""
_NODES = "nodes AS (SELECT p_partkey::BIGINT AS node, 46.4995::DOUBLE + (p_partkey % 45) * 0.0009::DOUBLE AS lat, 6.5995::DOUBLE + (p_partkey // 45) * 0.0009::DOUBLE AS lon FROM part)"
_WAYS = f"""ways AS (SELECT a.node AS a, b.node AS b, round({O._M}, 6) AS meters FROM nodes a JOIN nodes b ON b.node = a.node + 45 OR (b.node = a.node + 1 AND a.node % 45 < 44)),
wedges AS (SELECT src, dst, min(s) AS seconds FROM (SELECT a AS src, b AS dst, greatest(1, trunc(meters / 1.4::DOUBLE)::BIGINT) AS s FROM ways UNION ALL SELECT b, a, greatest(1, trunc(meters / 1.4::DOUBLE)::BIGINT) FROM ways) GROUP BY src, dst)"""
_SNAP = f"""snap_met AS (SELECT a.k, b.node, {O._M} AS m, greatest(abs(floor(a.lat / 0.01::DOUBLE) - floor(b.lat / 0.01::DOUBLE)), abs(floor(a.lon / 0.01::DOUBLE) - floor(b.lon / 0.01::DOUBLE))) AS ring FROM stops a, nodes b),
snapped AS (SELECT k, node FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY least(ring, 4), round(m, 6), node) AS n FROM snap_met) WHERE n = 1)"""
_WALK_LAST, _WALK_ROUNDS = O.relaxed(8, "SELECT DISTINCT node AS source, node FROM snapped", "wedges", O.BY_SECONDS, "seconds <= 300", "w")
_SAME = "same_station AS (SELECT a.k AS src, b.k AS dst FROM stops a JOIN stops b ON a.station = b.station AND a.k <> b.k)"
_NEAR250 = "near250 AS (SELECT src, dst, m FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(m, 6), stop_b) AS n FROM pairs WHERE m > 0 AND m <= 250) WHERE n <= 4)"
_ENDS = f"""place_a AS (SELECT query_id AS point, lat + 0.0002::DOUBLE AS lat, lon + 0.0003::DOUBLE AS lon FROM journeys JOIN stops ON k = from_k),
place_b AS (SELECT query_id AS point, lat + 0.0002::DOUBLE AS lat, lon + 0.0003::DOUBLE AS lon FROM journeys JOIN stops ON k = to_k),
{_met("place_a", "stops", "met_a")},
{_met("place_b", "stops", "met_b")},
{_DEGREES},
{_candidates("met_a", "starts", 1000, 2, True)},
{_candidates("met_b", "ends", 1000, 6, False)}"""
_WALKS_OF = "(len(string_split(path, '>walk>')) - 1)"
_PENALTY = lambda c: f"greatest(least({c}, 900), 0) // 2"
_CHOICE = f"min({{'transfers': transfers, 'arr': arr, 'walks': {_WALKS_OF}, 'score': arr + {_PENALTY('access')} + {_PENALTY('egress')} + transfers * 3600 + {_WALKS_OF} * 900, 'egress': egress, 'n_a': n_a, 'n_b': n_b, 'from_k': from_k, 'to_k': to_k, 'access': access, 'path': path}})"
_PAIRS = "SELECT s.point AS query_id, s.k AS from_k, e.k AS to_k, s.penalty AS access, e.penalty AS egress, s.n AS n_a, e.n AS n_b, j.departure FROM starts s JOIN ends e ON e.point = s.point JOIN journeys j ON j.query_id = s.point"
_SEED_PAIRS = f"seed_pairs AS ({_PAIRS} WHERE s.seed AND e.seed), od_src AS (SELECT DISTINCT from_k, departure FROM seed_pairs)"
_OD_BASE = f"{O.NETWORK},\n{_JOURNEYS},\n{_ENDS},\n{_SEED_PAIRS},\n{O.label_tables('od_src')},\nmet AS (SELECT p.*, l.transfers, l.arr, l.path FROM seed_pairs p JOIN lab l ON l.from_k = p.from_k AND l.departure = p.departure AND l.k = p.to_k)"


def _resolved() -> str:
    """The attempts over unrolled labels, then static paths."""
    last, rounds = O.relaxed(O.STATIC_EDGES, "SELECT DISTINCT k AS source, k AS node FROM starts", "edges", O.BY_SECONDS, name="s")
    wide = "wide AS ({p}), wide_src AS (SELECT DISTINCT from_k, departure FROM wide)".format(p=_PAIRS)
    attempts = ((0, "seeds", 2, 6, 4, "lab"), (1, "destinations", 2, 12, 4, "lab"), (2, "origins", 12, 12, 4, "lab"), (3, "transfers", 12, 12, 6, "lab"), (4, "scan", 12, 12, 6, "more"))
    tried = " UNION ALL ".join(
        f"SELECT p.*, l.transfers, l.arr, l.path, {i} AS i, '{name}' AS attempt FROM wide p JOIN {labels} l ON l.from_k = p.from_k AND l.departure = p.departure AND l.k = p.to_k WHERE n_a <= {a} AND n_b <= {b} AND l.transfers <= {most}"
        for i, name, a, b, most, labels in attempts
    )
    left = "left_src AS (SELECT DISTINCT from_k, departure FROM wide WHERE query_id NOT IN (SELECT p.query_id FROM wide p JOIN lab l ON l.from_k = p.from_k AND l.departure = p.departure AND l.k = p.to_k))"
    return f"""WITH {O.NETWORK},\n{_JOURNEYS},\n{_ENDS},\n{wide},\n{O._EDGES},\n{O.label_tables('wide_src', most=6)},\n{left},\n{O.label_tables('left_src', most=6, scan=18, name='more')},\n{rounds},
tried AS ({tried}),
raptor AS (SELECT query_id, attempt, i, m.from_k AS from_k, m.to_k AS to_k, m.transfers AS transfers, m.arr AS arr FROM (SELECT query_id, attempt, i, {_CHOICE} AS m FROM tried GROUP BY query_id, attempt, i) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i) = 1),
static AS (SELECT query_id, m.from_k AS from_k, m.to_k AS to_k, m.arr AS arr FROM (SELECT query_id, min({{'arr': departure + seconds, 'n_a': n_a, 'n_b': n_b, 'from_k': from_k, 'to_k': to_k}}) AS m FROM wide JOIN {last} s ON s.source = from_k AND s.node = to_k WHERE query_id NOT IN (SELECT query_id FROM raptor) GROUP BY query_id)),
n_s AS (SELECT point AS query_id, count(*) AS n_starts FROM starts GROUP BY point), n_e AS (SELECT point AS query_id, count(*) AS n_ends FROM ends GROUP BY point)
SELECT j.query_id, CASE WHEN r.query_id IS NOT NULL THEN 'raptor' WHEN s.query_id IS NOT NULL THEN 'dijkstra' END AS resolver, coalesce(r.attempt, CASE WHEN s.query_id IS NOT NULL THEN 'static' END) AS attempt, r.query_id IS NULL AND s.query_id IS NOT NULL AS fallback_used,
  coalesce(r.from_k, s.from_k) AS from_k, coalesce(r.to_k, s.to_k) AS to_k, r.transfers, coalesce(r.arr, s.arr) AS arr, coalesce(r.i + 1, 5) AS runs,
  CASE WHEN r.query_id IS NULL AND s.query_id IS NULL THEN CASE WHEN coalesce(n_starts, 0) * coalesce(n_ends, 0) = 0 THEN 'no_attempt' WHEN n_ends > 6 THEN 'no_path_after_destination_expansion' WHEN n_starts > 2 THEN 'no_path_after_origin_expansion' ELSE 'no_path_within_candidate_budget' END END AS reason
FROM journeys j LEFT JOIN raptor r USING (query_id) LEFT JOIN static s ON s.query_id = j.query_id LEFT JOIN n_s ON n_s.query_id = j.query_id LEFT JOIN n_e ON n_e.query_id = j.query_id"""


def _next_options() -> str:
    """Options one after the other, each from labels of the probes after the one before."""
    parts = [O.NETWORK, _JOURNEYS, O.label_tables(), _OWN, _LEGS, _SIGNED, "o1 AS MATERIALIZED (SELECT query_id, 1 AS option, departure, transfers, arr, path, concat_ws('@', trip_id, stop) AS sign FROM signed)"]
    for i in (2, 3):
        parts += [
            f"ask{i} AS (SELECT query_id, from_k, to_k, o.departure + unnest([300, 900, 2100, 3900]) AS departure, sign AS was FROM o{i - 1} o JOIN journeys j USING (query_id))",
            f"src{i} AS (SELECT DISTINCT from_k, departure FROM ask{i})", O.label_tables(f"src{i}", name=f"p{i}"),
            f"answers{i} AS MATERIALIZED (SELECT query_id, a.departure, was, transfers, arr, path FROM ask{i} a JOIN p{i} l ON l.from_k = a.from_k AND l.departure = a.departure AND l.k = a.to_k)",
            _LEGS.replace("tok AS", f"tok{i} AS").replace("FROM answers", f"FROM answers{i}").replace("journey_legs AS", f"journey_legs{i} AS").replace("FROM tok)", f"FROM tok{i})"),
            _SIGNED.replace("signed AS", f"signed{i} AS").replace("FROM answers a", f"FROM answers{i} a").replace("FROM journey_legs ", f"FROM journey_legs{i} "),
            f"o{i} AS MATERIALIZED (SELECT query_id, {i} AS option, departure, transfers, arr, path, sign FROM (SELECT s.*, concat_ws('@', trip_id, stop) AS sign, row_number() OVER (PARTITION BY s.query_id ORDER BY s.departure) AS r FROM signed{i} s JOIN o{i - 1} w ON w.query_id = s.query_id WHERE concat_ws('@', trip_id, stop) <> w.sign) WHERE r = 1)",
        ]
    return "WITH " + ",\n".join(parts) + " SELECT query_id, option, departure, transfers, arr, path FROM (SELECT * FROM o1 UNION ALL SELECT * FROM o2 UNION ALL SELECT * FROM o3)"


_KNOWN = "(SELECT stop_id FROM stops)"
_TEXTS = "CASE o_orderkey % 6 WHEN 0 THEN ' ' || (o_orderkey % 90000)::VARCHAR WHEN 1 THEN (o_orderkey + 1738580100)::VARCHAR WHEN 2 THEN '2024-05-0' || (o_orderkey % 9 + 1)::VARCHAR || 'T0' || (o_orderkey % 10)::VARCHAR || ':1' || (o_orderkey % 10)::VARCHAR || ':30' WHEN 3 THEN 'soon ' || o_orderkey::VARCHAR WHEN 4 THEN NULL ELSE '-' || (o_orderkey % 50)::VARCHAR END"
_BAD = lambda c, low: f"({c} IS NOT NULL AND coalesce(try_cast({c} AS INTEGER) < {low}, true))"
_LIKE = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{x}' AS text, k, name FROM named WHERE contains(lower(name), '{x.lower()}') ORDER BY (lower(name) = '{x.lower()}') DESC, name, k LIMIT 100)" for x in ("widget", "BOLT 7", "blue rod")
)

ORACLES = {
    "ingest_rows": f"WITH {_RAW} SELECT stop_id, trip_id, arrival, seq, kind, lat, lon FROM good",
    "stop_index": f"WITH {_RAW} SELECT stop_id, row_number() OVER (ORDER BY stop_id) - 1 AS idx FROM (SELECT DISTINCT stop_id FROM good)",
    "stop_first_coords": f"WITH {_RAW} SELECT s.stop_id, m.lat AS lat, m.lon AS lon FROM (SELECT DISTINCT stop_id FROM good) s LEFT JOIN (SELECT stop_id, min({{'a': arrival, 's': stop_id, 't': trip_id, 'q': seq, 'lat': lat, 'lon': lon}}) AS m FROM good WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY stop_id) x USING (stop_id)",
    "trip_route_types": f"WITH {_RAW} SELECT t.trip_id, coalesce(m.kind, -1) AS route_type FROM (SELECT DISTINCT trip_id FROM good) t LEFT JOIN (SELECT trip_id, min({{'q': seq, 'a': arrival, 's': stop_id, 'kind': kind}}) AS m FROM good WHERE kind <> -1 GROUP BY trip_id) x USING (trip_id)",
    "clean_start_ids": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = o_custkey % 5 THEN (o_orderkey % 7)::VARCHAR ELSE (o_orderkey % 7)::VARCHAR || ',' || (o_custkey % 5)::VARCHAR END AS ids FROM orders",
    "departure_texts": f"SELECT o_orderkey, CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN CASE WHEN abs(x::BIGINT) >= 946684800 THEN x::BIGINT % 86400 ELSE x::BIGINT END WHEN regexp_matches(x, '^\\d{{4}}-\\d\\d-\\d\\d') THEN (hour(x::TIMESTAMP) * 3600 + minute(x::TIMESTAMP) * 60 + second(x::TIMESTAMP))::BIGINT END AS seconds FROM (SELECT o_orderkey, trim({_TEXTS}) AS x FROM orders)",
    "walk_penalties": "SELECT o_orderkey, greatest(least(o_orderkey % 2500 - 100, 900), 0) // 2 AS penalty, CASE WHEN o_custkey % 300 > 0 AND o_orderkey % 7 > 0 THEN round((o_custkey % 300)::DOUBLE / (o_orderkey % 7 * 30) * 3.6::DOUBLE, 2) END AS kmh FROM orders",
    "request_errors": f"""WITH {O._STOPS}, r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'ST' || (o_orderkey % 40)::VARCHAR || ':1' END AS a, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'ST' || (o_orderkey % 23)::VARCHAR || ':2' END AS b,
  ['raptor', 'RAPTOR', 'dijkstra', 'bfs', ''][(o_orderkey % 5 + 1)::INTEGER] AS algorithm, o_orderkey % 3 = 1 AS no_time, ['4', NULL, '-1', 'many', '2', '3', '0'][(o_orderkey % 7 + 1)::INTEGER] AS most, ['3', '0', NULL, '2'][(o_orderkey % 4 + 1)::INTEGER] AS count, [NULL, '10', '-5'][(o_orderkey % 3 + 1)::INTEGER] AS minutes FROM orders)
SELECT o_orderkey, CASE WHEN a = '' OR b = '' THEN 'invalid_stop_id' WHEN algorithm = '' THEN 'invalid_algorithm' WHEN no_time THEN 'invalid_departure_time' WHEN {_BAD('most', 0)} THEN 'invalid_max_transfers' WHEN {_BAD('count', 1)} THEN 'invalid_option_count' WHEN a NOT IN {_KNOWN} OR b NOT IN {_KNOWN} THEN 'unknown_stop_id' WHEN lower(algorithm) NOT IN ('raptor', 'astar', 'dijkstra') THEN 'unsupported_algorithm' WHEN {_BAD('minutes', 0)} THEN 'invalid_offset_minutes' END AS error FROM r""",
    "destination_candidates": f"""WITH {O._STOPS}, {_POINTS}, {_met('points', 'stops', 'met')}, {_candidates('met', 'near', 300, 6, False)}
SELECT * FROM near UNION ALL SELECT point, k, n, n <= 6, trunc(m / 1.4::DOUBLE)::BIGINT FROM (SELECT *, {_NEAREST}::INTEGER AS n FROM met WHERE point NOT IN (SELECT point FROM near)) WHERE n <= 12""",
    "origin_candidates": f"WITH {O._ST}, {O._STOPS}, {O._ROUTES}, {_POINTS}, {_met('points', 'stops', 'met')}, {_DEGREES}, {_candidates('met', 'near', 300, 2, True)} SELECT * FROM near",
    "candidate_tiers": "SELECT o_orderkey, CASE WHEN c = 0 OR s = 0 THEN '' WHEN c <= s THEN c::VARCHAR ELSE array_to_string(list_distinct_sorted, ',') END AS tiers FROM (SELECT o_orderkey, o_orderkey % 40 AS c, o_orderkey % 7 AS s, list_sort(list_distinct([least(c, s), least(c, s * 2), least(c, s * 4), c])) AS list_distinct_sorted FROM orders)",
    "tier_candidates": f"WITH {O._STOPS}, {_POINTS}, {_met('points', 'stops', 'met')}, r AS (SELECT point, k, {_NEAREST}::INTEGER AS n FROM met) SELECT point, tier, k, n FROM r, (SELECT unnest([2, 4, 8, 12])::BIGINT AS tier) WHERE n <= tier",
    "nearest_stations": f"WITH {O._STOPS}, {_POINTS}, {_STATIONS}, {_met('points', 'stations', 'met')}, r AS (SELECT point, k, {_NEAREST}::INTEGER AS n FROM met) SELECT point, t.station, n, s.k FROM r JOIN stations t ON t.k = r.k JOIN (SELECT station, k, row_number() OVER (PARTITION BY station ORDER BY k) AS i FROM stops) s ON s.station = t.station AND i <= 6 WHERE n <= 3",
    "augmented_candidates": f"""WITH {O._STOPS}, {_POINTS}, {_STATIONS}, {_met('points', 'stops', 'met')}, {_met('points', 'stations', 'smet')}, {_candidates('met', 'near', 300, 6, False)},
ends AS (SELECT point, k FROM near UNION ALL SELECT point, k FROM (SELECT *, {_NEAREST} AS n FROM met WHERE point NOT IN (SELECT point FROM near)) WHERE n <= 12),
r AS (SELECT point, k, {_NEAREST} AS n FROM smet), more AS (SELECT point, s.k FROM r JOIN stations t ON t.k = r.k JOIN (SELECT station, k, row_number() OVER (PARTITION BY station ORDER BY k) AS i FROM stops) s ON s.station = t.station AND i <= 6 WHERE n <= 3)
SELECT point, k, trunc(m / 1.4::DOUBLE)::BIGINT AS penalty FROM (SELECT point, k FROM ends UNION SELECT point, k FROM more) JOIN met USING (point, k)""",
    "static_path_segments": f"""WITH {O._ST}, {O._OD}, {O._HOPS}, {O._EDGES}, {O._ROUNDS_S}, x AS (SELECT source, node, string_split(path, '>') AS t FROM {O._LAST_S}), y AS (SELECT source, node, t, unnest(range(2, len(t) + 1)) AS i FROM x)
SELECT y.source, y.node, (i - 1)::INTEGER AS pos, e.dst AS k, e.trip_id, sum(e.seconds) OVER (PARTITION BY y.source, y.node ORDER BY i)::BIGINT AS seconds FROM y JOIN edges e ON e.src = t[i - 1]::INTEGER AND e.dst = t[i]::INTEGER""",
    "stop_stations": f"WITH {O._STOPS} SELECT k, station FROM stops",
    "nearest_hubs": f"WITH {O._ST}, {O._STOPS}, {_HUBS}, {_TO_HUB} SELECT * FROM to_hub",
    "station_backbone": f"WITH {O._ST}, {O._STOPS}, {_JOURNEYS}, {_HUBS}, {_TO_HUB}, {_BACKBONE} SELECT * FROM spine",
    "backbone_check": f"WITH {_ALL}, {_HUBS}, {_TO_HUB}, {_BACKBONE}, {_OWN}, {_SEGMENTS}, off AS (SELECT query_id, count(*) AS n FROM (SELECT DISTINCT query_id, station FROM segs JOIN stops USING (k) WHERE trip_id <> 'TRANSFER') ANTI JOIN spine USING (query_id, station) GROUP BY query_id) SELECT query_id, coalesce(n, 0) AS off_path, coalesce(n, 0) <= 2 AS follows FROM (SELECT DISTINCT query_id FROM segs) LEFT JOIN off USING (query_id)",
    "stops_like": f"WITH named AS (SELECT p_partkey::INTEGER AS k, p_name || ' ' || p_partkey::VARCHAR AS name FROM part) {_LIKE}",
    "walk_edges": f"WITH {_NODES}, {_WAYS} SELECT * FROM wedges",
    "walk_snap_nodes": f"WITH {O._STOPS}, {_NODES}, {_SNAP} SELECT * FROM snapped",
    "walk_sssp_bounded": f"WITH {O._STOPS}, {_NODES}, {_WAYS}, {_SNAP}, {_WALK_ROUNDS} SELECT source, node, seconds, path FROM {_WALK_LAST}",
    "walk_targets": f"WITH {O._STOPS}, {O._PAIRS}, {_SAME}, {_NEAR250} SELECT src, dst FROM near250 UNION SELECT src, dst FROM same_station",
    "walk_transfers": f"WITH {O._STOPS}, {O._PAIRS}, {_SAME}, {_NEAR250}, {_NODES}, {_WAYS}, {_SNAP}, {_WALK_ROUNDS} SELECT t.src, t.dst, greatest(30, seconds) AS seconds FROM (SELECT src, dst FROM near250 UNION SELECT src, dst FROM same_station) t JOIN snapped a ON a.k = t.src JOIN snapped b ON b.k = t.dst JOIN {_WALK_LAST} x ON x.source = a.node AND x.node = b.node",
    "precomputed_transfers": f"WITH {O._STOPS}, {O._PAIRS}, {_SAME}, {_NEAR250} SELECT src, dst, {O._WALK} AS seconds FROM near250 ANTI JOIN same_station USING (src, dst) UNION ALL SELECT src, dst, 30 FROM same_station",
    "raptor_itineraries": f"WITH {_ALL}, {_ANSWERS}, {_SEGMENTS} SELECT * FROM segs",
    "segment_payload": f"WITH {_ALL}, {_ANSWERS}, {_SEGMENTS}, {_PAYLOAD} SELECT query_id, pos, trip_id, from_stop_id, stop_id, arrival, round(lat, 6) AS lat, round(lon, 6) AS lon FROM payload",
    "walk_legs": f"""WITH {_ALL}, {_ANSWERS}, {_SEGMENTS}, {_PAYLOAD}, x AS (SELECT p.*, coalesce(lag(arrival) OVER o, departure) AS before, max(pos) OVER (PARTITION BY p.query_id) AS last FROM payload p JOIN answers a ON a.query_id = p.query_id WINDOW o AS (PARTITION BY p.query_id ORDER BY pos)),
y AS (SELECT *, round({O._M.replace('a.lat', 'from_lat').replace('a.lon', 'from_lon').replace('b.lat', 'lat').replace('b.lon', 'lon')}, 3) AS meters, arrival - before AS seconds FROM x WHERE trip_id = 'TRANSFER')
SELECT query_id, pos, from_stop_id, stop_id, CASE WHEN pos = 1 THEN 'access' WHEN pos = last THEN 'egress' ELSE 'transfer' END AS kind, seconds, meters, 'straight_line' AS routing, CASE WHEN meters > 0 AND seconds > 0 THEN round(meters / seconds * 3.6::DOUBLE, 2) END AS kmh,
  concat_ws(',', round(from_lon * 1000000)::BIGINT, round(from_lat * 1000000)::BIGINT, round(lon * 1000000)::BIGINT, round(lat * 1000000)::BIGINT) AS line FROM y""",
    "itinerary_profile": f"WITH {_ALL}, {_ANSWERS}, {_SEGMENTS}, {_PROFILE} SELECT * FROM profile",
    "transfer_counts": f"WITH {_ALL}, {_ANSWERS}, {_SEGMENTS}, {_PROFILE} SELECT query_id, changes FROM profile",
    "raptor_transfer_cap": f"WITH {O.NETWORK}, {_JOURNEYS}, {O.label_tables(most=1)} SELECT query_id, transfers, arr FROM journeys j LEFT JOIN lab l ON l.from_k = j.from_k AND l.departure = j.departure AND l.k = j.to_k",
    "best_od_option": f"WITH {_OD_BASE} SELECT query_id, m.transfers AS transfers, m.arr AS arr, m.walks AS walks, m.score AS score, m.egress AS egress, m.from_k AS from_k, m.to_k AS to_k, m.access AS access, m.path AS path FROM (SELECT query_id, {_CHOICE} AS m FROM met GROUP BY query_id)",
    "direct_preference": f"WITH {_OD_BASE} SELECT query_id, m.transfers AS transfers, m.arr - earliest AS later FROM (SELECT query_id, {_CHOICE} AS m, min(arr) AS earliest FROM met GROUP BY query_id)",
    "soonest_start": f"WITH {O.NETWORK}, {_JOURNEYS}, {_ENDS}, asked AS (SELECT point AS query_id, k AS from_k, to_k, departure FROM starts JOIN journeys j ON j.query_id = point), a_src AS (SELECT DISTINCT from_k, departure FROM asked), {O.label_tables('a_src')} SELECT query_id, m.transfers AS transfers, m.arr AS arr, m.from_k AS from_k FROM (SELECT query_id, min({{'transfers': transfers, 'arr': arr, 'from_k': a.from_k}}) AS m FROM asked a JOIN lab l ON l.from_k = a.from_k AND l.departure = a.departure AND l.k = a.to_k GROUP BY query_id)",
    "multi_departure_options": f"WITH {O.NETWORK}, {_JOURNEYS}, asked AS (SELECT query_id, from_k, to_k, minutes, departure + minutes * 60 AS departure FROM journeys, (SELECT unnest([0, 10, 20, 30, 40]) AS minutes)), a_src AS (SELECT DISTINCT from_k, departure FROM asked), {O.label_tables('a_src')} SELECT query_id, minutes, a.departure, transfers, arr, arr - a.departure AS seconds FROM asked a LEFT JOIN lab l ON l.from_k = a.from_k AND l.departure = a.departure AND l.k = a.to_k",
    "option_signature": f"WITH {_ALL}, {_ANSWERS}, {_LEGS}, {_SIGNED} SELECT query_id, trip_id, stop FROM signed",
    "next_departure_options": _next_options(),
    "resolved_journeys": _resolved(),
    "merged_diagnostics": "SELECT o_custkey AS query_id, string_agg(o_orderkey::VARCHAR || ':' || (8 << (o_orderkey % 4)::INTEGER)::VARCHAR, ',' ORDER BY o_orderkey) AS runs, array_to_string(list_sort(list_distinct(list(8 << (o_orderkey % 4)::INTEGER))), ',') AS attempt_caps, bool_or(o_orderkey % 5 = 0) AS max_rounds_reached, max(o_orderkey % 9)::INTEGER AS rounds_used_max FROM orders GROUP BY o_custkey",
    "path_responses": f"""WITH {_ALL}, {_ANSWERS}, {_SEGMENTS}, {_PAYLOAD}, listed AS (SELECT query_id, '[' || string_agg('{{"trip_id":"' || trip_id || '","stop_id":"' || stop_id || '","from_stop_id":"' || from_stop_id || '","arrival":' || arrival || '}}', ',' ORDER BY pos) || ']' AS segments FROM payload GROUP BY query_id)
SELECT a.query_id, '{{"algorithm":"raptor","transfers":' || transfers || ',"duration_seconds":' || (arr - departure) || ',"segments":' || coalesce(segments, '[]') || '}}' AS response FROM answers a LEFT JOIN listed USING (query_id)""",
    "transfer_expansion": f"WITH {_ALL}, {_ANSWERS}, x AS (SELECT query_id, arr, string_split(path, '>') AS t FROM answers) SELECT query_id, t[-1]::INTEGER AS k, dst AS to_k, arr + seconds AS arr, (seconds * 3 + 1) // 2 AS weighted FROM x JOIN transfers ON src = t[-1]::INTEGER AND seconds <= 180 WHERE len(t) > 1 AND t[-2] <> 'walk'",
}
