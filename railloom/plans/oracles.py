"""SQL that states the registered queries again, for DuckDB over the same tables."""

_ST = """st AS (
  SELECT user_id, user_id::VARCHAR || '@' || strftime(ts, '%Y-%m-%d') AS trip_id,
         regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER AS k,
         (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS t,
         row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)::INTEGER AS seq, event_type,
         [-1, 0, 2, 3, 4][(user_id % 5 + 1)::INTEGER] AS route_type
  FROM events)"""
_STOPS = """stops AS (
  SELECT c_custkey::INTEGER AS k, 'ST' || (c_custkey // 4)::VARCHAR || ':' || (c_custkey % 4)::VARCHAR AS stop_id, 'ST' || (c_custkey // 4)::VARCHAR AS station,
         46.5::DOUBLE + (c_custkey % 10) * 0.0009::DOUBLE AS lat, 6.6::DOUBLE + (c_custkey // 10) * 0.0009::DOUBLE AS lon
  FROM customer)"""
_M = """2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h}))""".format(
    h="(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))"
)
_PAIRS = f"pairs AS (SELECT a.k AS src, b.k AS dst, a.stop_id AS stop_a, b.stop_id AS stop_b, a.station AS station_a, b.station AS station_b, {_M} AS m FROM stops a JOIN stops b ON a.k <> b.k AND abs(a.lat - b.lat) < 0.03 AND abs(a.lon - b.lon) < 0.03)"
_WALK = "greatest(30, floor(m / 1.4)::BIGINT)"
_HOPS = """hops AS (SELECT * FROM (SELECT trip_id, seq, k AS src, lead(k) OVER w AS dst, t AS dep, lead(t) OVER w AS arr FROM st WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) WHERE dst IS NOT NULL)"""
_EDGES = """edges AS (SELECT src, dst, m.w AS seconds, m.trip AS trip_id FROM (SELECT src, dst, min({'w': arr - dep, 'trip': trip_id}) AS m FROM hops WHERE arr >= dep GROUP BY src, dst))"""
_PATTERNS = """patterns AS (SELECT trip_id, string_agg(event_type, '>' ORDER BY seq) AS pattern, arg_min(t, seq) AS dep0 FROM st GROUP BY trip_id)"""
_SAME = f"same AS (SELECT src, dst, {_WALK} AS seconds FROM pairs WHERE station_a = station_b AND m <= 250)"
_NEAR = f"near AS (SELECT src, dst, {_WALK} AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(m, 6), stop_b) AS n FROM pairs WHERE m > 0 AND m <= 120) WHERE n <= 4)"
_TRANSFERS = "transfers AS (SELECT src, dst, min(seconds) AS seconds FROM (SELECT * FROM same UNION ALL SELECT * FROM near) GROUP BY src, dst)"
_SPEEDS = f"""speeds AS (SELECT s.trip_id, s.route_type, v.speed FROM (SELECT DISTINCT trip_id, route_type FROM st) s LEFT JOIN (
  SELECT trip_id, sum(m) / sum(arr - dep) AS speed FROM (SELECT h.*, {_M} AS m FROM hops h JOIN stops a ON a.k = src JOIN stops b ON b.k = dst) WHERE arr > dep AND m > 0 GROUP BY trip_id) v USING (trip_id))"""
_FACTORS = """factors AS (SELECT trip_id, route_type, (CASE route_type WHEN -1 THEN CASE WHEN speed IS NULL THEN 1500 WHEN speed >= 14 THEN 1000 WHEN speed >= 10 THEN 1150 WHEN speed >= 7 THEN 1450 ELSE 1900 END
  WHEN 0 THEN 1100 WHEN 2 THEN 1000 WHEN 3 THEN 2000 WHEN 4 THEN 1200 ELSE 1450 END)::BIGINT AS cost_factor FROM speeds)"""
_STATION_EDGES = """heads AS (SELECT trip_id, seq, station, t, lag(station) OVER (PARTITION BY trip_id ORDER BY seq) AS before FROM st JOIN stops USING (k)),
legs AS (SELECT station AS src, lead(station) OVER w AS dst, lead(t) OVER w - t AS s FROM heads WHERE before IS NULL OR before <> station WINDOW w AS (PARTITION BY trip_id ORDER BY seq)),
sedges AS (SELECT src, dst, min(s) AS seconds FROM legs WHERE dst IS NOT NULL AND s >= 0 GROUP BY src, dst)"""
_DEGREES = """degrees AS (SELECT coalesce(o.station, i.station) AS station, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree
  FROM (SELECT src AS station, count(DISTINCT dst) AS out_degree FROM sedges GROUP BY src) o FULL JOIN (SELECT dst AS station, count(DISTINCT src) AS in_degree FROM sedges GROUP BY dst) i ON o.station = i.station)"""
_OD = """od AS (SELECT * FROM (SELECT o_orderkey AS query_id, (o_custkey % 100)::INTEGER AS from_k, (o_orderkey * 7 % 100)::INTEGER AS to_k, 28800 + o_orderkey % 8 * 1800 AS departure FROM orders) WHERE from_k <> to_k)"""
_SRC = "src AS (SELECT DISTINCT from_k, departure FROM od)"
_ROUTES = """kpat AS (SELECT trip_id, string_agg(k::VARCHAR, '>' ORDER BY seq) AS pattern, arg_min(t, seq) AS dep0 FROM st GROUP BY trip_id),
kfell AS (SELECT pattern, seq, coalesce(t < lag(t) OVER (PARTITION BY pattern, seq ORDER BY dep0, trip_id), false) AS fell FROM st JOIN kpat USING (trip_id)),
kmono AS (SELECT pattern, seq, NOT bool_or(fell) AS mono FROM kfell GROUP BY pattern, seq),
routes AS MATERIALIZED (SELECT trip_id, pattern, seq, k, t, mono FROM st JOIN kpat USING (trip_id) JOIN kmono USING (pattern, seq))"""
_BOARD = """board AS (SELECT * FROM (SELECT from_k, departure, trip_id, seq, t AS board_t, mono, row_number() OVER (PARTITION BY from_k, departure, pattern, seq ORDER BY t, trip_id) AS n FROM src JOIN routes ON k = from_k AND t >= departure) WHERE n <= 6 OR NOT mono)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts)


def relaxed(n: int, start: str, edges: str, order: tuple[str, ...], most: str = "true", name: str = "l") -> tuple[str, str]:
    """Relaxation unrolled for ``n`` edges: the name of the last round's table, and the tables."""
    struct = ", ".join(f"'{c}': {c}" for c in order)
    made = [f"{name}0 AS (SELECT source, node, 0 AS hops, 0::BIGINT AS seconds, node::VARCHAR AS path FROM ({start}))"]
    for i in range(1, n + 1):
        made.append(f"""{name}{i} AS MATERIALIZED (SELECT source, node, m.hops AS hops, m.seconds AS seconds, m.path AS path FROM (SELECT source, node, min({{{struct}}}) AS m FROM (
  SELECT * FROM {name}{i - 1} UNION ALL SELECT source, e.dst, hops + 1, l.seconds + e.seconds, path || '>' || e.dst FROM {name}{i - 1} l JOIN {edges} e ON e.src = l.node) WHERE {most} GROUP BY source, node))""")
    return f"{name}{n}", ",\n".join(made)


BY_SECONDS, BY_HOPS = ("seconds", "hops", "path"), ("hops", "seconds", "path")
#: Edges after which no path of the network at sf0.01 and below gets shorter; the registered query goes on until none does.
STATIC_EDGES = 14
_LAST_S, _ROUNDS_S = relaxed(STATIC_EDGES, "SELECT DISTINCT from_k AS source, from_k AS node FROM od", "edges", BY_SECONDS)
_LAST_H, _ROUNDS_H = relaxed(6, "SELECT DISTINCT src AS source, src AS node FROM sedges", "sedges", BY_HOPS)


def label_tables(src: str = "src", penalty: int = 3600, most: int = 4, scan: int = 6, name: str = "lab") -> str:
    """Label rounds unrolled over ``src`` (from_k, departure), routes, factors and transfers: tables that end in ``name``."""
    own = "from_k, departure"
    fields = "cost, walk, arr, path"
    least = lambda table: f"(SELECT {own}, k, m.cost AS cost, m.walk AS walk, m.arr AS arr, m.path AS path, m.rode AS rode FROM (SELECT {own}, k, min({{'cost': cost, 'walk': walk, 'arr': arr, 'path': path, 'rode': rode}}) AS m FROM {table} GROUP BY {own}, k))"
    walk = lambda table, pay: f"SELECT l.from_k, l.departure, w.dst AS k, l.cost + (seconds * 3 + 1) // 2 * 1000 + {pay * 1000} AS cost, l.walk + seconds AS walk, l.arr + seconds AS arr, l.path || '>walk>' || w.dst AS path FROM {table} l JOIN transfers w ON w.src = l.k AND w.seconds <= 180 WHERE l.walk + seconds <= 600"
    n = name
    made = [
        f"{n}_start AS (SELECT {own}, from_k AS k, departure * 1000 AS cost, 0::BIGINT AS walk, departure AS arr, from_k::VARCHAR AS path FROM {src})",
        f"{n}_access AS MATERIALIZED ({walk(f'{n}_start', penalty)})",
        f"{n}_settled_0 AS (SELECT {own}, k FROM {n}_start)",
        f"{n}_front_0 AS (SELECT * FROM {n}_start UNION ALL SELECT * FROM {n}_access)",
    ]
    for r in range(most + 1):
        ready = f"f.arr + {min(10, penalty // 60) if r else 0}"
        made.append(f"""{n}_board_{r} AS (SELECT * FROM (SELECT f.from_k, f.departure, t.trip_id, t.seq, t.t AS bt, t.mono, f.cost + (t.t - ({ready})) * 1000 + {penalty * 1000 if r else 0} AS cost, f.walk, f.path,
  row_number() OVER (PARTITION BY f.from_k, f.departure, f.k, t.pattern, t.seq ORDER BY t.t, t.trip_id) AS n FROM {n}_front_{r} f JOIN routes t ON t.k = f.k AND t.t >= {ready}) WHERE n <= {scan} OR NOT mono)""")
        made.append(f"""{n}_ride_{r} AS (SELECT b.from_k, b.departure, s.k, b.cost + greatest(0, s.t - b.bt) * x.cost_factor AS cost, b.walk, s.t AS arr, b.path || '>' || b.trip_id || ':' || b.seq || '-' || s.seq || '>' || s.k AS path, true AS rode
  FROM {n}_board_{r} b JOIN routes s ON s.trip_id = b.trip_id AND s.seq > b.seq JOIN factors x ON x.trip_id = b.trip_id{f" UNION ALL SELECT {own}, k, {fields}, false FROM {n}_access" if r == 0 else ""})""")
        made.append(f"{n}_fresh_{r} AS MATERIALIZED (SELECT * FROM {least(f'{n}_ride_{r}')} ANTI JOIN {n}_settled_{r} USING ({own}, k))")
        made.append(f"{n}_walked_{r} AS ({walk(f'(SELECT * FROM {n}_fresh_{r} WHERE rode)', penalty)})")
        made.append(f"{n}_both_{r} AS MATERIALIZED (SELECT * FROM {least(f'(SELECT * FROM {n}_fresh_{r} UNION ALL SELECT *, false AS rode FROM {n}_walked_{r})')} ANTI JOIN {n}_settled_{r} USING ({own}, k))")
        made.append(f"{n}_settled_{r + 1} AS MATERIALIZED (SELECT * FROM {n}_settled_{r} UNION ALL SELECT {own}, k FROM {n}_both_{r})")
        went = f"SELECT {own}, k, {fields} FROM {n}_both_{r}"
        made.append(f"{n}_front_{r + 1} AS ({went if r else f'SELECT b.from_k, b.departure, b.k, b.cost, b.walk, b.arr, b.path FROM {n}_both_0 b LEFT JOIN {n}_access a USING ({own}, k) WHERE a.path IS NULL OR a.path <> b.path'})")
    every = " UNION ALL ".join([f"SELECT {own}, k, 0 AS transfers, {fields} FROM {n}_start", *(f"SELECT {own}, k, {r} AS transfers, {fields} FROM {n}_both_{r}" for r in range(most + 1))])
    made.append(f"{n} AS MATERIALIZED ({every})")
    return ",\n".join(made)


NETWORK = ",\n".join((_ST, _STOPS, _PAIRS, _SAME, _NEAR, _TRANSFERS, _HOPS, _SPEEDS, _FACTORS, _ROUTES))

ORACLES = {
    "timetable_stop_times": f"{_with(_ST)} SELECT * FROM st",
    "parse_time_seconds": """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN (o_orderkey % 30)::VARCHAR || ':0' || (o_orderkey % 7)::VARCHAR WHEN 1 THEN '25:10:0' || (o_orderkey % 9)::VARCHAR WHEN 2 THEN o_orderkey::VARCHAR WHEN 3 THEN 'x' || o_orderkey::VARCHAR WHEN 4 THEN NULL ELSE ' 7:5 ' END AS x FROM orders)
SELECT o_orderkey, CASE WHEN regexp_full_match(trim(x), '[0-9]+') THEN trim(x)::BIGINT WHEN regexp_full_match(trim(x), '[0-9]+:[0-9]+(:[0-9]+)?') THEN split_part(trim(x), ':', 1)::BIGINT * 3600 + split_part(trim(x), ':', 2)::BIGINT * 60 + coalesce(nullif(split_part(trim(x), ':', 3), '')::BIGINT, 0) END AS seconds FROM s""",
    "departure_seconds": "SELECT event_id, CASE WHEN abs(v) >= 946684800 THEN v % 86400 ELSE v END AS seconds FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1738580100 + event_id ELSE event_id * 17 % 90000 END AS v FROM events)",
    "haversine_pairs": f"{_with(_ST, _STOPS, _HOPS)} SELECT src, dst, round({_M}, 3) AS meters FROM (SELECT DISTINCT src, dst FROM hops) JOIN stops a ON a.k = src JOIN stops b ON b.k = dst",
    "grid_cells": f"{_with(_STOPS)} SELECT k, floor(lat / (120.0::DOUBLE / 111320))::BIGINT AS r, floor(lon / (120.0::DOUBLE / 111320))::BIGINT AS c FROM stops",
    "station_keys": f"{_with(_STOPS)} SELECT k, station FROM stops",
    "stop_text_normalized": "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM part",
    "ride_edges": f"{_with(_ST, _HOPS, _EDGES)} SELECT * FROM edges",
    "incoming_edges": f"{_with(_ST, _HOPS, _EDGES)} SELECT dst AS k, string_agg(src::VARCHAR, ',' ORDER BY src) AS sources FROM edges GROUP BY dst",
    "two_hop_expansion": f"{_with(_ST, _HOPS, _EDGES)}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges) SELECT DISTINCT s.a AS k, t.b AS near FROM u s JOIN u t ON s.b = t.a UNION SELECT a, b FROM u",
    "route_patterns": f"{_with(_ST, _PATTERNS)} SELECT pattern, count(*) AS n_trips, min(dep0) AS first_dep FROM patterns GROUP BY pattern",
    "pattern_trips_ranked": f"{_with(_ST, _PATTERNS)} SELECT trip_id, pattern, row_number() OVER (PARTITION BY pattern ORDER BY dep0, trip_id)::INTEGER AS nth FROM patterns",
    "board_monotonic": f"{_with(_ST, _PATTERNS)}, r AS (SELECT pattern, seq, coalesce(t < lag(t) OVER (PARTITION BY pattern, seq ORDER BY dep0, trip_id), false) AS fell FROM st JOIN patterns USING (trip_id)) SELECT pattern, seq, NOT bool_or(fell) AS monotonic, count(*) AS n_trips FROM r GROUP BY pattern, seq",
    "same_station_transfers": f"{_with(_STOPS, _PAIRS, _SAME)} SELECT * FROM same",
    "nearby_transfers": f"{_with(_STOPS, _PAIRS, _NEAR)} SELECT * FROM near",
    "transfer_edges": f"{_with(_STOPS, _PAIRS, _SAME, _NEAR, _TRANSFERS)} SELECT * FROM transfers",
    "trip_avg_speed": f"{_with(_ST, _STOPS, _HOPS, _SPEEDS)} SELECT trip_id, round(speed, 6) AS speed FROM speeds",
    "trip_cost_factor": f"{_with(_ST, _STOPS, _HOPS, _SPEEDS, _FACTORS)} SELECT * FROM factors",
    "network_profile": f"""{_with(_ST, _STOPS, _HOPS, _SPEEDS, _FACTORS)}, a AS (SELECT route_type AS v, count(*) AS n FROM factors GROUP BY 1 ORDER BY n DESC, v LIMIT 8), b AS (SELECT cost_factor AS v, count(*) AS n FROM factors GROUP BY 1 ORDER BY n DESC, v LIMIT 8)
SELECT count(*) AS trips, round(avg((route_type = -1)::INTEGER), 6) AS unknown_share, (SELECT string_agg(v::VARCHAR || ':' || n::VARCHAR, ',' ORDER BY n DESC, v) FROM a) AS route_types, (SELECT string_agg(v::VARCHAR || ':' || n::VARCHAR, ',' ORDER BY n DESC, v) FROM b) AS cost_factors FROM factors""",
    "station_centroids": f"{_with(_STOPS)} SELECT station, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon FROM stops GROUP BY station",
    "station_edges": f"{_with(_ST, _STOPS, _STATION_EDGES)} SELECT * FROM sedges",
    "station_degrees": f"{_with(_ST, _STOPS, _STATION_EDGES, _DEGREES)} SELECT * FROM degrees",
    "hub_stations": f"{_with(_ST, _STOPS, _STATION_EDGES, _DEGREES)} SELECT station, out_degree + in_degree AS degree FROM degrees ORDER BY degree DESC, station LIMIT 512",
    "boardings_asof": f"{_with(_ST, _OD, _SRC, _ROUTES, _BOARD)} SELECT from_k, departure, trip_id, seq, board_t FROM board",
    "ride_alightings": f"{_with(_ST, _OD, _SRC, _ROUTES, _BOARD)} SELECT from_k, departure, b.trip_id, board_t, s.k, s.t AS arr FROM board b JOIN st s ON s.trip_id = b.trip_id AND s.seq > b.seq",
    "static_shortest_path": f"{_with(_ST, _OD, _HOPS, _EDGES, _ROUNDS_S)} SELECT * FROM {_LAST_S}",
    "station_hop_path": f"{_with(_ST, _STOPS, _STATION_EDGES, _ROUNDS_H)} SELECT * FROM {_LAST_H}",
    "raptor_labels": f"{_with(NETWORK, _OD, _SRC, label_tables())} SELECT from_k, departure, k, transfers, cost, walk, arr, path FROM lab",
    "reliability_rates": f"""{_with(NETWORK, _OD, _SRC, label_tables(), _EDGES, _ROUNDS_S)} SELECT count(*) AS n_requests, round(avg(CASE WHEN b.k IS NOT NULL OR s.node IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS found_rate, round(avg(CASE WHEN b.k IS NULL AND s.node IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS fallback_rate
FROM od LEFT JOIN lab b ON b.from_k = od.from_k AND b.departure = od.departure AND b.k = od.to_k LEFT JOIN {_LAST_S} s ON s.source = od.from_k AND s.node = od.to_k""",
    "stop_bbox_quantiles": f"""{_with(_STOPS)}, box AS (SELECT CASE WHEN count(*) >= 100 THEN quantile_cont(lat, 0.005) ELSE min(lat) END AS a, CASE WHEN count(*) >= 100 THEN quantile_cont(lat, 0.995) ELSE max(lat) END AS b, CASE WHEN count(*) >= 100 THEN quantile_cont(lon, 0.005) ELSE min(lon) END AS c, CASE WHEN count(*) >= 100 THEN quantile_cont(lon, 0.995) ELSE max(lon) END AS d FROM stops),
m AS (SELECT *, 500.0::DOUBLE / 111320 AS n, 500.0::DOUBLE / (111320 * greatest(1e-6, cos(radians((a + b) / 2)))) AS e FROM box) SELECT round(a - n, 9) AS lat_low, round(b + n, 9) AS lat_high, round(c - e, 9) AS lon_low, round(d + e, 9) AS lon_high FROM m""",
    "event_counts": "SELECT event_type, count(*) AS n_events FROM events GROUP BY event_type",
}
