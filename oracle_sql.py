"""DuckDB twins of the registered queries.

They share no logic with the Spark side: allocation is a recursive CTE that
walks every area one request at a time over its grid.
"""

from __future__ import annotations

# --- derived logs ---------------------------------------------------------------------------

AREAS = """
areas AS (
  SELECT (n_regionkey - 5)::BIGINT AS seq, 'event-' || n_regionkey || '#' || n_nationkey AS event_area_id,
         'event-' || n_regionkey AS event_id, n_nationkey::VARCHAR AS area_id, n_nationkey AS nation,
         (100 * (1 + n_nationkey % 5))::INTEGER AS price,
         (5 + n_nationkey % 4)::INTEGER AS row_count, (6 + n_nationkey % 5)::INTEGER AS col_count
  FROM nation JOIN region ON r_regionkey = n_regionkey),
init AS (
  SELECT *, (row_count * col_count)::INTEGER AS available_seats,
         rtrim(repeat(repeat('1', col_count) || '|', row_count), '|') AS grid
  FROM areas)"""

RAW = """
raw AS (
  SELECT event_id + 1 AS seq, ts, 'r-' || e.event_id AS reservation_id, user_id::VARCHAR AS user_id,
         'event-' || coalesce(n_regionkey, 0) AS event_id, nk::VARCHAR AS area_id,
         (floor(value)::BIGINT % 6)::INTEGER AS num_of_seats, 0::INTEGER AS num_of_seat,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'RANDOM'
              WHEN event_type = 'signup' THEN 'SELF_PICK' ELSE 'BOGUS' END AS type,
         CASE WHEN event_type <> 'signup' THEN NULL
              WHEN e.event_id % 2 = 0 THEN [{'r': k % 9, 'c': e.event_id % 11}, {'r': k % 9, 'c': e.event_id % 11 + 1}]
              ELSE [{'r': k % 9, 'c': e.event_id % 11}] END AS seats
  FROM (SELECT *, k % 26 AS nk FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events)) e
  LEFT JOIN nation ON n_nationkey = nk)"""

REQ = RAW + """,
req AS (
  SELECT seq, ts, reservation_id, user_id, event_id, area_id, num_of_seats, num_of_seat,
         CASE WHEN type IN ('RANDOM', 'SELF_PICK', 'INVALID') THEN type ELSE 'INVALID' END AS type,
         coalesce(seats, []) AS seats, event_id || '#' || area_id AS event_area_id
  FROM raw)"""

PINNED = """
snap AS (
  SELECT *, length(replace(replace(grid, '0', ''), '|', ''))::INTEGER AS available_seats FROM (
    SELECT seq, event_area_id, event_id, area_id, price, row_count, col_count,
           array_to_string(list_transform(range(0, row_count), lambda r: array_to_string(list_transform(range(0, col_count),
             lambda c: CASE WHEN nation % 6 = 0 OR (r * 7 + c * 3 + nation) % 5 = 0 THEN '0' ELSE '1' END), '')), '|') AS grid
    FROM areas WHERE nation % 7 <> 6))"""

INITIAL = "snap AS (SELECT * FROM init)"

AREA_UPDATES = AREAS + """,
updates AS (
  SELECT e.event_id + 1 AS seq, a.event_area_id, a.event_id, a.area_id, a.price, a.row_count, a.col_count,
         (floor(value)::BIGINT % (a.row_count * a.col_count + 1))::INTEGER AS available_seats
  FROM events e JOIN areas a ON a.nation = (props->>'$.k')::INTEGER % 25)"""

RESERVATION_UPDATES = """
updates AS (
  SELECT event_id + 1 AS seq, 'u-' || user_id AS reservation_id,
         'event-' || ((props->>'$.k')::INTEGER % 5) AS event_id, ((props->>'$.k')::INTEGER % 25)::VARCHAR AS area_id,
         (floor(value)::BIGINT % 6)::INTEGER AS num_of_seats,
         CASE event_type WHEN 'purchase' THEN 'RESERVED' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PROCESSING'
                         WHEN 'click' THEN 'PAID' ELSE 'CANCELLED' END AS state,
         CASE WHEN event_type = 'error' THEN '[NOT_AVAILABLE]: sold out' ELSE '' END AS failed_reason
  FROM events)"""

TIMES = """
times AS (
  SELECT *, coalesce(post_ms, 0) + coalesce(get_ms, 0) AS response_ms FROM (
    SELECT 'r-' || event_id AS reservation_id, ts, event_type AS config, floor(value)::INTEGER AS post_ms,
           CASE WHEN event_id % 17 <> 0 THEN (props->>'$.k')::INTEGER END AS get_ms,
           CASE WHEN event_id % 50 = 0 THEN 503 ELSE 200 END AS post_status,
           CASE WHEN event_id % 17 <> 0 THEN CASE WHEN event_id % 40 = 0 THEN 404 ELSE 200 END END AS get_status,
           (event_id % 5)::INTEGER AS round
    FROM events))"""

WAITS = """
asks AS (SELECT 'r-' || event_id AS reservation_id, ts AS ask_ts FROM events),
own AS (
  SELECT event_id, epoch_us(ts) + ((props->>'$.k')::BIGINT - 50) * 400000 AS us FROM events WHERE event_id % 17 <> 0),
outcomes AS (
  SELECT 'r-' || event_id AS reservation_id, make_timestamp(min(us)) AS outcome_ts FROM (
    SELECT event_id, us FROM own
    UNION ALL SELECT event_id, us + 7000000 FROM own WHERE event_id % 3 = 0
    UNION ALL SELECT event_id, us - 3600000000 FROM own WHERE event_id % 5 = 0)
  GROUP BY event_id)"""

DECIDED = """
decided AS (
  SELECT *, CASE WHEN failed_reason = '' THEN 'PROCESSING' ELSE 'FAILED' END AS state FROM (
    SELECT q.*, CASE
      WHEN s.event_area_id IS NULL THEN ''
      WHEN q.type = 'RANDOM' THEN CASE WHEN q.num_of_seats <= s.available_seats AND q.num_of_seats <= s.col_count
           THEN '' ELSE 'request rejected at cache level' END
      WHEN q.type = 'SELF_PICK' THEN CASE WHEN len(list_filter(q.seats, lambda x: x.r < 0 OR x.r >= s.row_count
             OR x.c < 0 OR x.c >= s.col_count OR substr(s.grid, x.r * (s.col_count + 1) + x.c + 1, 1) <> '1')) = 0
           THEN '' ELSE 'request rejected at cache level' END
      ELSE q.type || ' type reservation is not supported' END AS failed_reason
    FROM req q LEFT JOIN snap s ON s.event_area_id = q.event_area_id))"""

PASSED = "passed AS (SELECT * FROM decided WHERE state = 'PROCESSING')"


def seats_text(column: str = "seats") -> str:
    return f"array_to_string(list_transform({column}, lambda s: s.r || '-' || s.c), ',')"


def walk(requests: str, areas: str = "init", back_row: bool = False) -> str:
    """CTEs ``walk`` (one row per step of an area, step 0 is its creation) and ``results``."""
    search = "instr(w.grid, repeat('1', r.num_of_seats))"
    if back_row:
        run = "repeat('1', r.num_of_seats)"
        mirrored = f"length(w.grid) - r.num_of_seats + 2 - instr(reverse(w.grid), {run})"
        search = (
            f"CASE WHEN r.type <> 'BACK_ROW' THEN {search} WHEN instr(w.grid, {run}) = 0 THEN 0 ELSE {mirrored} END"
        )
    return f"""
ranked AS (
  SELECT q.*, row_number() OVER (PARTITION BY event_area_id ORDER BY seq, reservation_id) AS rn
  FROM {requests} q WHERE event_area_id IN (SELECT event_area_id FROM {areas})),
walk(event_area_id, rn, seq, reservation_id, grid, available_seats, row_count, col_count, code, message, seats) AS (
  SELECT event_area_id, 0::BIGINT, seq, NULL::VARCHAR, grid, available_seats, row_count, col_count,
         NULL::VARCHAR, NULL::VARCHAR, []::STRUCT(r BIGINT, c BIGINT)[]
  FROM {areas}
  UNION ALL
  SELECT event_area_id, rn, seq, reservation_id,
         CASE WHEN code IS NULL THEN array_to_string(list_transform(range(1, length(grid) + 1), lambda i:
           CASE WHEN list_contains(list_transform(won, lambda s: s.r * (col_count + 1) + s.c + 1), i)
                THEN '0' ELSE substr(grid, i, 1) END), '') ELSE grid END,
         (available_seats - CASE WHEN code IS NULL THEN len(won) ELSE 0 END)::INTEGER,
         row_count, col_count, code,
         CASE WHEN code IS NULL THEN NULL
              WHEN type IN ('RANDOM') AND code = 'INVALID_ARGUMENT' THEN num_of_seats || ' continuous seats is invalid'
              WHEN type = 'RANDOM' THEN 'no continuous ' || num_of_seats || ' seats at area ' || area_id || ' in event ' || event_id
              WHEN type = 'BACK_ROW' AND code = 'INVALID_ARGUMENT' THEN num_of_seats || ' seats at the back are invalid'
              WHEN type = 'BACK_ROW' THEN 'no ' || num_of_seats || ' seats left at the back'
              WHEN code = 'INVALID_SEAT' THEN event_area_id || ' (' || bad.r || ', ' || bad.c || ') is not a valid seat.'
              WHEN code = 'NOT_AVAILABLE' THEN event_area_id || ' (' || bad.r || ', ' || bad.c || ') is unavailable.'
              ELSE type || ' reservation strategy is not implemented' END,
         won
  FROM (
    SELECT *, CASE WHEN type IN ('RANDOM', 'BACK_ROW') THEN
                     list_transform(range(0, CASE WHEN p > 0 THEN num_of_seats ELSE 0 END),
                       lambda i: {{'r': (p - 1) // (col_count + 1), 'c': (p - 1) % (col_count + 1) + i}})
                   ELSE seats END AS won,
           CASE WHEN type IN ('RANDOM', 'BACK_ROW') THEN
                  CASE WHEN num_of_seats <= 0 THEN 'INVALID_ARGUMENT' WHEN p = 0 THEN 'NOT_AVAILABLE' END
                WHEN type = 'SELF_PICK' THEN
                  CASE WHEN bad IS NULL THEN NULL
                       WHEN bad.r < 0 OR bad.r >= row_count OR bad.c < 0 OR bad.c >= col_count THEN 'INVALID_SEAT'
                       ELSE 'NOT_AVAILABLE' END
                ELSE 'INVALID_ARGUMENT' END AS code
    FROM (
      SELECT r.*, w.grid, w.available_seats, w.row_count, w.col_count,
             CASE WHEN r.num_of_seats > 0 THEN {search} ELSE 0 END AS p,
             list_filter(r.seats, lambda s: s.r < 0 OR s.r >= w.row_count OR s.c < 0 OR s.c >= w.col_count
               OR substr(w.grid, s.r * (w.col_count + 1) + s.c + 1, 1) = '0')[1] AS bad
      FROM walk w JOIN ranked r ON r.event_area_id = w.event_area_id AND r.rn = w.rn + 1))),
results AS (
  SELECT q.*, CASE WHEN w.rn IS NOT NULL AND w.code IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS result,
         CASE WHEN w.rn IS NOT NULL AND w.code IS NULL THEN w.seats END AS won,
         CASE WHEN w.rn IS NULL THEN 'INVALID_EVENT_AREA' ELSE w.code END AS error_code,
         CASE WHEN w.rn IS NULL THEN q.event_area_id || ' event area does not exist' ELSE w.message END AS error_message
  FROM {requests} q LEFT JOIN (SELECT * FROM walk WHERE rn > 0) w
    ON w.event_area_id = q.event_area_id AND w.seq = q.seq AND w.reservation_id = q.reservation_id)"""


FINAL = """
final AS (
  SELECT d.seq, d.ts, d.reservation_id, d.user_id, d.event_id, d.area_id, d.event_area_id, d.num_of_seats, d.num_of_seat,
         d.type,
         CASE WHEN x.result = 'SUCCESS' THEN 'RESERVED' ELSE 'FAILED' END AS state,
         CASE WHEN x.result = 'SUCCESS' THEN x.won ELSE d.seats END AS seats,
         CASE WHEN d.state = 'FAILED' THEN d.failed_reason WHEN x.result = 'SUCCESS' THEN ''
              ELSE '[' || x.error_code || ']: ' || x.error_message END AS failed_reason
  FROM decided d LEFT JOIN results x ON x.reservation_id = d.reservation_id)"""


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"


BASE = (AREAS, REQ)
FLOW = (AREAS, REQ, INITIAL, DECIDED, PASSED, walk("passed"), FINAL)
PLAIN = (AREAS, REQ, walk("req"))
PIN = (AREAS, REQ, PINNED, DECIDED)

FINAL_COLUMNS = (
    f"reservation_id, user_id, event_id, area_id, num_of_seats, type, state, {seats_text()} AS seats, failed_reason"
)
FOLD_COLUMNS = (
    f"reservation_id, event_area_id, result, {seats_text('won')} AS seats, error_code, error_message"
)
RESULT_COLUMNS = f"seq, ts, reservation_id, result, {seats_text('won')} AS seats, error_code, error_message"
RESERVE_COLUMNS = (
    f"seq, ts, event_area_id, reservation_id, event_id, area_id, num_of_seats, num_of_seat, type, {seats_text()} AS seats"
)
REQUEST_COLUMNS = (
    f"seq, ts, reservation_id, user_id, event_id, area_id, num_of_seats, num_of_seat, type, {seats_text()} AS seats"
)


def of_type(name: str) -> str:
    wanted = f"wanted AS (SELECT * FROM req WHERE type = '{name}')"
    return ctes(AREAS, REQ, wanted, walk("wanted")) + f"SELECT {FOLD_COLUMNS} FROM results"


def passing(name: str, predicate: str) -> str:
    return ctes(AREAS, REQ, PINNED) + f"""
SELECT q.reservation_id, q.event_area_id, {predicate} AS passes
FROM req q JOIN snap s ON s.event_area_id = q.event_area_id WHERE q.type = '{name}'"""


def routed(where: str) -> str:
    return ctes(RESERVATION_UPDATES) + f"SELECT seq, reservation_id, state, failed_reason FROM updates WHERE {where}"


def line_flow(hot: bool) -> str:
    """Walks each area until it has no seat left; all later requests fail for that reason."""
    supplier = "0" if hot else "l_suppkey"
    return f"""WITH RECURSIVE
lines AS (SELECT *, {supplier} AS supplier FROM lineitem),
req AS (
  SELECT epoch_us(l_shipdate) // 86400000000 AS seq,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS reservation_id,
         l_orderkey::VARCHAR AS user_id, 'event-' || s_nationkey AS event_id, supplier::VARCHAR AS area_id,
         (1 + trunc(l_quantity)::INTEGER % 4)::INTEGER AS n
  FROM lines JOIN supplier s ON s_suppkey = lines.supplier),
ranked AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY seq, reservation_id) AS rn FROM req),
walk(area_id, rn, grid, p, n) AS (
  SELECT s_suppkey::VARCHAR, 0::BIGINT, rtrim(repeat(repeat('1', 20) || '|', 20), '|'), 0::BIGINT, 0 FROM supplier
  UNION ALL
  SELECT area_id, rn, CASE WHEN p = 0 THEN grid ELSE grid[1:p - 1] || repeat('0', n) || grid[p + n:] END, p, n
  FROM (SELECT w.area_id, r.rn, w.grid, r.n, instr(w.grid, repeat('1', r.n)) AS p
        FROM walk w JOIN ranked r ON r.area_id = w.area_id AND r.rn = w.rn + 1 WHERE contains(w.grid, '1')))
SELECT r.reservation_id, r.user_id, r.event_id, r.area_id, r.n AS num_of_seats, 'RANDOM' AS type,
       CASE WHEN w.p > 0 THEN 'RESERVED' ELSE 'FAILED' END AS state,
       CASE WHEN w.p > 0 THEN array_to_string(list_transform(range(0, r.n),
         lambda i: ((w.p - 1) // 21) || '-' || ((w.p - 1) % 21 + i)), ',') ELSE '' END AS seats,
       CASE WHEN w.p > 0 THEN '' ELSE '[NOT_AVAILABLE]: no continuous ' || r.n || ' seats at area ' || r.area_id
         || ' in event ' || r.event_id END AS failed_reason
FROM ranked r LEFT JOIN walk w ON w.area_id = r.area_id AND w.rn = r.rn"""


SOLD = "sold AS (SELECT event_id, area_id, unnest(seats) AS s FROM final WHERE state = 'RESERVED')"
PER_AREA = (
    "per_area AS (SELECT event_id, area_id, count(DISTINCT (s.r, s.c)) AS seats_reserved FROM sold GROUP BY ALL)"
)
STAGES = TIMES + """,
stages AS (
  SELECT reservation_id, 1::INTEGER AS stage_no, 'requested' AS stage, ts AS stage_ts FROM times
  UNION ALL SELECT reservation_id, 2, 'filtered', make_timestamp(epoch_us(ts) + post_ms * 1000) FROM times
  UNION ALL SELECT reservation_id, 3, 'allocated', make_timestamp(epoch_us(ts) + (post_ms + get_ms) * 1000)
            FROM times WHERE get_ms IS NOT NULL
  UNION ALL SELECT reservation_id, 4, 'final', make_timestamp(epoch_us(ts) + (post_ms + get_ms) * 1000 + 1000)
            FROM times WHERE get_ms IS NOT NULL)"""

JSON_TEXT = """
sent AS (
  SELECT *, '{"userId":"' || user_id || '","eventId":"' || event_id || '","areaId":"' || area_id || '","numOfSeats":'
         || num_of_seats || ',"type":"' || type || '"' || CASE WHEN seats IS NULL THEN '' ELSE ',"seats":['
         || array_to_string(list_transform(seats, lambda s: '{"row":' || s.r || ',"col":' || s.c || '}'), ',') || ']' END
         || '}' AS value
  FROM raw)"""

LATEST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY seq DESC) = 1"

LOOKUP_WAIT = ctes(WAITS) + """
SELECT a.reservation_id, a.ask_ts, o.outcome_ts, o.outcome_ts IS NULL AS timed_out
FROM asks a LEFT JOIN outcomes o
  ON o.reservation_id = a.reservation_id AND o.outcome_ts <= a.ask_ts + INTERVAL 10 SECOND"""

PERCENTILE_SKETCHES = ctes(TIMES) + """
SELECT window_start, count(*) AS n, true AS p50_within, true AS p95_within, true AS p99_within
FROM (SELECT date_trunc('hour', ts) AS window_start FROM times UNION ALL SELECT NULL FROM times) GROUP BY ALL"""

RATE_TUMBLING = ctes(TIMES) + """
SELECT make_timestamp(epoch_us(ts) // 250000 * 250000) AS window_start, count(*) AS n FROM times GROUP BY ALL"""

FINAL_AREAS = ctes(*PLAIN) + """
SELECT event_area_id, any_value(row_count) AS row_count, any_value(col_count) AS col_count,
       max_by(available_seats, rn) AS available_seats, max_by(grid, rn) AS grid
FROM walk GROUP BY event_area_id"""

ORACLES: dict[str, str] = {
    # sources and sinks
    "src_create_event": ctes(AREAS) + """
SELECT a.seq, a.event_id AS event_name, r_name AS artist, string_agg(
         a.area_id || ':' || a.price || ':' || a.row_count || ':' || a.col_count, ',' ORDER BY a.nation) AS areas
FROM areas a JOIN region ON a.event_id = 'event-' || r_regionkey GROUP BY ALL""",
    "src_reserve_seat": ctes(*BASE) + f"SELECT {RESERVE_COLUMNS} FROM req",
    "src_reservation_requests": ctes(*BASE) + f"SELECT {REQUEST_COLUMNS} FROM req",
    "src_reservation_results": ctes(*FLOW) + f"SELECT {RESULT_COLUMNS} FROM results",
    "src_reservation_state": ctes(*FLOW) + f"SELECT {REQUEST_COLUMNS}, state, failed_reason FROM final",
    "area_status_snapshot": ctes(AREA_UPDATES) + "SELECT event_area_id, seq, row_count, col_count, available_seats "
    "FROM updates " + LATEST.format("event_area_id"),
    "sink_results_roundtrip": ctes(*FLOW) + f"SELECT {RESULT_COLUMNS} FROM results",
    "area_status_changelog": ctes(*PLAIN) + "SELECT event_area_id, seq, available_seats, grid FROM walk WHERE code IS NULL",
    "area_status_deltas": ctes(*PLAIN) + """
SELECT event_area_id, seq, available_seats, array_to_string(list_sort(list_distinct(
         list_transform(seats, lambda s: s.r * col_count + s.c))), ',') AS cells
FROM walk WHERE code IS NULL""",
    "area_status_at_requests": ctes(*PLAIN) + """
SELECT event_area_id, seq, reservation_id, available_seats, grid FROM walk WHERE rn > 0""",
    "sink_reserve_seat_roundtrip": ctes(*PIN) + f"SELECT {RESERVE_COLUMNS} FROM decided WHERE state = 'PROCESSING'",
    "final_reservations": ctes(*FLOW) + f"SELECT {FINAL_COLUMNS} FROM final",
    "ingest_json_requests": ctes(RAW, JSON_TEXT) + f"""
SELECT seq, 'accepted' AS status,
       concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS reservation_id, user_id,
       event_id || '#' || area_id AS event_area_id, num_of_seats, num_of_seat,
       CASE WHEN type = 'BOGUS' THEN 'INVALID' ELSE type END AS type, {seats_text("coalesce(seats, [])")} AS seats
FROM (SELECT *, sha256(seq || chr(1) || value) AS h FROM sent WHERE seq % 97 <> 0)
UNION ALL
SELECT seq, 'rejected', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM sent WHERE seq % 97 = 0""",
    "ingest_json_events": """
SELECT o_orderkey::BIGINT AS seq, o_orderkey::VARCHAR AS event_name,
       CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey::VARCHAR ELSE '' END AS artist,
       o_orderdate::TIMESTAMP + INTERVAL 123 MILLISECOND AS opening_ts, true AS no_closing, coalesce((
         SELECT string_agg(l_linenumber || ':' || CASE WHEN l_linenumber <> 2 THEN l_partkey ELSE 0 END || ':'
                           || (1 + l_suppkey % 9) || ':' || (1 + l_partkey % 7), ',' ORDER BY l_linenumber::VARCHAR, CASE WHEN l_linenumber <> 2 THEN l_partkey END NULLS FIRST,
                                          l_suppkey % 9, l_partkey % 7)
         FROM lineitem WHERE l_orderkey = o_orderkey), '') AS areas
FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 97 <> 0""",
    "area_snapshot_of_all": """
        SELECT 'part#' || l_partkey AS event_area_id,
               max(l_orderkey::BIGINT * 10000 + l_linenumber * 1000 + l_suppkey % 1000) AS seq
        FROM lineitem GROUP BY l_partkey
    """,
    "asof_many_versions": """
WITH v AS (SELECT l_suppkey, l_orderkey::BIGINT AS since, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY ALL)
SELECT r.l_suppkey, r.l_partkey, r.l_linenumber, (r.l_orderkey - 3)::BIGINT AS at, v.since, v.lines
FROM lineitem r ASOF LEFT JOIN v ON v.l_suppkey = r.l_suppkey AND v.since <= r.l_orderkey - 3""",
    "typed_roundtrip": ctes(*BASE) + f"SELECT {REQUEST_COLUMNS} FROM req",
    # projections
    "event_areas": ctes(AREAS) + "SELECT event_area_id, event_id, area_id, price, row_count, col_count FROM areas",
    "area_status_init": ctes(AREAS) + "SELECT event_area_id, row_count, col_count, available_seats, grid FROM init",
    "seat_rows": ctes(AREAS, PINNED.replace(" WHERE nation % 7 <> 6", "")) + """
SELECT event_area_id, r::INTEGER AS row, c::INTEGER AS col, substr(grid, r * (col_count + 1) + c + 1, 1) = '1' AS is_available
FROM (SELECT *, unnest(range(0, row_count)) AS r FROM snap), LATERAL (SELECT unnest(range(0, col_count)) AS c)""",
    "event_area_key": ctes(*BASE) + "SELECT reservation_id, event_area_id FROM req",
    "reservations_created": ctes(*BASE) + f"SELECT {REQUEST_COLUMNS}, 'PROCESSING' AS state, '' AS failed_reason FROM req",
    "unmatched_results_dropped": ctes(*FLOW) + "SELECT reservation_id, result, error_code FROM results WHERE seq % 3 = 0",
    "reserve_seat_requests": ctes(*PIN) + f"SELECT {RESERVE_COLUMNS} FROM decided WHERE state = 'PROCESSING'",
    "route_processed": routed("state IN ('FAILED', 'RESERVED')"),
    "route_processing": routed("state = 'PROCESSING'"),
    "route_invalid": routed("state NOT IN ('FAILED', 'RESERVED', 'PROCESSING')"),
    "dead_letter_states": ctes(RESERVATION_UPDATES) + """
SELECT state, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM updates
WHERE state IN ('PAID', 'CANCELLED') GROUP BY state""",
    "request_type_coerced": ctes(RAW) + """
SELECT reservation_id, sent, CASE WHEN sent IN ('RANDOM', 'SELF_PICK', 'INVALID') THEN sent ELSE 'INVALID' END AS type
FROM (SELECT *, CASE WHEN seq % 13 = 0 THEN lower(type) WHEN seq % 29 = 0 THEN NULL ELSE type END AS sent FROM raw)""",
    "request_seats_normalised": ctes(*BASE) + f"""
SELECT reservation_id, len(seats)::INTEGER AS n_seats, {seats_text()} AS seats FROM req""",
    "failure_messages": ctes(*PLAIN) + "SELECT reservation_id, error_message FROM results WHERE result = 'FAILED'",
    "event_times": ctes(AREAS, REQ) + """
SELECT id, epoch_us(t) // 1000 AS millis, make_timestamp(epoch_us(t) // 1000 * 1000) AS at_ts FROM (
  SELECT DISTINCT event_id AS id, TIMESTAMP '2024-01-01 10:00:00.123456' AS t FROM areas
  UNION ALL SELECT reservation_id, ts FROM req)""",
    "reservation_json": ctes(*FLOW) + """
SELECT reservation_id, '{"reservationId":"' || reservation_id || '","userId":"' || user_id || '","eventId":"' || event_id
  || '","areaId":"' || area_id || '","numOfSeats":' || num_of_seats || ',"numOfSeat":0,"type":"' || type || '","seats":['
  || array_to_string(list_transform(seats, lambda s: '{"row":' || s.r || ',"col":' || s.c || '}'), ',')
  || '],"state":"' || state || '","failedReason":"' || failed_reason || '"}' AS document FROM final""",
    # tables, joins, lookups
    "area_latest": ctes(AREA_UPDATES) + "SELECT * FROM updates " + LATEST.format("event_area_id"),
    "reservation_latest": ctes(RESERVATION_UPDATES)
    + "SELECT reservation_id, seq, event_id, area_id, num_of_seats, state, failed_reason FROM updates "
    + LATEST.format("reservation_id"),
    "changelog_compacted": ctes(AREA_UPDATES)
    + "SELECT seq // 500 AS batch, event_area_id, seq, available_seats FROM updates "
    + LATEST.format("seq // 500, event_area_id"),
    "prefilter_decisions": ctes(*PIN) + "SELECT reservation_id, event_area_id, state, failed_reason FROM decided",
    "allocator_area_lookup": ctes(*BASE) + """
SELECT q.reservation_id, q.event_area_id, a.row_count IS NOT NULL AS known, a.row_count, a.col_count
FROM req q LEFT JOIN areas a ON a.event_area_id = q.event_area_id""",
    # Created by the pinned snapshot, decided by the flow: two different filters meet here on purpose.
    "apply_results": ctes(AREAS, REQ, INITIAL, DECIDED, PASSED, walk("passed"), PINNED.replace("snap AS", "snap2 AS"),
                          DECIDED.replace("decided AS", "decided2 AS").replace("snap s", "snap2 s")) + f"""
SELECT d.reservation_id, d.user_id, d.event_id, d.area_id, d.num_of_seats, d.type,
       CASE WHEN x.result = 'SUCCESS' THEN 'RESERVED' ELSE 'FAILED' END AS state,
       {seats_text("CASE WHEN x.result = 'SUCCESS' THEN x.won ELSE d.seats END")} AS seats,
       CASE WHEN x.result = 'SUCCESS' THEN '' ELSE '[' || x.error_code || ']: ' || x.error_message END AS failed_reason
FROM decided2 d JOIN results x ON x.reservation_id = d.reservation_id
WHERE d.state = 'PROCESSING'""",
    "reservation_updates": ctes(*FLOW) + f"""
SELECT reservation_id, user_id, event_id, area_id, num_of_seats, type, state, {seats_text()} AS seats, failed_reason
FROM decided
UNION ALL
SELECT {FINAL_COLUMNS} FROM final WHERE reservation_id IN (SELECT reservation_id FROM passed)""",
    "lookup_wait": LOOKUP_WAIT,
    "reservation_lookup": ctes(RESERVATION_UPDATES) + """
SELECT reservation_id, seq, state FROM (SELECT * FROM updates """ + LATEST.format("reservation_id") + """)
WHERE reservation_id IN (SELECT 'u-' || c_custkey FROM customer)""",
    "area_cache_topn": """
SELECT 'event-' || s_nationkey || '#' || s_suppkey AS event_area_id, max(epoch_us(l_shipdate)) // 86400000000 AS seq
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY event_area_id ORDER BY seq DESC, event_area_id DESC LIMIT 50""",
    # pre-filter and allocation
    "prefilter_random": passing("RANDOM", "q.num_of_seats <= s.available_seats AND q.num_of_seats <= s.col_count"),
    "prefilter_self_pick": passing(
        "SELF_PICK",
        "len(list_filter(q.seats, lambda x: x.r >= 0 AND x.r < s.row_count AND x.c >= 0 AND x.c < s.col_count AND "
        "substr(s.grid, x.r * (s.col_count + 1) + x.c + 1, 1) = '1')) = len(q.seats)",
    ),
    "reserve_random": of_type("RANDOM"),
    "reserve_self_pick": of_type("SELF_PICK"),
    "reserve_seats": ctes(*PLAIN) + f"SELECT {FOLD_COLUMNS} FROM results",
    "area_status_final": FINAL_AREAS,
    "reservation_flow_final": ctes(*FLOW) + f"SELECT {FINAL_COLUMNS} FROM final",
    "strategy_extension": ctes(
        AREAS, REQ,
        "mixed AS (SELECT * REPLACE (CASE WHEN type = 'RANDOM' AND seq % 2 = 0 THEN 'BACK_ROW' ELSE type END AS type) FROM req)",
        walk("mixed", back_row=True),
    ) + f"SELECT {FOLD_COLUMNS} FROM results",
    "strategy_extension_flow": ctes(
        AREAS, REQ,
        "mixed AS (SELECT * REPLACE (CASE WHEN type = 'RANDOM' AND seq % 2 = 0 THEN 'BACK_ROW' ELSE type END AS type) FROM req)",
        walk("mixed", back_row=True),
    ) + f"""
SELECT m.reservation_id, m.type, CASE WHEN x.result = 'SUCCESS' THEN 'RESERVED' ELSE 'FAILED' END AS state,
       {seats_text("CASE WHEN x.result = 'SUCCESS' THEN x.won ELSE m.seats END")} AS seats
FROM mixed m JOIN results x ON x.reservation_id = m.reservation_id""",
    # reports
    "outcome_counts": ctes(*FLOW, TIMES) + """
SELECT count(*) FILTER (post_status = 200 AND state = 'RESERVED') AS successful,
       count(*) FILTER (post_status = 200 AND state <> 'RESERVED') AS failed,
       count(*) FILTER (post_status <> 200) AS errors
FROM final JOIN times USING (reservation_id)""",
    "seats_per_area": ctes(*FLOW, SOLD, PER_AREA) + "SELECT * FROM per_area",
    "seats_rollup": ctes(*FLOW, SOLD, PER_AREA) + """
SELECT event_id, area_id, sum(seats_reserved)::BIGINT AS seats_reserved FROM per_area GROUP BY ROLLUP (event_id, area_id)""",
    "double_booking_audit": ctes(*FLOW, SOLD) + """
SELECT event_id || '#' || area_id AS event_area_id, s.r::INTEGER AS row, s.c::INTEGER AS col, count(*) AS times_sold
FROM sold GROUP BY ALL HAVING count(*) > 1""",
    "double_booking_found": ctes(
        *FLOW,
        """twice AS (SELECT event_area_id, unnest(seats) AS s FROM (
  SELECT * FROM final UNION ALL SELECT * FROM final WHERE seq % 3 = 0) WHERE state = 'RESERVED')""",
    ) + """
SELECT event_area_id, s.r::INTEGER AS row, s.c::INTEGER AS col, count(*) AS times_sold
FROM twice GROUP BY ALL HAVING count(*) > 1""",
    "response_time": ctes(TIMES) + "SELECT reservation_id, response_ms FROM times",
    "latency_percentiles": ctes(TIMES) + "SELECT " + ", ".join(
        f"round(quantile_cont({column}, {point}), 6) AS {label}_{name}"
        for name, column in (("processing", "response_ms"), ("latency", "response_ms + round"))
        for label, point in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    ) + " FROM times WHERE post_status = 200",
    "latency_percentiles_rank": ctes(TIMES) + """
SELECT measure, point, (SELECT count(*) FROM times WHERE post_status = 200) AS calls, true AS within_bound
FROM (VALUES ('processing'), ('latency')) AS m(measure), (VALUES ('p50'), ('p95'), ('p99')) AS p(point)""",
    "check_rate_trend": ctes(TIMES) + """
SELECT checks, checks_passed, round(checks_passed / checks, 6) AS check_rate, completed, round(avg_ms, 6) AS avg_ms,
       min_ms, round(med_ms, 6) AS med_ms, max_ms, round(p90_ms, 6) AS p90_ms, round(p95_ms, 6) AS p95_ms
FROM (SELECT count(*) + count(*) FILTER (post_status = 200 AND get_status IS NOT NULL) AS checks,
             count(*) FILTER (post_status = 200) + count(*) FILTER (done) AS checks_passed,
             count(*) FILTER (done) AS completed, avg(d) AS avg_ms, min(d) AS min_ms, quantile_cont(d, 0.5) AS med_ms,
             max(d) AS max_ms, quantile_cont(d, 0.9) AS p90_ms, quantile_cont(d, 0.95) AS p95_ms
      FROM (SELECT *, post_status = 200 AND get_status IS NOT NULL AND get_status = 200 AS done,
                   CASE WHEN post_status = 200 AND get_status = 200 THEN response_ms END AS d FROM times))""",
    "rate_tumbling": RATE_TUMBLING,
    "rate_tumbling_hourly": ctes(TIMES)
    + "SELECT date_trunc('hour', ts) AS window_start, count(*) AS n FROM times GROUP BY ALL",
    "duration_percentile_tumbling": ctes(TIMES) + """
SELECT date_trunc('hour', ts) AS window_start, round(quantile_cont(response_ms, 0.95), 6) AS duration_ms, count(*) AS n
FROM times GROUP BY ALL""",
    "sold_out_time": ctes(*PLAIN) + """,
emptied AS (
  SELECT w.event_area_id, min_by(q.ts, w.rn) AS sold_out_ts
  FROM walk w JOIN req q ON q.reservation_id = w.reservation_id
  WHERE w.code IS NULL AND w.available_seats <= 0 GROUP BY w.event_area_id),
started AS (SELECT event_id, min(ts) AS first_request_ts FROM req GROUP BY event_id)
SELECT *, floor((epoch_us(sold_out_ts) - epoch_us(first_request_ts)) / 1000)::BIGINT AS sold_out_ms FROM (
  SELECT a.event_id AS event_id, count(*) AS areas, count(e.sold_out_ts) AS areas_sold_out,
         CASE WHEN count(*) = count(e.sold_out_ts) THEN max(e.sold_out_ts) END AS sold_out_ts,
         min(s.first_request_ts) AS first_request_ts
  FROM areas a JOIN started s ON s.event_id = a.event_id LEFT JOIN emptied e ON e.event_area_id = a.event_area_id
  GROUP BY ROLLUP (a.event_id))""",
    "prefilter_selectivity": ctes(*PIN) + """
SELECT event_id, count(*) AS requests, count(*) FILTER (state = 'PROCESSING') AS passed,
       round(count(*) FILTER (state = 'PROCESSING') / count(*), 6) AS passed_share
FROM decided GROUP BY event_id""",
    "area_skew_topk": """
SELECT 'event-' || s_nationkey || '#' || s_suppkey AS event_area_id, count(*) AS requests,
       round(count(*) / (SELECT count(*) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), 6) AS share
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 ORDER BY requests DESC, event_area_id LIMIT 10""",
    "run_summary": ctes(TIMES) + """
SELECT requests, errors, round(errors / requests, 6) AS error_rate, round(span, 6) AS completion_s,
       round(requests / span, 6) AS requests_per_s
FROM (SELECT count(*) AS requests, count(*) FILTER (post_status <> 200) AS errors,
             (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS span FROM times)""",
    "rounds_avg": ctes(TIMES) + """,
per_round AS (
  SELECT round::VARCHAR AS round, count(*)::DOUBLE AS requests, quantile_cont(response_ms, 0.5)::DOUBLE AS p50_ms,
         quantile_cont(response_ms, 0.95)::DOUBLE AS p95_ms, avg(response_ms) AS avg_ms FROM times GROUP BY round)
SELECT round, round(requests, 6) AS requests, round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms,
       round(avg_ms, 6) AS avg_ms
FROM (SELECT * FROM per_round UNION ALL
      SELECT 'Avg', avg(requests), avg(p50_ms), avg(p95_ms), avg(avg_ms) FROM per_round)""",
    "config_delta": ctes(TIMES) + """,
c AS (SELECT config, avg(response_ms) AS a FROM times GROUP BY config)
SELECT c.config, round(c.a, 6) AS avg_ms, round((c.a - b.a) / b.a * 100, 4) AS delta_pct
FROM c, (SELECT a FROM c WHERE config = 'click') b""",
    "journey_sample": ctes(STAGES) + """
SELECT reservation_id, stage_no, stage FROM stages WHERE substr(md5(reservation_id), 1, 8) < '19999999'""",
    "reservation_journey": ctes(STAGES) + """
SELECT *, epoch_us(stage_ts) // 1000 - epoch_us(lag(stage_ts) OVER (PARTITION BY reservation_id ORDER BY stage_ts, stage_no)) // 1000 AS gap_ms
FROM stages""",
    "failed_reason_hist": ctes(*FLOW) + """
SELECT CASE WHEN failed_reason[1] = '[' THEN split_part(failed_reason[2:], ']', 1) ELSE failed_reason END AS reason_class,
       count(*) AS n
FROM final WHERE state = 'FAILED' GROUP BY 1""",
    # streams
    "stream_rate_tumbling": RATE_TUMBLING,
    "duration_percentile_sketches": PERCENTILE_SKETCHES,
    "stream_duration_percentile": PERCENTILE_SKETCHES,
    "stream_lookup_wait": LOOKUP_WAIT,
    "stream_prefilter": ctes(*PIN) + "SELECT reservation_id, event_area_id, state, failed_reason FROM decided",
    "stream_area_latest": ctes(AREA_UPDATES) + "SELECT * FROM updates " + LATEST.format("event_area_id"),
    # the large log
    "line_item_flow": line_flow(hot=False),
    "line_item_flow_hot": line_flow(hot=True),
}

# Streams that must end up with what their batch twin gives.
for _name in ("stream_reserve_seats", "stream_restart", "stream_order_by_seq", "stream_small_batches"):
    ORACLES[_name] = ORACLES["reserve_seats"]
ORACLES["stream_area_changelog"] = ORACLES["area_status_changelog"]
ORACLES["stream_lifecycle"] = ORACLES["apply_results"]
ORACLES["stream_reservation_flow"] = ctes(*FLOW) + f"SELECT reservation_id, state, {seats_text()} AS seats FROM final"
ORACLES["reservation_lookup_stored"] = ORACLES["reservation_lookup"]
ORACLES["stream_chained_jobs"] = ORACLES["stream_reservation_flow"]
ORACLES["stream_early_rejection"] = ctes(*FLOW) + """
SELECT count(*) AS requests, count(*) FILTER (state = 'RESERVED') AS reserved, true AS some_rejected_early,
       0::BIGINT AS rejected_and_reserved FROM final"""
