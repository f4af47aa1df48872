"""Small inputs and a slow, obvious allocator to compare with."""

from __future__ import annotations

import datetime as dt

REQUESTS = (
    "seq bigint, ts timestamp, reservation_id string, user_id string, event_id string, area_id string, "
    "num_of_seats int, num_of_seat int, type string, seats array<struct<row:int,col:int>>, event_area_id string"
)
AREAS = "seq bigint, event_area_id string, event_id string, area_id string, price int, row_count int, col_count int"
START = dt.datetime(2024, 1, 1)


def request(seq, kind, n=0, seats=(), area="A", event="event", rid=None):
    ts = START + dt.timedelta(seconds=seq)
    rid = rid or f"r{seq}"
    return (seq, ts, rid, "user", event, area, n, 0, kind, list(seats), f"{event}#{area}")


def area(rows, cols, seq=0, name="A", event="event"):
    return (seq, f"{event}#{name}", event, name, 100, rows, cols)


def requests_df(spark, rows):
    return spark.createDataFrame(rows, REQUESTS)


def areas_df(spark, rows):
    return spark.createDataFrame(rows, AREAS)


def state_df(spark, grid, available=None, name="A", event="event"):
    """An area with a given grid, as initial state and as snapshot."""
    rows = grid.split("|")
    free = grid.count("1") if available is None else available
    row = (*area(len(rows), len(rows[0]), name=name, event=event), grid, free)
    return spark.createDataFrame([row], AREAS + ", grid string, available_seats int")


def naive(areas, requests):
    """Results by id and final (counter, seat matrix) by area, one record at a time on nested lists."""
    log = [(a[0], 0, "", a) for a in areas] + [(r[0], 1, r[2], r) for r in requests]
    free, left, results = {}, {}, {}
    for _, is_request, _, record in sorted(log, key=lambda x: x[:3]):
        if not is_request:
            _, key, _, _, _, rows, cols = record
            free[key] = [[True] * cols for _ in range(rows)]
            left[key] = rows * cols
            continue
        _, _, rid, _, event, name, n, _, kind, seats, key = record
        results[rid] = outcome(free.get(key), kind, n, seats, key, event, name)
        for row, col in results[rid][1] or []:
            free[key][row][col] = False
            left[key] -= 1
    return results, {key: (left[key], free[key]) for key in free}


def outcome(grid, kind, n, seats, key, event, name):
    if grid is None:
        return "FAILED", None, "INVALID_EVENT_AREA", f"{key} event area does not exist"
    if kind == "SELF_PICK":
        for row, col in seats:
            if row not in range(len(grid)) or col not in range(len(grid[0])):
                return "FAILED", None, "INVALID_SEAT", f"{key} ({row}, {col}) is not a valid seat."
            if not grid[row][col]:
                return "FAILED", None, "NOT_AVAILABLE", f"{key} ({row}, {col}) is unavailable."
        return "SUCCESS", list(seats), None, None
    if kind == "RANDOM":
        if n < 1:
            return "FAILED", None, "INVALID_ARGUMENT", f"{n} continuous seats is invalid"
        for r, row in enumerate(grid):
            for c in range(len(row) - n + 1):
                if all(row[c : c + n]):
                    return "SUCCESS", [(r, c + i) for i in range(n)], None, None
        return "FAILED", None, "NOT_AVAILABLE", f"no continuous {n} seats at area {name} in event {event}"
    return "FAILED", None, "INVALID_ARGUMENT", f"{kind} reservation strategy is not implemented"


def results_by_id(results):
    found = {}
    for r in results.collect():
        seats = None if r["reserved_seats"] is None else [(s["row"], s["col"]) for s in r["reserved_seats"]]
        found[r["reservation_id"]] = (r["result"], seats, r["error_code"], r["error_message"])
    return found


def finals_by_area(final):
    return {
        r["event_area_id"]: (r["available_seats"], [[s == "1" for s in row] for row in r["grid"].split("|")])
        for r in final.collect()
    }
