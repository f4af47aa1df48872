import pytest
from helpers import area, areas_df, request, requests_df, state_df
from pyspark.sql import functions as F

from turnstile.operators import lifecycle, prefilter, projections
from turnstile.operators.lookup import lookup, lookup_or_wait
from turnstile.operators.tables import compact_updates, latest_per_key, most_recent, replicated_snapshot
from turnstile.plans.reservations import reservation_flow

RESULT = (
    "seq bigint, ts timestamp, reservation_id string, result string, seats array<struct<row:int,col:int>>, "
    "error_code string, error_message string"
)


def decided(spark, grid, rows, available=None):
    out = prefilter.decide(requests_df(spark, rows), state_df(spark, grid, available))
    return {r["reservation_id"]: (r["state"], r["failed_reason"]) for r in out.collect()}


@pytest.mark.parametrize(
    "grid, kind, n, seats, passes",
    [
        ("111|111|111", "RANDOM", 3, [], True),
        ("101|101|101", "RANDOM", 3, [], True),
        ("000|000|000", "RANDOM", 1, [], False),
        ("111|111|111", "RANDOM", 4, [], False),
        ("111|111|111", "RANDOM", 0, [], True),
        ("111|111|111", "SELF_PICK", 0, [(0, 0), (0, 1), (0, 2)], True),
        ("101|111|111", "SELF_PICK", 0, [(0, 0), (0, 1), (0, 2)], False),
        ("111|111|111", "SELF_PICK", 0, [(0, 4)], False),
        ("111|111|111", "SELF_PICK", 0, [(0, -1)], False),
        ("111|111|111", "SELF_PICK", 0, [(4, 0)], False),
        ("111|111|111", "SELF_PICK", 0, [(-1, 0)], False),
        ("111|111|111", "SELF_PICK", 0, [], True),
    ],
)
def test_prefilter_predicates(spark, grid, kind, n, seats, passes):
    got = decided(spark, grid, [request(1, kind, n, seats)])["r1"]
    assert got == (("PROCESSING", "") if passes else ("FAILED", "request rejected at cache level"))


def test_prefilter_dispatch(spark):
    got = decided(
        spark, "111|111|111", [request(1, "INVALID", 1), request(2, "RANDOM", 9, area="B"), request(3, "INVALID", 1, area="B")]
    )
    assert got["r1"] == ("FAILED", "INVALID type reservation is not supported")
    assert got["r2"] == ("PROCESSING", "")
    assert got["r3"] == ("PROCESSING", "")


def test_prefilter_uses_the_counter_even_if_too_low(spark):
    assert decided(spark, "111|111", [request(1, "RANDOM", 3)], available=2)["r1"][0] == "FAILED"


def test_snapshot_is_bounded_and_misses_pass(spark):
    areas = projections.area_status(areas_df(spark, [area(1, 1, seq=i, name=str(i)) for i in range(5)]))
    rows = [request(10 + i, "RANDOM", 2, area=str(i)) for i in range(5)]
    out = prefilter.decide(requests_df(spark, rows), areas, keep=2)
    states = {r["area_id"]: r["state"] for r in out.collect()}
    assert states == {"0": "PROCESSING", "1": "PROCESSING", "2": "PROCESSING", "3": "FAILED", "4": "FAILED"}
    assert replicated_snapshot(areas, 3).count() == 3


def test_snapshot_of_any_number_of_areas(spark):
    areas = projections.area_status(areas_df(spark, [area(1, 1, seq=i, name=str(i)) for i in range(1001)]))
    rows = [request(2000 + i, "RANDOM", 2, area=str(i)) for i in range(1001)]
    assert prefilter.decide(requests_df(spark, rows), areas).where("state = 'FAILED'").count() == 1001


def reservations(spark, rows):
    return projections.new_reservations(requests_df(spark, rows)).drop("event_area_id")


def test_results_change_reservations(spark):
    base = reservations(
        spark,
        [request(1, "RANDOM", 3), request(2, "SELF_PICK", 0, [(0, 0)]), request(3, "RANDOM", 1), request(4, "RANDOM", 2)],
    )
    results = spark.createDataFrame(
        [
            (1, None, "r1", "SUCCESS", [(0, 0), (0, 1), (0, 2)], None, None),
            (2, None, "r2", "FAILED", None, "NOT_AVAILABLE", "event#A (0, 0) is unavailable."),
            (3, None, "nobody", "SUCCESS", [(1, 1)], None, None),
            (4, None, "r4", "SUCCESS", [(1, 0), (1, 1)], None, None),
            (5, None, "r4", "FAILED", None, "NOT_AVAILABLE", "again"),
        ],
        RESULT,
    )
    out = {r["reservation_id"]: r for r in lifecycle.apply_results(base, results).collect()}
    assert set(out) == {"r1", "r2", "r4"}
    assert (out["r1"]["state"], out["r1"]["failed_reason"], len(out["r1"]["seats"])) == ("RESERVED", "", 3)
    assert out["r2"]["failed_reason"] == "[NOT_AVAILABLE]: event#A (0, 0) is unavailable."
    assert [tuple(s) for s in out["r2"]["seats"]] == [(0, 0)]
    # The second result overwrites the state; the seats of the first stay.
    assert (out["r4"]["state"], len(out["r4"]["seats"])) == ("FAILED", 2)
    assert lifecycle.unmatched_results(base, results).first()["reservation_id"] == "nobody"


def test_routes(spark):
    states = ["PROCESSING", "RESERVED", "FAILED", "PAID", "CANCELLED"]
    rows = spark.createDataFrame([(s,) for s in states], "state string")
    names = {r["state"]: r["route"] for r in lifecycle.with_route(rows).collect()}
    assert names == dict(zip(states, ["processing", "processed", "processed", "invalid", "invalid"]))


def test_flow_end_to_end(spark):
    areas = areas_df(spark, [area(3, 3)])
    log = [
        request(1, "RANDOM", 3), request(2, "SELF_PICK", 0, [(1, 0), (1, 2)]), request(3, "SELF_PICK", 0, [(1, 1), (1, 2)]),
        request(4, "RANDOM", 4), request(5, "RANDOM", 1, area="B"), request(6, "INVALID", 1),
    ]
    out = reservation_flow(requests_df(spark, log), areas, projections.area_status(areas))
    got = {r["reservation_id"]: (r["state"], [tuple(s) for s in r["seats"]], r["failed_reason"]) for r in out.collect()}
    assert got == {
        "r1": ("RESERVED", [(0, 0), (0, 1), (0, 2)], ""),
        "r2": ("RESERVED", [(1, 0), (1, 2)], ""),
        "r3": ("FAILED", [(1, 1), (1, 2)], "[NOT_AVAILABLE]: event#A (1, 2) is unavailable."),
        "r4": ("FAILED", [], "request rejected at cache level"),
        "r5": ("FAILED", [], "[INVALID_EVENT_AREA]: event#B event area does not exist"),
        "r6": ("FAILED", [], "INVALID type reservation is not supported"),
    }


def test_stale_snapshot_never_changes_who_gets_seats(spark):
    areas = areas_df(spark, [area(3, 3)])
    log = requests_df(spark, [request(s, "RANDOM", 1 + s % 3) for s in range(1, 12)])
    flows = [
        reservation_flow(log, areas, snapshot)
        for snapshot in (projections.area_status(areas), projections.area_status(areas).limit(0))
    ]
    won = [{r["reservation_id"] for r in f.where(F.col("state") == "RESERVED").collect()} for f in flows]
    assert won[0] == won[1]


def test_nested_grid_roundtrip(spark):
    flat = state_df(spark, "101|010").select("event_area_id", "row_count", "col_count", "grid")
    nested = projections.nested_status(flat)
    assert projections.flat_status(nested).first()["grid"] == "101|010"
    assert projections.seat_rows(nested).where("is_available").count() == 3
    empty = projections.nested_status(projections.area_status(areas_df(spark, [area(0, 3)])))
    assert empty.first()["seats"] == [] and empty.first()["available_seats"] == 0


def test_latest_and_compaction(spark):
    log = spark.createDataFrame([(0, "a", 1), (0, "a", 2), (1, "a", 3), (0, "b", 4)], "batch int, k string, seq int")
    assert {tuple(r) for r in latest_per_key(log, "k", ["seq"]).collect()} == {(1, "a", 3), (0, "b", 4)}
    assert {tuple(r) for r in compact_updates(log, "k", ["seq"], "batch").collect()} == {(0, "a", 2), (1, "a", 3), (0, "b", 4)}
    assert [r["seq"] for r in most_recent(log, ["seq"], 2).orderBy("seq").collect()] == [3, 4]


def test_lookup(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "reservation_id string, v int")
    ids = spark.createDataFrame([("a",), ("a",), ("z",)], "reservation_id string")
    assert [tuple(r) for r in lookup(table, ids).collect()] == [("a", 1)]


def test_lookup_waits_ten_seconds(spark):
    asks = spark.sql("select * from values ('a'), ('b'), ('c'), ('d'), ('d') as t(reservation_id)").withColumn(
        "ask_ts", F.lit("2024-01-01 00:01:00").cast("timestamp")
    )
    outcomes = spark.sql(
        "select reservation_id, timestamp(ts) as outcome_ts from values ('a', '2024-01-01 00:01:10'),"
        " ('b', '2024-01-01 00:01:10.000001'), ('d', '2020-01-01 00:00:00'), ('d', '2024-01-01 00:01:05')"
        " as t(reservation_id, ts)"
    )
    rows = lookup_or_wait(asks, outcomes).collect()
    assert sorted((r["reservation_id"], r["timed_out"]) for r in rows) == [
        ("a", False), ("b", True), ("c", True), ("d", False), ("d", False),
    ]
