"""Work that is left out as it cannot change an answer."""

import pyarrow as pa
from helpers import area, areas_df, naive, request, requests_df, results_by_id

from turnstile.operators import fold as module
from turnstile.operators.allocate import allocate
from turnstile.operators.fold import REQUESTS_AT_ONCE, _fold_task
from turnstile.operators.strategies import STRATEGIES
from turnstile.streaming.allocator import AreaStates

_SEATS = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32())]))
_ROWS = pa.schema(
    [
        ("event_area_id", pa.string()), ("epoch", pa.int64()), ("row_count", pa.int32()), ("col_count", pa.int32()),
        ("grid", pa.string()), ("available_seats", pa.int32()), ("initial_seats", pa.int32()), ("kind", pa.int32()),
        ("seq", pa.int64()), ("reservation_id", pa.string()), ("type", pa.string()), ("num_of_seats", pa.int32()),
        ("seats", _SEATS),
    ]
)


def _state(name):
    shape = {"row_count": 1, "col_count": 4, "grid": "1111", "available_seats": 4, "initial_seats": 4}
    return {"event_area_id": name, "epoch": 0, "kind": 0, **shape}


def _ask(seq, kind, n=None, seats=None):
    named = seats if seats is None else [{"row": r, "col": c} for r, c in seats]
    return {"kind": 1, "seq": seq, "reservation_id": f"r{seq}", "type": kind, "num_of_seats": n, "seats": named}


def test_the_fold_looks_at_few_requests_of_a_sold_out_area(monkeypatch):
    seen, listed = [], module._listed
    monkeypatch.setattr(module, "_listed", lambda column: seen.append(len(column)) or listed(column))
    rows = [_state("A"), _ask(1, "SELF_PICK", seats=[(0, 1)]), *[_ask(s, "RANDOM", 1 + s % 2) for s in range(2, 5_000)]]
    rows += [_state("B"), _state("C"), _ask(1, "RANDOM", 3), _ask(2, "RANDOM", 1, [])]
    table = pa.Table.from_pylist(rows, schema=_ROWS)
    picks = {name: (strategy.pick, strategy.bounded) for name, strategy in STRATEGIES.items()}
    for size in (7, 100, 10_000):
        seen.clear()
        got = pa.Table.from_batches(_fold_task(picks)(iter(table.to_batches(max_chunksize=size)))).to_pylist()
        assert [(a["event_area_id"], a["grid"], a["available_seats"]) for a in got] == [("A", "0000", 0), ("B", "1111", 4), ("C", "0000", 0)]
        assert [[(w["seq"], w["id"], w["cells"], w["available_seats"]) for w in a["wins"]] for a in got] == [
            [(1, "r1", [1], 3), (2, "r2", [0], 2), (3, "r3", [2, 3], 0)], [], [(1, "r1", [0, 1, 2], 1), (2, "r2", [3], 0)],
        ]
        assert sum(seen) <= 4 * 2 * REQUESTS_AT_ONCE


def test_sorts_of_the_answers_begin_with_a_number(spark):
    log = [request(s, "RANDOM", 1 + s % 2) for s in range(1, 30)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        allocation = allocate(requests_df(spark, log), areas_df(spark, [area(1, 4)]))
        results = allocation.results()
        assert "Sort [_hash" in results._jdf.queryExecution().executedPlan().toString()
        assert results_by_id(results) == naive([area(1, 4)], log)[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_requests_that_may_win_nothing_are_answered_again_for_the_changes(spark):
    log = [request(s, "RANDOM", 1) for s in range(1, 20)]
    log += [request(20, "SELF_PICK", 0, []), request(21, "SELF_PICK", 0, [(0, 0)]), request(22, "BOGUS", 1)]
    allocation = allocate(requests_df(spark, log), areas_df(spark, [area(1, 4)]))
    assert {r["seq"] for r in allocation._may_win_nothing().collect()} == {20, 21}
    changes = sorted((r["seq"], r["number"], r["available_seats"], len(r["cells"])) for r in allocation.changes().collect())
    assert changes == [(0, 0, 4, 0), (1, 1, 3, 1), (2, 2, 2, 1), (3, 3, 1, 1), (4, 4, 0, 1), (20, 4, 0, 0)]


def test_a_job_begins_without_python_tasks(spark, tmp_path):
    states = AreaStates(spark, str(tmp_path / "states")).before(0)
    assert states.dtypes == [("event_area_id", "string"), ("row_count", "int"), ("col_count", "int"), ("grid", "string"), ("available_seats", "int")]
    assert states.count() == 0
    assert "ExistingRDD" not in states._jdf.queryExecution().executedPlan().toString()
