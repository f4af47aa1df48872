import datetime as dt
import glob
import os

from helpers import area, areas_df, naive, request, requests_df
from pyspark.sql import functions as F

from turnstile.operators.lookup import lookup_or_wait
from turnstile.operators.projections import new_reservations
from turnstile.schemas import conform
from turnstile.sources import logs
from turnstile.streaming.allocator import BATCHES_PER_BASE, AreaStates, run_allocator, run_flow
from turnstile.streaming.lifecycle import lifecycle_stream
from turnstile.streaming.runtime import run_to_end, stream_files
from turnstile.streaming.waiting import lookup_or_wait_stream

RESULT = (
    "seq bigint, ts timestamp, reservation_id string, result string, seats array<struct<row:int,col:int>>, "
    "error_code string, error_message string"
)


class Job:
    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0

    def add(self, areas, log):
        self.n += 1
        areas_df(self.spark, areas).write.parquet(f"{self.path}/areas/{self.n}")
        requests_df(self.spark, log).repartition(1).write.parquet(f"{self.path}/requests/{self.n}")

    def run(self):
        areas = stream_files(self.spark, f"{self.path}/areas", areas_df(self.spark, []).schema)
        requests = stream_files(self.spark, f"{self.path}/requests", requests_df(self.spark, []).schema)
        run_allocator(
            areas, requests, f"{self.path}/results", f"{self.path}/changes", f"{self.path}/states", f"{self.path}/checkpoint"
        )

    def results(self):
        return {
            r["reservation_id"]: (
                r["result"], None if r["seats"] is None else [tuple(s) for s in r["seats"]], r["error_code"], r["error_message"]
            )
            for r in logs.read_batches(self.spark, f"{self.path}/results").collect()
        }


def test_allocator_restarts_with_its_state_and_takes_recreations(spark, tmp_path):
    job = Job(spark, tmp_path)
    first = [
        request(1, "SELF_PICK", 0, [(0, 1), (0, 1)]), request(2, "RANDOM", 1), request(3, "INVALID"),
        request(4, "SELF_PICK", 0, [(0, 5)]), request(5, "SELF_PICK"), request(6, "RANDOM", 1, area="B"),
        request(7, "RANDOM", 0),
    ]
    second = [
        request(11, "RANDOM", 2), request(12, "SELF_PICK", 0, [(1, 0), (0, 1)]), request(21, "RANDOM", 2),
        request(22, "SELF_PICK", 0, [(0, 0), (7, 7)]), request(23, "RANDOM", 2),
    ]
    job.add([area(2, 2)], first)
    job.run()
    job.add([area(2, 2, seq=20)], second)
    job.run()
    expected, _ = naive([area(2, 2), area(2, 2, seq=20)], first + second)
    assert job.results() == expected
    changes = logs.read_batches(spark, f"{tmp_path}/changes").orderBy("seq").collect()
    assert [(r["seq"], r["available_seats"]) for r in changes] == [
        (0, 4), (1, 2), (2, 1), (5, 1), (11, -1), (20, 4), (21, 2), (23, 0)
    ]


def test_area_states_stay_small_over_many_batches(spark, tmp_path):
    """50 batches: what a batch reads and what is kept are bounded, and a batch that runs again finds the same."""
    states, expected = AreaStates(spark, str(tmp_path)), {}
    for batch in range(50):
        touched = {f"a{batch % 7}": batch, f"b{batch}": batch}
        before = {r["event_area_id"]: r["available_seats"] for r in states.before(batch).collect()} if batch % 6 == 5 else expected
        assert before == expected
        rows = [(k, 1, 1, "1", v) for k, v in touched.items()]
        states.write(spark.createDataFrame(rows, "event_area_id string, row_count int, col_count int, grid string, available_seats int"), batch)
        if batch == 23:  # runs again
            assert {r["event_area_id"]: r["available_seats"] for r in states.before(batch).collect()} == expected
            states.write(spark.createDataFrame([("a0", 1, 1, "1", -9)], "event_area_id string, row_count int, col_count int, grid string, available_seats int"), batch)
        expected = {**expected, **touched}
        assert len(states._parts(batch + 1)) <= BATCHES_PER_BASE
        kept = logs.batch_ids(spark, f"{tmp_path}/base") + logs.batch_ids(spark, f"{tmp_path}/changes")
        assert len(kept) <= 2 * BATCHES_PER_BASE + 2
    assert {r["event_area_id"]: r["available_seats"] for r in states.before(50).collect()} == expected


def test_lifecycle_overwrites_and_drops(spark, tmp_path):
    created = conform(
        new_reservations(requests_df(spark, [request(1, "RANDOM", 1), request(2, "SELF_PICK", 0, [(0, 0)])])), "reservation"
    )
    created.write.parquet(f"{tmp_path}/created")
    results = spark.createDataFrame(
        [
            (1, None, "r1", "SUCCESS", [(3, 4)], None, None),
            (2, None, "r1", "FAILED", None, "NOT_AVAILABLE", "late"),
            (3, None, "nobody", "SUCCESS", [(1, 1)], None, None),
            (4, None, "r2", "FAILED", None, "INVALID_SEAT", "no"),
        ],
        RESULT,
    )
    results.write.parquet(f"{tmp_path}/results")
    stream = lifecycle_stream(
        stream_files(spark, f"{tmp_path}/created", created.schema), stream_files(spark, f"{tmp_path}/results", results.schema)
    )
    run_to_end(stream, lambda b, n: logs.write_batch(b, f"{tmp_path}/final", n), f"{tmp_path}/cp", partitions=2)
    rows = logs.read_batches(spark, f"{tmp_path}/final").collect()
    got = sorted((r["reservation_id"], r["state"], [tuple(s) for s in r["seats"]], r["failed_reason"]) for r in rows)
    assert got == [
        ("r1", "FAILED", [(3, 4)], "[NOT_AVAILABLE]: late"),
        ("r1", "RESERVED", [(3, 4)], ""),
        ("r2", "FAILED", [(0, 0)], "[INVALID_SEAT]: no"),
    ]


def test_a_hot_area_and_bad_rows_in_one_batch(spark, tmp_path):
    log = [request(i, "RANDOM", 1 + i % 3) for i in range(1, 300)]
    job = Job(spark, tmp_path)
    job.add([area(3, 5)], log + [request(400, "RANDOM", None), request(401, "SELF_PICK", 0, [(0, 0)])])
    path = f"{tmp_path}/requests/bad"
    odd = requests_df(spark, [request(402, "SELF_PICK"), request(403, "SELF_PICK", 0, [(9, 9)])])
    odd.withColumn("seats", F.when(F.col("seq") == 403, F.col("seats"))).write.parquet(path)
    job.run()
    expected, _ = naive([area(3, 5)], log + [request(400, "RANDOM", 0), request(401, "SELF_PICK", 0, [(0, 0)])])
    got = job.results()
    assert {k: v for k, v in got.items() if k in expected} == expected
    assert got["r402"] == ("SUCCESS", [], None, None) and got["r403"][2] == "INVALID_SEAT"


def test_a_replayed_batch_changes_nothing_downstream(spark, tmp_path):
    """The job ends between its sinks and its commit; a stream over the results reads each row once."""
    job = Job(spark, tmp_path)
    job.add([area(2, 2)], [request(1, "RANDOM", 1), request(2, "RANDOM", 2)])
    job.run()

    def follow():
        results = stream_files(spark, f"{tmp_path}/results", spark.read.parquet(f"{tmp_path}/results").drop("batch").schema)
        run_to_end(results, lambda b, n: logs.write_batch(b, f"{tmp_path}/follow", n), f"{tmp_path}/follow-checkpoint")
        return sorted(r["reservation_id"] for r in logs.read_batches(spark, f"{tmp_path}/follow").collect())

    before = job.results()
    assert follow() == ["r1", "r2"]
    for commit in glob.glob(f"{tmp_path}/checkpoint/commits/*") + glob.glob(f"{tmp_path}/checkpoint/commits/.*.crc"):
        os.remove(commit)
    job.run()
    assert job.results() == before
    assert follow() == ["r1", "r2"]


def test_waiting_lookups_answer_once_from_outcomes_of_any_age(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    outcomes = [("a", at(95)), ("a", at(105)), ("b", at(10)), ("c", at(120)), ("d", at(108)), ("z", at(9000))]
    asks = [("a", at(100)), ("b", at(100)), ("b", at(100)), ("c", at(100)), ("d", at(100)), ("e", at(100)), ("z", at(9000))]
    frames = {
        "asks": spark.createDataFrame(asks, "reservation_id string, ask_ts timestamp"),
        "outcomes": spark.createDataFrame(outcomes, "reservation_id string, outcome_ts timestamp"),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{tmp_path}/{name}")
    streams = [stream_files(spark, f"{tmp_path}/{name}", frame.schema) for name, frame in frames.items()]
    run_to_end(
        lookup_or_wait_stream(*streams), lambda b, n: logs.write_batch(b, f"{tmp_path}/answers", n),
        f"{tmp_path}/checkpoint", partitions=2,
    )
    got = logs.read_batches(spark, f"{tmp_path}/answers").drop("batch").where("reservation_id <> 'z'").collect()
    expected = lookup_or_wait(frames["asks"], frames["outcomes"]).where("reservation_id <> 'z'")
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, expected.select(*got[0].asDict()).collect()), key=repr)
    assert len(got) == 6


def test_flow_rejects_early_what_earlier_batches_sold_out(spark, tmp_path):
    base = str(tmp_path)
    batches = [[request(1, "RANDOM", 2), request(2, "RANDOM", 3)], [request(3, "RANDOM", 2), request(4, "RANDOM", 1)]]
    areas_df(spark, [area(1, 3)]).write.parquet(f"{base}/areas/1")
    for n, log in enumerate(batches):
        requests_df(spark, log).repartition(1).write.parquet(f"{base}/requests/{n}")
        streams = [
            stream_files(spark, f"{base}/{name}", empty.schema)
            for name, empty in (("areas", areas_df(spark, [])), ("requests", requests_df(spark, [])))
        ]
        run_flow(*streams, f"{base}/final", f"{base}/changes", f"{base}/states", f"{base}/checkpoint")
    got = {r["reservation_id"]: r for r in logs.read_batches(spark, f"{base}/final").collect()}
    assert {k: (r["state"], r["admitted"]) for k, r in got.items()} == {
        "r1": ("RESERVED", True), "r2": ("FAILED", True), "r3": ("FAILED", False), "r4": ("RESERVED", True)
    }
