"""Streams with a state per key and logs of several files per piece."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnstile.operators.lookup import lookup_or_wait
from turnstile.plans.stream_queries import STREAMS
from turnstile.schemas import conform
from turnstile.sources import driver_tables as D
from turnstile.sources import logs
from turnstile.streaming import keyed, runtime
from turnstile.streaming.lifecycle import lifecycle_stream
from turnstile.streaming.runtime import run_to_end, stream_files, write_pieces


def test_no_lookup_is_late_where_a_piece_has_several_files(spark, tmp_path, monkeypatch):
    """The files of a piece cover the same times: read one by one, the second is behind the watermark and its asks are lost."""
    start = dt.datetime(2024, 1, 1)
    events = [(i, start + dt.timedelta(seconds=40 * i), f'{{"k": {i * 7 % 100}}}') for i in range(120)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, props string").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(runtime, "ROWS_PER_FILE", 15)
    sf = str(tmp_path)
    got = STREAMS["stream_lookup_wait"](spark, sf)
    expected = lookup_or_wait(D.asks(spark, sf), D.outcomes(spark, sf)).select(*got.columns)
    assert got.count() == 120 and got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def test_pieces_have_equally_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "ROWS_PER_FILE", 10)
    log = spark.range(0, 90).select(F.col("id").alias("seq"), F.lit("one").alias("key"))
    files = write_pieces(log, f"{tmp_path}/log", 3, "key")
    assert files == 4
    for piece in range(3):
        assert len(list((tmp_path / "log" / f"{piece:04d}").rglob("part-*.parquet"))) == files
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log").count() == 90


@pytest.mark.parametrize("buckets", [1, 1 << 12])
def test_reservations_that_share_a_bucket_keep_apart(spark, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(keyed, "BUCKETS", buckets)
    seats = "array<struct<row:int,col:int>>"
    made = [(i, dt.datetime(2024, 1, 1, 0, 0, 0, i + 1), None if i == 3 else f"r{i}", None, 'a "b"é') for i in range(4)]
    created = spark.createDataFrame(made, "seq bigint, ts timestamp, reservation_id string, user_id string, event_id string").withColumns(
        {"area_id": F.lit(""), "num_of_seats": F.lit(None).cast("int"), "num_of_seat": F.lit(0), "type": F.lit("RANDOM"),
         "seats": F.array().cast(seats), "state": F.lit("PROCESSING"), "failed_reason": F.lit("")}
    )
    created = conform(created, "reservation")
    created.repartition(1).write.parquet(f"{tmp_path}/created")
    told = "seq bigint, reservation_id string, result string, seats " + seats + ", error_code string, error_message string"
    batches = [
        [(9, "r0", "SUCCESS", [(1, 2)], None, None), (9, None, "SUCCESS", [], None, None)],
        [(10, "r0", "FAILED", None, "X", "late"), (10, "nobody", "SUCCESS", [], None, None), (10, "r1", "FAILED", None, "X", "no")],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, told).repartition(1).write.parquet(f"{tmp_path}/results/{n}")
    results = stream_files(spark, f"{tmp_path}/results", spark.createDataFrame([], told).schema, 1)
    stream = lifecycle_stream(stream_files(spark, f"{tmp_path}/created", created.schema), results)
    run_to_end(stream, lambda b, n: logs.write_batch(b, f"{tmp_path}/final", n), f"{tmp_path}/cp", partitions=2)
    rows = logs.read_batches(spark, f"{tmp_path}/final").drop("batch").collect()
    got = {(r["reservation_id"], r["state"], r["failed_reason"]): ([tuple(s) for s in r["seats"]], r["ts"], r["user_id"], r["event_id"], r["num_of_seats"]) for r in rows}
    ts = [m[1] for m in made]
    assert len(rows) == 4 and got == {
        ("r0", "RESERVED", ""): ([(1, 2)], ts[0], None, 'a "b"é', None),
        (None, "RESERVED", ""): ([], ts[3], None, 'a "b"é', None),
        ("r0", "FAILED", "[X]: late"): ([(1, 2)], ts[0], None, 'a "b"é', None),
        ("r1", "FAILED", "[X]: no"): ([], ts[1], None, 'a "b"é', None),
    }
