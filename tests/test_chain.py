"""Jobs that run apart over commit logs."""

import glob
import os

from helpers import area, areas_df, request, requests_df
from pyspark.sql import functions as F

from turnstile.operators.projections import area_status
from turnstile.plans.reservations import reservation_flow
from turnstile.sources.commitlog import Commits, commit_batch, commit_stream, committed
from turnstile.streaming.chain import RECORDS, Chain
from turnstile.streaming.runtime import AVAILABLE_NOW, stream_files

ROWS = "id bigint, at timestamp, seats array<struct<row:int,col:int>>"


def rows_df(spark, ids):
    ts = F.timestamp_micros(F.col("id") * 1_000_001)
    seat = F.struct(F.col("id").cast("int").alias("row"), F.lit(None).cast("int").alias("col"))
    return spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", ts.alias("at"), F.array(seat).alias("seats"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_batch_is_there_once_and_as_a_whole(spark, tmp_path):
    path = f"{tmp_path}/log"
    commit_batch(rows_df(spark, range(5)), path, 0)
    commit_batch(rows_df(spark, range(7)), path, 0)  # runs again
    commit_batch(rows_df(spark, []), path, 1)
    assert ids(committed(spark, path, ROWS)) == [0, 1, 2, 3, 4]
    assert sorted(map(tuple, committed(spark, path, ROWS).collect())) == sorted(map(tuple, rows_df(spark, range(5)).collect()))
    # Files without a record, and a record that is half there, are no batch.
    Commits(path).write(iter(rows_df(spark, [99]).toArrow().to_batches()))
    with open(f"{path}/commits/{2:012d}", "wb") as half:
        half.write(b"0000")
    assert Commits(path).end() == 2 and ids(committed(spark, path, ROWS)) == [0, 1, 2, 3, 4]
    commit_batch(rows_df(spark, [5]), path, 2)
    assert ids(committed(spark, path, ROWS)) == [0, 1, 2, 3, 4, 5]


def test_a_record_that_came_first_stays_and_the_other_files_go(spark, tmp_path):
    log = Commits(str(tmp_path))
    first, second = (log.write(iter(rows_df(spark, [n]).toArrow().to_batches())) for n in (1, 2))
    log.add(0, first)
    log.add(0, second)
    assert log.files(0) == first and len(os.listdir(f"{tmp_path}/data")) == 1


def test_a_stream_follows_a_stream(spark, tmp_path):
    first, second = f"{tmp_path}/first", f"{tmp_path}/second"

    def follow():
        commit_stream(committed(spark, first, ROWS, True), second, f"{tmp_path}/cp", AVAILABLE_NOW).awaitTermination()
        return ids(committed(spark, second, ROWS))

    commit_batch(rows_df(spark, [1, 2]), first, 0)
    assert follow() == [1, 2]
    assert follow() == [1, 2]
    commit_batch(rows_df(spark, []), first, 1)
    commit_batch(rows_df(spark, [3]), first, 2)
    assert follow() == [1, 2, 3]
    forget_last_commit(f"{tmp_path}/cp")
    assert follow() == [1, 2, 3]


def forget_last_commit(checkpoint):
    """As if the job had ended between its sinks and its commit."""
    last = max((p for p in glob.glob(f"{checkpoint}/commits/*") if os.path.basename(p).isdigit()), key=lambda p: int(os.path.basename(p)))
    for path in (last, f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"):
        if os.path.exists(path):
            os.remove(path)


def test_three_jobs_of_which_each_ends_before_its_commit(spark, tmp_path):
    base = str(tmp_path)
    parts = [
        [request(i, "RANDOM", 1 + i % 3) for i in range(1, 9)] + [request(9, "SELF_PICK", 0, [(9, 9)])],
        [request(i, "SELF_PICK", 0, [(i % 3, i % 4)]) for i in range(10, 20)] + [request(20, "RANDOM", 0), request(21, "RANDOM", 1, area="B")],
    ]
    areas = areas_df(spark, [area(3, 4)])
    areas.write.parquet(f"{base}/areas/1")
    chain, snapshot = Chain(spark, f"{base}/chain"), area_status(areas)

    def step():
        requests = stream_files(spark, f"{base}/requests", requests_df(spark, []).schema)
        chain.intake(requests, lambda n: snapshot)
        yield "intake"
        chain.allocator(stream_files(spark, f"{base}/areas", areas.schema))
        yield "allocator"
        chain.lifecycle(2)
        yield "lifecycle"

    for n, part in enumerate(parts):
        requests_df(spark, part).repartition(1).write.parquet(f"{base}/requests/{n}")
        for job in step():
            forget_last_commit(f"{base}/chain/checkpoint-{job}")
        for _ in step():
            pass
    flow = reservation_flow(requests_df(spark, parts[0] + parts[1]), areas, snapshot=snapshot)

    def found(df):
        return sorted((r["reservation_id"], r["state"], [tuple(s) for s in r["seats"] or []], r["failed_reason"]) for r in df.collect())

    assert found(chain.reservations()) == found(flow)
    assert chain.log("created").count() == 21 and set(RECORDS) >= {"created", "results", "updated"}
