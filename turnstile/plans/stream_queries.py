"""The registered streaming queries: the driver's tables cut into files and streamed to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.operators import projections, report, sketches, tables
from turnstile.operators.lifecycle import merge_updates
from turnstile.plans import queries as Q
from turnstile.schemas import conform
from turnstile.session import scratch_path
from turnstile.sources import driver_tables as D
from turnstile.sources import logs
from turnstile.streaming.allocator import run_allocator, run_flow
from turnstile.streaming.chain import Chain
from turnstile.streaming.intake import run_intake
from turnstile.streaming.lifecycle import lifecycle_stream
from turnstile.streaming.runtime import bounds, run_to_end, stream_files, write_pieces
from turnstile.streaming.waiting import lookup_or_wait_stream

STREAMS: dict[str, Q.Query] = {}

PIECES = 3
STATE_PARTITIONS = 8


def query(fn: Q.Query) -> Q.Query:
    STREAMS[fn.__name__] = fn
    return fn


class _AllocatorRun:
    """Logs of one allocator job, in a folder of their own."""

    key = "event_area_id"
    bounds = None

    def __init__(self, spark, sf):
        self.spark = spark
        base = scratch_path(spark, "allocator")
        self.areas, self.requests = f"{base}/areas", f"{base}/requests"
        self.results, self.changes, self.checkpoint = f"{base}/results", f"{base}/changes", f"{base}/checkpoint"
        self.states, self.final = f"{base}/states", f"{base}/final"
        conform(D.create_events(spark, sf), "create_event").write.parquet(self.areas)
        self.log = conform(projections.reserve_requests(D.requests(spark, sf)), "reserve_seat")

    def feed(self, **how):
        self.bounds = self.bounds or bounds(self.log)
        self.files = write_pieces(self.log, self.requests, PIECES, self.key, within=self.bounds, **how)

    def run(self, files_per_batch=None):
        events = stream_files(self.spark, self.areas, logs.schema_of(self.spark, "create_event"))
        requests = stream_files(
            self.spark, self.requests, logs.schema_of(self.spark, "reserve_seat"), files_per_batch
        )
        run_allocator(
            projections.event_areas(events), requests, self.results, self.changes, self.states, self.checkpoint
        )

    def table(self):
        return Q._fold_columns(logs.read_batches(self.spark, self.results).withColumnRenamed("seats", "reserved_seats"))


@query
def stream_reserve_seats(spark, sf):
    run = _AllocatorRun(spark, sf)
    run.feed()
    run.run()
    return run.table()


@query
def stream_area_changelog(spark, sf):
    run = _AllocatorRun(spark, sf)
    run.feed()
    run.run(files_per_batch=run.files)
    return logs.read_batches(spark, run.changes).select("event_area_id", "seq", "available_seats", "grid")


@query
def stream_restart(spark, sf):
    """Part of the files, stop, the rest of the files: state comes back from the checkpoint."""
    run = _AllocatorRun(spark, sf)
    run.feed(only=range(0, 1))
    run.run()
    run.feed(only=range(1, PIECES))
    run.run()
    return run.table()


@query
def stream_order_by_seq(spark, sf):
    """Rows mixed inside each file are still allocated in log order."""
    run = _AllocatorRun(spark, sf)
    run.feed(shuffled=True)
    run.run(files_per_batch=run.files)
    return run.table()


@query
def stream_small_batches(spark, sf):
    run = _AllocatorRun(spark, sf)
    run.feed()
    run.run(files_per_batch=run.files)
    return run.table()


class _FlowRun(_AllocatorRun):
    """The whole flow as one job, over requests as they were sent."""

    key = "reservation_id"

    def __init__(self, spark, sf):
        super().__init__(spark, sf)
        self.log = conform(D.requests(spark, sf), "create_reservation")

    def run(self):
        events = stream_files(self.spark, self.areas, logs.schema_of(self.spark, "create_event"))
        requests = stream_files(self.spark, self.requests, self.log.schema, self.files)
        requests = projections.normalise_requests(requests)
        run_flow(
            projections.event_areas(events), requests, self.final, self.changes, self.states, self.checkpoint
        )
        return logs.read_batches(self.spark, self.final)


@query
def stream_reservation_flow(spark, sf):
    """Intake, allocator and life cycle, connected: which reservations got which seats."""
    run = _FlowRun(spark, sf)
    run.feed()
    return Q.seats_as_text(run.run()).select("reservation_id", "state", "seats")


@query
def stream_chained_jobs(spark, sf):
    """Intake, allocator and life cycle as three jobs; each runs twice, the second time over what has come since."""
    run = _FlowRun(spark, sf)
    chain = Chain(spark, scratch_path(spark, "chain"))
    snapshot = projections.area_status(D.areas(spark, sf))
    for pieces in (range(0, 1), range(1, PIECES)):
        run.feed(only=pieces)
        events = stream_files(spark, run.areas, logs.schema_of(spark, "create_event"))
        requests = projections.normalise_requests(stream_files(spark, run.requests, run.log.schema))
        chain.intake(requests, lambda batch_id: snapshot)
        chain.allocator(projections.event_areas(events))
        chain.lifecycle(STATE_PARTITIONS)
    return Q.seats_as_text(chain.reservations()).select("reservation_id", "state", "seats")


@query
def stream_early_rejection(spark, sf):
    """Requests of the connected flow, and whether early rejection ever kept out one that would have got seats."""
    run = _FlowRun(spark, sf)
    run.feed()
    final = run.run()
    kept_out = ~F.col("admitted") & (F.col("state") == "RESERVED")
    return final.agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("state") == "RESERVED").alias("reserved"),
        (F.count_if(~F.col("admitted")) > 0).alias("some_rejected_early"),
        F.count_if(kept_out).alias("rejected_and_reserved"),
    )


@query
def stream_prefilter(spark, sf):
    base = scratch_path(spark, "intake")
    requests = D.requests(spark, sf)
    files = write_pieces(requests, f"{base}/requests", PIECES, "event_area_id")
    stream = stream_files(spark, f"{base}/requests", requests.schema, files)
    snapshot = D.pinned_snapshot(spark, sf)
    run_intake(
        stream, lambda batch_id: snapshot, f"{base}/created", f"{base}/reserve", f"{base}/final", f"{base}/checkpoint"
    )
    passed = logs.read_batches(spark, f"{base}/reserve").select(
        "reservation_id", "event_area_id", F.lit("PROCESSING").alias("state"), F.lit("").alias("failed_reason")
    )
    failed = logs.read_batches(spark, f"{base}/final").select(
        "reservation_id", "event_area_id", "state", "failed_reason"
    )
    return merge_updates(passed, failed)


@query
def stream_lifecycle(spark, sf):
    """Reservations of the pre-filter meet the allocator's results."""
    base = scratch_path(spark, "lifecycle")
    created = conform(
        Q._decided(spark, sf).where(F.col("state") == "PROCESSING"), "reservation"
    )
    results = conform(Q._results(spark, sf), "reservation_result")
    write_pieces(created, f"{base}/created", 1, "reservation_id")
    files = write_pieces(results, f"{base}/results", PIECES, "reservation_id")
    updated = lifecycle_stream(
        stream_files(spark, f"{base}/created", created.schema),
        stream_files(spark, f"{base}/results", results.schema, files),
    )
    run_to_end(
        updated, lambda batch, n: logs.write_batch(batch, f"{base}/final", n), f"{base}/checkpoint",
        partitions=STATE_PARTITIONS,
    )
    return Q._final_columns(logs.read_table(spark, f"{base}/final", "reservation_id", ["seq"]))


@query
def stream_area_latest(spark, sf):
    """Every batch adds the last state of each area it touched; reading merges them."""
    base = scratch_path(spark, "area-latest")
    updates = D.area_updates(spark, sf)
    files = write_pieces(updates, f"{base}/updates", PIECES, "event_area_id")
    run_to_end(
        stream_files(spark, f"{base}/updates", updates.schema, files),
        lambda batch, n: logs.write_batch(
            tables.latest_per_key(batch, "event_area_id", ["seq"]), f"{base}/table", n
        ),
        f"{base}/checkpoint",
    )
    return logs.read_table(spark, f"{base}/table", "event_area_id", ["seq"]).drop("grid")


# A row far past the others lets the watermark pass all of them; it is left out of the result.
_CLOSING_ID = "closing"


def _closing(log, ts: str):
    late = log.agg(F.max("seq").alias("seq"), (F.max(ts) + F.expr("interval 1 day")).alias(ts))
    return late.withColumns({"seq": F.col("seq") + 1, "reservation_id": F.lit(_CLOSING_ID)})


def _streamed_with_closing(spark, log, ts, path, *more):
    columns = ["reservation_id", ts, "seq", *more]
    rows = log.withColumn("seq", F.unix_micros(ts)).select(*columns)
    files = write_pieces(rows, path, PIECES, "reservation_id")
    empty = {c: F.lit(None).cast(rows.schema[c].dataType) for c in more}
    _closing(rows, ts).withColumns(empty).select(*columns).write.parquet(f"{path}/last")
    return stream_files(spark, path, rows.schema, files).drop("seq")


@query
def stream_rate_tumbling(spark, sf):
    base = scratch_path(spark, "rate")
    times = D.timings(spark, sf)
    stream = _streamed_with_closing(spark, times, "ts", f"{base}/times").withWatermark("ts", "10 seconds")
    run_to_end(
        report.tumbling_rate(stream), lambda batch, n: logs.write_batch(batch, f"{base}/rates", n),
        f"{base}/checkpoint", partitions=STATE_PARTITIONS,
    )
    return logs.read_batches(spark, f"{base}/rates").drop("batch")


@query
def stream_duration_percentile(spark, sf):
    """Sketches of a live stream's windows as a table, merged into percentiles per hour and over all."""
    base = scratch_path(spark, "percentile")
    times = D.timings(spark, sf)
    stream = _streamed_with_closing(spark, times, "ts", f"{base}/times", "post_ms", "get_ms")
    live = stream.withWatermark("ts", "10 seconds")
    run_to_end(
        sketches.window_sketches(live, report.response_ms(), "1 minute"),
        lambda batch, n: logs.write_batch(batch, f"{base}/sketches", n),
        f"{base}/checkpoint", partitions=STATE_PARTITIONS,
    )
    return Q.merged_percentiles(logs.read_batches(spark, f"{base}/sketches").drop("batch"), times)


@query
def stream_lookup_wait(spark, sf):
    base = scratch_path(spark, "wait")
    asks = _streamed_with_closing(spark, D.asks(spark, sf), "ask_ts", f"{base}/asks")
    outcomes = _streamed_with_closing(spark, D.outcomes(spark, sf), "outcome_ts", f"{base}/outcomes")
    run_to_end(
        lookup_or_wait_stream(asks, outcomes), lambda batch, n: logs.write_batch(batch, f"{base}/answers", n),
        f"{base}/checkpoint", partitions=STATE_PARTITIONS,
    )
    answers = logs.read_batches(spark, f"{base}/answers").drop("batch")
    return answers.where(F.col("reservation_id") != _CLOSING_ID)
