"""The registered batch queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.functions import grid as G
from turnstile.functions.asof import asof_join
from turnstile.functions.records import at_millis, reservation_document, to_millis
from turnstile.operators import changelog, lifecycle, prefilter, projections, report, sketches, tables
from turnstile.operators.allocate import allocate
from turnstile.operators.lookup import lookup, lookup_or_wait
from turnstile.operators.strategies import STRATEGIES, refused, register_strategy
from turnstile.plans.reservations import admit_and_allocate, reservation_flow, result_records
from turnstile.schemas import conform
from turnstile.session import scratch_path
from turnstile.sources import driver_tables as D
from turnstile.sources import buckets, ingest, logs

Query = Callable[[SparkSession, str], DataFrame]
BATCH: dict[str, Query] = {}


def query(fn: Query) -> Query:
    BATCH[fn.__name__] = fn
    return fn


def seats_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("seats", G.seats_text(F.col("seats")))


def _allocated(spark, sf):
    """Plain fold of all requests, without the pre-filter."""
    return allocate(D.requests(spark, sf), D.areas(spark, sf))


def _initial(spark, sf):
    return projections.area_status(D.areas(spark, sf))


def _flow(spark, sf):
    return reservation_flow(D.requests(spark, sf), D.areas(spark, sf), _initial(spark, sf))


def _results(spark, sf):
    return result_records(admit_and_allocate(D.requests(spark, sf), D.areas(spark, sf), _initial(spark, sf)))


def _decided(spark, sf):
    return prefilter.decide(D.requests(spark, sf), D.pinned_snapshot(spark, sf))


def _fold_columns(results: DataFrame) -> DataFrame:
    return results.select(
        "reservation_id",
        "event_area_id",
        "result",
        G.seats_text(F.col("reserved_seats")).alias("seats"),
        "error_code",
        "error_message",
    )


def _final_columns(reservations: DataFrame) -> DataFrame:
    return seats_as_text(reservations).select(
        "reservation_id", "user_id", "event_id", "area_id", "num_of_seats", "type", "state", "seats", "failed_reason"
    )


def _through_sink(df: DataFrame, record: str) -> DataFrame:
    """Write as batch 0 of a record log, twice, and read the log back."""
    path = scratch_path(df.sparkSession, record)
    typed = conform(df, record)
    logs.write_batch(typed, path, 0)
    logs.write_batch(typed, path, 0)
    return logs.read_batches(df.sparkSession, path)


# --- sources and sinks ------------------------------------------------------------------


@query
def src_create_event(spark, sf):
    path = scratch_path(spark, "create_event")
    conform(D.create_events(spark, sf), "create_event").write.parquet(path)
    log = logs.read_log(spark, "create_event", path)
    areas = F.transform(
        "areas",
        lambda a: F.concat_ws(
            ":", a["area_id"], a["price"].cast("string"), a["row_count"].cast("string"), a["col_count"].cast("string")
        ),
    )
    return log.select("seq", "event_name", "artist", F.array_join(areas, ",").alias("areas"))


@query
def src_reserve_seat(spark, sf):
    path = scratch_path(spark, "reserve_seat")
    reserve = projections.reserve_requests(D.requests(spark, sf))
    conform(reserve, "reserve_seat").write.parquet(path)
    return seats_as_text(logs.read_log(spark, "reserve_seat", path))


@query
def src_reservation_requests(spark, sf):
    path = scratch_path(spark, "create_reservation")
    conform(D.requests(spark, sf), "create_reservation").write.json(
        path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    )
    return seats_as_text(logs.read_log(spark, "create_reservation", path, fmt="json"))


@query
def src_reservation_results(spark, sf):
    path = scratch_path(spark, "reservation_result")
    conform(_results(spark, sf), "reservation_result").write.parquet(path)
    return seats_as_text(logs.read_log(spark, "reservation_result", path))


@query
def src_reservation_state(spark, sf):
    path = scratch_path(spark, "reservation")
    conform(_flow(spark, sf), "reservation").write.parquet(path)
    return seats_as_text(logs.read_log(spark, "reservation", path))


@query
def area_status_snapshot(spark, sf):
    return tables.replicated_snapshot(D.area_updates(spark, sf)).select(
        "event_area_id", "seq", "row_count", "col_count", "available_seats"
    )


@query
def sink_results_roundtrip(spark, sf):
    return seats_as_text(_through_sink(_results(spark, sf), "reservation_result")).drop("batch")


@query
def area_status_changelog(spark, sf):
    return _allocated(spark, sf).changelog().select("event_area_id", "seq", "available_seats", "grid")


@query
def area_status_deltas(spark, sf):
    """The changelog without grids: the cells that each change took and the counter that it left."""
    changes = _allocated(spark, sf).changes()
    cells = F.array_join(F.array_sort("cells"), ",").alias("cells")
    return changes.select("event_area_id", "seq", "available_seats", cells)


@query
def area_status_at_requests(spark, sf):
    """Each request's area as it was right after the request, won or not."""
    allocation = _allocated(spark, sf)
    requests = D.requests(spark, sf).select("event_area_id", "seq", "reservation_id")
    found = changelog.at_positions(requests, allocation.states).where(F.col("epoch").isNotNull())
    return changelog.with_grids(found, allocation.states).select(
        "event_area_id", "seq", "reservation_id", "available_seats", "grid"
    )


@query
def sink_reserve_seat_roundtrip(spark, sf):
    passed = lifecycle.route(_decided(spark, sf), "processing")
    keyed = projections.reserve_requests(passed).repartition("event_area_id")
    return seats_as_text(_through_sink(keyed, "reserve_seat")).drop("batch")


@query
def final_reservations(spark, sf):
    path = scratch_path(spark, "final")
    final = lifecycle.route(_flow(spark, sf), "processed")
    logs.write_batch(conform(final, "reservation"), path, 0)
    return _final_columns(logs.read_table(spark, path, "reservation_id", ["seq"]))


@query
def ingest_json_requests(spark, sf):
    sent = D.raw_requests(spark, sf)
    body = F.to_json(
        F.struct(
            F.col("user_id").alias("userId"),
            F.col("event_id").alias("eventId"),
            F.col("area_id").alias("areaId"),
            F.col("num_of_seats").alias("numOfSeats"),
            F.col("type"),
            F.col("seats"),
        )
    )
    broken = F.when(F.col("seq") % 97 == 0, F.substr(body, F.lit(1), F.length(body) - 3)).otherwise(body)
    raw = sent.select("seq", "ts", broken.alias("value"))
    accepted = seats_as_text(ingest.reservation_commands(raw)).select(
        "seq", F.lit("accepted").alias("status"), "reservation_id", "user_id", "event_area_id",
        "num_of_seats", "num_of_seat", "type", "seats",
    )
    rejected = ingest.rejected_commands(raw, ingest.RESERVATION_BODY, "userId", "eventId", "areaId").select(
        "seq", F.lit("rejected").alias("status")
    )
    return accepted.unionByName(rejected, allowMissingColumns=True)


@query
def ingest_json_events(spark, sf):
    """Orders as event commands with one area per line item; some documents are cut off."""
    lines = D.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("l_linenumber").cast("string").alias("areaId"),
                    F.when(F.col("l_linenumber") != 2, F.col("l_partkey").cast("int")).alias("price"),
                    (1 + F.col("l_suppkey") % 9).cast("int").alias("rowCount"),
                    (1 + F.col("l_partkey") % 7).cast("int").alias("colCount"),
                )
            )
        ).alias("areas")
    )
    opening = F.to_timestamp("o_orderdate")
    sent = D.table(spark, sf, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    body = F.to_json(
        F.struct(
            F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey").cast("string")).alias("eventName"),
            F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("string")).alias("artist"),
            F.date_format(opening, "yyyy-MM-dd'T'HH:mm:ss.123456'Z'").alias("reservationOpeningTime"),
            F.col("areas"),
        )
    )
    broken = F.when(F.col("o_orderkey") % 97 == 0, F.substr(body, F.lit(1), F.length(body) - 3)).otherwise(body)
    events = ingest.event_commands(sent.select(F.col("o_orderkey").cast("bigint").alias("seq"), broken.alias("value")))
    areas = F.transform(
        "areas",
        lambda a: F.concat_ws(
            ":", a["area_id"], a["price"].cast("string"), a["row_count"].cast("string"), a["col_count"].cast("string")
        ),
    )
    return events.select(
        "seq", "event_name", "artist", "opening_ts", F.col("closing_ts").isNull().alias("no_closing"),
        F.array_join(areas, ",").alias("areas"),
    )


@query
def typed_roundtrip(spark, sf):
    encoded = logs.encode(D.requests(spark, sf), "create_reservation", "reservation_id")
    return seats_as_text(logs.decode(encoded, "create_reservation"))


# --- projections --------------------------------------------------------------------------


@query
def event_areas(spark, sf):
    return D.areas(spark, sf).drop("seq")


@query
def area_status_init(spark, sf):
    return _initial(spark, sf).select("event_area_id", "row_count", "col_count", "available_seats", "grid")


@query
def seat_rows(spark, sf):
    return projections.seat_rows(projections.nested_status(D.pinned_snapshot(spark, sf, every=True)))


@query
def event_area_key(spark, sf):
    return D.requests(spark, sf).select("reservation_id", "event_area_id")


@query
def reservations_created(spark, sf):
    return seats_as_text(projections.new_reservations(D.requests(spark, sf))).drop("event_area_id")


@query
def unmatched_results_dropped(spark, sf):
    kept = _decided(spark, sf).where(F.col("seq") % 3 != 0)
    return lifecycle.unmatched_results(kept, _results(spark, sf)).select("reservation_id", "result", "error_code")


@query
def reserve_seat_requests(spark, sf):
    return seats_as_text(projections.reserve_requests(lifecycle.route(_decided(spark, sf), "processing")))


def _routed(spark, sf, name):
    return lifecycle.route(D.reservation_updates(spark, sf), name).select(
        "seq", "reservation_id", "state", "failed_reason"
    )


@query
def route_processed(spark, sf):
    return _routed(spark, sf, "processed")


@query
def route_processing(spark, sf):
    return _routed(spark, sf, "processing")


@query
def route_invalid(spark, sf):
    return _routed(spark, sf, "invalid")


@query
def dead_letter_states(spark, sf):
    path = scratch_path(spark, "dead_letters")
    logs.write_batch(lifecycle.route(D.reservation_updates(spark, sf), "invalid"), path, 0)
    return logs.read_batches(spark, path).groupBy("state").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


@query
def request_type_coerced(spark, sf):
    raw = D.raw_requests(spark, sf).withColumn(
        "sent",
        F.when(F.col("seq") % 13 == 0, F.lower("type")).when(F.col("seq") % 29 == 0, None).otherwise(F.col("type")),
    )
    coerced = projections.normalise_requests(raw.withColumn("type", F.col("sent")))
    return coerced.select("reservation_id", "sent", "type")


@query
def request_seats_normalised(spark, sf):
    requests = D.requests(spark, sf)
    return seats_as_text(requests.withColumn("n_seats", F.size("seats"))).select("reservation_id", "n_seats", "seats")


@query
def failure_messages(spark, sf):
    return _allocated(spark, sf).results().where(F.col("result") == "FAILED").select("reservation_id", "error_message")


@query
def event_times(spark, sf):
    definitions = D.create_events(spark, sf).select(
        F.col("event_name").alias("id"),
        to_millis(F.col("opening_ts")).alias("millis"),
        at_millis(F.col("opening_ts")).alias("at_ts"),
    )
    requested = D.requests(spark, sf).select(
        F.col("reservation_id").alias("id"),
        to_millis(F.col("ts")).alias("millis"),
        at_millis(F.col("ts")).alias("at_ts"),
    )
    return definitions.unionByName(requested)


@query
def reservation_json(spark, sf):
    return _flow(spark, sf).select("reservation_id", reservation_document().alias("document"))


# --- tables, joins, lookups -----------------------------------------------------------------


@query
def area_latest(spark, sf):
    return tables.latest_per_key(D.area_updates(spark, sf), "event_area_id", ["seq"]).drop("grid")


@query
def reservation_latest(spark, sf):
    latest = tables.latest_per_key(D.reservation_updates(spark, sf), "reservation_id", ["seq"])
    return latest.select("reservation_id", "seq", "event_id", "area_id", "num_of_seats", "state", "failed_reason")


@query
def changelog_compacted(spark, sf):
    batched = D.area_updates(spark, sf).withColumn("batch", F.floor(F.col("seq") / 500))
    compact = tables.compact_updates(batched, "event_area_id", ["seq"], "batch")
    return compact.select("batch", "event_area_id", "seq", "available_seats")


@query
def prefilter_decisions(spark, sf):
    return _decided(spark, sf).select("reservation_id", "event_area_id", "state", "failed_reason")


@query
def allocator_area_lookup(spark, sf):
    known = D.areas(spark, sf).select("event_area_id", "row_count", "col_count")
    joined = D.requests(spark, sf).join(known, "event_area_id", "left")
    return joined.select(
        "reservation_id", "event_area_id", F.col("row_count").isNotNull().alias("known"), "row_count", "col_count"
    )


@query
def area_snapshot_of_all(spark, sf):
    """The snapshot keeps every area: one per part, with the line item that came last."""
    lines = D.table(spark, sf, "lineitem")
    changes = lines.select(
        F.concat(F.lit("part#"), F.col("l_partkey").cast("string")).alias("event_area_id"),
        (F.col("l_orderkey").cast("bigint") * 10_000 + F.col("l_linenumber") * 1_000 + F.col("l_suppkey") % 1_000).alias("seq"),
    )
    return tables.replicated_snapshot(changes)


@query
def asof_many_versions(spark, sf):
    """Line items with the newest order of their supplier so far: many versions per key, and many rows for each."""
    lines = D.table(spark, sf, "lineitem")
    versions = lines.groupBy("l_suppkey", F.col("l_orderkey").cast("bigint").alias("since")).agg(
        F.sum("l_linenumber").cast("bigint").alias("lines")
    )
    rows = lines.where(F.col("l_linenumber").isNotNull()).select(
        "l_suppkey", "l_partkey", "l_linenumber", (F.col("l_orderkey").cast("bigint") - 3).alias("at")
    )
    return asof_join(rows, versions, "l_suppkey", "since", "at")


@query
def apply_results(spark, sf):
    created = _decided(spark, sf).where(F.col("state") == "PROCESSING")
    return _final_columns(lifecycle.apply_results(created, _results(spark, sf)))


@query
def reservation_updates(spark, sf):
    created = prefilter.decide(D.requests(spark, sf), _initial(spark, sf))
    updated = lifecycle.apply_results(
        lifecycle.route(created, "processing"), _results(spark, sf)
    )
    return _final_columns(lifecycle.merge_updates(created, updated))


@query
def lookup_wait(spark, sf):
    return lookup_or_wait(D.asks(spark, sf), D.outcomes(spark, sf))


@query
def reservation_lookup(spark, sf):
    customers = D.table(spark, sf, "customer").select(
        F.concat(F.lit("u-"), F.col("c_custkey").cast("string")).alias("reservation_id")
    )
    latest = tables.latest_per_key(D.reservation_updates(spark, sf), "reservation_id", ["seq"])
    return lookup(latest, customers).select("reservation_id", "seq", "state")


@query
def reservation_lookup_stored(spark, sf):
    """The same lookup on a table that is kept in hash buckets and was filled by three batches."""
    path, updates = scratch_path(spark, "reservations"), D.reservation_updates(spark, sf)
    how = ("reservation_id", ["seq"], 16)
    for batch in range(3):
        buckets.add_updates(updates.where(F.pmod(F.col("seq"), F.lit(3)) == batch), path, *how)
    customers = D.table(spark, sf, "customer").select(
        F.concat(F.lit("u-"), F.col("c_custkey").cast("string")).alias("reservation_id")
    )
    return buckets.find_all(path, updates.schema, *how, customers).select("reservation_id", "seq", "state")


@query
def area_cache_topn(spark, sf):
    touched = tables.latest_per_key(
        D.line_requests(spark, sf).select("event_area_id", "seq", "reservation_id"),
        "event_area_id",
        ["seq", "reservation_id"],
    )
    return tables.most_recent(touched, ["seq", "event_area_id"], 50).select("event_area_id", "seq")


# --- pre-filter and allocation ----------------------------------------------------------------


def _passing(spark, sf, request_type):
    rows = prefilter.passing(D.requests(spark, sf), D.pinned_snapshot(spark, sf), request_type)
    return rows.select("reservation_id", "event_area_id", "passes")


@query
def prefilter_random(spark, sf):
    return _passing(spark, sf, "RANDOM")


@query
def prefilter_self_pick(spark, sf):
    return _passing(spark, sf, "SELF_PICK")


def _of_type(spark, sf, request_type):
    wanted = D.requests(spark, sf).where(F.col("type") == request_type)
    return _fold_columns(allocate(wanted, D.areas(spark, sf)).results())


@query
def reserve_random(spark, sf):
    return _of_type(spark, sf, "RANDOM")


@query
def reserve_self_pick(spark, sf):
    return _of_type(spark, sf, "SELF_PICK")


@query
def reserve_seats(spark, sf):
    return _fold_columns(_allocated(spark, sf).results())


@query
def area_status_final(spark, sf):
    return _allocated(spark, sf).final_areas().drop("free_seats")


@query
def reservation_flow_final(spark, sf):
    return _final_columns(_flow(spark, sf))


def _pick_back_row(grid: bytearray, rows: int, cols: int, count: int, seats: list) -> list | None:
    """Rightmost free run of the last row that has one."""
    if count <= 0:
        return None
    at = grid.rfind(b"1" * count)
    if at < 0:
        return None
    row, col = divmod(at, cols + 1)
    return [(row, col + i) for i in range(count)]


def _back_row_registry():
    n = F.col("num_of_seats")
    registry = register_strategy(
        "BACK_ROW",
        pick=_pick_back_row,
        passes=STRATEGIES["RANDOM"].passes,
        refusal=lambda: F.when(n <= 0, refused("INVALID_ARGUMENT", "%d seats at the back are invalid", n)).otherwise(
            refused("NOT_AVAILABLE", "no %d seats left at the back", n)
        ),
    )
    return registry


def _back_row_requests(spark, sf, registry):
    sent = D.raw_requests(spark, sf).withColumn(
        "type", F.when((F.col("type") == "RANDOM") & (F.col("seq") % 2 == 0), "BACK_ROW").otherwise(F.col("type"))
    )
    return projections.normalise_requests(sent, [*registry, "INVALID"])


@query
def strategy_extension(spark, sf):
    """A third request type, BACK_ROW, used by every second RANDOM request."""
    registry = _back_row_registry()
    mixed = _back_row_requests(spark, sf, registry)
    return _fold_columns(allocate(mixed, D.areas(spark, sf), registry=registry).results())


@query
def strategy_extension_flow(spark, sf):
    """The third type through normalising, pre-filter, allocation and life cycle."""
    registry = _back_row_registry()
    areas = D.areas(spark, sf)
    requests = _back_row_requests(spark, sf, registry)
    final = reservation_flow(requests, areas, projections.area_status(areas), registry)
    return final.select("reservation_id", "type", "state", G.seats_text(F.col("seats")).alias("seats"))


# --- reports ------------------------------------------------------------------------------------


def _is_error():
    return F.col("post_status") != 200


def _with_calls(spark, sf):
    """Final reservations with the status of the calls that asked for them."""
    calls = D.timings(spark, sf).select("reservation_id", "post_status")
    return _flow(spark, sf).join(calls, "reservation_id")


@query
def outcome_counts(spark, sf):
    return report.outcome_counts(_with_calls(spark, sf), _is_error())


@query
def seats_per_area(spark, sf):
    return report.seats_per_area(_flow(spark, sf))


@query
def seats_rollup(spark, sf):
    return report.seats_rollup(_flow(spark, sf))


@query
def double_booking_audit(spark, sf):
    return report.double_booking_audit(_flow(spark, sf))


@query
def double_booking_found(spark, sf):
    """The audit on a damaged table: every third reservation is there a second time."""
    final = _flow(spark, sf)
    again = final.where(F.col("seq") % 3 == 0).withColumn("reservation_id", F.concat(F.lit("x-"), "reservation_id"))
    return report.double_booking_audit(final.unionByName(again))


@query
def response_time(spark, sf):
    return D.timings(spark, sf).select("reservation_id", report.response_ms().alias("response_ms"))


def _with_latency(spark, sf):
    return D.timings(spark, sf).withColumn("latency_ms", report.response_ms() + F.col("round"))


@query
def latency_percentiles(spark, sf):
    return report.latency_percentiles(_with_latency(spark, sf), _is_error())


@query
def latency_percentiles_approx(spark, sf):
    return report.latency_percentiles_approx(_with_latency(spark, sf), _is_error())


@query
def latency_percentiles_rank(spark, sf):
    return report.approx_rank_errors(_with_latency(spark, sf), _is_error())


@query
def check_rate_trend(spark, sf):
    return report.check_rate_trend(D.timings(spark, sf))


@query
def rate_tumbling(spark, sf):
    return report.tumbling_rate(D.timings(spark, sf))


@query
def rate_tumbling_hourly(spark, sf):
    """Windows that hold many rows each."""
    return report.tumbling_rate(D.timings(spark, sf), width="1 hour")


@query
def duration_percentile_tumbling(spark, sf):
    return report.tumbling_percentile(D.timings(spark, sf), report.response_ms(), width="1 hour")


def merged_percentiles(fine: DataFrame, times: DataFrame) -> DataFrame:
    """Hourly and overall percentiles from the sketches of shorter windows, held against the rows."""
    longer = sketches.merged(fine, "1 hour").unionByName(sketches.merged(fine))
    found = sketches.percentiles(longer, report.POINTS)
    return sketches.rank_errors(found, times, report.response_ms(), report.POINTS, "1 hour")


@query
def duration_percentile_sketches(spark, sf):
    times = D.timings(spark, sf)
    return merged_percentiles(sketches.window_sketches(times, report.response_ms(), "1 minute"), times)


@query
def sold_out_time(spark, sf):
    requests = D.requests(spark, sf)
    key = ["event_area_id", "seq", "reservation_id"]
    changes = allocate(requests, D.areas(spark, sf)).changes().join(requests.select(*key, "ts"), key)
    return report.sold_out_times(requests, changes, D.areas(spark, sf))


@query
def prefilter_selectivity(spark, sf):
    return report.selectivity(_decided(spark, sf))


@query
def area_skew_topk(spark, sf):
    return report.key_skew(D.line_requests(spark, sf), "event_area_id")


@query
def run_summary(spark, sf):
    return report.run_summary(D.timings(spark, sf), _is_error())


@query
def rounds_avg(spark, sf):
    return report.rounds_average(D.timings(spark, sf))


@query
def config_delta(spark, sf):
    return report.config_delta(D.timings(spark, sf), "click")


@query
def journey_sample(spark, sf):
    stages = report.journey_stages(D.timings(spark, sf))
    return report.sampled(stages, "reservation_id", 0.1).select("reservation_id", "stage_no", "stage")


@query
def reservation_journey(spark, sf):
    return report.reservation_journey(report.journey_stages(D.timings(spark, sf)))


@query
def failed_reason_hist(spark, sf):
    return report.failed_reasons(_flow(spark, sf))


# --- the large log --------------------------------------------------------------------------------


def _line_flow(spark, sf, hot=None):
    areas = D.supplier_areas(spark, sf)
    return reservation_flow(D.line_requests(spark, sf, hot), areas, projections.area_status(areas))


@query
def line_item_flow(spark, sf):
    """Every line item asks for seats in its supplier's area."""
    return _final_columns(_line_flow(spark, sf))


@query
def line_item_flow_hot(spark, sf):
    """The same log with all requests in one area."""
    return _final_columns(_line_flow(spark, sf, F.lit(True)))
