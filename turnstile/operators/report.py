"""Load-test reports: outcomes, seats sold, audits, latencies, rates, skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.functions.records import event_area_key

# --- outcomes ---------------------------------------------------------------------------


def outcome_counts(reservations: DataFrame, is_error: Column) -> DataFrame:
    """Successful, failed and errored calls; an errored call has no reservation to look at."""
    reserved = F.col("state") == "RESERVED"
    return reservations.agg(
        F.count_if(~is_error & reserved).alias("successful"),
        F.count_if(~is_error & ~reserved).alias("failed"),
        F.count_if(is_error).alias("errors"),
    )


def sold_seats(reservations: DataFrame) -> DataFrame:
    """One row per seat of each reserved reservation."""
    return (
        reservations.where(F.col("state") == "RESERVED")
        .select("event_id", "area_id", F.explode("seats").alias("seat"))
        .select("event_id", "area_id", "seat.row", "seat.col")
    )


def seats_per_area(reservations: DataFrame) -> DataFrame:
    """Distinct seats sold per area; combines by seat first, so a hot area spreads out."""
    return (
        sold_seats(reservations)
        .groupBy("event_id", "area_id")
        .agg(F.count_distinct("row", "col").alias("seats_reserved"))
    )


def seats_rollup(reservations: DataFrame) -> DataFrame:
    """Seats per area with subtotals per event and the total; nulls mark subtotals."""
    return seats_per_area(reservations).rollup("event_id", "area_id").agg(
        F.sum("seats_reserved").alias("seats_reserved")
    )


def double_booking_audit(reservations: DataFrame) -> DataFrame:
    """Seats in more than one reserved reservation; empty on sound data.

    A reservation that names a seat twice still holds it once.
    """
    distinct = reservations.withColumn("seats", F.array_distinct("seats"))
    return (
        sold_seats(distinct)
        .groupBy(event_area_key(F.col("event_id"), F.col("area_id")).alias("event_area_id"), "row", "col")
        .agg(F.count("*").alias("times_sold"))
        .where(F.col("times_sold") > 1)
    )


def failed_reasons(reservations: DataFrame) -> DataFrame:
    """Failures by class: the error code where there is one, else the text."""
    code = F.regexp_extract("failed_reason", r"^\[([A-Z_]+)\]", 1)
    return (
        reservations.where(F.col("state") == "FAILED")
        .groupBy(F.when(code != "", code).otherwise(F.col("failed_reason")).alias("reason_class"))
        .agg(F.count("*").alias("n"))
    )


def sold_out_times(requests: DataFrame, changelog: DataFrame, areas: DataFrame) -> DataFrame:
    """Per event and overall: first request, and when the last area had no seat left.

    The time is null while any area still has seats; the overall row has a null event.
    """
    started = requests.groupBy("event_id").agg(F.min("ts").alias("first_request_ts"))
    emptied = (
        changelog.where(F.col("available_seats") <= 0)
        .groupBy("event_area_id")
        .agg(F.min_by("ts", F.struct("seq", "reservation_id")).alias("sold_out_ts"))
    )
    totals = (
        areas.join(emptied, "event_area_id", "left")
        .join(started, "event_id")
        .rollup("event_id")
        .agg(
            F.min("first_request_ts").alias("first_request_ts"),
            F.count("*").alias("areas"),
            F.count("sold_out_ts").alias("areas_sold_out"),
            F.when(F.count("*") == F.count("sold_out_ts"), F.max("sold_out_ts")).alias("sold_out_ts"),
        )
    )
    gap = F.unix_micros("sold_out_ts") - F.unix_micros("first_request_ts")
    return totals.withColumn("sold_out_ms", F.floor(gap / 1000))


def selectivity(decisions: DataFrame) -> DataFrame:
    """Per event: requests and the share of them that reach the allocator."""
    passed = F.count_if(F.col("state") == "PROCESSING")
    return decisions.groupBy("event_id").agg(
        F.count("*").alias("requests"),
        passed.alias("passed"),
        F.round(passed / F.count("*"), 6).alias("passed_share"),
    )


def key_skew(requests: DataFrame, key: str, top: int = 10) -> DataFrame:
    """The ``top`` keys by load with their share of all requests."""
    counts = requests.groupBy(key).agg(F.count("*").alias("requests"))
    total = counts.agg(F.sum("requests")).scalar()
    busiest = counts.orderBy(F.col("requests").desc(), key).limit(top)
    return busiest.withColumn("share", F.round(F.col("requests") / total, 6))


# --- latencies ----------------------------------------------------------------------------


def response_ms() -> Column:
    """Sum of the two stage times; a stage that did not run counts as zero."""
    return F.coalesce("post_ms", F.lit(0)) + F.coalesce("get_ms", F.lit(0))


def percentiles_exact(rows: DataFrame, measures: dict[str, Column], points: dict[str, float]) -> DataFrame:
    """Interpolated percentiles of whole-number measures, one row.

    Rows are first counted per value, so what reaches the final task is the
    number of distinct milliseconds and not the number of rows.
    """
    named = F.array(*[F.struct(F.lit(name).alias("m"), column.alias("v")) for name, column in measures.items()])
    counted = (
        rows.select(F.explode(named).alias("e"))
        .groupBy(F.col("e.m").alias("m"), F.col("e.v").alias("v"))
        .agg(F.count("*").alias("n"))
    )
    return counted.agg(
        *[
            F.round(
                F.percentile(F.when(F.col("m") == name, F.col("v")), point, F.col("n")), 6
            ).alias(f"{label}_{name}")
            for name in measures
            for label, point in points.items()
        ]
    )


# The points of the latency report.
POINTS = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def latency_percentiles(times: DataFrame, is_error: Column) -> DataFrame:
    """P50, P95 and P99 of processing time and latency, errored calls left out."""
    return percentiles_exact(
        times.where(~is_error), {"processing": response_ms(), "latency": F.col("latency_ms")}, POINTS
    )


def latency_percentiles_approx(times: DataFrame, is_error: Column, accuracy: int = 10_000) -> DataFrame:
    """The same report with bounded memory, for measures with very many distinct values."""
    return times.where(~is_error).agg(
        *[
            F.percentile_approx(column, point, accuracy).alias(f"{label}_{name}")
            for name, column in (("processing", response_ms()), ("latency", F.col("latency_ms")))
            for label, point in POINTS.items()
        ]
    )


def approx_rank_errors(times: DataFrame, is_error: Column, accuracy: int = 10_000) -> DataFrame:
    """Per measure and point, whether the approximate value's rank is within ``1 / accuracy`` of the point.

    A value stands for all ranks from the rows below it to the rows up to it.
    """
    calls = times.where(~is_error).select(response_ms().alias("processing"), F.col("latency_ms").alias("latency"))
    each = calls.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in ("processing", "latency")
    ])))
    points = F.array(*[F.struct(F.lit(k).alias("point"), F.lit(p).alias("p")) for k, p in POINTS.items()])
    found = each.groupBy("measure").agg(
        F.percentile_approx("v", list(POINTS.values()), accuracy).alias("values"), F.count("v").alias("n")
    )
    wanted = found.select("measure", "n", F.posexplode(points).alias("i", "w"), "values").select(
        "measure", "n", "w.point", "w.p", F.col("values")[F.col("i")].alias("value")
    )
    counted = each.groupBy("measure", "v").agg(F.count("*").alias("k"))
    ranks = wanted.join(counted, "measure").groupBy("measure", "point", "p", "n").agg(
        F.sum(F.when(F.col("v") < F.col("value"), F.col("k")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("v") <= F.col("value"), F.col("k")).otherwise(0)).alias("upto"),
    )
    slack = F.ceil(F.col("n") / accuracy)
    target = F.ceil(F.col("p") * F.col("n"))
    within = (F.col("below") - slack <= target) & (target <= F.col("upto") + slack)
    return ranks.select("measure", "point", F.col("n").alias("calls"), within.alias("within_bound"))


def check_rate_trend(times: DataFrame) -> DataFrame:
    """Checks passed, and the duration of journeys whose two calls both succeeded.

    The second call is only made, and checked, if the first succeeded.
    """
    post_ok = F.col("post_status") == 200
    get_made = post_ok & F.col("get_status").isNotNull()
    done = get_made & (F.col("get_status") == 200)
    duration = F.when(done, response_ms())
    checks = F.count("*") + F.count_if(get_made)
    passed = F.count_if(post_ok) + F.count_if(done)
    return times.agg(
        checks.alias("checks"),
        passed.alias("checks_passed"),
        F.round(passed / checks, 6).alias("check_rate"),
        F.count_if(done).alias("completed"),
        F.round(F.avg(duration), 6).alias("avg_ms"),
        F.min(duration).alias("min_ms"),
        F.round(F.percentile(duration, 0.5), 6).alias("med_ms"),
        F.max(duration).alias("max_ms"),
        F.round(F.percentile(duration, 0.9), 6).alias("p90_ms"),
        F.round(F.percentile(duration, 0.95), 6).alias("p95_ms"),
    )


# Fixed value: window width of the span graphs.
WINDOW = "250 milliseconds"


def tumbling_rate(rows: DataFrame, ts: str = "ts", width: str = WINDOW) -> DataFrame:
    """Rows per tumbling window; works on streams as well."""
    return (
        rows.groupBy(F.window(ts, width).alias("w"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "n")
    )


def tumbling_percentile(rows: DataFrame, measure: Column, point: float = 0.95, width: str = WINDOW) -> DataFrame:
    return (
        rows.withColumn("_m", measure)
        .groupBy(F.window("ts", width).alias("w"))
        .agg(F.round(F.percentile("_m", point), 6).alias("duration_ms"), F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "duration_ms", "n")
    )


def run_summary(times: DataFrame, is_error: Column) -> DataFrame:
    """Requests, errors, completion time and throughput of a run."""
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1_000_000)
    n = F.count("*")
    return times.agg(
        n.alias("requests"),
        F.count_if(is_error).alias("errors"),
        F.round(F.count_if(is_error) / n, 6).alias("error_rate"),
        F.round(span, 6).alias("completion_s"),
        F.round(n / span, 6).alias("requests_per_s"),
    )


def rounds_average(times: DataFrame) -> DataFrame:
    """Figures per round and their mean over rounds, which is not the pooled figure."""
    ms = response_ms()
    per_round = times.groupBy("round").agg(
        F.count("*").cast("double").alias("requests"),
        F.percentile(ms, 0.5).alias("p50_ms"),
        F.percentile(ms, 0.95).alias("p95_ms"),
        F.avg(ms).alias("avg_ms"),
    )
    figures = ("requests", "p50_ms", "p95_ms", "avg_ms")
    mean = per_round.agg(*[F.avg(c).alias(c) for c in figures])
    rows = per_round.select(F.col("round").cast("string").alias("round"), *figures).unionByName(
        mean.select(F.lit("Avg").alias("round"), *figures)
    )
    return rows.select("round", *[F.round(c, 6).alias(c) for c in figures])


def config_delta(times: DataFrame, baseline: str) -> DataFrame:
    """Mean response time per configuration and its change against a baseline, in percent."""
    base = times.where(F.col("config") == baseline).agg(F.avg(response_ms())).scalar()
    per_config = times.groupBy("config").agg(F.avg(response_ms()).alias("avg_ms"))
    return per_config.select(
        "config",
        F.round("avg_ms", 6).alias("avg_ms"),
        F.round((F.col("avg_ms") - base) / base * 100, 4).alias("delta_pct"),
    )


# --- journeys -----------------------------------------------------------------------------


def sampled(rows: DataFrame, key: str, ratio: float) -> DataFrame:
    """A share of the ids, the same ids in every table.

    The id's hash decides, so a journey is kept or dropped as a whole.
    """
    if ratio >= 1:
        return rows
    bar = f"{int(ratio * 2**32):08x}"
    return rows.where(F.substring(F.md5(F.col(key)), 1, 8) < bar)


def journey_stages(times: DataFrame) -> DataFrame:
    """One row per stage a request went through."""
    micros = F.unix_micros("ts")
    post = F.coalesce("post_ms", F.lit(0)) * 1000
    both = post + F.coalesce("get_ms", F.lit(0)) * 1000
    known = F.col("get_ms").isNotNull()
    stage = lambda n, name, at: F.struct(
        F.lit(n).alias("stage_no"), F.lit(name).alias("stage"), F.timestamp_micros(at).alias("stage_ts")
    )
    stages = F.array(
        stage(1, "requested", micros),
        stage(2, "filtered", micros + post),
        F.when(known, stage(3, "allocated", micros + both)),
        F.when(known, stage(4, "final", micros + both + 1000)),
    )
    return (
        times.select("reservation_id", F.explode(stages).alias("s"))
        .where(F.col("s").isNotNull())
        .select("reservation_id", "s.stage_no", "s.stage", "s.stage_ts")
    )


def reservation_journey(stages: DataFrame) -> DataFrame:
    """Each stage with the gap to the one before it."""
    order = Window.partitionBy("reservation_id").orderBy("stage_ts", "stage_no")
    gap = F.unix_millis("stage_ts") - F.unix_millis(F.lag("stage_ts").over(order))
    return stages.withColumn("gap_ms", gap)
