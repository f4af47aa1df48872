"""Event, request and timing logs derived from the driver's star-schema tables.

Every rule here has a twin in ``oracle_sql.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.functions import grid as G
from turnstile.functions.records import event_area_key
from turnstile.operators.projections import area_status, event_areas, normalise_requests
from turnstile.schemas import SEATS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its zone-less times are read as instants in the session's zone (UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    times = [n for n, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in times}) if times else df


# --- events with nested areas: one event per region, one area per nation ------------


def create_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event definition per region; definitions come before all requests."""
    key = F.col("n_nationkey")
    area = F.struct(
        key.alias("nation"),
        key.cast("string").alias("area_id"),
        (100 * (1 + key % 5)).alias("price"),
        (5 + key % 4).alias("row_count"),
        (6 + key % 5).alias("col_count"),
    )
    by_region = (
        table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(area)).alias("areas"))
    )
    opening = F.lit("2024-01-01 10:00:00.123456").cast("timestamp")
    return (
        table(spark, sf_dir, "region")
        .join(by_region, F.col("r_regionkey") == F.col("n_regionkey"))
        .select(
            (F.col("r_regionkey") - 5).cast("bigint").alias("seq"),
            F.concat(F.lit("event-"), F.col("r_regionkey").cast("string")).alias("event_name"),
            F.col("r_name").alias("artist"),
            opening.alias("opening_ts"),
            (opening + F.expr("interval 2 days")).alias("closing_ts"),
            (opening + F.expr("interval 30 days")).alias("start_ts"),
            (opening + F.expr("interval 30 days 3 hours")).alias("end_ts"),
            F.transform(
                "areas", lambda a: F.struct(a["area_id"], a["price"], a["row_count"], a["col_count"])
            ).cast("array<struct<area_id:string,price:int,row_count:int,col_count:int>>").alias("areas"),
        )
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_areas(create_events(spark, sf_dir))


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservation requests as sent: unknown types and missing seat lists included."""
    events = (
        table(spark, sf_dir, "events")
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .withColumn("nk", F.col("k") % 26)
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    joined = events.join(nations, F.col("nk") == F.col("n_nationkey"), "left")
    row = F.col("k") % 9
    col = (F.col("event_id") % 11).cast("int")
    first, second = F.struct(row.alias("row"), col.alias("col")), F.struct(row.alias("row"), (col + 1).alias("col"))
    picks = F.when(F.col("event_id") % 2 == 0, F.array(first, second)).otherwise(F.array(first)).cast(SEATS)
    sent_type = (
        F.when(F.col("event_type").isin("click", "view", "purchase"), "RANDOM")
        .when(F.col("event_type") == "signup", "SELF_PICK")
        .otherwise("BOGUS")
    )
    return joined.select(
        (F.col("event_id") + 1).alias("seq"),
        "ts",
        F.concat(F.lit("r-"), F.col("event_id").cast("string")).alias("reservation_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("event-"), F.coalesce("n_regionkey", F.lit(0)).cast("string")).alias("event_id"),
        F.col("nk").cast("string").alias("area_id"),
        (F.floor("value") % 6).cast("int").alias("num_of_seats"),
        F.lit(0).alias("num_of_seat"),
        sent_type.alias("type"),
        F.when(sent_type == "SELF_PICK", picks).alias("seats"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_requests(raw_requests(spark, sf_dir))


def pinned_snapshot(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """A fixed area snapshot: some areas sold out, some unknown unless ``every``, the others partly taken."""
    status = area_status(areas(spark, sf_dir))
    nation = F.col("area_id").cast("int")
    rows, cols = F.col("row_count"), F.col("col_count")
    taken = F.array_join(
        F.transform(
            G.indices(rows),
            lambda r: F.array_join(
                F.transform(
                    G.indices(cols),
                    lambda c: F.when((nation % 6 == 0) | ((r * 7 + c * 3 + nation) % 5 == 0), "0").otherwise("1"),
                ),
                "",
            ),
        ),
        "|",
    )
    return (
        status.where(F.lit(every) | (nation % 7 != 6))
        .withColumn("grid", taken)
        .withColumn("available_seats", F.length(F.regexp_replace("grid", "[0|]", "")))
    )


# --- logs with many updates per key ---------------------------------------------------


def area_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area states as a changelog: every event row reports the seats left in one area."""
    key = F.get_json_object("props", "$.k").cast("int") % 25
    status = area_status(areas(spark, sf_dir)).drop("seq", "available_seats")
    updates = table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"), key.cast("string").alias("area_id"), F.floor("value").alias("v")
    )
    joined = updates.join(F.broadcast(status), "area_id")
    seats = F.col("row_count") * F.col("col_count")
    return joined.withColumn("available_seats", (F.col("v") % (seats + 1)).cast("int")).select(
        "seq", "event_area_id", "event_id", "area_id", "price", "row_count", "col_count", "available_seats", "grid"
    )


def reservation_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservation states by user, in all five states."""
    state = (
        F.when(F.col("event_type") == "purchase", "RESERVED")
        .when(F.col("event_type") == "error", "FAILED")
        .when(F.col("event_type") == "view", "PROCESSING")
        .when(F.col("event_type") == "click", "PAID")
        .otherwise("CANCELLED")
    )
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"),
        "ts",
        F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("reservation_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("event-"), (k % 5).cast("string")).alias("event_id"),
        (k % 25).cast("string").alias("area_id"),
        (F.floor("value") % 6).cast("int").alias("num_of_seats"),
        F.lit(0).alias("num_of_seat"),
        F.lit("RANDOM").alias("type"),
        F.array().cast(SEATS).alias("seats"),
        state.alias("state"),
        F.when(state == "FAILED", "[NOT_AVAILABLE]: sold out").otherwise("").alias("failed_reason"),
    )


# --- timings for the report -----------------------------------------------------------


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stage times per request, with failures, missing times and five rounds."""
    event_id = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("r-"), event_id.cast("string")).alias("reservation_id"),
        "ts",
        F.col("event_type").alias("config"),
        F.floor("value").cast("int").alias("post_ms"),
        F.when(event_id % 17 != 0, F.get_json_object("props", "$.k").cast("int")).alias("get_ms"),
        F.when(event_id % 50 == 0, 503).otherwise(200).alias("post_status"),
        F.when(event_id % 17 != 0, F.when(event_id % 40 == 0, 404).otherwise(200)).alias("get_status"),
        (event_id % 5).cast("int").alias("round"),
    )


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("r-"), F.col("event_id").cast("string")).alias("reservation_id"), F.col("ts").alias("ask_ts")
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes from 20 s before to 20 s after the ask; some ids get none, others a second one or one an hour old."""
    k = F.get_json_object("props", "$.k").cast("int")
    n, own = F.col("event_id"), F.unix_micros("ts") + (k - 50) * 400_000
    times = F.array_compact(
        F.array(own, F.when(n % 3 == 0, own + 7_000_000), F.when(n % 5 == 0, own - 3_600_000_000))
    )
    return (
        table(spark, sf_dir, "events")
        .where(n % 17 != 0)
        .select(F.concat(F.lit("r-"), n.cast("string")).alias("reservation_id"), F.explode(times).alias("us"))
        .select("reservation_id", F.timestamp_micros("us").alias("outcome_ts"))
    )


# --- the large log: line items competing for supplier areas -----------------------------


def supplier_areas(spark: SparkSession, sf_dir: str, side: int = 20) -> DataFrame:
    """One square area per supplier, in its nation's event."""
    event_id = F.concat(F.lit("event-"), F.col("s_nationkey").cast("string"))
    area_id = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        F.lit(0).cast("bigint").alias("seq"),
        event_area_key(event_id, area_id).alias("event_area_id"),
        event_id.alias("event_id"),
        area_id.alias("area_id"),
        F.lit(100).alias("price"),
        F.lit(side).alias("row_count"),
        F.lit(side).alias("col_count"),
    )


def line_requests(spark: SparkSession, sf_dir: str, hot: Column | None = None) -> DataFrame:
    """One request per line item, in ship-date order.

    ``seq`` is the ship date; the id, unique per line, breaks ties.  Rows where
    ``hot`` holds all go to the area of supplier 0.
    """
    key = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    supplier = F.col("l_suppkey") if hot is None else F.when(hot, 0).otherwise(F.col("l_suppkey"))
    lines = table(spark, sf_dir, "lineitem").select(*key, "l_quantity", "l_shipdate")
    lines = lines.withColumn("supplier", supplier)
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), "s_nationkey")
    event_id = F.concat(F.lit("event-"), F.col("s_nationkey").cast("string"))
    area_id = F.col("supplier").cast("string")
    return lines.join(suppliers, "supplier").select(
        F.unix_date(F.to_date("l_shipdate")).cast("bigint").alias("seq"),
        F.col("l_shipdate").alias("ts"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in key]).alias("reservation_id"),
        F.col("l_orderkey").cast("string").alias("user_id"),
        event_id.alias("event_id"),
        area_id.alias("area_id"),
        (1 + F.col("l_quantity").cast("int") % 4).alias("num_of_seats"),
        F.lit(0).alias("num_of_seat"),
        F.lit("RANDOM").alias("type"),
        F.array().cast(SEATS).alias("seats"),
        event_area_key(event_id, area_id).alias("event_area_id"),
    )
