"""Row-wise reshaping of command and state records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.functions import grid as G
from turnstile.functions.records import coerce_type, event_area_key, seat_list
from turnstile.schemas import REQUEST_TYPES


def event_areas(events: DataFrame) -> DataFrame:
    """One row per area of each created event."""
    return events.select("seq", "event_name", F.explode("areas").alias("area")).select(
        "seq",
        event_area_key(F.col("event_name"), F.col("area.area_id")).alias("event_area_id"),
        F.col("event_name").alias("event_id"),
        "area.area_id",
        "area.price",
        "area.row_count",
        "area.col_count",
    )


def area_status(areas: DataFrame) -> DataFrame:
    """Areas as new seat grids, all free."""
    rows, cols = F.col("row_count"), F.col("col_count")
    return areas.withColumns(
        {"available_seats": G.capacity(rows, cols), "grid": G.full_grid(rows, cols)}
    )


def nested_status(status: DataFrame) -> DataFrame:
    """Area state with the grid as nested seat records, the form kept at table edges."""
    matrix = G.seat_matrix(F.col("grid"), F.col("row_count"), F.col("col_count"))
    return status.withColumn("seats", matrix).drop("grid")


def flat_status(status: DataFrame) -> DataFrame:
    return status.withColumn("grid", G.matrix_grid(F.col("seats"))).drop("seats")


def seat_rows(status: DataFrame) -> DataFrame:
    """One row per seat of the nested form."""
    return status.select("event_area_id", F.explode(F.flatten("seats")).alias("seat")).select(
        "event_area_id", "seat.row", "seat.col", "seat.is_available"
    )


def normalise_requests(raw: DataFrame, known=REQUEST_TYPES) -> DataFrame:
    """Known request types, seat lists that are never null, and the area key.

    Pass the names of a registry with added strategies as ``known``.
    """
    return raw.withColumns(
        {
            "type": coerce_type(F.col("type"), known),
            "seats": seat_list(F.col("seats")),
            "event_area_id": event_area_key(F.col("event_id"), F.col("area_id")),
        }
    )


def new_reservations(requests: DataFrame) -> DataFrame:
    """Each request as a reservation that is being processed."""
    return requests.withColumns({"state": F.lit("PROCESSING"), "failed_reason": F.lit("")})


def reserve_requests(reservations: DataFrame) -> DataFrame:
    """Reservations re-keyed by area for the allocator, without user and state."""
    return reservations.select(
        "seq",
        "ts",
        event_area_key(F.col("event_id"), F.col("area_id")).alias("event_area_id"),
        "reservation_id",
        "event_id",
        "area_id",
        "num_of_seats",
        "num_of_seat",
        "type",
        "seats",
    )
