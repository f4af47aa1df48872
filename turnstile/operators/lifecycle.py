"""Reservation life cycle: results applied to reservations, routing by state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.functions.records import failure_reason

RESERVATION = [
    "seq", "ts", "reservation_id", "user_id", "event_id", "area_id",
    "num_of_seats", "num_of_seat", "type", "seats", "state", "failed_reason",
]
_RESULT = ["result", "reserved_seats", "error_code", "error_message"]


def settle(rows: DataFrame) -> DataFrame:
    """Move reservations that carry a result to their final state.

    A success replaces the seats; a failure keeps the requested ones and records
    why.  Rows without a result stay as they are.
    """
    won, lost = F.col("result") == "SUCCESS", F.col("result") == "FAILED"
    return rows.withColumns(
        {
            "state": F.when(won, "RESERVED").when(lost, "FAILED").otherwise(F.col("state")),
            "seats": F.when(won, F.col("reserved_seats")).otherwise(F.col("seats")),
            "failed_reason": F.when(lost, failure_reason(F.col("error_code"), F.col("error_message"))).otherwise(
                F.col("failed_reason")
            ),
        }
    ).drop(*_RESULT)


def apply_results(reservations: DataFrame, results: DataFrame) -> DataFrame:
    """Updated reservations for a table of results; results of unknown ids are dropped.

    ``reservations`` has one row per id.  Several results for one id overwrite
    one another in log order: the last one decides the state, the last success
    the seats and the last failure the reason.
    """
    position = F.struct("seq", "ts")
    won, lost = F.col("result") == "SUCCESS", F.col("result") == "FAILED"
    reason = failure_reason(F.col("error_code"), F.col("error_message"))
    merged = results.groupBy("reservation_id").agg(
        F.max_by("result", position).alias("_result"),
        F.max_by("seats", F.when(won, position)).alias("_seats"),
        F.max_by(reason, F.when(lost, position)).alias("_reason"),
    )
    return (
        reservations.join(merged, "reservation_id")
        .withColumns(
            {
                "state": F.when(F.col("_result") == "SUCCESS", "RESERVED").otherwise("FAILED"),
                "seats": F.coalesce("_seats", "seats"),
                "failed_reason": F.coalesce("_reason", "failed_reason"),
            }
        )
        .select(*reservations.columns)
    )


def unmatched_results(reservations: DataFrame, results: DataFrame) -> DataFrame:
    """The results that :func:`apply_results` drops."""
    return results.join(reservations.select("reservation_id"), "reservation_id", "left_anti")


def merge_updates(created: DataFrame, updated: DataFrame) -> DataFrame:
    """Created and updated reservations as one stream, nothing removed."""
    return created.unionByName(updated)


def with_route(reservations: DataFrame) -> DataFrame:
    """First matching route wins: processed, processing, invalid."""
    return reservations.withColumn(
        "route",
        F.when(F.col("state").isin("FAILED", "RESERVED"), "processed")
        .when(F.col("state") == "PROCESSING", "processing")
        .otherwise("invalid"),
    )


def route(reservations: DataFrame, name: str) -> DataFrame:
    return with_route(reservations).where(F.col("route") == name).drop("route")
