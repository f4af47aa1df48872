"""Reservation lookups by id, at once or waiting for an outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how long a lookup waits for its reservation, in seconds.
WAIT_SECONDS = 10


def lookup(reservations: DataFrame, ids: DataFrame) -> DataFrame:
    """Reservations (one row per id) whose id is asked for."""
    return reservations.join(ids.select("reservation_id"), "reservation_id", "left_semi")


def lookup_or_wait(asks: DataFrame, outcomes: DataFrame, wait: int = WAIT_SECONDS) -> DataFrame:
    """Each ask with its outcome's time, or marked as timed out.

    An outcome that is there before the ask answers it however old it is.  Only
    the first outcome of an id matters, so outcomes are reduced to one row per
    id before the join.
    """
    first = outcomes.groupBy("reservation_id").agg(F.min("outcome_ts").alias("_first"))
    in_time = F.col("_first") <= F.col("ask_ts") + F.make_dt_interval(secs=F.lit(wait).cast("decimal(18,6)"))
    return (
        asks.join(first, "reservation_id", "left")
        .withColumn("outcome_ts", F.when(in_time, F.col("_first")))
        .withColumn("timed_out", F.col("outcome_ts").isNull())
        .drop("_first")
    )
