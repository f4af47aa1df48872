"""Early rejection of hopeless requests against a possibly stale area snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.functions import messages as M
from turnstile.operators.projections import new_reservations
from turnstile.operators.strategies import STRATEGIES, Strategy, by_type
from turnstile.operators.tables import most_recent

_SNAPSHOT = ("row_count", "col_count", "available_seats", "grid")


def with_snapshot(requests: DataFrame, snapshot: DataFrame, keep: int | None = None) -> DataFrame:
    """Requests with the columns of their area's snapshot, null where it has none.

    ``keep`` cuts the snapshot to its newest areas; without it all areas count.
    Spark broadcasts a snapshot that is small and else splits areas that are hot.
    """
    if keep is not None:
        snapshot = most_recent(snapshot, ["seq", "event_area_id"], keep)
    return requests.join(snapshot.select("event_area_id", *_SNAPSHOT), "event_area_id", "left")


def decide(
    requests: DataFrame,
    snapshot: DataFrame,
    registry: dict[str, Strategy] = STRATEGIES,
    keep: int | None = None,
) -> DataFrame:
    """Requests as reservations, PROCESSING or already FAILED."""
    passes = by_type(registry, "passes", F.lit(True))
    reason = (
        F.when(F.col("row_count").isNull(), "")
        .when(~F.col("type").isin(*registry), F.format_string(M.TYPE_NOT_SUPPORTED, F.col("type")))
        .when(~passes, M.REJECTED_EARLY)
        .otherwise("")
    )
    looked_up = with_snapshot(new_reservations(requests), snapshot, keep)
    return (
        looked_up.withColumn("failed_reason", reason)
        .withColumn("state", F.when(F.col("failed_reason") == "", "PROCESSING").otherwise("FAILED"))
        .drop(*_SNAPSHOT)
    )


def passing(
    requests: DataFrame,
    snapshot: DataFrame,
    request_type: str,
    registry: dict[str, Strategy] = STRATEGIES,
    keep: int | None = None,
) -> DataFrame:
    """One strategy's predicate on the requests of its type whose area is known."""
    looked_up = with_snapshot(requests.where(F.col("type") == request_type), snapshot, keep)
    return (
        looked_up.where(F.col("row_count").isNotNull())
        .withColumn("passes", registry[request_type].passes())
        .drop(*_SNAPSHOT)
    )
