"""From requests to final reservations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.operators import prefilter
from turnstile.operators.allocate import Allocation, allocate
from turnstile.operators.lifecycle import settle
from turnstile.operators.strategies import STRATEGIES, Strategy


def admit_and_allocate(
    requests: DataFrame,
    areas: DataFrame,
    snapshot: DataFrame,
    registry: dict[str, Strategy] = STRATEGIES,
) -> Allocation:
    """Reject early against ``snapshot``, then allocate what is left.

    Rejected rows stay in the plan as rows that are not active, so requests are
    read and joined once and not split and united again.
    """
    decided = prefilter.decide(requests, snapshot, registry)
    return allocate(decided, areas, F.col("state") == "PROCESSING", registry)


def reservation_flow(
    requests: DataFrame,
    areas: DataFrame,
    snapshot: DataFrame,
    registry: dict[str, Strategy] = STRATEGIES,
) -> DataFrame:
    """Every request as its final reservation."""
    return settle(admit_and_allocate(requests, areas, snapshot, registry).results())


def result_records(allocation: Allocation) -> DataFrame:
    """The allocator's answers as result records, keyed by reservation id."""
    return (
        allocation.results()
        .where(F.col("result").isNotNull())
        .select(
            "seq", "ts", "reservation_id", "result",
            F.col("reserved_seats").alias("seats"), "error_code", "error_message",
        )
    )
