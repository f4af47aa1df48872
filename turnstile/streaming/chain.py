"""Intake, allocator and life cycle as jobs of their own, joined by commit logs.

Each job has its checkpoint and can be stopped, restarted and run at its own pace; the logs between them are all that
they share.  A job that ends between its sinks and its commit runs the batch again and adds nothing that others could
read twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from turnstile.operators.lifecycle import merge_updates
from turnstile.operators.strategies import STRATEGIES, Strategy
from turnstile.schemas import conform
from turnstile.sources.commitlog import commit_batch, commit_stream, committed
from turnstile.sources.logs import schema_of
from turnstile.streaming.allocator import run_allocator
from turnstile.streaming.intake import run_intake
from turnstile.streaming.lifecycle import lifecycle_stream
from turnstile.streaming.runtime import AVAILABLE_NOW
from turnstile.session import stateful_settings

#: What each log holds.
RECORDS = {"created": "reservation", "reserve": "reserve_seat", "final": "reservation", "results": "reservation_result",
           "updated": "reservation"}


def _sink(df: DataFrame, path: str, batch_id: int) -> None:
    """Records of a log have its declared columns; area changes have those that they come with."""
    record = RECORDS.get(path.rsplit("/", 1)[-1])
    commit_batch(conform(df, record) if record else df, path, batch_id)


@dataclass(frozen=True)
class Chain:
    """The logs and checkpoints of three jobs under ``base``."""

    spark: SparkSession
    base: str

    def log(self, name: str, stream: bool = False) -> DataFrame:
        return committed(self.spark, f"{self.base}/{name}", schema_of(self.spark, RECORDS[name]), stream)

    def _checkpoint(self, job: str) -> str:
        return f"{self.base}/checkpoint-{job}"

    def intake(
        self, requests: DataFrame, snapshot: Callable[[int], DataFrame], registry: dict[str, Strategy] = STRATEGIES
    ) -> None:
        """Requests to every reservation, those for the allocator, and those that are final."""
        logs = (f"{self.base}/{name}" for name in ("created", "reserve", "final"))
        run_intake(requests, snapshot, *logs, self._checkpoint("intake"), registry, _sink)

    def allocator(self, areas: DataFrame, registry: dict[str, Strategy] = STRATEGIES) -> None:
        """The intake's requests to results and area changes."""
        logs = (f"{self.base}/{name}" for name in ("results", "changes", "states"))
        run_allocator(areas, self.log("reserve", True), *logs, self._checkpoint("allocator"), registry, _sink)

    def lifecycle(self, partitions: int | None = None, trigger: dict = AVAILABLE_NOW) -> None:
        """Reservations and results to updated reservations."""
        updated = conform(lifecycle_stream(self.log("created", True), self.log("results", True)), RECORDS["updated"])
        with stateful_settings(self.spark, partitions):
            commit_stream(updated, f"{self.base}/updated", self._checkpoint("lifecycle"), trigger).awaitTermination()

    def reservations(self) -> DataFrame:
        """Every reservation that is final, by either way."""
        return merge_updates(self.log("final"), self.log("updated"))
