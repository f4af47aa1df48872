"""Seat allocation as a stream: every micro-batch goes through the batch allocator.

Between micro-batches an area is one row, its grid and counter.  A batch writes
the areas that it touched under its own number; every few batches all areas are
written as a base, and what only older batches needed is removed.  A batch reads
the newest base before it and the batches since, so that what it reads does not
grow with the age of the job, and running it again, after a failure, starts from
the same states and changes nothing.

Within a micro-batch only candidates are folded, so a task sees rows in
proportion to an area's seats and not to the requests of the batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.functions import grid as G
from turnstile.operators import prefilter
from turnstile.operators.allocate import Allocation, allocate
from turnstile.operators.lifecycle import settle
from turnstile.operators.strategies import STRATEGIES, Strategy
from turnstile.operators.tables import latest_per_key
from turnstile.sources.logs import batch_ids, drop_batches, write_batch
from turnstile.streaming.runtime import run_to_end

_REQUEST = [
    "seq", "ts", "reservation_id", "user_id", "event_id", "area_id", "num_of_seats", "num_of_seat", "type", "seats",
]
_AREA = ["event_area_id", "seq", "row_count", "col_count", "grid", "available_seats"]
_STATES = "event_area_id string, row_count int, col_count int, grid string, available_seats int"
#: So often all areas are written as a base.
BATCHES_PER_BASE = 8
# Position of what an area was before the batch: older than any row of the batch.
BEFORE = -(2**62)


@dataclass(frozen=True)
class AreaStates:
    """The states table of one job: what each batch changed, and bases that sum it up."""

    spark: SparkSession
    path: str

    def _parts(self, batch_id: int) -> list[str]:
        """The base before ``batch_id``, if there is one, and the changes since."""
        bases = [n for n in batch_ids(self.spark, f"{self.path}/base") if n < batch_id]
        base = bases[-1] if bases else -1
        changes = [n for n in batch_ids(self.spark, f"{self.path}/changes") if base < n < batch_id]
        return [f"{self.path}/base/batch={n}" for n in bases[-1:]] + [f"{self.path}/changes/batch={n}" for n in changes]

    def before(self, batch_id: int) -> DataFrame:
        """Each area as the batches before ``batch_id`` left it."""
        parts = self._parts(batch_id)
        if not parts:
            fields = T.StructType.fromDDL(_STATES).fields
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        numbered = [self.spark.read.schema(_STATES).parquet(part).withColumn("batch", F.lit(i)) for i, part in enumerate(parts)]
        return latest_per_key(reduce(DataFrame.unionAll, numbered), "event_area_id", ["batch"]).drop("batch")

    def write(self, states: DataFrame, batch_id: int) -> None:
        changed = states.select("event_area_id", "row_count", "col_count", "grid", "available_seats")
        write_batch(changed, f"{self.path}/changes", batch_id)
        if (batch_id + 1) % BATCHES_PER_BASE == 0:
            write_batch(self.before(batch_id + 1), f"{self.path}/base", batch_id)
            self._retire(batch_id)

    def _retire(self, batch_id: int) -> None:
        """A batch that runs again starts from the base before this one at the earliest."""
        bases = [n for n in batch_ids(self.spark, f"{self.path}/base") if n < batch_id]
        if bases:
            drop_batches(self.spark, f"{self.path}/base", bases[:-1])
            old = [n for n in batch_ids(self.spark, f"{self.path}/changes") if n <= bases[-1]]
            drop_batches(self.spark, f"{self.path}/changes", old)


def tagged(areas: DataFrame, requests: DataFrame) -> DataFrame:
    """Creations and requests as one stream, so that one job has both in order."""
    rows, cols = F.col("row_count"), F.col("col_count")
    created = areas.select(
        F.lit("created").alias("kind"), "event_area_id", "seq", "row_count", "col_count",
        G.capacity(rows, cols).alias("available_seats"), G.full_grid(rows, cols).alias("grid"),
    )
    # A request that lacks a part is refused like any other that asks for nothing.
    asked = requests.select(
        F.lit("asked").alias("kind"), "event_area_id", *[c for c in _REQUEST if c in requests.columns]
    ).withColumns(
        {
            "num_of_seats": F.coalesce("num_of_seats", F.lit(0)),
            "seats": F.coalesce("seats", F.array().cast("array<struct<row:int,col:int>>")),
        }
    )
    return asked.unionByName(created, allowMissingColumns=True)


@dataclass(frozen=True)
class Step:
    """One micro-batch: what was there before it, what it creates and asks."""

    before: DataFrame
    created: DataFrame
    requests: DataFrame

    def areas(self) -> DataFrame:
        """Areas that the batch touches: as they were, and as it creates them."""
        touched = self.created.select("event_area_id").union(self.requests.select("event_area_id")).distinct()
        known = self.before.join(touched, "event_area_id", "left_semi").withColumn("seq", F.lit(BEFORE))
        return known.select(*_AREA).unionByName(self.created.select(*_AREA))

    def changes(self, allocation: Allocation) -> DataFrame:
        """Area changelog of the batch: creations and successes."""
        return allocation.changelog().where((F.col("seq") > BEFORE) | F.col("reservation_id").isNotNull())


def step_of(batch: DataFrame, before: DataFrame) -> Step:
    asked = batch.where(F.col("kind") == "asked").drop("kind", "row_count", "col_count", "available_seats", "grid")
    return Step(before, batch.where(F.col("kind") == "created"), asked)


def run_allocator(
    areas: DataFrame,
    requests: DataFrame,
    results_path: str,
    changes_path: str,
    states_path: str,
    checkpoint: str,
    registry: dict[str, Strategy] = STRATEGIES,
    sink: Callable[[DataFrame, str, int], None] = write_batch,
) -> None:
    """The allocator job: results, area changes and area states, each to its own log.

    ``areas`` and ``requests`` are streams (:func:`turnstile.operators.projections.event_areas`
    and reserve-seat rows).  Between batches, order is the order of batches.
    """
    states = AreaStates(requests.sparkSession, states_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        step = step_of(batch.persist(), states.before(batch_id))
        allocation = allocate(step.requests, step.areas(), registry=registry)
        sink(allocation.results().withColumnRenamed("reserved_seats", "seats_won").select(
            "seq", "ts", "reservation_id", "event_area_id", "result", F.col("seats_won").alias("seats"),
            "error_code", "error_message",
        ), results_path, batch_id)
        sink(step.changes(allocation), changes_path, batch_id)
        states.write(allocation.final_areas(), batch_id)
        batch.unpersist()

    run_to_end(tagged(areas, requests), write, checkpoint)


def run_flow(
    areas: DataFrame,
    requests: DataFrame,
    final_path: str,
    changes_path: str,
    states_path: str,
    checkpoint: str,
    registry: dict[str, Strategy] = STRATEGIES,
) -> None:
    """Intake, allocator and life cycle as one job.

    The pre-filter looks at the areas as the batches before left them, so what
    has sold out is rejected without reaching the allocator.  Every request of a
    batch leaves it as a final reservation; ``admitted`` tells which ones reached
    the allocator.
    """
    states = AreaStates(requests.sparkSession, states_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        step = step_of(batch.persist(), states.before(batch_id))
        snapshot = step.before.withColumn("seq", F.lit(BEFORE))
        decided = prefilter.decide(step.requests, snapshot, registry)
        admitted = F.col("state") == "PROCESSING"
        allocation = allocate(decided.withColumn("admitted", admitted), step.areas(), admitted, registry)
        write_batch(settle(allocation.results()), final_path, batch_id)
        write_batch(step.changes(allocation), changes_path, batch_id)
        states.write(allocation.final_areas(), batch_id)
        batch.unpersist()

    run_to_end(tagged(areas, requests), write, checkpoint)
