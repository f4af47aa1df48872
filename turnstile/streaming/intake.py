"""Pre-filtering a stream of reservation requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from turnstile.operators import prefilter
from turnstile.operators.lifecycle import route
from turnstile.operators.projections import reserve_requests
from turnstile.operators.strategies import STRATEGIES, Strategy
from turnstile.sources.logs import write_batch
from turnstile.streaming.runtime import run_to_end


def run_intake(
    requests: DataFrame,
    snapshot: Callable[[int], DataFrame],
    created_path: str,
    reserve_path: str,
    final_path: str,
    checkpoint: str,
    registry: dict[str, Strategy] = STRATEGIES,
    sink: Callable[[DataFrame, str, int], None] = write_batch,
) -> None:
    """Each batch is decided against the snapshot that ``snapshot`` gives for its number.

    It has to be the same one whenever it is asked for, so that a batch that is
    run again decides as before; ``AreaStates.before`` of the allocator is such.

    Writes every reservation, the requests for the allocator, and the
    reservations that are final already.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        decided = prefilter.decide(batch, snapshot(batch_id), registry).persist()
        sink(decided, created_path, batch_id)
        sink(reserve_requests(route(decided, "processing")), reserve_path, batch_id)
        sink(route(decided, "processed"), final_path, batch_id)
        decided.unpersist()

    run_to_end(requests, write, checkpoint)
