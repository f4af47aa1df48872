"""Blocks of rows that stay in a task, met by rows that stream past them.

Both sides are one table, dealt by key and sorted so that a key's resident rows come first.  What a task holds is one
block; how many rows stream past it does not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

Streamed = Iterator[pa.RecordBatch]
#: Gets a key, the key's resident rows and the batches that stream past them.
Meeting = Callable[[tuple, pa.Table, Streamed], Iterator[pa.RecordBatch]]


def _runs(batch: pa.RecordBatch, by: list[str]) -> list[int]:
    """Where the key or the side changes, and the end."""
    n = batch.num_rows
    if n < 2:
        return [0, n]
    differs = None
    for c in [*by, "_side"]:
        column = batch.column(c)
        d = pc.not_equal(column.slice(1), column.slice(0, n - 1))
        differs = d if differs is None else pc.or_(differs, d)
    return [0, *(i + 1 for i, d in enumerate(differs.to_pylist()) if d), n]


def _task(by: list[str], run: Meeting):
    def parts(batches: Streamed) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
        for batch in batches:
            cuts = _runs(batch, by) if batch.num_rows else [0]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(batch.column(c)[a].as_py() for c in by)
                yield key, batch.column("_side")[a].as_py(), batch.slice(a, b - a)

    def task(batches: Streamed) -> Streamed:
        todo = parts(batches)
        now = next(todo, None)
        while now is not None:
            key, held = now[0], []
            while now is not None and now[0] == key and now[1] == 0:
                held.append(now[2])
                now = next(todo, None)

            def past() -> Streamed:
                nonlocal now
                while now is not None and now[0] == key:
                    yield now[2]
                    now = next(todo, None)

            stream = past()
            if held:
                yield from run(key, pa.Table.from_batches(held), stream)
            for _ in stream:  # what was not looked at
                pass

    return task


def meet(resident: DataFrame, streamed: DataFrame, by: list[str], run: Meeting, ddl: str, order: tuple[str, ...] = ()) -> DataFrame:
    """``run`` for each key of ``resident``; keys must not be null.  ``order`` sorts the rows of either side."""
    rows = resident.withColumn("_side", F.lit(0)).unionByName(
        streamed.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    return rows.repartition(*by).sortWithinPartitions(*by, "_side", *order).mapInArrow(_task(by, run), ddl)
