"""The ordered seat fold: the one step that has to look at requests one by one.

Runs inside a task over rows sorted by area, epoch and log position, holding the
grid of one area at a time.  An area's first row is its state, the rest are its
candidate requests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.functions import grid as G
from turnstile.operators.strategies import FREE, TAKEN, Strategy

KEY = "struct<seq:bigint,id:string>"
WINS = "array<struct<seq:bigint,id:string,cells:array<int>,available_seats:int>>"

# Holder of seats that were already taken when the area's state was written.
TAKEN_BEFORE = (-(2**63), "")

#: So many of an area's requests become Python objects at a time, until it is sold out.
REQUESTS_AT_ONCE = 64

# An area's state.  Cells are seats numbered row by row.  `taken` names the
# request holding each cell, null where free.  `wins` lists the successes in log
# order with their cells, as asked for, and the seat counter they left behind.
# Both are bounded by the number of seats.
STATE_DDL = (
    "event_area_id string, epoch bigint, row_count int, col_count int, grid string, "
    f"available_seats int, initial_seats int, taken array<{KEY}>, wins {WINS}"
)

_KEY = pa.struct([("seq", pa.int64()), ("id", pa.string())])
_WIN = pa.struct(
    [("seq", pa.int64()), ("id", pa.string()), ("cells", pa.list_(pa.int32())), ("available_seats", pa.int32())]
)
_STATE_SCHEMA = pa.schema(
    [
        ("event_area_id", pa.string()),
        ("epoch", pa.int64()),
        ("row_count", pa.int32()),
        ("col_count", pa.int32()),
        ("grid", pa.string()),
        ("available_seats", pa.int32()),
        ("initial_seats", pa.int32()),
        ("taken", pa.list_(_KEY)),
        ("wins", pa.list_(_WIN)),
    ]
)


def mark(grid: bytearray, cols: int, seats: list) -> list:
    """Take ``seats``; returns their cells."""
    for row, col in seats:
        grid[row * (cols + 1) + col] = TAKEN
    return [row * cols + col for row, col in seats]


class AreaFold:
    """One area while its requests pass by."""

    def __init__(self, row: dict):
        self.row = row
        self.grid = bytearray(row["grid"], "ascii")
        self.rows, self.cols = row["row_count"], row["col_count"]
        self.available = row["available_seats"]
        seats = self.grid.replace(b"|", b"")
        self.taken = [None if seat == FREE else TAKEN_BEFORE for seat in seats]
        self.wins = []
        self.hopeless = set()
        self.sold_out = FREE not in self.grid
        self.last = None

    def request(self, strategy: tuple, key: tuple, count: int, seats: list) -> None:
        if self.sold_out or key == self.last:  # delivered twice
            return
        self.last = key
        pick, by_count = strategy
        if by_count and count in self.hopeless:
            return
        won = pick(self.grid, self.rows, self.cols, count, seats)
        if not won:
            # What does not fit now never will: a sold-out area is not searched again.
            if by_count:
                self.hopeless.add(count)
            return
        cells = mark(self.grid, self.cols, won)
        for cell in cells:
            self.taken[cell] = key
        self.sold_out = FREE not in self.grid
        # A seat named twice lowers the counter twice.
        self.available -= len(cells)
        self.wins.append((*key, cells, self.available))

    def pass_by(self, picks: dict, requests: pa.RecordBatch) -> None:
        """The area's next requests; what comes after it has sold out is not looked at."""
        for at in range(0, len(requests), REQUESTS_AT_ONCE):
            if self.sold_out:
                return
            some = requests.slice(at, REQUESTS_AT_ONCE)
            columns = (_listed(some.column(c)) for c in ("type", "seq", "reservation_id", "num_of_seats"))
            for kind, seq, rid, count, seats in zip(*columns, _named(some.column("seats")), strict=True):
                self.request(picks[kind], (seq, rid), count, seats)


def _listed(column: pa.Array) -> list:
    """A column as Python objects; numbers without nulls by way of numpy, which is faster."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy().tolist()
    return column.to_pylist()


def _named(seats: pa.Array) -> list:
    """The (row, col) of each request's seats."""
    if not len(seats.flatten()):
        return [[]] * len(seats)
    return [[(s["row"], s["col"]) for s in named or []] for named in seats.to_pylist()]


def _key_lists(areas: list[AreaFold]) -> pa.Array:
    offsets, seqs, ids, free = [0], [], [], []
    for area in areas:
        for holder in area.taken:
            free.append(holder is None)
            seqs.append(None if holder is None else holder[0])
            ids.append(None if holder is None else holder[1])
        offsets.append(len(seqs))
    keys = pa.StructArray.from_arrays(
        [pa.array(seqs, pa.int64()), pa.array(ids, pa.string())],
        fields=list(_KEY),
        mask=pa.array(free, pa.bool_()),
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), keys)


def _offsets(lists: list) -> pa.Array:
    return pa.array(accumulate(map(len, lists), initial=0), pa.int32())


def _win_lists(areas: list[AreaFold]) -> pa.Array:
    wins = [win for area in areas for win in area.wins]
    seqs, ids, cells, left = zip(*wins, strict=True) if wins else ((), (), (), ())
    listed = pa.ListArray.from_arrays(_offsets(cells), pa.array(chain.from_iterable(cells), pa.int32()))
    columns = [pa.array(seqs, pa.int64()), pa.array(ids, pa.string()), listed, pa.array(left, pa.int32())]
    return pa.ListArray.from_arrays(_offsets([a.wins for a in areas]), pa.StructArray.from_arrays(columns, fields=list(_WIN)))


def _state_batch(areas: list[AreaFold]) -> pa.RecordBatch:
    def column(name: str, values: list) -> pa.Array:
        return pa.array(values, _STATE_SCHEMA.field(name).type)

    return pa.RecordBatch.from_arrays(
        [
            column("event_area_id", [a.row["event_area_id"] for a in areas]),
            column("epoch", [a.row["epoch"] for a in areas]),
            column("row_count", [a.rows for a in areas]),
            column("col_count", [a.cols for a in areas]),
            column("grid", [a.grid.decode("ascii") for a in areas]),
            column("available_seats", [a.available for a in areas]),
            column("initial_seats", [a.row["initial_seats"] for a in areas]),
            _key_lists(areas),
            _win_lists(areas),
        ],
        schema=_STATE_SCHEMA,
    )


_STATE_FIELDS = [f.name for f in _STATE_SCHEMA if f.name not in ("taken", "wins")]


def _fold_task(picks: dict, seats_per_batch: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        area, done, held = None, [], 0
        for batch in batches:
            firsts = np.flatnonzero(pc.equal(batch.column("kind"), 0).to_numpy(zero_copy_only=False)).tolist()
            ends = [*firsts, len(batch)]
            if ends[0]:
                area.pass_by(picks, batch.slice(0, ends[0]))
            for first, end in zip(firsts, ends[1:], strict=True):
                if area is not None:
                    done.append(area)
                    held += len(area.taken)
                    if held >= seats_per_batch:
                        yield _state_batch(done)
                        done, held = [], 0
                area = AreaFold({name: batch.column(name)[first].as_py() for name in _STATE_FIELDS})
                area.pass_by(picks, batch.slice(first + 1, end - first - 1))
        if area is not None:
            done.append(area)
        if done:
            yield _state_batch(done)

    return run


def new_states(areas: DataFrame) -> DataFrame:
    """Fold states of areas that have seen no request; one epoch per creation.

    ``areas`` may carry ``grid`` and ``available_seats`` to start from a grid
    that is partly taken.
    """
    rows, cols = F.col("row_count"), F.col("col_count")
    grid = F.col("grid") if "grid" in areas.columns else G.full_grid(rows, cols)
    seats = F.col("available_seats") if "available_seats" in areas.columns else G.capacity(rows, cols)
    return areas.select(
        "event_area_id",
        F.col("seq").cast("bigint").alias("epoch"),
        "row_count",
        "col_count",
        grid.alias("grid"),
        seats.cast("int").alias("available_seats"),
        seats.cast("int").alias("initial_seats"),
    )


def fold(states: DataFrame, candidates: DataFrame, registry: dict[str, Strategy]) -> DataFrame:
    """Apply candidate requests to area states, in log order within each area.

    Every candidate's (event_area_id, epoch) must be present in ``states``.
    Nothing may come between the exchange, the sort and the fold: a key must
    never be spread over two partitions.
    """
    rows = states.withColumn("kind", F.lit(0)).unionByName(
        candidates.withColumn("kind", F.lit(1)), allowMissingColumns=True
    )
    ordered = rows.repartition("event_area_id", "epoch").sortWithinPartitions(
        "event_area_id", "epoch", "kind", "seq", "reservation_id"
    )
    picks = {name: (strategy.pick, strategy.bounded) for name, strategy in registry.items()}
    return ordered.mapInArrow(_fold_task(picks), STATE_DDL)
