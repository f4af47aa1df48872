"""How a request type is filtered, allocated and answered.

A strategy has a part that runs in order inside the keyed fold (``pick``, plain
Python on one grid) and parts that run as Catalyst expressions over all rows.
Seats only ever go from free to taken while an area lives, so most requests can
be answered without entering the fold at all:

* ``rivals`` and ``winners`` say that of all requests of one area with the same
  ``rivals`` value, only the first ``winners`` can possibly get seats.  The fold
  needs no others.
* ``refusal`` says why a request got no seats.  Types that name their seats can
  ask which of them was taken first: the answers look it up seat by seat.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstile.functions import grid as G
from turnstile.functions import messages as M
from turnstile.functions.records import event_area_key, log_key

FREE, TAKEN = ord("1"), ord("0")


@dataclass(frozen=True)
class Strategy:
    """One request type; the column factories may use the names listed below.

    passes: request columns + row_count, col_count, available_seats, grid
    rivals, winners: request columns + row_count, col_count
    refusal: request columns + row_count, col_count and, if ``names_seats``, blocked: the
        index in ``seats`` of the first one that was taken before, null if none was;
        asked of requests that won no seat, null if such a request succeeds all the same
    bounded: the count alone decides what is asked for, so a count refused once stays refused
    takes_named: a request gets all seats that it names if all are free, and else nothing
    """

    pick: Callable[[bytearray, int, int, int, list], list | None]
    passes: Callable[[], Column]
    rivals: Callable[[], Column]
    winners: Callable[[], Column]
    refusal: Callable[[], Column]
    bounded: bool = False
    names_seats: bool = False
    takes_named: bool = False


def refused(code: str, template: str, *args: Column) -> Column:
    return F.struct(
        F.lit(code).alias("error_code"), F.format_string(template, *args).alias("error_message")
    )


def by_type(registry: dict[str, Strategy], part: str, otherwise: Column) -> Column:
    """One column factory of every strategy, chosen by request type."""
    cases = [(F.col("type") == name, getattr(strategy, part)()) for name, strategy in registry.items()]
    chosen = F.when(*cases[0])
    for case in cases[1:]:
        chosen = chosen.when(*case)
    return chosen.otherwise(otherwise)


def request_key() -> Column:
    return log_key(F.col("seq"), F.col("reservation_id"))


# --- first run of adjacent seats --------------------------------------------------


def pick_first_run(grid: bytearray, rows: int, cols: int, count: int, seats: list) -> list | None:
    """Lowest row first, then leftmost run of ``count`` free neighbours."""
    if count <= 0:
        return None
    at = grid.find(b"1" * count)
    if at < 0:
        return None
    row, col = divmod(at, cols + 1)
    return [(row, col + i) for i in range(count)]


def _run_passes() -> Column:
    n = F.col("num_of_seats")
    return (n <= F.col("available_seats")) & (n <= F.col("col_count"))


def _run_winners() -> Column:
    # Once a run of n is gone it stays gone, so winners of size n come first in
    # the log, and an area has room for this many of them at most.
    n, rows, cols = F.col("num_of_seats"), F.col("row_count"), F.col("col_count")
    return F.when((n > 0) & (n <= cols), F.greatest(rows, F.lit(0)) * F.floor(cols / n).cast("int")).otherwise(0)


def _run_refusal() -> Column:
    n = F.col("num_of_seats")
    return F.when(n <= 0, refused("INVALID_ARGUMENT", M.BAD_COUNT, n)).otherwise(
        refused("NOT_AVAILABLE", M.NO_RUN, n, F.col("area_id"), F.col("event_id"))
    )


# --- hand-picked seats --------------------------------------------------------------


def pick_named_seats(grid: bytearray, rows: int, cols: int, count: int, seats: list) -> list | None:
    for row, col in seats:
        if not (0 <= row < rows and 0 <= col < cols) or grid[row * (cols + 1) + col] != FREE:
            return None
    return seats


def _named_passes() -> Column:
    rows, cols, grid = F.col("row_count"), F.col("col_count"), F.col("grid")
    return F.forall("seats", lambda s: G.in_range(s, rows, cols) & G.is_free(grid, s, cols))


def _named_rivals() -> Column:
    # The same set of seats can be won once; order and repeats do not matter.
    cols = F.col("col_count")
    cells = F.transform("seats", lambda s: s["row"] * cols + s["col"])
    return F.array_join(F.array_sort(F.array_distinct(cells)).cast("array<string>"), ",")


def _named_winners() -> Column:
    rows, cols = F.col("row_count"), F.col("col_count")
    possible = (F.size("seats") > 0) & F.forall("seats", lambda s: G.in_range(s, rows, cols))
    return F.when(possible, 1).otherwise(0)


def _named_refusal() -> Column:
    rows, cols = F.col("row_count"), F.col("col_count")
    area = event_area_key(F.col("event_id"), F.col("area_id"))
    outside = F.filter(
        F.transform("seats", lambda s, i: F.when(~G.in_range(s, rows, cols), i)), lambda i: i.isNotNull()
    )
    # Seats are looked at in the order asked for; no seats asked for, none refused.
    first = F.get("seats", F.least(F.get(outside, F.lit(0)), F.col("blocked")))
    return (
        F.when(first.isNull(), None)
        .when(G.in_range(first, rows, cols), refused("NOT_AVAILABLE", M.SEAT_TAKEN, area, first["row"], first["col"]))
        .otherwise(refused("INVALID_SEAT", M.BAD_SEAT, area, first["row"], first["col"]))
    )


STRATEGIES: dict[str, Strategy] = {
    "RANDOM": Strategy(
        pick=pick_first_run,
        passes=_run_passes,
        rivals=lambda: F.col("num_of_seats").cast("string"),
        winners=_run_winners,
        refusal=_run_refusal,
        bounded=True,
    ),
    "SELF_PICK": Strategy(
        pick=pick_named_seats,
        passes=_named_passes,
        rivals=_named_rivals,
        winners=_named_winners,
        refusal=_named_refusal,
        names_seats=True,
        takes_named=True,
    ),
}


def register_strategy(
    request_type: str,
    pick: Callable[[bytearray, int, int, int, list], list | None],
    passes: Callable[[], Column],
    refusal: Callable[[], Column],
    base: dict[str, Strategy] = STRATEGIES,
    rivals: Callable[[], Column] | None = None,
    winners: Callable[[], Column] | None = None,
) -> dict[str, Strategy]:
    """A registry that also knows ``request_type``; ``base`` is left as it is.

    ``pick`` returns free seats or None; ``refusal`` gives the ``refused(...)``
    struct of a request that got none.

    ``rivals`` and ``winners`` are the type's promise of monotony: of one area's
    requests with the same ``rivals`` value, those that win come first in the log,
    and there are ``winners`` of them at most (0: never).  Then the fold gets a
    number of requests that the area's seats bound.  Without the promise every
    request of the type passes through the fold until the area is sold out.
    """
    if (rivals is None) != (winners is None):
        raise ValueError("rivals and winners go together")
    added = Strategy(
        pick=pick,
        passes=passes,
        rivals=rivals or (lambda: F.col("reservation_id")),
        winners=winners or (lambda: F.lit(1)),
        refusal=refusal,
    )
    return {**base, request_type: added}
