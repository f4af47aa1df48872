"""Seat allocation per area, in log order, for logs of any size and any skew.

The result of a request depends on every earlier success in its area, but an
area has a fixed number of seats, so successes are few.  Allocation therefore
runs in three steps:

1. pick the candidates: of all requests that compete for the same thing in one
   area only the first few can win (:mod:`turnstile.operators.strategies`), and
   where they are many, counts by log position tell up to where these come
   (:mod:`turnstile.operators.cut`);
2. fold the candidates over the grid, one area at a time;
3. answer every request, candidate or not, from the finished area states, with
   built-in expressions and hash joins.

The areas, and the requests with their areas, are written once to the shared
folder; all steps read these tables.

Step 2 sees a number of rows that depends on the area's size, not on the number
of requests, so an area holding a third of all requests is no hot spot.  Its
output, bounded by the number of seats, is written once to the shared folder and
read by everything that needs it; its file size tells Spark whether to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.functions import grid as G
from turnstile.functions import messages as M
from turnstile.functions.asof import asof_join
from turnstile.functions.records import log_key
from turnstile.operators.changelog import deltas, with_grids
from turnstile.operators.cut import first_rows
from turnstile.operators.fold import STATE_DDL, fold, new_states
from turnstile.operators.handpicked import settle_handpicked
from turnstile.operators.strategies import STRATEGIES, Strategy, by_type, refused, request_key
from turnstile.session import write_once


#: What answers are joined on.  The hash leads, so that sorts compare numbers and not texts that begin alike.
AT = ["_hash", "event_area_id", "seq", "reservation_id"]


def with_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_hash", F.xxhash64("event_area_id", F.col("seq").cast("bigint"), "reservation_id"))


def place(requests: DataFrame, epochs: DataFrame) -> DataFrame:
    """Add epoch, row_count and col_count: the area as it was when the request came."""
    versions = epochs.select("event_area_id", "epoch", "row_count", "col_count")
    return asof_join(requests, versions, "event_area_id", "epoch", "seq")


def contested(placed: DataFrame, registry: dict[str, Strategy]) -> DataFrame:
    """The requests that could win seats in an empty area, as fold input plus ``_winners``."""
    return (
        placed.where(F.col("epoch").isNotNull() & F.col("type").isin(*registry))
        .withColumn("_winners", by_type(registry, "winners", F.lit(0)))
        .where(F.col("_winners") > 0)
        .select(
            "event_area_id", "epoch", "row_count", "col_count",
            "seq", "reservation_id", "type", "num_of_seats", "seats", "_winners",
        )
    )


def candidates(pool: DataFrame, registry: dict[str, Strategy]) -> DataFrame:
    """Of the contested requests, those that may still win given all their earlier rivals."""
    grouped = pool.withColumn("_rivals", by_type(registry, "rivals", F.lit(None)))
    return first_rows(grouped, ["event_area_id", "epoch", "type", "_rivals"], "_winners").drop("_rivals")


def fold_areas(states: DataFrame, placed: DataFrame, registry: dict[str, Strategy]) -> DataFrame:
    """Final state of every (area, epoch)."""
    pool = settle_handpicked(candidates(contested(placed, registry), registry), states, registry)
    return fold(states, pool.drop("_winners", "row_count", "col_count"), registry)


def naming(registry: dict[str, Strategy]) -> list[str]:
    return [name for name, strategy in registry.items() if strategy.names_seats]


def first_blocked(placed: DataFrame, states: DataFrame, registry: dict[str, Strategy]) -> DataFrame:
    """Of each request that names seats, the index of the first one that an earlier request took, as ``blocked``.

    Asked seats meet held seats one by one, so the rows that meet for a seat in
    demand can be split, and none carries an area's grid.
    """
    rows, cols = F.col("row_count"), F.col("col_count")
    asked = (
        placed.where(F.col("epoch").isNotNull() & F.col("type").isin(*naming(registry)))
        .select("event_area_id", "epoch", "seq", "reservation_id", *["row_count", "col_count"], F.posexplode("seats"))
        .where(G.in_range(F.col("col"), rows, cols))
        .select(
            "event_area_id", "epoch", "seq", "reservation_id", "pos",
            (F.col("col.row") * cols + F.col("col.col")).alias("cell"),
        )
    )
    held = (
        states.select("event_area_id", "epoch", F.posexplode("taken").alias("cell", "holder"))
        .where(F.col("holder").isNotNull())
    )
    met = asked.join(held, ["event_area_id", "epoch", "cell"]).where(F.col("holder") < request_key())
    return with_hash(met).groupBy(*AT).agg(F.min("pos").alias("blocked"))


def refusal_of(registry: dict[str, Strategy], area_known: Column) -> Column:
    """Why a request was refused, null if it was not.

    Uses ``_cells``, the cells it won or null, and the columns of ``Strategy.refusal``.
    """
    no_strategy = refused("INVALID_ARGUMENT", M.NO_STRATEGY, F.col("type"))
    return (
        F.when(~area_known, refused("INVALID_EVENT_AREA", M.NO_SUCH_AREA, F.col("event_area_id")))
        .when(F.col("_cells").isNotNull(), None)
        .otherwise(by_type(registry, "refusal", no_strategy))
    )


def cells_to_seats(cells: Column, col_count: Column) -> Column:
    return F.transform(
        F.coalesce(cells, F.array().cast("array<int>")),
        lambda cell: F.struct(F.floor(cell / col_count).cast("int").alias("row"), (cell % col_count).alias("col")),
    )


@dataclass(frozen=True)
class Allocation:
    """Requests, areas and finished area states, tied together for the readers below.

    ``placed`` is a table; ``naming`` says whether requests in it name their seats.
    """

    placed: DataFrame
    active: Column
    areas: DataFrame
    states: DataFrame
    registry: dict[str, Strategy]
    naming: bool = True

    def _answered(self, placed: DataFrame) -> DataFrame:
        """Rows of ``placed`` with ``_cells``, ``_seats_left`` (both null if none were won) and ``_refusal``."""
        win = F.explode("wins")
        wins = self.states.select("event_area_id", win.alias("win")).select(
            "event_area_id",
            F.col("win.seq").alias("seq"),
            F.col("win.id").alias("reservation_id"),
            F.col("win.cells").alias("_cells"),
            F.col("win.available_seats").alias("_seats_left"),
        )
        looked_up = with_hash(placed).join(with_hash(wins), AT, "left").withColumn("blocked", F.lit(None).cast("int"))
        if self.naming:
            blocked = first_blocked(placed.where(self.active), self.states, self.registry)
            looked_up = looked_up.drop("blocked").join(blocked, AT, "left")
        refusal = refusal_of(self.registry, F.col("epoch").isNotNull())
        return looked_up.withColumn("_refusal", F.when(self.active, refusal)).drop("blocked", "_hash")

    def _may_win_nothing(self) -> DataFrame:
        """Placed requests without those that succeed with seats or not at all, whatever the states are.

        What a type that names no seats is refused for does not depend on other requests.
        """
        plain = self.placed.withColumns({"blocked": F.lit(None).cast("int"), "_cells": F.lit(None).cast("array<int>")})
        refusal = refusal_of(self.registry, F.col("epoch").isNotNull())
        kept = self.active & (F.col("type").isin(*naming(self.registry)) | refusal.isNull())
        return plain.where(kept).drop("blocked", "_cells")

    def results(self) -> DataFrame:
        """All request columns plus result, reserved_seats, error_code, error_message.

        Requests that were not active keep nulls in the added columns.
        """
        won = cells_to_seats(F.col("_cells"), F.col("col_count"))
        succeeded = self.active & F.col("_refusal").isNull()
        state = ["epoch", "row_count", "col_count", "_active"]
        return self._answered(self.placed).select(
            *[c for c in self.placed.columns if c not in state],
            F.when(succeeded, "SUCCESS").when(self.active, "FAILED").alias("result"),
            F.when(succeeded, won).alias("reserved_seats"),
            F.col("_refusal.error_code").alias("error_code"),
            F.col("_refusal.error_message").alias("error_message"),
        )

    def final_areas(self) -> DataFrame:
        """Grid and counters of every area after the last request.

        ``free_seats`` counts the grid; ``available_seats`` may be lower.
        """
        newest = self.areas.groupBy("event_area_id").agg(F.max(F.col("seq").cast("bigint")).alias("epoch"))
        return self.states.join(newest, ["event_area_id", "epoch"]).select(
            "event_area_id", "row_count", "col_count", "available_seats", "grid",
            F.length(F.regexp_replace("grid", "[0|]", "")).alias("free_seats"),
        )

    def changes(self) -> DataFrame:
        """One row per area creation and per success, without grids: :func:`turnstile.operators.changelog.deltas`.

        A success without seats has no cells, and the number and counter of the change before it.
        """
        sold = F.transform("wins", lambda w: w.dropFields("cells")).alias("_sold")
        states = self.states.select("event_area_id", "epoch", "initial_seats", sold)
        earlier = F.filter("_sold", lambda w: log_key(w["seq"], w["id"]) < request_key())
        unchanged = (
            self._answered(self._may_win_nothing())
            .where(self.active & F.col("_refusal").isNull() & F.col("_cells").isNull())
            .join(states, ["event_area_id", "epoch"])
            .withColumns({"number": F.size(earlier), "cells": F.array().cast("array<int>")})
            .withColumn(
                "available_seats", F.coalesce(F.get("_sold", F.col("number") - 1)["available_seats"], F.col("initial_seats"))
            )
        )
        known = deltas(self.states)
        return known.unionByName(unchanged.select(*known.columns))

    def changelog(self) -> DataFrame:
        """One row per area creation and per success, with the state it left behind."""
        shape = ["event_area_id", "seq", "reservation_id", "row_count", "col_count", "available_seats", "grid"]
        return with_grids(self.changes(), self.states).select(*shape)


def allocate(
    requests: DataFrame,
    areas: DataFrame,
    active: Column | None = None,
    registry: dict[str, Strategy] = STRATEGIES,
) -> Allocation:
    """Allocate seats to ``requests`` in areas created by ``areas``.

    requests: seq, reservation_id, event_area_id, event_id, area_id, num_of_seats, type, seats, and
        any other columns, which are kept.  active: only these rows take part.  A request that was
        delivered twice wins once, and both rows get its answer.
    areas: seq, event_area_id, row_count, col_count, optionally grid and available_seats; a creation
        that was delivered twice counts once.

    Runs the fold; the tables read from the returned object are lazy.
    """
    active = F.lit(True) if active is None else F.coalesce(active, F.lit(False))
    areas = areas.dropDuplicates(["event_area_id", "seq"])
    areas = write_once(areas, areas.schema, "areas")
    empty = new_states(areas)
    placed = place(requests.withColumn("_active", active), empty)
    placed = write_once(placed, placed.schema, "placed")
    taking_part = F.col("_active")
    states = write_once(fold_areas(empty, placed.where(taking_part), registry), STATE_DDL, "area-states")
    names = not placed.where(taking_part & F.col("type").isin(*naming(registry))).isEmpty()
    return Allocation(placed, taking_part, areas, states, registry, names)
