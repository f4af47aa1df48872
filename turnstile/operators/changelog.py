"""Area changes as a log of deltas, with images in between.

A delta is one change of an area: its number within the area's epoch, the cells that it took and the counter that it
left; number 0 is the creation.  No delta carries a grid.  Of every ``EVERY`` changes of an epoch, a segment holds the
grid before the first of them, its image, and the cells that each of them took.  A grid at any number is the image of
its segment with fewer than ``EVERY`` changes drawn on it, so whoever needs grids pays for them in the last step, and
whoever needs cells or counters never does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.functions import grid as G
from turnstile.functions.asof import asof_join
from turnstile.operators.fold import TAKEN_BEFORE

#: Changes of a segment.
EVERY = 32
_EPOCH = ["event_area_id", "epoch"]
_SHAPE = ["row_count", "col_count"]


def deltas(states: DataFrame) -> DataFrame:
    """Every change of every epoch, in ``number`` order: creations, then successes that took seats.

    A creation's cells are those that were taken from the start; its id is null.
    """
    before = F.array_compact(
        F.transform("taken", lambda holder, i: F.when(holder["seq"] == TAKEN_BEFORE[0], i))
    )
    created = states.select(
        *_EPOCH, *_SHAPE, F.lit(0).alias("number"), F.col("epoch").alias("seq"),
        F.lit(None).cast("string").alias("reservation_id"), before.alias("cells"), F.col("initial_seats").alias("available_seats"),
    )
    sales = states.select(*_EPOCH, *_SHAPE, F.posexplode("wins").alias("at", "win")).select(
        *_EPOCH, *_SHAPE, (F.col("at") + 1).alias("number"), F.col("win.seq").alias("seq"),
        F.col("win.id").alias("reservation_id"), F.array_distinct("win.cells").alias("cells"),
        F.col("win.available_seats").alias("available_seats"),
    )
    return created.unionByName(sales)


def segments(states: DataFrame, every: int = EVERY) -> DataFrame:
    """Per ``every`` changes of an epoch: ``segment``, its ``image`` and the cells of its changes as ``later``."""
    split = states.withColumn("segment", F.explode(F.sequence(F.lit(0), F.floor(F.size("wins") / every).cast("int"))))
    before = F.get("wins", F.col("segment") * every - 1)
    # Null before the first change.
    until = F.when(before.isNotNull(), F.struct(before["seq"].alias("seq"), before["id"].alias("id")))
    start = F.struct(F.lit(TAKEN_BEFORE[0]).alias("seq"), F.lit(TAKEN_BEFORE[1]).alias("id"))
    rows, cols = F.col("row_count"), F.col("col_count")
    image = F.array_join(
        F.transform(
            G.indices(rows),
            lambda r: F.array_join(
                F.transform(
                    F.slice("taken", r * cols + 1, cols),
                    lambda holder: F.when(holder <= F.coalesce(until, start), "0").otherwise("1"),
                ),
                "",
            ),
        ),
        "|",
    )
    return split.select(
        *_EPOCH, "segment",
        F.when((rows > 0) & (cols > 0), image).otherwise("").alias("image"),
        F.transform(F.slice("wins", F.col("segment") * every + 1, every), lambda w: w["cells"]).alias("later"),
    )


def _drawn(image: Column, cells: Column, col_count: Column) -> Column:
    """The image with these cells taken."""
    place = lambda cell: (cell + F.floor(cell / col_count)).cast("int") + 1
    return F.aggregate(cells, image, lambda grid, cell: F.overlay(grid, F.lit("0"), place(cell), F.lit(1)))


def with_grids(rows: DataFrame, states: DataFrame, every: int = EVERY) -> DataFrame:
    """Rows of an epoch and a change's ``number``, with the ``grid`` that the change left."""
    parts = segments(states, every).select(
        F.col("event_area_id").alias("_area"), F.col("epoch").alias("_epoch"), "segment", "image", "later"
    )
    segment = F.floor(F.col("number") / every).cast("int")
    met = rows.withColumn("_segment", segment).join(
        parts,
        F.col("event_area_id").eqNullSafe(F.col("_area"))
        & (F.col("epoch") == F.col("_epoch"))
        & (F.col("_segment") == F.col("segment")),
    )
    cells = F.flatten(F.slice("later", F.lit(1), F.col("number") - F.col("_segment") * every))
    return met.select(*rows.columns, _drawn(F.col("image"), cells, F.col("col_count")).alias("grid"))


def at_positions(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Rows with ``event_area_id``, ``seq`` and ``reservation_id``, and the last change at or before that log position.

    Adds ``epoch``, ``row_count``, ``col_count``, ``number`` and ``available_seats``, null where the area is not there
    yet.  An area is there for requests at the position of its creation.
    """

    def position(first: Column) -> Column:
        return F.struct(F.col("seq").cast("bigint").alias("seq"), first.alias("kind"), F.coalesce("reservation_id", F.lit("")).alias("id"))

    changes = deltas(states).withColumn("_position", position(F.when(F.col("number") == 0, 0).otherwise(1)))
    versions = changes.select("event_area_id", "_position", "epoch", *_SHAPE, "number", "available_seats")
    asked = rows.withColumn("_asked", position(F.lit(1)))
    return asof_join(asked, versions, "event_area_id", "_position", "_asked").drop("_asked", "_position")
