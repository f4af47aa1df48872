"""Requests that name their seats, settled in parallel before the fold.

In an area where all candidates name the seats they want, who comes first on all
of its seats wins, whatever the others do, and whoever names a seat that was won
has lost.  What is then left is decided in the same way, in rounds: each is an
aggregate per seat, combined before the shuffle, and joins that Spark can split
at a seat in demand.  An area takes part while it has far more candidates than
seats, so what remains for its fold is bounded by the seats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.functions import grid as G
from turnstile.operators.strategies import Strategy
from turnstile.session import write_once

#: An area takes part while it has more than so many candidates per seat.
SLACK = 4

_AREA = ["event_area_id", "epoch"]
_REQUEST = [*_AREA, "seq", "reservation_id"]


def _names(registry: dict[str, Strategy]) -> list[str]:
    return [name for name, strategy in registry.items() if strategy.takes_named]


def crowded_areas(pool: DataFrame, registry: dict[str, Strategy]) -> DataFrame:
    """``event_area_id``, ``epoch`` and ``_most`` of areas with many candidates, all of which name their seats."""
    counted = pool.groupBy(*_AREA).agg(
        F.count("*").alias("_n"),
        F.bool_and(F.col("type").isin(*_names(registry))).alias("_named"),
        F.max(SLACK * G.capacity(F.col("row_count"), F.col("col_count"))).alias("_most"),
    )
    return counted.where("_named and _n > _most").select(*_AREA, "_most")


def _decide(asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``asks`` (a request and a ``cell`` in each row): the requests that win now, and the asks of those left open."""
    key = F.struct("seq", "reservation_id")
    first = asks.groupBy(*_AREA, "cell").agg(F.min(key).alias("_first"))
    checked = asks.join(first, [*_AREA, "cell"]).groupBy(*_REQUEST).agg(F.bool_and(key == F.col("_first")).alias("_wins"))
    won = checked.where("_wins").select(*_REQUEST)
    won = write_once(won, won.schema, "handpicked-won")
    taken = asks.join(won, _REQUEST, "left_semi").select(*_AREA, "cell").distinct()
    over = asks.join(taken, [*_AREA, "cell"], "left_semi").select(*_REQUEST).distinct()
    left = asks.join(over, _REQUEST, "left_anti")
    return won, write_once(left, left.schema, "handpicked-open")


def settle_handpicked(pool: DataFrame, states: DataFrame, registry: dict[str, Strategy]) -> DataFrame:
    """``pool`` without those of its requests in crowded areas that are known to lose.

    ``states`` have the grids that the areas start from.
    """
    if pool.where(F.col("type").isin(*_names(registry))).isEmpty():
        return pool
    areas = crowded_areas(pool, registry)
    areas = write_once(areas, areas.schema, "handpicked-areas")
    if areas.isEmpty():
        return pool
    inside = pool.join(areas, _AREA, "left_semi").join(states.select(*_AREA, "grid"), _AREA)
    cols = F.col("col_count")
    free = F.forall("seats", lambda s: G.is_free(F.col("grid"), s, cols))
    cells = F.array_distinct(F.transform("seats", lambda s: s["row"] * cols + s["col"]))
    asks = inside.where(free).select(*_REQUEST, F.explode(cells).alias("cell")).distinct()
    open_asks, kept = write_once(asks, asks.schema, "handpicked-asks"), []
    busy = open_asks
    while not busy.isEmpty():
        won, left = _decide(busy)
        kept.append(won)
        counts = left.select(*_REQUEST).distinct().groupBy(*_AREA).agg(F.count("*").alias("_n")).join(areas, _AREA)
        crowded = counts.where("_n > _most").select(*_AREA)
        crowded = write_once(crowded, crowded.schema, "handpicked-crowded")
        kept.append(left.join(crowded, _AREA, "left_anti").select(*_REQUEST).distinct())
        busy = left.join(crowded, _AREA, "left_semi")
    stay = kept[0]
    for more in kept[1:]:
        stay = stay.unionAll(more)
    stay = stay.withColumn("_stays", F.lit(True))
    marked = pool.join(areas.withColumn("_crowded", F.lit(True)).drop("_most"), _AREA, "left").join(stay, _REQUEST, "left")
    return marked.where("_crowded is null or _stays").drop("_crowded", "_stays")
