"""Percentiles from sketches that can be merged: per window, for coarser windows and over all, in batch and on streams.

A sketch keeps a bounded number of values of a window, whatever number of rows it has seen, and is a column of a table.
Sketches of windows add up to that of a longer one, so a report over any span reads sketches and no rows.  The rank of
a value is off by ``RANK_ERROR`` of the rows at most, but for odds that are far below one in a million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; about three times as many values are kept.
SIZE = 1_000
RANK_ERROR = 0.01


def window_sketches(rows: DataFrame, measure: Column, width: str, ts: str = "ts", size: int = SIZE) -> DataFrame:
    """``window_start`` and the ``sketch`` of a whole-number measure; nulls are not counted.  For streams as well."""
    return (
        rows.withColumn("_m", measure.cast("bigint"))
        .where("_m is not null")
        .groupBy(F.window(ts, width).alias("w"))
        .agg(F.kll_sketch_agg_bigint("_m", F.lit(size)).alias("sketch"))
        .select(F.col("w.start").alias("window_start"), "sketch")
    )


def merged(sketches: DataFrame, width: str | None = None, size: int = SIZE) -> DataFrame:
    """The sketches of longer windows, or one row over all with a null ``window_start``.

    ``width`` must be a multiple of the width that the sketches have.
    """
    start = F.window("window_start", width)["start"] if width else F.lit(None).cast("timestamp")
    dealt = sketches.select(start.alias("window_start"), "sketch")
    return dealt.groupBy("window_start").agg(F.kll_merge_agg_bigint("sketch", F.lit(size)).alias("sketch"))


def percentiles(sketches: DataFrame, points: dict[str, float]) -> DataFrame:
    """``window_start``, the number of rows ``n`` and a column of each point."""
    return sketches.select(
        "window_start",
        F.kll_sketch_get_n_bigint("sketch").alias("n"),
        *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p))).alias(label) for label, p in points.items()],
    )


def rank_errors(
    found: DataFrame, rows: DataFrame, measure: Column, points: dict[str, float], width: str, error: float = RANK_ERROR
) -> DataFrame:
    """Per window of :func:`percentiles`, over all too, whether the rank of each point's value is within its bound.

    A value stands for all ranks from the rows below it to the rows up to it.
    """
    spans = F.explode(F.array(F.window("ts", width)["start"], F.lit(None).cast("timestamp")))
    counted = (
        rows.select("ts", measure.cast("bigint").alias("v")).where("v is not null")
        .select(spans.alias("_start"), "v").groupBy("_start", "v").agg(F.count("*").alias("k"))
    )
    met = found.join(counted, F.col("window_start").eqNullSafe(F.col("_start")))
    below = {p: F.sum(F.when(F.col("v") < F.col(p), F.col("k")).otherwise(0)) for p in points}
    upto = {p: F.sum(F.when(F.col("v") <= F.col(p), F.col("k")).otherwise(0)) for p in points}
    n, slack = F.col("n"), F.ceil(F.col("n") * error)
    within = [(below[p] - slack <= F.ceil(n * at)) & (F.ceil(n * at) <= upto[p] + slack) for p, at in points.items()]
    return met.groupBy("window_start", "n").agg(*[w.alias(f"{p}_within") for p, w in zip(points, within)])
