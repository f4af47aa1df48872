"""The first rows of each group in log order, without sorting or ranking the rows.

A distributed order statistic: rows are counted per group and range of log
positions, combined before the shuffle; running sums over the ranges tell up to
which position a group's first rows come; a hash join drops what is later.  A
group that is not much larger than what is wanted of it is left as it is, and so
is the rest of the range in which the last wanted row lies, so a few rows more
than wanted remain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.session import write_once

#: A group is cut if it has more than so many times the rows that are wanted.
SLACK = 4
#: Ranges of positions per group: so many, one more for each ``PER_RANGE`` wanted rows, and two for each time that the
#: group has the wanted number of rows, but not more than ``MOST`` for these.
RANGES, PER_RANGE, MOST = 64, 64, 4096
#: Distinct rows of a range are counted in so many longs of bits.
LONGS = 8


def _bits() -> list[Column]:
    """A bit per row, ``_hash``, in one of ``LONGS`` longs: rows that are delivered twice share it."""
    long, mask = F.pmod("_hash", F.lit(LONGS)), F.expr("shiftleft(1L, cast(pmod(shiftright(_hash, 8), 64) as int))")
    return [F.bit_or(F.when(long == i, mask)).alias(f"_bits{i}") for i in range(LONGS)]


def _ranges(rows: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """Per group of ``spans`` (``_low``, ``_high``, ``_wanted``, ``_size``) and range: rows, a lower bound of distinct ones, its end."""
    times = F.least(F.floor(2 * F.col("_size") / F.greatest("_wanted", F.lit(1))), F.lit(MOST))
    parts = RANGES + F.floor(F.col("_wanted") / PER_RANGE) + times
    width = F.floor((F.col("_high") - F.col("_low")) / parts) + 1
    inside = rows.join(spans, by).where(F.col("seq").between(F.col("_low"), F.col("_high")))
    hashed = {"_hash": F.xxhash64("seq", "reservation_id"), "_range": F.floor((F.col("seq") - F.col("_low")) / width)}
    counted = (
        inside.withColumns({**hashed, "_width": width})
        .groupBy(*by, "_low", "_high", "_wanted", "_width", "_range")
        .agg(F.count("*").alias("_rows"), *_bits())
    )
    distinct = reduce(lambda a, b: a + b, (F.coalesce(F.bit_count(f"_bits{i}"), F.lit(0)) for i in range(LONGS)))
    end = F.least(F.col("_low") + (F.col("_range") + 1) * F.col("_width") - 1, F.col("_high"))
    return counted.select(*by, "_low", "_wanted", "_rows", distinct.cast("bigint").alias("_distinct"), end.alias("_end"))


def _cuts(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Per group the end of the range with the last wanted row (``_cut``), the rows before it and within, and where it starts."""
    order = Window.partitionBy(*by).orderBy("_end")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranges.select(
        *by, "_wanted", "_end", "_rows", "_distinct",
        F.sum("_distinct").over(so_far).alias("_found"),
        F.coalesce(F.lag("_end").over(order) + 1, F.col("_low")).alias("_start"),
    )
    reached = F.struct("_end", "_start", "_rows", (F.col("_found") - F.col("_distinct")).alias("_before"))
    last = summed.groupBy(*by, "_wanted").agg(F.min(F.when(F.col("_found") >= F.col("_wanted"), reached)).alias("_at"))
    return last.where(F.col("_at").isNotNull()).select(
        *by, "_wanted", F.col("_at._end").alias("_cut"), "_at._start", "_at._rows", "_at._before"
    )


def first_rows(rows: DataFrame, by: list[str], wanted: str) -> DataFrame:
    """``rows`` without those that come after the first ``wanted`` of their group, by ``seq`` and ``reservation_id``.

    ``rows`` is read several times and should be a table.  ``wanted`` is the same
    all over a group.  A row that was delivered twice takes one place.  Where very
    many rows of a group have one position, these are ranked.
    """
    groups = rows.groupBy(*by).agg(
        F.count("*").alias("_rows"), F.min("seq").alias("_low"), F.max("seq").alias("_high"), F.max(wanted).cast("bigint").alias("_wanted")
    )
    large = groups.where(F.col("_rows") > SLACK * F.col("_wanted"))
    large = large.withColumnRenamed("_rows", "_size")
    spans = write_once(large, large.schema, "large-groups")
    tied = None
    while not spans.isEmpty():
        cuts = _cuts(_ranges(rows, spans, by), by)
        cuts = write_once(cuts, cuts.schema, "cuts")
        rows = rows.join(cuts.select(*by, "_cut"), by, "left").where(F.col("_cut").isNull() | (F.col("seq") <= F.col("_cut")))
        rows = rows.drop("_cut")
        # A range that holds far too many rows is looked at again, for what is still wanted in it.
        crowded = cuts.where(F.col("_rows") > SLACK * F.col("_wanted"))
        one = crowded.where("_start = _cut").select(*by)
        tied = one if tied is None else tied.unionAll(one)
        spans = crowded.where("_start < _cut").select(
            *by, F.col("_start").alias("_low"), F.col("_cut").alias("_high"), (F.col("_wanted") - F.col("_before")).alias("_wanted"),
            F.col("_rows").alias("_size"),
        )
    if tied is None or tied.isEmpty():
        return rows
    marked = rows.join(tied.withColumn("_tied", F.lit(True)), by, "left")
    return marked.where("_tied is null").drop("_tied").unionByName(_ranked(marked.where("_tied").drop("_tied"), by, wanted))


def _ranked(rows: DataFrame, by: list[str], wanted: str) -> DataFrame:
    """By rank, first in salted parts of each group, then as a whole."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for group in ([*by, F.pmod(F.xxhash64("reservation_id"), F.lit(parts))], by):
        rank = F.dense_rank().over(Window.partitionBy(*group).orderBy("seq", "reservation_id"))
        rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= F.col(wanted)).drop("_rank")
    return rows
