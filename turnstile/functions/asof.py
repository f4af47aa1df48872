"""As-of join: the newest version of a keyed table at each row's log position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.session import write_once

#: Versions of a key that each of its rows may be compared with.
FEW = 16


def asof_join(rows: DataFrame, versions: DataFrame, key: str, position: str, at: str) -> DataFrame:
    """Every row with the columns of the version that holds at ``at``, null where none is old enough.

    A version holds from its position up to the next one of its key, so a row
    meets one version at most.  Where each key has few versions, an equi-join on
    the key compares a row with all of them; Spark broadcasts a small table of
    versions and else splits the rows of a hot key.  With more of them, rows and
    versions are scanned together in order of position.
    """
    most = versions.where(F.col(key).isNotNull()).groupBy(key).count().agg(F.max("count")).first()[0] or 0
    return (by_span if most <= FEW else by_scan)(rows, versions, key, position, at)


def by_span(rows: DataFrame, versions: DataFrame, key: str, position: str, at: str) -> DataFrame:
    """By an equi-join on the key with the version's range as its condition."""
    names = [c for c in versions.columns if c != key]
    until = F.lead(position).over(Window.partitionBy(key).orderBy(position))
    spans = versions.select(
        F.col(key).alias("_key"), *[F.col(n).alias(f"_v_{n}") for n in names], until.alias("_until")
    )
    holds = (
        (F.col(key) == F.col("_key"))
        & (F.col(f"_v_{position}") <= F.col(at))
        & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    )
    joined = rows.join(spans, holds, "left")
    return joined.select(*rows.columns, *[F.col(f"_v_{n}").alias(n) for n in names])


def by_scan(rows: DataFrame, versions: DataFrame, key: str, position: str, at: str) -> DataFrame:
    """By a scan in segments, whose work is linear in rows and versions.

    Rows and versions are range-partitioned by key and position and written; a
    slice is what a key has in one partition, so a hot key is many slices.  In a
    slice each row takes the last version before it; what a slice hands on to the
    next ones of its key is one row of a small table.
    """
    names = [c for c in versions.columns if c != key]
    known = versions.where(F.col(key).isNotNull() & F.col(position).isNotNull()).select(
        F.col(key).alias("_key"), F.col(position).alias("_at"), F.lit(0).alias("_side"), F.struct(*names).alias("_version")
    )
    asked = rows.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"))
    both = known.unionByName(asked, allowMissingColumns=True)
    # A row at a version's position already has that version.
    order = ["_at", "_side"]
    sliced = both.repartitionByRange("_key", *order).withColumn("_slice", F.spark_partition_id())
    sliced = write_once(sliced, sliced.schema, "asof")
    before = Window.partitionBy("_key", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = sliced.withColumn("_found", F.last("_version", ignorenulls=True).over(before)).where("_side = 1")
    last = F.max_by("_version", F.when(F.col("_side") == 0, F.col("_at"))).alias("_last")
    earlier = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sliced.groupBy("_key", "_slice").agg(last).select(
        F.col("_key").alias("_k"), F.col("_slice").alias("_s"), F.last("_last", ignorenulls=True).over(earlier).alias("_carried")
    )
    joined = scanned.join(carried.where("_carried is not null"), (F.col("_key") == F.col("_k")) & (F.col("_slice") == F.col("_s")), "left")
    found = F.coalesce("_found", "_carried")
    return joined.select("_row.*", *[found.getField(n).alias(n) for n in names])
