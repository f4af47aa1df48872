"""Tables from streams: latest value per key, changelogs, recency bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last update of every key.

    An aggregate rather than a ranking window: it combines before the shuffle,
    so a key with a third of all updates reaches its task as a few rows.
    """
    newest = updates.groupBy(key).agg(
        F.max_by(F.struct(*updates.columns), F.struct(*order)).alias("_newest")
    )
    return newest.select("_newest.*")


def most_recent(table: DataFrame, order: list[str], keep: int) -> DataFrame:
    """The ``keep`` most recently written rows of a table with one row per key."""
    return table.orderBy(*[F.col(c).desc() for c in order]).limit(keep)


def replicated_snapshot(changelog: DataFrame, keep: int | None = None) -> DataFrame:
    """The area snapshot that the pre-filter looks at: the latest state of every area.

    With ``keep``, of the most recently written ones only.  The others are absent
    on purpose: the pre-filter passes requests for unknown areas on, and the
    allocator decides them.
    """
    newest = latest_per_key(changelog, "event_area_id", ["seq"])
    if keep is None:
        return newest
    return most_recent(newest, ["seq", "event_area_id"], keep)


def compact_updates(updates: DataFrame, key: str, order: list[str], batch: str) -> DataFrame:
    """Changelog with only the last update of each key per batch."""
    newest = updates.groupBy(batch, key).agg(
        F.max_by(F.struct(*updates.columns), F.struct(*order)).alias("_newest")
    )
    return newest.select("_newest.*")
