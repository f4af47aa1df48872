"""Helpers that the corpus operators share: white space, words, scratch tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnstile.session import remove, scratch_path

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole_text(name: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


#: Of each open :func:`released`, the tables to remove.
_open: list[list[str]] = []


def scratch(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there.

    What follows neither recomputes ``df`` nor depends on the executors that made it.  ``stays``: :func:`released` leaves it.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    if _open and not stays:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables that were written inside, but for those that stay, once all inside is done.

    For steps whose result is such a table: what led to it is not read again.
    """
    _open.append([])
    try:
        yield
    finally:
        made = _open.pop()
    for path in made:
        remove(spark, path)
