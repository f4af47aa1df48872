"""Seat grids as text: one character per seat, ``1`` free and ``0`` taken, rows joined by ``|``.

The text form keeps a grid at one byte per seat and lets a run of adjacent
free seats be found with a substring search, because a run never matches
across the row separator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_grid(row_count: Column, col_count: Column) -> Column:
    """All seats free; an area without rows or columns has an empty grid."""
    body = F.repeat(F.concat(F.repeat(F.lit("1"), col_count), F.lit("|")), row_count)
    return F.when(
        (row_count > 0) & (col_count > 0), F.rtrim(body, F.lit("|"))
    ).otherwise(F.lit(""))


def capacity(row_count: Column, col_count: Column) -> Column:
    return F.greatest(row_count, F.lit(0)) * F.greatest(col_count, F.lit(0))


def in_range(seat: Column, row_count: Column, col_count: Column) -> Column:
    row, col = seat.getField("row"), seat.getField("col")
    return (row >= 0) & (row < row_count) & (col >= 0) & (col < col_count)


def is_free(grid: Column, seat: Column, col_count: Column) -> Column:
    """Availability of a seat that is known to be in range."""
    at = seat.getField("row") * (col_count + 1) + seat.getField("col") + 1
    return F.substr(grid, at, F.lit(1)) == "1"


def indices(count: Column) -> Column:
    """``[0 .. count-1]``; ``sequence`` alone would count down for zero."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )


def seat_matrix(grid: Column, row_count: Column, col_count: Column) -> Column:
    """The nested record form: rows of ``(row, col, is_available)``."""
    return F.transform(
        indices(row_count),
        lambda r: F.transform(
            indices(col_count),
            lambda c: F.struct(
                r.alias("row"),
                c.alias("col"),
                (F.substr(grid, r * (col_count + 1) + c + 1, F.lit(1)) == "1").alias("is_available"),
            ),
        ),
    )


def matrix_grid(matrix: Column) -> Column:
    """Inverse of :func:`seat_matrix`."""
    return F.array_join(
        F.transform(
            matrix,
            lambda row: F.array_join(
                F.transform(row, lambda s: F.when(s["is_available"], "1").otherwise("0")), ""
            ),
        ),
        "|",
    )


def seats_text(seats: Column) -> Column:
    """Canonical text of a seat list: ``row-col`` joined by commas."""
    return F.array_join(
        F.transform(seats, lambda s: F.concat_ws("-", s["row"].cast("string"), s["col"].cast("string"))), ","
    )
