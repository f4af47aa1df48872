"""Scalar rules on single records: keys, enum coercion, times, documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstile.schemas import DEFAULT_TYPE, REQUEST_TYPES, SEATS


def event_area_key(event_id: Column, area_id: Column) -> Column:
    """``event#area``; null when either part is null, unlike ``concat_ws``."""
    return F.concat(event_id, F.lit("#"), area_id)


def coerce_type(raw: Column, known=REQUEST_TYPES) -> Column:
    """Unknown, wrongly cased and missing request types become INVALID."""
    return F.when(raw.isin(*known), raw).otherwise(F.lit(DEFAULT_TYPE))


def seat_list(seats: Column) -> Column:
    """A seat list that is never null and holds exactly the two seat fields."""
    listed = F.coalesce(seats, F.array().cast(SEATS))
    return F.transform(
        listed,
        lambda s: F.struct(s["row"].cast("int").alias("row"), s["col"].cast("int").alias("col")),
    )


def to_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def at_millis(ts: Column) -> Column:
    """A timestamp cut to whole milliseconds, as stored records carry it."""
    return F.timestamp_millis(F.unix_millis(ts))


def log_key(seq: Column, record_id: Column) -> Column:
    """Comparable position of a record in its log."""
    return F.struct(seq.cast("bigint").alias("seq"), record_id.alias("id"))


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped id that is a pure function of the request.

    ``uuid()`` would give a new id whenever a lost task is run again.
    """
    digest = F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cuts])


def failure_reason(error_code: Column, error_message: Column) -> Column:
    return F.format_string("[%s]: %s", error_code, error_message)


# Field names of the served JSON document, in order.
DOCUMENT_FIELDS = {
    "reservationId": "reservation_id",
    "userId": "user_id",
    "eventId": "event_id",
    "areaId": "area_id",
    "numOfSeats": "num_of_seats",
    "numOfSeat": "num_of_seat",
    "type": "type",
    "seats": "seats",
    "state": "state",
    "failedReason": "failed_reason",
}


def reservation_document() -> Column:
    """The reservation as the JSON document handed to callers."""
    return F.to_json(F.struct(*[F.col(source).alias(name) for name, source in DOCUMENT_FIELDS.items()]))
