"""JSON commands into typed command rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.functions.records import at_millis, coerce_type, event_area_key, seat_list, stable_id
from turnstile.schemas import REQUEST_TYPES

# Field names of the JSON commands.
RESERVATION_BODY = (
    "userId string, eventId string, areaId string, numOfSeats int, type string, "
    "seats array<struct<row:int,col:int>>"
)
EVENT_BODY = (
    "eventName string, artist string, reservationOpeningTime timestamp, reservationClosingTime timestamp, "
    "eventStartTime timestamp, eventEndTime timestamp, "
    "areas array<struct<areaId:string,price:int,rowCount:int,colCount:int>>"
)


def _parsed(raw: DataFrame, body: str) -> DataFrame:
    schema = T.StructType.fromDDL(body).add("_corrupt", "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return raw.withColumn("body", F.from_json("value", schema, options))


def _unusable(*required: str):
    broken = F.col("body").isNull() | F.col("body._corrupt").isNotNull()
    for name in required:
        broken = broken | F.col(f"body.{name}").isNull()
    return broken


def reservation_commands(raw: DataFrame, known=REQUEST_TYPES) -> DataFrame:
    """Usable reservation requests of ``raw`` (seq, ts, value).

    The id is derived from position and text, so it is the same whenever a row
    is read again.  A missing count is 0, and the second count is never taken
    from the request.
    """
    body = _parsed(raw, RESERVATION_BODY).where(~_unusable("userId", "eventId", "areaId"))
    return body.select(
        "seq",
        "ts",
        stable_id(F.col("seq"), F.col("value")).alias("reservation_id"),
        F.col("body.userId").alias("user_id"),
        F.col("body.eventId").alias("event_id"),
        F.col("body.areaId").alias("area_id"),
        F.coalesce("body.numOfSeats", F.lit(0)).alias("num_of_seats"),
        F.lit(0).alias("num_of_seat"),
        coerce_type(F.col("body.type"), known).alias("type"),
        seat_list(F.col("body.seats")).alias("seats"),
        event_area_key(F.col("body.eventId"), F.col("body.areaId")).alias("event_area_id"),
    )


def event_commands(raw: DataFrame) -> DataFrame:
    """Usable event definitions of ``raw`` (seq, value); times are cut to milliseconds."""
    body = _parsed(raw, EVENT_BODY).where(~_unusable("eventName"))
    areas = F.transform(
        F.coalesce("body.areas", F.array()),
        lambda a: F.struct(
            a["areaId"].alias("area_id"),
            F.coalesce(a["price"], F.lit(0)).alias("price"),
            F.coalesce(a["rowCount"], F.lit(0)).alias("row_count"),
            F.coalesce(a["colCount"], F.lit(0)).alias("col_count"),
        ),
    )
    return body.select(
        "seq",
        F.col("body.eventName").alias("event_name"),
        F.coalesce("body.artist", F.lit("")).alias("artist"),
        at_millis(F.col("body.reservationOpeningTime")).alias("opening_ts"),
        at_millis(F.col("body.reservationClosingTime")).alias("closing_ts"),
        at_millis(F.col("body.eventStartTime")).alias("start_ts"),
        at_millis(F.col("body.eventEndTime")).alias("end_ts"),
        areas.alias("areas"),
    )


def rejected_commands(raw: DataFrame, body: str, *required: str) -> DataFrame:
    """The rows of ``raw`` that no command can be made of."""
    return _parsed(raw, body).where(_unusable(*required)).select(*raw.columns)
