"""Fixed record types of the six keyed tables.

``seq`` is the position of a record in its command log and ``ts`` its record
time.  Where two records of one key share a ``seq``, the record id breaks the
tie, so the order of a key is always total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: enum domains ------------------------------------------------
REQUEST_TYPES = ("SELF_PICK", "RANDOM", "INVALID")
DEFAULT_TYPE = "INVALID"
# -------------------------------------------------------------------------------

SEATS = "array<struct<row:int,col:int>>"
SEAT_GRID = "array<array<struct<row:int,col:int,is_available:boolean>>>"
AREAS = "array<struct<area_id:string,price:int,row_count:int,col_count:int>>"

_REQUEST_BODY = f"num_of_seats int, num_of_seat int, type string, seats {SEATS}"

DDL = {
    "create_event": (
        "seq bigint, event_name string, artist string, opening_ts timestamp, closing_ts timestamp, "
        f"start_ts timestamp, end_ts timestamp, areas {AREAS}"
    ),
    "create_reservation": (
        "seq bigint, ts timestamp, reservation_id string, user_id string, event_id string, area_id string, "
        + _REQUEST_BODY
    ),
    "reserve_seat": (
        "seq bigint, ts timestamp, event_area_id string, reservation_id string, event_id string, area_id string, "
        + _REQUEST_BODY
    ),
    "reservation_result": (
        f"seq bigint, ts timestamp, reservation_id string, result string, seats {SEATS}, "
        "error_code string, error_message string"
    ),
    "area_status": (
        "seq bigint, event_area_id string, event_id string, area_id string, price int, row_count int, "
        f"col_count int, available_seats int, seats {SEAT_GRID}"
    ),
    "reservation": (
        "seq bigint, ts timestamp, reservation_id string, user_id string, event_id string, area_id string, "
        + _REQUEST_BODY
        + ", state string, failed_reason string"
    ),
}

def conform(df: DataFrame, record: str) -> DataFrame:
    """Project ``df`` onto the columns and types of ``record``.

    Casts are strict under ANSI mode: a value that does not fit its declared
    type fails the job instead of turning into null.
    """
    fields = df.sparkSession.createDataFrame([], DDL[record]).schema.fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
