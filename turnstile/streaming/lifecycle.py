"""The reservation state machine as a stateful stream; the state is the reservations by bucket of their ids."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnstile.functions.records import failure_reason
from turnstile.operators.lifecycle import RESERVATION
from turnstile.schemas import DDL
from turnstile.streaming.keyed import held, hold, per_bucket

# Reservations travel and are kept as JSON with their time in microseconds; fields that are null are left out.
_JSON = DDL["reservation"].replace("ts timestamp", "ts bigint")


def update_reservations(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Results change the reservations that the bucket holds, results without one are dropped."""
    now = {r.get("reservation_id"): r for r in held(state) or []}
    rows = [json.loads(row) for frame in frames for row in frame["row"]]
    updated = []
    for r in sorted(rows, key=lambda r: ("_result" in r, "seq" in r, r.get("seq"))):
        name = r.get("reservation_id")
        if "_result" not in r:
            now[name] = {c: r[c] for c in RESERVATION if c in r}
            continue
        if name not in now:
            continue
        if r["_result"] == "SUCCESS":
            now[name].update(state="RESERVED", seats=r.get("_seats"))
        else:
            now[name].update(state="FAILED", failed_reason=r.get("_reason"))
        updated.append(json.dumps(now[name]))
    if now:
        hold(state, list(now.values()))
    if updated:
        yield pd.DataFrame({"row": updated})


def lifecycle_stream(created: DataFrame, results: DataFrame) -> DataFrame:
    """Updated reservations, one row per applied result."""
    made = created.select(*RESERVATION).withColumn("ts", F.unix_micros("ts"))
    told = results.select(
        "seq",
        "reservation_id",
        F.col("result").alias("_result"),
        F.col("seats").alias("_seats"),
        failure_reason(F.col("error_code"), F.col("error_message")).alias("_reason"),
    )
    # Results first: of a job that follows both logs live, what is asked for later has the reservations of these results.
    tagged = (df.select("reservation_id", F.to_json(F.struct(*df.columns)).alias("row")) for df in (told, made))
    updated = per_bucket(next(tagged).unionByName(next(tagged)), "reservation_id", update_reservations, "row string", GroupStateTimeout.NoTimeout)
    parsed = updated.select(F.from_json("row", _JSON).alias("r")).select("r.*")
    return parsed.withColumn("ts", F.timestamp_micros("ts"))
