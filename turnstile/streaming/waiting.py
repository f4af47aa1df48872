"""Lookups that wait, as a stateful stream; the state is outcomes and waiting asks by bucket of their ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnstile.operators.lookup import WAIT_SECONDS
from turnstile.streaming.keyed import held, hold, per_bucket

_ANSWER = "reservation_id string, ask_us bigint, outcome_us bigint, timed_out boolean"
NO_TIME = -(2**63)


def waiting(wait_us: int) -> Callable:
    """Holds each id's first outcome, however old, and its asks that wait.

    Times are microseconds.  An ask is answered once: by an outcome that is
    known by its deadline, at the latest when the watermark passes that.
    """

    def answer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        firsts, waits = held(state) or ([], [])
        first = dict(map(tuple, firsts))
        waits = [tuple(ask) for ask in waits]
        for frame in frames:
            for name, us, is_ask in zip(frame["reservation_id"].tolist(), frame["us"].tolist(), frame["asks"].tolist()):
                if is_ask:
                    waits.append((name, us))
                else:
                    first[name] = min(us, first.get(name, us))
        passed = state.getCurrentWatermarkMs() * 1000
        open_asks, answers = [], []
        for name, at in waits:
            # Answered if the answer can no longer change: the deadline is over, or no earlier outcome can come.
            known, deadline = first.get(name), at + wait_us
            if passed <= deadline and (known is None or passed <= known):
                open_asks.append((name, at))
            else:
                answers.append((name, at, known if known is not None and known <= deadline else None))
        hold(state, (list(first.items()), open_asks))
        if open_asks:
            # Timers are in milliseconds and fire once the watermark is past them.
            state.setTimeoutTimestamp((min(at for _, at in open_asks) + wait_us) // 1000 + 1)
        if answers:
            names, asked, found = zip(*answers)
            yield pd.DataFrame(
                {
                    "reservation_id": pd.Series(names, dtype=object),
                    "ask_us": asked,
                    "outcome_us": pd.array(found, dtype="Int64"),
                    "timed_out": [us is None for us in found],
                }
            )

    return answer


def lookup_or_wait_stream(
    asks: DataFrame, outcomes: DataFrame, wait: int = WAIT_SECONDS, lateness: str = "5 seconds"
) -> DataFrame:
    """Each ask once, with the first outcome of its id or timed out, as :func:`lookup_or_wait` answers it.

    Outcomes may be any age.  Rows may be late by ``lateness``.
    """
    at = F.col("at")
    # Each stream has its own watermark; the slower one holds for both.
    asked = asks.select("reservation_id", F.col("ask_ts").alias("at"), F.lit(True).alias("asks"))
    known = outcomes.select("reservation_id", F.col("outcome_ts").alias("at"), F.lit(False).alias("asks"))
    both = asked.withWatermark("at", lateness).unionByName(known.withWatermark("at", lateness))
    # An outcome without a time is none; an ask without one is over at once.
    us = F.coalesce(F.unix_micros(at), F.lit(NO_TIME)).alias("us")
    timed = both.where(at.isNotNull() | F.col("asks")).select("reservation_id", "at", us, "asks")
    answers = per_bucket(timed, "reservation_id", waiting(wait * 1_000_000), _ANSWER, GroupStateTimeout.EventTimeTimeout)
    return answers.select(
        "reservation_id",
        F.timestamp_micros(F.nullif("ask_us", F.lit(NO_TIME))).alias("ask_ts"),
        F.timestamp_micros("outcome_us").alias("outcome_ts"),
        "timed_out",
    )
