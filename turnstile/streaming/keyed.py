"""State of very many keys: one state per bucket of keys, which a task reads and writes as a whole.

A state per key costs calls between Spark and Python for every key of a batch.  With ``BUCKETS`` states those calls are
bounded, and what grows with the rows is a loop inside the task.  A batch reads the buckets of its keys only.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: Buckets of a job; fixed for its life.
BUCKETS = 1 << 12
#: What a bucket holds is JSON text.
STATE = "held string"


def held(state: GroupState):
    """What the bucket holds, None if it is new."""
    return json.loads(state.get[0]) if state.exists else None


def hold(state: GroupState, what) -> None:
    state.update((json.dumps(what, separators=(",", ":")),))


def per_bucket(rows: DataFrame, key: str, fn: Callable, ddl: str, timeout: str) -> DataFrame:
    """``fn(key, frames, state)`` on all rows of a bucket."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").applyInPandasWithState(fn, ddl, STATE, "append", timeout)
