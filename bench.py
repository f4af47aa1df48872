"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the local master.  Every query runs once to warm up and then
BENCH_RUNS times; the best time counts.  Streaming jobs run once.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from turnstile.operators import prefilter, projections, report
from turnstile.operators.allocate import allocate
from turnstile.plans import queries as Q
from turnstile.plans.reservations import reservation_flow
from turnstile.plans.stream_queries import PIECES, STREAMS
from turnstile.session import build_session
from turnstile.sources import driver_tables as D


def fold_only(spark, sf):
    """Allocation states of the large log, without pre-filter and answers."""
    return allocate(D.line_requests(spark, sf), D.supplier_areas(spark, sf)).states


def mixed_hot(spark, sf):
    """All requests, random and hand-picked, in one large area."""
    area = F.lit("hot")
    requests = D.requests(spark, sf).withColumns({"event_id": area, "area_id": area, "event_area_id": F.lit("hot#hot")})
    areas = D.areas(spark, sf).limit(1).withColumns(
        {"event_id": area, "area_id": area, "event_area_id": F.lit("hot#hot"),
         "row_count": F.lit(60), "col_count": F.lit(60)}
    )
    return reservation_flow(requests, areas, projections.area_status(areas))


def line_selectivity(spark, sf):
    areas = D.supplier_areas(spark, sf)
    return report.selectivity(prefilter.decide(D.line_requests(spark, sf), projections.area_status(areas)))


QUERIES = {
    "line_item_flow": Q.BATCH["line_item_flow"],
    "line_item_flow_hot": Q.BATCH["line_item_flow_hot"],
    "line_item_fold": fold_only,
    "line_item_selectivity": line_selectivity,
    "area_skew_topk": Q.BATCH["area_skew_topk"],
    "reservation_flow_final": Q.BATCH["reservation_flow_final"],
    "prefilter_decisions": Q.BATCH["prefilter_decisions"],
    "reservation_latest": Q.BATCH["reservation_latest"],
    "lookup_wait": Q.BATCH["lookup_wait"],
    "latency_percentiles": Q.BATCH["latency_percentiles"],
    "rate_tumbling": Q.BATCH["rate_tumbling"],
    "seats_rollup": Q.BATCH["seats_rollup"],
    "mixed_hot_area": mixed_hot,
    "stream_reservation_flow": STREAMS["stream_reservation_flow"],
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__python__sql__dataFrameDebugging__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    requests = D.table(spark, sf, "lineitem").count()
    seconds = {}
    for name, fn in QUERIES.items():
        times = []
        for _ in range(1 if name.startswith("stream_") else runs + 1):
            start = time.perf_counter()
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:] or times), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "requests": requests,
                "reservations_per_sec": {
                    name: round(requests / seconds[name], 1)
                    for name in ("line_item_flow", "line_item_flow_hot", "line_item_fold")
                },
                "stream_seconds_per_batch": round(seconds["stream_reservation_flow"] / PIECES, 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
