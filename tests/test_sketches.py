import random

from pyspark.sql import functions as F

from turnstile.operators.sketches import RANK_ERROR, merged, percentiles, window_sketches

POINTS = {"p10": 0.1, "p50": 0.5, "p99": 0.99}


def timed(spark, values, step=7):
    """A value every ``step`` seconds."""
    rows = [(i * step, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "s bigint, v bigint").withColumn("ts", F.timestamp_seconds("s"))


def test_merged_windows_keep_ranks(spark):
    """Sketches of minutes, merged per hour and over all, against sorted values."""
    rnd = random.Random(3)
    values = [int(rnd.lognormvariate(5, 2)) for _ in range(40_000)]
    fine = window_sketches(timed(spark, values), F.col("v"), "1 minute")
    for width, groups in (("1 hour", 3600), (None, None)):
        for row in percentiles(merged(fine, width), POINTS).collect():
            at = row["window_start"].timestamp() if width else 0
            own = sorted(v for i, v in enumerate(values) if not groups or at <= i * 7 < at + groups)
            assert row["n"] == len(own)
            for label, point in POINTS.items():
                below, upto = sum(v < row[label] for v in own), sum(v <= row[label] for v in own)
                slack = 1 + RANK_ERROR * len(own)
                assert below - slack <= point * len(own) <= upto + slack


def test_size_of_a_sketch_does_not_grow_with_rows(spark):
    sizes = [
        window_sketches(timed(spark, range(n), step=0), F.col("v"), "1 minute").select(F.length("sketch")).first()[0]
        for n in (50_000, 200_000)
    ]
    assert sizes[1] < 1.3 * sizes[0] < 64_000


def test_nulls_and_empty_tables(spark):
    some = timed(spark, [None, 5, None])
    found = percentiles(window_sketches(some, F.col("v"), "1 minute"), POINTS).collect()
    assert [(r["n"], r["p10"], r["p99"]) for r in found] == [(1, 5, 5)]
    assert window_sketches(timed(spark, [None]), F.col("v"), "1 minute").count() == 0
    none = window_sketches(some.limit(0), F.col("v"), "1 minute")
    assert percentiles(merged(none, "1 hour"), POINTS).count() == 0
    assert percentiles(merged(none), POINTS).count() == 0
