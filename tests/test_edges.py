import json
import random
import statistics

from pyspark.sql import functions as F

from turnstile.functions import asof
from turnstile.functions.asof import asof_join
from turnstile.operators import report
from turnstile.sources import ingest, logs


def test_asof_join_agrees_with_brute_force(spark):
    rnd = random.Random(1)
    versions = list({(rnd.choice("aab"), rnd.randint(0, 300)): None for _ in range(60)})
    rows = [(i, rnd.choice("aabc"), rnd.randint(-5, 310)) for i in range(300)]
    v = spark.createDataFrame([(k, p, f"{k}{p}") for k, p in versions], "k string, pos bigint, v string")
    r = spark.createDataFrame(rows, "id int, k string, at bigint")
    expected = {}
    for i, key, at in rows:
        past = [p for k, p in versions if k == key and p <= at]
        expected[i] = f"{key}{max(past)}" if past else None
    for threshold in ("-1", "10MB"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            assert {x["id"]: x["v"] for x in asof_join(r, v, "k", "pos", "at").collect()} == expected
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def asof_rows(spark, n, parts):
    """One key with n rows and n versions, and two small ones; nulls take nothing."""
    rnd = random.Random(n)
    versions = [("hot", p) for p in range(0, 3 * n, 3)] + [("a", 5), ("a", 9), (None, 1), ("a", None)]
    rows = [(i, "hot", rnd.randrange(-5, 3 * n + 5)) for i in range(n)] + [(n, "a", 8), (n + 1, "a", 9), (n + 2, "b", 3), (n + 3, None, 3), (n + 4, "a", None)]
    v = spark.createDataFrame([(k, p, f"{k}{p}") for k, p in versions], "k string, pos bigint, v string").repartition(parts)
    r = spark.createDataFrame(rows, "id int, k string, at bigint").repartition(parts)
    expected = {i: f"hot{at // 3 * 3 if at < 3 * n else 3 * n - 3}" if at >= 0 else None for i, _, at in rows[:n]}
    return r, v, {**expected, n: "a5", n + 1: "a9", n + 2: None, n + 3: None, n + 4: None}


def test_asof_scan_splits_a_hot_key_and_is_linear(spark, monkeypatch):
    written = []

    def watched(df, schema, name):
        table = write_once(df, schema, name)
        written.append([r["n"] for r in table.groupBy("_key", "_slice").agg(F.count("*").alias("n")).where("_key = 'hot'").collect()])
        return table

    write_once = asof.write_once
    monkeypatch.setattr(asof, "write_once", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (2_000, 4_000):
            r, v, expected = asof_rows(spark, n, 4)
            got = asof_join(r, v, "k", "pos", "at")
            assert got.columns == ["id", "k", "at", "pos", "v"]
            assert {x["id"]: x["v"] for x in got.collect()} == expected
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "pos" not in plan.partition("Join")[2].partition("\n")[0]  # no range condition is left to a join
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    small, large = written
    assert sum(small) == 4_000 and sum(large) == 8_000  # what is scanned doubles with rows and versions
    assert len(large) > 1 and max(large) < 0.6 * sum(large)


def test_single_version_hides_later_areas(spark):
    v = spark.createDataFrame([("a", 5, "x")], "k string, pos bigint, v string")
    r = spark.createDataFrame([(1, "a", 4), (2, "a", 5), (3, "b", 9)], "id int, k string, at bigint")
    got = {x["id"]: x["v"] for x in asof_join(r, v, "k", "pos", "at").collect()}
    assert got == {1: None, 2: "x", 3: None}


def test_json_requests(spark):
    bodies = [
        {"userId": "u", "eventId": "e", "areaId": "A", "numOfSeats": 3, "type": "RANDOM"},
        {"userId": "u", "eventId": "e", "areaId": "A", "type": "random", "seats": [{"row": 1, "col": 2}]},
        {"userId": "u", "eventId": "e", "areaId": "A", "type": None, "seats": None},
        {"userId": "u", "eventId": None, "areaId": "A", "type": "RANDOM"},
        {"userId": "u", "eventId": "e", "areaId": "A", "numOfSeats": "many"},
    ]
    texts = [json.dumps(b) for b in bodies] + ["{not json"]
    raw = spark.createDataFrame(list(enumerate(texts)), "seq bigint, value string").withColumn("ts", F.current_timestamp())
    ok = {r["seq"]: r for r in ingest.reservation_commands(raw).collect()}
    bad = ingest.rejected_commands(raw, ingest.RESERVATION_BODY, "userId", "eventId", "areaId").collect()
    assert set(ok) == {0, 1, 2} and {r["seq"] for r in bad} == {3, 4, 5}
    assert (ok[0]["num_of_seats"], ok[0]["num_of_seat"], ok[0]["seats"], ok[0]["type"]) == (3, 0, [], "RANDOM")
    assert ok[1]["type"] == "INVALID" and [tuple(s) for s in ok[1]["seats"]] == [(1, 2)]
    assert ok[2]["type"] == "INVALID" and ok[2]["num_of_seats"] == 0
    again = {r["seq"]: r["reservation_id"] for r in ingest.reservation_commands(raw).collect()}
    assert all(again[s] == ok[s]["reservation_id"] for s in ok) and len(set(again.values())) == 3


def test_json_events(spark):
    body = {
        "eventName": "show", "artist": "x", "reservationOpeningTime": "2024-01-01T10:00:00.123456Z",
        "areas": [{"areaId": "A", "price": 100, "rowCount": 2, "colCount": 3}],
    }
    raw = spark.createDataFrame([(1, json.dumps(body)), (2, "{}")], "seq bigint, value string")
    event = ingest.event_commands(raw).collect()
    assert len(event) == 1
    assert tuple(event[0]["areas"][0]) == ("A", 100, 2, 3)
    assert event[0]["opening_ts"].microsecond == 123000


def test_batches_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, seq int")
    logs.write_batch(rows, path, 0)
    logs.write_batch(rows, path, 0)
    logs.write_batch(rows.where("k = 'a'").withColumn("seq", F.lit(0)), path, 1)
    assert logs.read_batches(spark, path).count() == 3
    assert {tuple(r) for r in logs.read_table(spark, path, "k", ["seq"]).collect()} == {("a", 0), ("b", 2)}


def times(spark, values):
    return spark.createDataFrame(
        [(v, None, v + 1, 200) for v in values] + [(10**6, 1, 10**6, 503)],
        "post_ms int, get_ms int, latency_ms int, post_status int",
    )


def test_percentiles_interpolate_and_skip_errors(spark):
    values = [1, 2, 3, 4, 10, 20, 30]
    error = F.col("post_status") != 200
    exact = report.latency_percentiles(times(spark, values), error).first()
    cuts = statistics.quantiles(values, n=100, method="inclusive")
    assert abs(exact["p50_processing"] - cuts[49]) < 1e-6
    assert abs(exact["p95_processing"] - cuts[94]) < 1e-6
    assert abs(exact["p99_latency"] - cuts[98] - 1) < 1e-6
    assert report.latency_percentiles(times(spark, []), error).first()["p50_latency"] is None


def test_approximate_percentiles_stay_close(spark):
    rnd = random.Random(5)
    values = [int(rnd.expovariate(0.01)) for _ in range(5000)]
    error = F.col("post_status") != 200
    approx = report.latency_percentiles_approx(times(spark, values), error, accuracy=1000).first()
    ordered = sorted(values)
    for name, point in report.POINTS.items():
        got = approx[f"{name}_processing"]
        rank = sum(v <= got for v in ordered) / len(ordered)
        assert abs(rank - point) < 0.01


def test_double_booking_is_found(spark):
    rows = [("r1", "e", "A", "RESERVED", [(0, 0), (0, 1)]), ("r2", "e", "A", "RESERVED", [(0, 1), (0, 1)]),
            ("r3", "e", "A", "FAILED", [(0, 0)]), ("r4", "f", "A", "RESERVED", [(0, 0)])]
    df = spark.createDataFrame(
        rows, "reservation_id string, event_id string, area_id string, state string, seats array<struct<row:int,col:int>>"
    )
    assert [tuple(r) for r in report.double_booking_audit(df).collect()] == [("e#A", 0, 1, 2)]
    assert {tuple(r) for r in report.seats_rollup(df).collect()} == {
        ("e", "A", 2), ("f", "A", 1), ("e", None, 2), ("f", None, 1), (None, None, 3),
    }


def test_samples_keep_whole_journeys(spark):
    ids = spark.range(2000).select(F.col("id").cast("string").alias("reservation_id"))
    both = ids.crossJoin(spark.range(2).withColumnRenamed("id", "stage"))
    kept = report.sampled(both, "reservation_id", 0.25).groupBy("reservation_id").count().collect()
    assert all(r["count"] == 2 for r in kept) and 400 < len(kept) < 600
    other = {r["reservation_id"] for r in report.sampled(ids, "reservation_id", 0.25).collect()}
    assert other == {r["reservation_id"] for r in kept}
