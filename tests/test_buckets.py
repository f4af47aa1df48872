"""Lookups on a table in hash buckets."""

import glob

from pyspark.sql import functions as F

from turnstile.sources import buckets

HOW = ("id", ["seq"], 8)


def updates(spark, rows):
    return spark.createDataFrame(rows, "id string, seq bigint, note string")


def found(df):
    return sorted(map(tuple, df.collect()))


def test_a_lookup_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    path = str(tmp_path)
    first = [(f"r{i}", i, "a") for i in range(100)] + [(None, 7, "nobody")]
    second = [(f"r{i}", 1000 + i, "b") for i in range(0, 100, 2)] + [("r0", 5, "late")]
    buckets.add_updates(updates(spark, first), path, *HOW)
    for _ in range(2):  # a batch that runs again
        buckets.add_updates(updates(spark, second), path, *HOW)
    schema = updates(spark, []).schema
    everything = {r[0]: r for r in first if r[0]} | {r[0]: r for r in second if r[1] >= 1000}
    asked = updates(spark, [(i, 0, "") for i in ["r0", "r1", "r1", "r98", "none", None]])
    assert found(buckets.find_all(path, schema, *HOW, asked)) == sorted(everything[i] for i in ("r0", "r1", "r98"))
    assert found(buckets.find(spark, path, schema, *HOW, [])) == []
    kept = asked.where("id in ('r0', 'r98')").select(buckets.bucket_of(F.col("id"), 8)).distinct().collect()
    broken = [f for f in glob.glob(f"{path}/_bucket=*/*.parquet") if not any(f"_bucket={r[0]}/" in f for r in kept)]
    assert len(broken) > 3
    for file in broken:
        with open(file, "wb") as f:
            f.write(b"not a table")
    some = buckets.find(spark, path, schema, *HOW, ["r0", "r98", None])
    assert found(some) == sorted(everything[i] for i in ("r0", "r98"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_keys_of_other_types_and_an_empty_table(spark, tmp_path):
    table = spark.createDataFrame([(i, i) for i in range(50)], "id bigint, seq bigint")
    buckets.add_updates(table, f"{tmp_path}/numbers", *HOW)
    buckets.add_updates(table.limit(0), f"{tmp_path}/numbers", *HOW)
    assert found(buckets.find(spark, f"{tmp_path}/numbers", table.schema, *HOW, [3, 49, 77])) == [(3, 3), (49, 49)]
