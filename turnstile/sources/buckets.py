"""A table kept in hash buckets of its key, so that a lookup reads the buckets of its keys and nothing else.

Every batch of updates adds a file or so per bucket, sorted by key: inside a bucket, parquet's minima and maxima leave out
most row groups.  The newest update of a key counts, so a batch that is written twice changes nothing.  A bucket holds
about its share of the keys however the updates are spread, as each batch adds only the last update of a key.  Null keys
are one key that is never found.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from turnstile.operators.tables import latest_per_key

BUCKET = "_bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def add_updates(updates: DataFrame, path: str, key: str, order: list[str], buckets: int) -> None:
    """Add the last update of each key; ``buckets`` is the table's for life."""
    newest = latest_per_key(updates, key, order).withColumn(BUCKET, bucket_of(F.col(key), buckets))
    dealt = newest.repartition(BUCKET).sortWithinPartitions(BUCKET, key)
    dealt.write.mode("append").partitionBy(BUCKET).parquet(path)


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields]).add(BUCKET, IntegerType())).parquet(path)


def find(spark: SparkSession, path: str, schema: StructType, key: str, order: list[str], buckets: int, ids: list) -> DataFrame:
    """The rows of a few keys: only their buckets are listed and read."""
    table = _stored(spark, path, schema)
    # Constants of the key's own type, as the hash depends on it; Spark prunes by them before it plans the scan.
    wanted = [F.lit(i).cast(schema[key].dataType) for i in ids if i is not None]
    there = reduce(or_, (F.col(BUCKET) == bucket_of(i, buckets) for i in wanted), F.lit(False))
    return latest_per_key(table.where(there & F.col(key).isin(wanted)).drop(BUCKET), key, order)


def find_all(table_path: str, schema: StructType, key: str, order: list[str], buckets: int, ids: DataFrame) -> DataFrame:
    """The rows of all keys of ``ids`` (column ``key``), each once.  Few ids leave most buckets unread at run time."""
    spark = ids.sparkSession
    asked = ids.select(key).where(F.col(key).isNotNull()).withColumn(BUCKET, bucket_of(F.col(key), buckets))
    met = _stored(spark, table_path, schema).join(asked, [BUCKET, key], "left_semi")
    return latest_per_key(met.select(*schema.names), key, order)
