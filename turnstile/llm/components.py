"""Connected components of a table of links, by alternating stars.

Each round hangs every node's larger neighbours on its smallest one, then every node and its smaller neighbours on the
smallest of these.  Both steps are an aggregate (combined before the shuffle) and a join, so a hub with very many links
is a skewed join that Spark splits, never one task.  Rounds grow with the logarithm of the longest path.  The links of a
round are a table in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnstile.llm.text import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    hung = both.where("v > u").join(least, "u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of ``edges`` (``u``, ``v``); links to itself drop out."""
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = scratch(ordered.distinct(), "links")
    before, state = None, _state(now)
    while state[0] and state != before:
        now = scratch(_small_star(_large_star(now)), "links")
        before, state = state, _state(now)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
