"""Exact and near duplicates against comparing everything."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import brute
from turnstile.llm import exact_dedup, simhash
from turnstile.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS).repartition(parts)


def exact_rows(df):
    rows = df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_exact_matches_brute_force(spark, parts):
    rng = random.Random(parts)
    texts = [None, "", " ", "\n", "a", "a b", "a  b", "a\tb", "A b", "x" * 50_000, " a", "é b", "é b"]
    rows = [(i, rng.choice(texts)) for i in range(400)] + [(i, "hot copy") for i in range(400, 700)]
    rows += [(5, "a"), (5, "a"), (None, "a"), (None, "only here")]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert exact_rows(exact_dedup.duplicate_groups(docs(spark, rows))) == brute.exact(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_exact_on_driver_rows(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    assert exact_rows(exact_dedup.duplicate_groups(table)) == brute.exact(rows)


def test_small_batches_change_nothing(spark):
    rows = [(i, f"text {i % 7}" if i % 3 else "hot") for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert exact_rows(exact_dedup.duplicate_groups(docs(spark, rows))) == brute.exact(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_drop_duplicates_keeps_columns_and_clashing_names(spark):
    rows = [(3, "a b"), (1, "a  b"), (2, None), (7, ""), (9, "z")]
    table = docs(spark, rows).withColumn("keep_id", F.lit("x")).withColumn("edge", F.lit(None).cast("string"))
    kept = exact_dedup.drop_duplicates(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 9]
    assert {r["keep_id"] for r in kept.collect()} == {"x"}


def test_empty_tables(spark):
    none = docs(spark, [(1, "a")]).where("doc_id > 1")
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert exact_dedup.drop_duplicates(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


def test_hash_and_fingerprint():
    for text in (None, "", "one", "One two", "a b c", "É a B c d e", "x " * 3000, "tab\tand\nline  ends"):
        assert simhash.fingerprint(text) % (1 << 64) == brute.fingerprint(text)
    assert xxhash.xxh64_intdigest(b"", 42) == xxhash.xxh64(b"", seed=42).intdigest()


def test_links_lose_nothing(spark):
    """Fingerprints at every distance from 0 to 6, and a crowded ball of near ones."""
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for base in list(prints)[:60]:
        for flips in range(7):
            value = base
            for bit in rng.sample(range(64), flips):
                value ^= 1 << bit
            prints.add(value)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)} | {0, 1, (1 << 64) - 1}
    values = sorted(prints)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame(signed, "fp bigint")).collect()]
    assert len(found) == len(set(found))
    expected = {
        tuple(sorted((a[0], b[0])))
        for i, a in enumerate(signed)
        for b in signed[i + 1 :]
        if ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= 4
    }
    assert set(found) == expected


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(900, i) for i in range(500, 600)]
    others = [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    edges = chain + star + others + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: parent[x] for x in linked}


def test_near_duplicates_on_driver_rows(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = table.select("doc_id", "text").collect()
    prints = [brute.fingerprint(r["text"]) for r in rows]
    least = brute.components([r["doc_id"] for r in rows], prints)
    expected = {(r["doc_id"], f"{p:016x}", least[r["doc_id"]]) for r, p in zip(rows, prints)}
    got = simhash.near_duplicates(table).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == expected


def test_near_duplicates_of_nulls_ties_and_repeated_rows(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(9, None), (4, ""), (6, " \n"), (1, long), (2, long), (2, long), (3, "other words here now then"), (None, long)]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {(9, 4), (4, 4), (6, 4), (1, 1), (2, 1), (3, 3), (None, 1)}
