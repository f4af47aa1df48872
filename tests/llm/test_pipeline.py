"""The registered queries against their SQL twins, and the pipeline against brute force."""

import os
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from tests.llm import brute
from tools.check import rows_of
from turnstile.llm import mixing, oracle, packing, quality, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not there")


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query_matches_its_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(oracle.ORACLES[name])
    expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}


def test_pipeline_matches_brute_force(spark):
    """Each stage is repeated on plain rows, from what the one before it really kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, columns = [tuple(r) for r in docs.collect()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.scratch(stage(spark, docs, SF), f"test-{name}")
        got = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == columns
        assert Counter(map(repr, got)) == Counter(map(repr, expected_rows(spark, name, rows))) if name != "packing" else True
        if name == "packing":
            check_packing(docs, rows)
        rows = got


def expected_rows(spark, name, rows):
    if name == "quality":
        bits = {r["doc_id"]: r["fail_bits"] for r in quality.ledger(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
        return [r for r in rows if not bits[r[0]] and not brute.quality(r[1])[-1]]
    if name == "exact_dedup":
        kept = {d for d, _, _, kept, _ in brute.exact([(r[0], r[1]) for r in rows]) if kept}
        return [r for r in rows if r[0] in kept]
    if name == "near_dedup":
        stay = set(brute.without_near_copies([(r[0], r[1]) for r in rows]))
        return [r for r in rows if r[0] in stay]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    taken = {r["doc_id"]: (r["taken"], r["size"], r["source"]) for r in mixing.mix(frame).collect()}
    by = defaultdict(int)
    for words, _, source in taken.values():
        by[source] += words
    sizes = defaultdict(int)
    for _, size, source in taken.values():
        sizes[source] += size
    for source, target in brute.targets(list(sizes.items())).items():
        assert abs(by[source] - target) <= 2 * mixing.BLOCK_WORDS
    return [r for r in rows for _ in range(int(taken[r[0]][0] / taken[r[0]][1] + 0.5))]


def check_packing(packed, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    file, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for r in rows:
        ids = file.encode(r[1], add_special_tokens=False).ids + [packing.END]
        expected += [(r[0], *p) for p in brute.pieces(ids)]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed.collect()]
    assert sorted(got) == sorted(expected)


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.scratch(stage(spark, docs, SF), f"none-{name}")
    assert docs.count() == 0


def test_registered_pipeline(spark):
    assert queries.QUERIES["pipeline"](spark, SF).count() > 0
