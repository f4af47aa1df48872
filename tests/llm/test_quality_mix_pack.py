"""Quality rules, mixing and packing against slow versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from turnstile.llm import mixing, packing, quality

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " ", "\n\n", "a", "a b c", "a b c a b c", "x\ty\nz  w", "a a a a", "l1 b\nl1 b\n\nl1 b", "é ü #* |", "A! B!"]


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_matches_brute_force(spark, table):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(99, "w1 w2 w3 " * 5000, "s")]
    frame = docs(spark, rows).unionByName(table.select(*docs(spark, rows).columns))
    got = quality.ledger(frame)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = got.select("doc_id", *names, (~quality.passes("base")).alias("failed")).collect()
    assert sorted(tuple(r) for r in got) == sorted((r["doc_id"], *brute.quality(r["text"])) for r in frame.collect())


def test_policies_and_ablation(spark, table):
    entries = quality.ledger(table).cache()
    rows = entries.collect()
    for policy, rules in quality.POLICIES.items():
        got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablation(entries, policy).collect()}
        for rule in rules:
            bit = quality.BITS[rule]
            failed = sum(r["fail_bits"] & bit > 0 for r in rows)
            only = sum(r["fail_bits"] & quality.mask(policy) == bit for r in rows)
            assert got[rule] == (failed, only)


def test_quality_keeps_clean_documents_and_columns(spark, table):
    frame = table.withColumn("n_words", F.lit("clash")).withColumn("fail_bits", F.lit(1))
    kept = quality.keep_passing(frame)
    assert kept.columns == frame.columns
    assert quality.keep_passing(frame.where("doc_id < 0")).count() == 0
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {r["doc_id"] for r in quality.ledger(table).where(quality.passes()).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(table, "doc_id").collect()
    good = [r for r in labels if r["quality"] == 1 and not brute.quality(r["text"])[-1]]
    bad = [r for r in labels if r["quality"] == 0]
    assert sum(r["doc_id"] in ids for r in good) >= 0.98 * len(good)
    assert sum(r["doc_id"] in ids for r in bad) <= 0.1 * len(bad)


def test_targets(spark):
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 23):
        sizes = [(f"s{i}", rng.choice([0, 3, 50, 1000, 90_000])) for i in range(n - 1)] + [(None, 40)]
        got = mixing.targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()
        expected = brute.targets(sizes)
        assert {r["source"]: pytest.approx(r["target"]) for r in got} == expected


def test_apportionment_matches_highest_quotients(spark):
    rng = random.Random(9)
    groups = []
    for g in range(40):
        votes = [rng.choice([0, 1, 5, 5, 17, 1000, 3333]) for _ in range(rng.randrange(1, 12))]
        seats = rng.randrange(0, 120) if sum(votes) else 0
        groups.append((votes, seats))
    rows = [(g, i, v, s) for g, (votes, s) in enumerate(groups) for i, v in enumerate(votes)]
    frame = spark.createDataFrame(rows, "g int, i int, votes bigint, seats bigint")
    got = defaultdict(dict)
    for r in mixing.apportion(frame, ["g"], [F.col("i")], "votes", "seats", "won").collect():
        got[r["g"]][r["i"]] = r["won"]
    for g, (votes, seats) in enumerate(groups):
        assert [got[g][i] for i in range(len(votes))] == brute.highest_quotients(votes, seats)


def test_mix_meets_targets(spark, table):
    extra = docs(spark, [(10_001, None, None), (10_002, "a b", None), (10_002, "a b", None), (10_003, "w " * 20_000, "big")])
    frame = table.select(*extra.columns).unionByName(extra)
    rows = mixing.mix(frame).collect()
    assert len(rows) == frame.count()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    expected = brute.targets([(s, sum(r["size"] for r in own)) for s, own in by.items()])
    for source, own in by.items():
        assert own[0]["target"] == pytest.approx(expected[source])
        assert abs(sum(r["taken"] for r in own) - expected[source]) <= 0.5
    again = mixing.mix(frame.repartition(5)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert mixing.mix(frame.where("doc_id < 0")).count() == 0


def test_small_and_uneven_sources_meet_targets(spark, monkeypatch):
    """Sources below a block, sources at their ceiling with shards of all sizes, and several bundles."""
    monkeypatch.setattr(mixing, "SHARD_DOCS", 3)
    monkeypatch.setattr(mixing, "BUNDLE", 4)
    rng = random.Random(8)
    rows = [(1, "w " * 25, "a"), (2, "w " * 25, "b"), (3, "w", "c"), (4, None, "d"), (5, "w " * 60_000, "e")]
    rows += [(i, "w " * rng.choice([0, 1, 3, 40, 900]), "e") for i in range(10, 130)]
    rows += [(i, "w " * rng.choice([2, 500]), "f") for i in range(130, 200)]
    got = mixing.mix(docs(spark, rows)).collect()
    by = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    for source, own in by.items():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5, source
    assert by["a"][0]["taken"] == by["b"][0]["taken"] == 50 and by["f"][0]["target"] == 2 * by["f"][0]["source_size"]


def test_repeated_rows_share_what_they_are_taken(spark):
    rows = [(1, "x " * 9 + "y", "a"), (1, "z " * 9 + "y", "a"), (1, "z " * 9 + "y", "a"), (2, "w " * 500, "b")]
    frame = docs(spark, rows)
    taken = sum(r["taken"] for r in mixing.mix(frame).where("doc_id = 1").collect())
    assert mixing.mixed(frame).where("doc_id = 1").count() * 10 == taken == 60


def test_mixed_rows(spark, table):
    frame = table.withColumn("size", F.lit("clash"))
    rows = mixing.mixed(frame)
    assert rows.columns == frame.columns
    times = {r["doc_id"]: r["n"] for r in rows.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in mixing.mix(table).collect():
        assert times.get(r["doc_id"], 0) == (int(r["taken"] / r["size"] + 0.5) if r["size"] else 0)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pack_is_whole_and_tight(spark, table, tokenizer):
    extra = docs(spark, [(10_001, None, "s"), (10_002, "", "s"), (10_003, "a b " * 4000, "s"), (10_003, "a b " * 4000, "s")])
    frame = table.select(*extra.columns).unionByName(extra)
    rows = packing.pack(frame).collect()
    expected = []
    for r in frame.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        expected += [(r["doc_id"], *p) for p in brute.pieces(ids)]
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == sorted(expected)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(p[3] for p in expected) // 1024)
    assert len(sequences) <= 1.02 * least + 1
    assert packing.pack(frame.where("doc_id < 0")).count() == 0


def test_few_open_bins_close_the_fullest():
    rng = random.Random(2)
    bins, fill = packing.Bins(100, 4), defaultdict(int)
    for _ in range(3000):
        length = rng.randrange(1, 100)
        sequence, offset = bins.place(length)
        assert offset == fill[sequence]
        fill[sequence] += length
        assert fill[sequence] <= 100 and bins.open <= 4
    assert sum(fill.values()) / (100 * len(fill)) > 0.8
