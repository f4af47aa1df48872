"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Targets: sources in the order of their names (by code point, null last) weigh 5, 2, 1, repeating, and share ``SHARE`` of
all words; none gets more than ``REPEATS`` times its own, and what is above goes to the others by weight.  This is a
water level over the ratio of ceiling to weight, found with running sums over one row per source.

Quotas: the mix is a number of blocks of ``BLOCK_WORDS`` words.  Blocks go to the sources with the highest quotients
target / (2k - 1), then within a source in the same way to bundles of shards, and from a bundle to its shards, by their
words.  The total bounds each one's number of seats from both sides, so only the quotients between these bounds (about four
per party) are ranked, never all blocks.  At each step what blocks leave of the words to give out, more or less than a
block for each party, and what is above twice a party's words, is filled in or taken back party by party.  So each source's
words are its target to the word, however small it is.

Selection: a source's documents are dealt over shards of about ``SHARD_DOCS`` by a seeded digest of their id, and lie in a
shard in seeded order.  A quota takes the shard's words from the front, as often as it goes around; the last document may
be taken in part.  The seed decides, so reruns agree.  Only ids and sizes are shuffled, never texts.  What meets in one task
is the documents of a shard, the shards of a bundle (``BUNDLE``), or the bundles of a source: one for ``SHARD_DOCS`` times
``BUNDLE`` documents.

Null texts have no words and are taken 0 times; a null source is a source.  Repeated rows are documents of their own.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstile.llm.text import n_words, scratch, whole_text

WEIGHTS = (5, 2, 1)
#: All targets together: so many halves of all words.
SHARE_HALVES = 3
REPEATS = 2
BLOCK_WORDS = 128
SHARD_DOCS = 1_000
BUNDLE = 1_000
SEED = "mix-1"


def targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size`` and ``target`` per source; ``sizes`` has one row per source (``source``, ``source_size``)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(w) for w in WEIGHTS))
    ranked = sizes.select(
        "source",
        "source_size",
        F.get(weights, (F.row_number().over(by_name) - 1) % len(WEIGHTS)).cast("long").alias("weight"),
        F.sum("source_size").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    ceiling = REPEATS * F.col("source_size")
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ranked.select(
        "*",
        (SHARE_HALVES * F.col("total") - 2 * F.coalesce(F.sum(ceiling).over(before), F.lit(0))).alias("left2"),
        F.sum("weight").over(rest).alias("weights_left"),
    )
    # In order of ceiling by weight, sources reach their ceiling until one does not; from there on all share alike.
    reached = ceiling * 2 * F.col("weights_left") <= F.col("weight") * F.col("left2")
    first_free = F.min(F.when(~F.col("reached"), F.struct("place", "left2", "weights_left"))).over(
        Window.partitionBy(F.lit(0))
    )
    marked = level.select(
        "*", reached.alias("reached"), F.row_number().over(full).alias("place")
    ).withColumn("free", first_free)
    shared = F.col("weight") * F.col("free.left2") / (2 * F.col("free.weights_left"))
    return marked.select(
        "source",
        "source_size",
        F.when(F.col("place") < F.coalesce(F.col("free.place"), F.col("place") + 1), ceiling.cast("double"))
        .otherwise(shared)
        .alias("target"),
    )


def apportion(parties: DataFrame, group: list[str], party: list[Column], votes: str, seats: str, out: str) -> DataFrame:
    """``parties`` with ``out``: of the group's ``seats``, those that go to the party with ``votes``.

    Seats go to the highest quotients votes / (2k - 1), ties to the first party.  With n parties and the group's votes per
    seat q, a party of share s has between votes / q - (s n + 1) / 2 and votes / q + (s n + 1) / 2 seats, rounded.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    base = parties.withColumns({"_llm_votes": F.sum(votes).over(whole), "_llm_n": F.count("*").over(whole)})
    share = F.when(F.col("_llm_votes") > 0, F.col(votes) / F.col("_llm_votes")).otherwise(0.0)
    middle, slack = share * F.col(seats) + 0.5, share * F.col("_llm_n") / 2
    base = base.withColumns(
        {
            "_llm_low": F.greatest(F.floor(middle - slack) - 1, F.lit(0)).cast("long"),
            "_llm_high": (F.floor(middle + slack) + 1).cast("long"),
        }
    )
    base = base.withColumn("_llm_open", F.col(seats) - F.sum("_llm_low").over(whole))
    quotients = base.withColumn(
        "_llm_k",
        F.explode_outer(F.when(F.col(votes) > 0, F.sequence(F.col("_llm_low") + 1, F.col("_llm_high")))),
    )
    quotient = F.col(votes) / (2 * F.col("_llm_k") - 1)
    ranked = quotients.withColumn(
        "_llm_rank", F.row_number().over(whole.orderBy(F.desc_nulls_last(quotient), *party, "_llm_k"))
    )
    won = F.count_if(F.col("_llm_k").isNotNull() & (F.col("_llm_rank") <= F.col("_llm_open")))
    kept = [c for c in parties.columns]
    return ranked.groupBy(*kept).agg((F.first("_llm_low") + won).cast("long").alias(out))


def allot(parties: DataFrame, group: list[str], party: str, size: str, blocks: str, words: str, out: str) -> DataFrame:
    """``parties`` with ``out``: of the group's ``words``, what goes to the party, in proportion to its ``size``.

    ``blocks`` of them by apportionment, none above ``REPEATS`` times its size; the difference party by party.
    """
    dealt = apportion(parties, group, [F.col(party)], size, blocks, "_llm_won")
    whole = Window.partitionBy(*group)
    before = whole.orderBy(party).rowsBetween(Window.unboundedPreceding, -1)
    most = REPEATS * F.col(size)
    dealt = dealt.withColumn("_llm_cut", F.least(F.col("_llm_won") * BLOCK_WORDS, most))
    dealt = dealt.withColumn("_llm_rest", F.col(words) - F.sum("_llm_cut").over(whole))
    dealt = dealt.withColumn("_llm_room", F.when(F.col("_llm_rest") > 0, most - F.col("_llm_cut")).otherwise(F.col("_llm_cut")))
    left = F.abs("_llm_rest") - F.coalesce(F.sum("_llm_room").over(before), F.lit(0))
    change = F.signum("_llm_rest").cast("long") * F.least(F.col("_llm_room"), F.greatest(left, F.lit(0)))
    return dealt.select(*parties.columns, (F.col("_llm_cut") + change).cast("long").alias(out))


def _digest(key: Column) -> Column:
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(key.cast("string"), F.lit("null"))))


def mix(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and the words ``taken``."""
    sized = scratch(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            n_words(whole_text()).alias("size"),
        ),
        "sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    wanted = targets(sources.select("source", "source_size"))
    wanted = wanted.withColumn(
        "blocks",
        F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / BLOCK_WORDS).cast("long"),
    )
    quotas = apportion(wanted, [], [F.col("source").asc_nulls_last()], "target", "blocks", "source_blocks")
    counted = sources.select(F.col("source").alias("_llm_s"), F.ceil(F.col("n_docs") / SHARD_DOCS).alias("n_shards"))
    plan = scratch(
        quotas.join(counted, F.col("source").eqNullSafe(F.col("_llm_s"))).drop("_llm_s", "blocks"), "mix-sources"
    )
    digest = _digest(F.col("doc_id"))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    known = plan.select(F.col("source").alias("_llm_s"), "n_shards", "source_size", "target")
    dealt = sized.join(known, F.col("source").eqNullSafe(F.col("_llm_s"))).select(
        "doc_id", "source", "size", "source_size", "target", (place % F.col("n_shards")).alias("shard"), digest.alias("at")
    )
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    shards = scratch(shards.withColumn("bundle", F.floor(F.col("shard") / BUNDLE)), "mix-sizes")
    bundles = shards.groupBy("source", "bundle").agg(F.sum("shard_size").alias("bundle_size"))
    quota = plan.select(F.col("source").alias("_llm_s"), "source_blocks", F.round("target").cast("long").alias("source_words"))
    bundles = bundles.join(quota, F.col("source").eqNullSafe(F.col("_llm_s"))).drop("_llm_s")
    bundles = allot(bundles, ["source"], "bundle", "bundle_size", "source_blocks", "source_words", "bundle_words")
    quota = bundles.select(
        F.col("source").alias("_llm_s"),
        F.col("bundle").alias("_llm_b"),
        "bundle_words",
        F.round(F.col("bundle_words") / BLOCK_WORDS).cast("long").alias("bundle_blocks"),
    )
    of_bundle = F.col("source").eqNullSafe(F.col("_llm_s")) & (F.col("bundle") == F.col("_llm_b"))
    shards = shards.join(quota, of_bundle).drop("_llm_s", "_llm_b")
    shards = allot(shards, ["source", "bundle"], "shard", "shard_size", "bundle_blocks", "bundle_words", "words")
    return _select(dealt, scratch(shards.select("source", "shard", "shard_size", "words"), "mix-shards"))


def _select(dealt: DataFrame, shards: DataFrame) -> DataFrame:
    quota = shards.select(F.col("source").alias("_llm_s"), F.col("shard").alias("_llm_h"), "shard_size", "words")
    joined = dealt.join(quota, F.col("source").eqNullSafe(F.col("_llm_s")) & (F.col("shard") == F.col("_llm_h")))
    order = Window.partitionBy("source", "shard").orderBy("at", "doc_id", "size")
    ends = joined.withColumn("ends", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(F.lit(0))
    more = F.col("words") - F.col("rounds") * F.col("shard_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("more") - (F.col("ends") - F.col("size"))))
    return (
        ends.withColumn("rounds", rounds.cast("long"))
        .withColumn("more", more)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"),
        )
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as rows: each row of ``docs`` as often as its words are taken, to the nearest whole number of times.

    Rows that agree in id, source and size share what they are taken together, the first by the digest of their text more.
    """
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    plan = mix(docs).select(F.col("doc_id").alias("_llm_id"), F.col("source").alias("_llm_s"), "size", times.alias("_llm_n"))
    return _repeat(docs, plan)


def _repeat(docs: DataFrame, plan: DataFrame) -> DataFrame:
    per_id = plan.groupBy("_llm_id", "_llm_s", F.col("size").alias("_llm_z")).agg(
        F.sum("_llm_n").cast("int").alias("_llm_n"), F.count("*").alias("_llm_rows")
    )
    per_id = scratch(per_id.where("_llm_n > 0"), "mix-times")
    # One row per document: it never goes through the driver.
    per_id = per_id.hint("merge")
    sized = docs.withColumn("_llm_size", n_words(whole_text()))
    same = (
        F.col("doc_id").cast("bigint").eqNullSafe(F.col("_llm_id"))
        & F.col("source").cast("string").eqNullSafe(F.col("_llm_s"))
        & (F.col("_llm_size") == F.col("_llm_z"))
    )
    rows = sized.join(per_id.where("_llm_rows = 1"), same)
    if not per_id.where("_llm_rows > 1").isEmpty():
        again = sized.join(per_id.where("_llm_rows > 1"), same)
        key = Window.partitionBy("_llm_id", "_llm_s", "_llm_z").orderBy(F.xxhash64("text"))
        shared = F.floor((F.col("_llm_n") - F.row_number().over(key)) / F.col("_llm_rows")) + 1
        rows = rows.unionAll(again.withColumn("_llm_n", shared.cast("int")))
    rows = rows.where("_llm_n > 0").withColumn("_llm_copy", F.explode(F.sequence(F.lit(1), F.col("_llm_n"))))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
