"""Near-duplicate groups by SimHash, found in an embedding of segment bit counts.

A fingerprint of 64 bits is cut into 32 segments of two bits, and each segment is mapped to the number of its set bits.
Written as a thermometer (0, 1 or 2 ones), these counts make another 64-bit word, ``counts``, in which the Manhattan
distance of two count vectors is the number of differing bits.  Flipping one fingerprint bit changes one count by one,
so that distance is never more than the Hamming distance.

The join is a range join on a grid over those vectors.  The segments fall into ``GROUPS`` groups; two vectors at
distance 4 or less agree exactly in all groups but four, so they share the grid cell of some choice of the remaining
ones.  Each distinct fingerprint goes to the cell of every such choice, an equi-join that Spark can split where a cell
is crowded.  In a cell, pairs must pass the Manhattan bound, then the exact Hamming distance; a pair that shares several
cells is taken in the first.  Copies never meet: only distinct fingerprints are joined.

Null and empty texts have fingerprint zero and link like any other.  Repeated rows keep their rows and share a component.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from turnstile.llm.components import components
from turnstile.llm.text import scratch

SHINGLE_WORDS = 4
SEED = 42
DISTANCE = 4
GROUPS = 7
SEGMENTS = 32
LOW_BITS = 0x5555555555555555
#: Texts of one record batch are cut where their characters reach this, to bound the memory of hashing.
SLICE = 1 << 18


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def group_masks(groups: int = GROUPS) -> list[int]:
    """Per group the bits of its segments, as a signed long."""
    cuts = [SEGMENTS * g // groups for g in range(groups + 1)]
    return [_signed(sum(3 << (2 * s) for s in range(a, b))) for a, b in zip(cuts, cuts[1:])]


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's shingles."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    k = min(words, len(found))
    starts, stops = (ends - lengths)[: len(found) - k + 1], ends[k - 1 :]
    total = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SLICE):
        pairs = zip(starts[at : at + SLICE].tolist(), stops[at : at + SLICE].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py()) for t in batch.column("_llm_text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) per row."""
    slim = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("_llm_text"))
    return slim.mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def counts(fp: Column) -> Column:
    """The segment counts of a fingerprint as thermometers of two bits."""
    low, high = F.lit(LOW_BITS), F.shiftrightunsigned(fp, 1)
    any_bit = fp.bitwiseOR(high).bitwiseAND(low)
    both = fp.bitwiseAND(high).bitwiseAND(low)
    return any_bit.bitwiseOR(F.shiftleft(both, 1))


def links(prints: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Pairs (``a``, ``b``) of distinct fingerprints at ``DISTANCE`` or less, each once.

    ``prints`` has one column ``fp`` of distinct values.
    """
    masks, chosen = group_masks(groups), list(combinations(range(groups), groups - DISTANCE))
    kept = [_signed(sum(masks[g] & (2**64 - 1) for g in c)) for c in chosen]
    passed = [sum(1 << g for g in range(max(c)) if g not in c) for c in chosen]
    places = [
        F.struct(F.lit(cell).cast("int").alias("cell"), F.col("counts").bitwiseAND(F.lit(mask)).alias("at"))
        for cell, mask in enumerate(kept)
    ]
    # Both sides are one table, shuffled once: a row is no more than its cell and its fingerprint.  It is many times what
    # Spark takes it for, so it must not go through the driver.
    cells = prints.select("fp", counts(F.col("fp")).alias("counts")).select("fp", F.inline(F.array(*places)))
    met = cells.alias("a").join(cells.alias("b").hint("merge"), ["cell", "at"]).where("a.fp < b.fp")
    met = met.select("cell", F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    apart = counts(F.col("a")).bitwiseXOR(counts(F.col("b")))
    agree = F.lit(0)
    for g, m in enumerate(masks):
        agree = agree + F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(1 << g)).otherwise(F.lit(0))
    near = (
        (F.bit_count(apart) <= DISTANCE)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
        & (agree.bitwiseAND(F.get(F.array(*map(F.lit, passed)), F.col("cell"))) == 0)
    )
    return met.where(near).select("a", "b")


def grouped(prints: DataFrame) -> DataFrame:
    """Per distinct fingerprint of ``prints`` (``doc_id``, ``fp``) the smallest id that it can reach."""
    distinct = scratch(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    pairs = links(distinct.select("fp"))
    left, right = (
        distinct.select(F.col("fp").alias(c), F.col("first_id").alias(f"{c}_id")) for c in ("a", "b")
    )
    edges = pairs.join(left, "a").join(right, "b").select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
    labels = components(edges).select(F.col("node").alias("first_id"), F.col("component").alias("_llm_least"))
    named = distinct.join(labels, "first_id", "left")
    return named.select("fp", F.coalesce("_llm_least", "first_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` per row."""
    prints = scratch(fingerprints(docs), "prints")
    joined = prints.join(grouped(prints), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
