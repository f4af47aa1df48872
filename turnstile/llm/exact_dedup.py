"""Exact duplicates by sorting contents.

Texts are normalised (each run of white space becomes one space) and range-partitioned by splitters that Spark samples.
A splitter is the text's first characters, its digest and the row's id: its size is bounded however long texts are, and
a text with any number of copies is dealt over as many partitions as its copies fill.  Spark's external sort then puts
equal texts next to each other, and a pass over each partition compares every text with its neighbour in full.  Only the
first and the last group of a partition can go on in another one: of these, one row each meets in a join on the text.

Null counts as empty, so null and empty texts are one group.  Of rows that repeat an id, each is a row of its own; the
one that stays is the first.  Null ids sort last.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from turnstile.llm.text import SPACE, scratch, whole_text

SPLITTER_CHARS = 24
OUT = "keep_id bigint, group_size bigint, is_first boolean, text_sha256 string, edge bigint, edge_text string"


def content_sorted(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` and its normalised text in ``_llm_norm``, equal texts adjacent, by id within them.

    The exchange carries the text as it came, once; it is normalised again behind the exchange.
    """
    norm = F.regexp_replace(whole_text(text), SPACE + "+", " ")
    tagged = docs.withColumns({"_llm_start": F.substring(norm, 1, SPLITTER_CHARS), "_llm_digest": F.unhex(F.sha2(norm, 256))})
    last = F.col(key).asc_nulls_last()
    dealt = tagged.repartitionByRange("_llm_start", "_llm_digest", last)
    return dealt.withColumn("_llm_norm", norm).sortWithinPartitions(
        "_llm_start", "_llm_digest", "_llm_norm", last
    )


def _groups(batch: pa.RecordBatch) -> np.ndarray:
    """Where a text differs from the one before; the first row starts a group."""
    norm = batch.column("_llm_norm")
    n = len(norm)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    differs = pc.not_equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.nonzero(differs)[0] + 1))


def _mark(carry: list[str], key: str, only_first: bool):
    """The pass over one sorted partition.  Held back: the ids of the last group and its first text."""

    def rows_out(parts, keep_id, size, sha, edge, text, first):
        for part in parts:
            n = part.num_rows
            head = np.zeros(n, dtype=bool)
            head[0] = first
            columns = [part.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns,
                    pa.array([keep_id] * n, pa.int64()),
                    pa.array([size] * n, pa.int64()),
                    pa.array(head),
                    pa.array([sha] * n, pa.string()),
                    pa.array([edge] * n, pa.int64()),
                    pa.array([text if first else None] + [None] * (n - 1), pa.string()),
                ],
                names=[*carry, "keep_id", "group_size", "is_first", "text_sha256", "edge", "edge_text"],
            )
            first = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        held_text, held_size, held_key, closed = None, 0, None, 0

        def close(edge):
            sha = hashlib.sha256(held_text.encode()).hexdigest()
            return rows_out(held, held_key, held_size, sha, edge, held_text if edge is not None else None, True)

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _groups(batch)
            norm, keys = batch.column("_llm_norm"), batch.column(key)
            slim = batch.select(carry)
            ends = np.append(starts[1:], batch.num_rows)
            at = 0
            if held and norm[0].as_py() == held_text:
                held_size += int(ends[0])
                if not only_first:
                    held.append(slim.slice(0, int(ends[0])))
                at = 1
            if at == len(starts):
                continue
            if held:
                yield from close(2 * part_id if not closed else None)
                closed += 1
            first, last = starts[at:-1], starts[-1]
            if len(first):
                if not closed:  # the partition's first group, whole in this batch
                    held = [slim.slice(int(first[0]), 1 if only_first else int(ends[at] - first[0]))]
                    held_text, held_size = norm[int(first[0])].as_py(), int(ends[at] - first[0])
                    held_key = keys[int(first[0])].as_py()
                    yield from close(2 * part_id)
                    closed += 1
                    first, at = first[1:], at + 1
                if len(first):
                    yield _whole(slim, norm, keys, first, ends[at:-1], carry, only_first)
                    closed += len(first)
            held = [slim.slice(int(last), 1 if only_first else batch.num_rows - int(last))]
            held_text, held_size = norm[int(last)].as_py(), batch.num_rows - int(last)
            held_key = keys[int(last)].as_py()
        if held:
            yield from close(2 * part_id + (1 if closed else 0))

    return run


def _whole(slim, norm, keys, starts, ends, carry, only_first) -> pa.RecordBatch:
    """Groups that begin and end within one batch, in one go."""
    sizes = ends - starts
    sha = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in norm.take(pa.array(starts))]
    if only_first:
        rows, group = starts, np.arange(len(starts))
        head = np.ones(len(starts), dtype=bool)
    else:
        rows, group = np.arange(starts[0], ends[-1]), np.repeat(np.arange(len(starts)), sizes)
        head = np.isin(rows, starts)
    taken = slim.take(pa.array(rows))
    n, of = len(rows), pa.array(group)
    return pa.RecordBatch.from_arrays(
        [
            *(taken.column(c) for c in carry),
            keys.take(pa.array(starts)).take(of),
            pa.array(sizes[group], pa.int64()),
            pa.array(head),
            pa.array(sha, pa.string()).take(of),
            pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.string()),
        ],
        names=[*carry, "keep_id", "group_size", "is_first", "text_sha256", "edge", "edge_text"],
    )


def grouped(docs: DataFrame, only_first: bool, carry: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``carry`` of each row (or of each group's first row), then ``keep_id``, ``group_size``, ``text_sha256``, ``kept``.

    The carried columns are called ``_llm_c0``, ``_llm_c1`` and so on, whatever their names in ``docs``.
    """
    own = {f"_llm_c{i}": c for i, c in enumerate(carry)}
    whole = next((alias for alias, c in own.items() if c == text), "_llm_text")
    base = docs.select(
        *(F.col(f"`{c}`").alias(alias) for alias, c in own.items()),
        F.col(key).cast("bigint").alias("_llm_key"),
        *([F.col(text).alias(whole)] if whole not in own else []),
    )
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    wide = content_sorted(base, whole, "_llm_key").select(*own, "_llm_key", "_llm_norm")
    ddl = ", ".join([*(f"{c} {kinds[c]}" for c in own), OUT])
    marked = scratch(wide.mapInArrow(_mark([*own], "_llm_key", only_first), ddl), "content-sort")
    ends = marked.where("edge_text is not null")
    met = ends.groupBy(F.col("edge_text").alias("_llm_t")).agg(
        F.min("keep_id").alias("_llm_keep"), F.sum("group_size").alias("_llm_size"), F.min("edge").alias("_llm_edge")
    )
    pieces = ends.select("edge_text", F.col("edge").alias("_llm_at")).join(met, F.col("edge_text") == F.col("_llm_t"))
    pieces = pieces.select("_llm_at", "_llm_keep", "_llm_size", "_llm_edge")
    inner = marked.where("edge is null").select(
        *own, "keep_id", "group_size", "text_sha256", F.col("is_first").alias("kept")
    )
    outer = marked.where("edge is not null").join(pieces, F.col("edge") == F.col("_llm_at"))
    outer = outer.select(
        *own,
        F.col("_llm_keep").alias("keep_id"),
        F.col("_llm_size").alias("group_size"),
        "text_sha256",
        (F.col("is_first") & (F.col("edge") == F.col("_llm_edge"))).alias("kept"),
    )
    return inner.unionAll(outer)


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its id, the id that stays for its text, the group's size, the text's digest."""
    marked = grouped(docs, only_first=False, carry=["doc_id"])
    return marked.withColumnRenamed("_llm_c0", "doc_id")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The first row of each distinct text, with its columns."""
    kept = grouped(docs, only_first=True, carry=docs.columns).where("kept")
    return kept.select(*(F.col(f"_llm_c{i}").alias(c) for i, c in enumerate(docs.columns)))
