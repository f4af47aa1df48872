"""Merkle manifest of a table of documents: a tree per source, one over all sources, and a proof for every document.

Time-forward processing.  A node's label is its tree, level and index; a node may be computed when all its children have
sent their digests.  Digests travel upwards as messages that a priority queue hands out by label, so that a parent's
messages come together, in order.  A reversed sweep hands the siblings on the way to the root downwards to the leaves.

The queue is external: a table in the shared folder, dealt by block and sorted by Spark.  A block is the subtree over
``FANOUT ** LEVELS`` consecutive nodes.  In a task a heap of one block's messages does the block's levels, and what it
sends to the next block is a row of the next table.  So memory holds one block, no task holds a source, and a source with
a third of all rows is as many blocks as it fills.

Order of leaves: sources by name, null first; in them by id, null first, then by leaf.  Their places come from a range
partitioning and running sums over one row per partition and source.

A null field is ``-``.  Rows that repeat an id are leaves of their own; equal leaves are interchangeable.  Of an empty
table nothing comes out.  A table's other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstile.llm.meet import Streamed, meet
from turnstile.llm.text import LOWER, UPPER, scratch

FANOUT = 16
LEVELS = 2
BLOCK = FANOUT**LEVELS
#: Which documents are tampered with to try the proofs: those whose id's crc32 this divides.
TAMPER = 5


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a document with this text."""
    return F.sha2(F.concat(*(_field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))), 256)


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def numbered(rows: DataFrame, tree: str, order: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``index``, from 0 in each ``tree``, and ``nodes``, how many it has; and a row per tree with ``nodes``.

    Only sizes of runs, one per partition and tree at most, are brought together.
    """
    by = [F.col(tree).asc_nulls_first(), *order]
    # The last column deals equal rows over partitions too.
    sorted_rows = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*by, "_at")
    sorted_rows = sorted_rows.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch(sorted_rows, f"{name}-sorted")
    placed = placed.withColumn("_part", F.shiftrightunsigned("_at", 33))
    runs = placed.groupBy("_part", tree).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns(
        {"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "nodes": F.sum("_n").over(Window.partitionBy(tree))}
    )
    runs = scratch(runs.withColumnRenamed(tree, "_tree"), f"{name}-runs")
    same = (F.col("_part") == F.col("_run_part")) & F.col(tree).eqNullSafe(F.col("_tree"))
    joined = placed.join(runs.withColumnRenamed("_part", "_run_part"), same)
    index = F.col("_before") + F.col("_at") - F.col("_first")
    out = joined.select(*rows.columns, index.alias("index"), "nodes")
    return out, runs.select(F.col("_tree").alias(tree), "nodes").distinct()


class Block:
    """The subtree over some consecutive nodes: ``rounds`` levels, computed by a heap of messages in order of labels."""

    def __init__(self, first: int, digests: list[str], rounds: int):
        #: Messages are (level, index, digest): all children of a node stand next to each other.
        queue = [(0, first + i, d) for i, d in enumerate(digests)]
        heapq.heapify(queue)
        self.levels: list[dict[int, str]] = [{} for _ in range(rounds + 1)]
        while queue:
            level, index, found = heapq.heappop(queue)
            self.levels[level][index] = found
            if level < rounds:
                parent, children = index // FANOUT, [found]
                while queue and queue[0][0] == level and queue[0][1] // FANOUT == parent:
                    _, index, found = heapq.heappop(queue)
                    self.levels[level][index] = found
                    children.append(found)
                heapq.heappush(queue, (level + 1, parent, digest(children)))

    def steps(self, index: int) -> list[tuple[str, str]]:
        """From a node of the block to its root: the digests of the siblings on the left and on the right, joined."""
        out = []
        for nodes in self.levels[:-1]:
            run = index // FANOUT * FANOUT
            near = [(i, nodes[i]) for i in range(run, run + FANOUT) if i in nodes]
            out.append(("".join(d for i, d in near if i < index), "".join(d for i, d in near if i > index)))
            index //= FANOUT
        return out


def rounds_of(nodes: int) -> int:
    """Levels that a block does in a tree with so many nodes at its lowest level."""
    rounds = 0
    while nodes > 1 and rounds < LEVELS:
        nodes, rounds = -(-nodes // FANOUT), rounds + 1
    return rounds


def _up(_key: tuple, resident: pa.Table, _streamed: Streamed) -> Iterator[pa.RecordBatch]:
    first, nodes = resident.column("index")[0].as_py(), resident.column("nodes")[0].as_py()
    rounds = rounds_of(nodes)
    ((index, root),) = Block(first, resident.column("digest").to_pylist(), rounds).levels[-1].items()
    for _ in range(rounds):
        nodes = -(-nodes // FANOUT)
    kinds = {"tree": pa.int64(), "index": pa.int64(), "nodes": pa.int64(), "digest": pa.string()}
    values = resident.column("tree")[0].as_py(), index, nodes, root
    arrays = [pa.array([v], k) for v, k in zip(values, kinds.values())]
    yield pa.RecordBatch.from_arrays(arrays, names=list(kinds))


_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
STEPS = "array<struct<left:string,right:string>>"


def _down(_key: tuple, resident: pa.Table, streamed: Streamed) -> Iterator[pa.RecordBatch]:
    """Resident: a block's nodes.  Streamed: the one row of what leads from its root upwards."""
    above = [tuple(s.values()) for b in streamed for steps in b.column("steps").to_pylist() for s in steps]
    first, nodes = resident.column("index")[0].as_py(), resident.column("nodes")[0].as_py()
    block = Block(first, resident.column("digest").to_pylist(), rounds_of(nodes))
    indices = resident.column("index").to_pylist()
    paths = [[{"left": a, "right": b} for a, b in block.steps(i) + above] for i in indices]
    columns = [resident.column(c).combine_chunks() for c in ("tree", "index")]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(paths, _STEPS)], names=["tree", "index", "steps"])


def fold(start: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        start = digest([left, start, right])
    return start


def _prove(_key: tuple, resident: pa.Table, streamed: Streamed) -> Iterator[pa.RecordBatch]:
    """Like :func:`_down` for documents, whose proofs are used and hashed where they arrive."""
    above, subroot, root = [], None, None
    for b in streamed:
        for steps, subroot, root in zip(*(b.column(c).to_pylist() for c in ("steps", "subroot", "root"))):
            above = [tuple(s.values()) for s in steps]
    first, nodes = resident.column("index")[0].as_py(), resident.column("nodes")[0].as_py()
    leaves = resident.column("digest").to_pylist()
    block = Block(first, leaves, rounds_of(nodes))
    proofs, folded = [], []
    for i, tried in enumerate(resident.column("tried").to_pylist()):
        steps = block.steps(first + i) + above
        proofs.append(digest([part for step in steps for part in step]))
        folded.append(fold(tried, steps))
    n = len(leaves)
    ids, own = (resident.column(c).combine_chunks() for c in ("doc_id", "digest"))
    yield pa.RecordBatch.from_arrays(
        [ids, own, pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded),
         pa.array([f == root for f in folded])],
        names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    )


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("index") / BLOCK))


def sweep_up(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """``nodes`` (``tree``, ``index``, ``nodes``, ``digest``) and what each round sends on, and the ``root`` of each ``tree``."""
    tables, ddl = [nodes], "tree bigint, index bigint, nodes bigint, digest string"
    none = nodes.sparkSession.createDataFrame([], "tree bigint, block bigint")
    while (tables[-1].agg(F.max("nodes")).first()[0] or 0) > 1:
        sent = meet(_blocks(tables[-1]), none, ["tree", "block"], _up, ddl, ("index",))
        tables.append(scratch(sent, f"{name}-level"))
    return tables, tables[-1].select("tree", F.col("digest").alias("root"))


def sweep_down(tables: list[DataFrame], top: DataFrame, name: str) -> DataFrame:
    """What leads upwards from the blocks of the lowest table (``tree``, ``block``, ``steps``); ``top`` (``tree``,
    ``steps``) is what leads upwards from the trees' roots."""
    above, ddl = top.withColumn("block", F.lit(0).cast("bigint")), f"tree bigint, index bigint, steps {STEPS}"
    for nodes in reversed(tables[1:-1]):
        steps = meet(_blocks(nodes), above, ["tree", "block"], _down, ddl, ("index",))
        above = scratch(steps, f"{name}-steps").withColumnRenamed("index", "block")
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``folded_root`` is computed from the document as it is after tampering with some of them, and the untampered siblings.
    """
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % TAMPER == 0
    leaves = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        leaf(F.col("text")).alias("digest"),
        F.when(tampered, leaf(F.translate("text", UPPER, LOWER))).alias("_tried"),
    )
    leaves = scratch(leaves, "merkle-leaves").withColumn("tried", F.coalesce("_tried", "digest")).drop("_tried")
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()]
    placed, sources = numbered(leaves, "source", order, "merkle")
    # Sources are the leaves of one more tree; a source's index there is the number of its own tree.
    all_sources = sources.select("source", F.lit(0).cast("bigint").alias("tree"))
    ranked, _ = numbered(all_sources, "tree", [F.col("source").asc_nulls_first()], "merkle-sources")
    ranked = scratch(ranked, "merkle-ranked")
    names = ranked.select(F.col("source").alias("_source"), F.col("index").alias("tree"))
    base = placed.join(names, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    base = scratch(base, "merkle-base")
    tables, subroots = sweep_up(base.select("tree", "index", "nodes", "digest"), "merkle")
    own = subroots.select(F.col("tree").alias("index"), F.col("root").alias("digest"))
    tops = scratch(ranked.select("tree", "index", "nodes").join(own, "index"), "merkle-tops")
    top_tables, roots = sweep_up(tops, "merkle-top")
    nothing = roots.select("tree", F.array().cast(STEPS).alias("steps"))
    steps = meet(_blocks(tops), sweep_down(top_tables, nothing, "merkle-top"), ["tree", "block"], _down,
                 f"tree bigint, index bigint, steps {STEPS}", ("index",))
    starts = scratch(steps, "merkle-steps").select(F.col("index").alias("tree"), "steps")
    root = roots.first()
    arriving = sweep_down(tables, starts, "merkle").join(subroots.withColumnRenamed("root", "subroot"), "tree")
    arriving = arriving.withColumn("root", F.lit(root["root"] if root else None).cast("string"))
    ddl = (
        "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return meet(_blocks(base), arriving, ["tree", "block"], _prove, ddl, ("index",))
