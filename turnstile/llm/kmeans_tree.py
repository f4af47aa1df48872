"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on at most ``FIT_ROWS`` vectors, those with the smallest digests; every vector is then put into the leaf
that it reaches from the root by the nearest centre.  A query keeps a priority queue of branches by the inner product with
their centres and takes the best one until it has visited enough leaves.  How many are enough is calibrated: of
``CALIBRATION`` query vectors the true neighbours among all rows are found, and the visits widened until ``RECALL`` of
them are in visited leaves.

Equal vectors are searched once.  Each distinct vector carries its ``KEEP`` smallest ids, all that a list of neighbours can
show, so a vector that a third of all rows have is one row; queries with it share one search.

Leaves are dealt in blocks of about ``BLOCK`` rows, neighbouring leaves together, a leaf beyond that over several blocks.  A
task holds one block and the queries that visit it stream past.  The tree has at most ``MAX_LEAVES`` leaves and is sent to
all executors; nothing else that grows is.

Rows without an id, and vectors that are null, zero or hold null or non-finite components take no part.  Shorter vectors end
in zeros.  Scores are inner products in double precision, added up in one order.  Ties go to the smaller id.  Rows that
repeat an id are candidates of their own, and a query leaves out itself once.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from turnstile.llm.meet import Streamed, meet
from turnstile.llm.text import scratch
from turnstile.llm.vectors import dimension, finite, matrix

NEIGHBOURS = 20
#: One more: a query finds itself too.
KEEP = NEIGHBOURS + 1
FIT_ROWS = 20_000
FANOUT = 8
LEAF_ROWS = 256
MAX_LEAVES = 2_048
ITERATIONS = 12
CALIBRATION = 256
RECALL = 0.96
BLOCK = 8_192
#: Queries that meet a leaf at a time.
SLICE = 512
#: More candidates than are kept, so that rounding decides nothing before scores are added up exactly.
SPARE = 8
SEED = 12


def _nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)


def k_means(rows: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres that have rows, and each row's centre."""
    centres = rows[rng.choice(len(rows), size=min(k, len(rows)), replace=False)]
    for _ in range(ITERATIONS):
        at = _nearest_centre(rows, centres)
        used = np.unique(at)
        centres = np.stack([rows[at == i].mean(0) for i in used])
    return centres, _nearest_centre(rows, centres)


class Tree:
    """Centres by node, children by node; a node without children is a leaf and has a number."""

    def __init__(self, rows: np.ndarray, n_rows: int):
        self.centres, self.children, self.leaf = [], [], []
        self.leaves = 0
        per_sample = max(n_rows / max(len(rows), 1), 1)
        rng = np.random.default_rng(SEED)
        smallest = max(LEAF_ROWS / per_sample, len(rows) * FANOUT / MAX_LEAVES, 2 * FANOUT)
        self._grow(rows, np.zeros(rows.shape[1]) if not len(rows) else rows.mean(0), smallest, rng)
        self.centres = np.stack(self.centres)

    def _grow(self, rows: np.ndarray, centre: np.ndarray, smallest: float, rng: np.random.Generator) -> int:
        node = len(self.centres)
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        if len(rows) > smallest:
            centres, at = k_means(rows, FANOUT, rng)
            parts = [(c, rows[at == i]) for i, c in enumerate(centres)]
            if max(len(r) for _, r in parts) < len(rows):
                self.children[node] = [self._grow(r, c, smallest, rng) for c, r in parts if len(r)]
                return node
        self.leaf[node], self.leaves = self.leaves, self.leaves + 1
        return node

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.empty(len(rows), dtype=np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            children = self.children[node]
            if not children:
                out[at] = self.leaf[node]
                continue
            chosen = _nearest_centre(rows[at], self.centres[children])
            todo += [(child, at[chosen == i]) for i, child in enumerate(children)]
        return out

    def visits(self, queries: np.ndarray, leaves: int) -> Iterator[list[int]]:
        """Per query, the leaves to visit, best first."""
        for near in queries @ self.centres.T:
            queue, found = [(-near[0], 0)], []
            while queue and len(found) < leaves:
                node = heapq.heappop(queue)[1]
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(queue, (-near[child], child))
                else:
                    found.append(self.leaf[node])
            yield found


def _put(tree, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = pa.array(tree.value.assign(matrix(batch.column("v"), d)))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaf], names=[*batch.schema.names, "leaf"])

    return run


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (rows * query).sum(-1)


def _truth(queries: np.ndarray, d: int):
    """The task's best rows for each of a few queries, with their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, leaf = np.empty((len(queries), 0)), np.empty((len(queries), 0), dtype=np.int64)
        for batch in batches:
            near = queries @ matrix(batch.column("v"), d).T
            score = np.hstack([score, near])
            leaf = np.hstack([leaf, np.broadcast_to(batch.column("leaf").to_numpy(), near.shape)])
            if score.shape[1] > KEEP:
                best = np.argpartition(-score, KEEP - 1, axis=1)[:, :KEEP]
                score, leaf = np.take_along_axis(score, best, 1), np.take_along_axis(leaf, best, 1)
        of = np.repeat(np.arange(len(queries)), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(score.ravel()), pa.array(leaf.ravel())], names=["q", "score", "leaf"])

    return run


def calibrated(placed: DataFrame, queries: np.ndarray, tree: Tree, d: int) -> int:
    """How many leaves to visit, from the true neighbours of ``queries`` (bounded) among all rows."""
    if not len(queries):
        return 1
    best = Window.partitionBy("q").orderBy(F.desc("score"), "leaf")
    near = placed.mapInArrow(_truth(queries, d), "q bigint, score double, leaf bigint")
    near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= KEEP)
    orders = [{leaf: i for i, leaf in enumerate(order)} for order in tree.visits(queries, tree.leaves)]
    seen = np.zeros(tree.leaves, dtype=np.int64)
    for row in near.select("q", "leaf").collect():
        seen[orders[row["q"]][row["leaf"]]] += 1
    found = np.cumsum(seen) / max(seen.sum(), 1)
    return int(np.searchsorted(found, RECALL) + 1)


def layout(counts: dict[int, int], leaves: int) -> list[tuple[int, int, int]]:
    """(leaf, first block, blocks): small leaves share a block with their neighbours, large ones have several."""
    out, block, filled = [], 0, 0
    for leaf in range(leaves):
        rows = counts.get(leaf, 0)
        if filled and filled + rows > BLOCK:
            block, filled = block + 1, 0
        blocks = max(1, -(-rows // BLOCK))
        out.append((leaf, block, blocks))
        filled += rows
        if blocks > 1:
            block, filled = block + blocks, 0
    return out


def _visit(tree, leaves: int, blocks: dict[int, tuple[int, int]], d: int):
    """A row per query and block that it visits, with the leaves to look at there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, looked = [], [], []
            for i, order in enumerate(tree.value.visits(matrix(batch.column("v"), d), leaves)):
                by: dict[int, list[int]] = {}
                for leaf in order:
                    first, n = blocks[leaf]
                    for block in range(first, first + n):
                        by.setdefault(block, []).append(leaf)
                rows += [i] * len(by)
                at += by.keys()
                looked += by.values()
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column("at"), taken.column("v"), pa.array(at, pa.int64()), pa.array(looked, pa.list_(pa.int64()))],
                names=["query", "query_v", "block", "leaves"],
            )

    return run


FOUND = "query bigint, score double, vec_id bigint, at bigint"


def _search(d: int):
    def run(_key: tuple, resident: pa.Table, streamed: Streamed) -> Iterator[pa.RecordBatch]:
        rows, own = matrix(resident.column("v"), d), resident.column("at").to_numpy()
        ids = resident.column("ids").combine_chunks()
        id_values, id_at = ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.diff(ids.offsets.to_numpy()))))
        of_leaf = resident.column("leaf").to_numpy()
        members = {leaf: np.nonzero(of_leaf == leaf)[0] for leaf in np.unique(of_leaf).tolist()}
        for batch in streamed:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                queries, names = matrix(part.column("query_v"), d), part.column("query").to_numpy()
                yield from _found(queries, names, part.column("leaves").to_pylist(), rows, own, id_values, id_at, members)

    return run


def _best(order_by: tuple[np.ndarray, ...], group: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group."""
    order = np.lexsort((*order_by[::-1], group))
    sorted_group = group[order]
    starts = np.concatenate(([True], sorted_group[1:] != sorted_group[:-1])) if len(order) else np.zeros(0, dtype=bool)
    first = np.nonzero(starts)[0]
    within = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[within < most]


def _found(queries, names, looked, rows, own, id_values, id_at, members) -> Iterator[pa.RecordBatch]:
    by_leaf: dict[int, list[int]] = {}
    for i, leaves in enumerate(looked):
        for leaf in leaves:
            by_leaf.setdefault(leaf, []).append(i)
    of, row, score = [], [], []
    for leaf, asking in by_leaf.items():
        if leaf not in members:
            continue
        here, near = members[leaf], queries[asking] @ rows[members[leaf]].T
        most = min(KEEP + SPARE, len(here))
        best = np.argpartition(-near, most - 1, axis=1)[:, :most]
        of.append(np.repeat(asking, most))
        row.append(here[best].ravel())
        score.append(np.take_along_axis(near, best, 1).ravel())
    if not of:
        return
    of, row, score = np.concatenate(of), np.concatenate(row), np.concatenate(score)
    chosen = _best((-score,), of, KEEP + SPARE)
    of, row = of[chosen], row[chosen]
    score = exact(rows[row], queries[of])
    copies = id_at[row + 1] - id_at[row]
    within = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    vec_id = id_values[np.repeat(id_at[row], copies) + within]
    of, row, score = (np.repeat(x, copies) for x in (of, row, score))
    chosen = _best((-score, vec_id), of, KEEP)
    columns = (names[of[chosen]], score[chosen], vec_id[chosen], own[row[chosen]])
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "score", "vec_id", "at"])


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``at``, ``v`` and ``ids``, the smallest ``KEEP`` ids, of each distinct vector of ``rows`` (``vec_id``, ``v``)."""
    # A vector with very many ids is cut in parts, before the shuffle and after it, before its ids come together.
    salted = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(8))).orderBy("vec_id")
    first = rows.withColumn("_rank", F.row_number().over(salted)).where(F.col("_rank") <= KEEP)
    ids = F.slice(F.array_sort(F.collect_list("vec_id")), 1, KEEP).alias("ids")
    return scratch(first.groupBy("v").agg(ids).withColumn("at", F.monotonically_increasing_id()), "vectors")


def _sample(vectors: DataFrame, rows: int, d: int) -> np.ndarray:
    """At most ``rows`` vectors, those with the smallest digests."""
    taken = vectors.select("v").orderBy(F.xxhash64("v", F.lit(SEED)), "v").limit(rows).collect()
    out = np.zeros((len(taken), d))
    for i, row in enumerate(taken):
        out[i, : len(row["v"])] = row["v"]
    return out


def nearest(table: DataFrame, is_query: Column, vector: str = "embedding") -> DataFrame:
    """The nearest rows found for the rows of ``table`` that ``is_query`` tells (an expression over its columns).

    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; at most ``NEIGHBOURS`` per query.
    """
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    vectors = distinct_vectors(rows.select("vec_id", "v"))
    queries = scratch(rows.where("asks").select(F.col("vec_id").alias("query_id"), "v").join(vectors.select("at", "v"), "v"), "queries")
    d, context = dimension(vectors), table.sparkSession.sparkContext
    tree = Tree(_sample(vectors, FIT_ROWS, d), vectors.count())
    shared = context.broadcast(tree)
    placed = scratch(vectors.mapInArrow(_put(shared, d), T.StructType([*vectors.schema, T.StructField("leaf", T.LongType())])), "placed")
    asking = queries.groupBy("at").agg(F.first("v").alias("v"))
    visited = calibrated(placed, _sample(asking, CALIBRATION, d), tree, d)
    counts = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
    plan = layout(counts, tree.leaves)
    blocks = table.sparkSession.createDataFrame(plan, "leaf bigint, first bigint, blocks bigint")
    block = F.col("first") + F.pmod(F.xxhash64("at"), F.col("blocks"))
    resident = placed.join(F.broadcast(blocks), "leaf").select("at", "v", "ids", "leaf", block.alias("block"))
    ddl = f"query bigint, query_v {dict(vectors.dtypes)['v']}, block bigint, leaves array<bigint>"
    visits = asking.mapInArrow(_visit(shared, visited, {leaf: (first, n) for leaf, first, n in plan}, d), ddl)
    found = meet(resident, visits, ["block"], _search(d), FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "at")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= KEEP)
    near = ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "at"))).alias("near"))
    met = queries.join(near, F.col("at") == F.col("query"))
    is_own = F.transform("near", lambda x: (x["vec_id"] == F.col("query_id")) & (x["at"] == F.col("query")))
    own = F.array_position(is_own, F.lit(True))
    others = F.filter("near", lambda _, i: i + 1 != own)
    listed = met.select("query_id", F.posexplode(F.slice(others, 1, NEIGHBOURS)).alias("i", "x"))
    return listed.select(
        "query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
