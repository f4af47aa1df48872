"""Hard negatives for anchors, by exact integer inner products over blocks with zone maps.

Rows are ordered by label and by the place of their vector on a Hilbert curve through the dimensions that vary most, and
written as a Parquet table of blocks of ``BLOCK`` rows.  Each run of ``ZONE`` rows of one label in a block has a zone map,
the least and the greatest value of each dimension.  By interval arithmetic a zone map bounds the score of any anchor with
any row of the zone, so an anchor reads only blocks where a zone's bounds meet what it looks for:

1. in its own block it finds a floor under the score of its fifth positive;
2. it reads the blocks that have a zone of its label reaching that floor, which gives its positives exactly;
3. each positive opens a window of scores; it reads the blocks that have a zone of another label reaching into a window.

A block stays in a task and the anchors that chose it stream past; of each block an anchor keeps ``KEEP`` rows a window.
Zone maps are dealt in pages, each anchor goes to all pages, and a page's anchors to several tasks.  Nothing is broadcast.
Results are exact; what the bounds cannot exclude is read.

Rows take no part that have no id, no label, no vector, or a component that is null or not finite.  Components saturate at
the range of a long and scores wrap round; where scores could leave what doubles hold exactly, all blocks are read and
products are those of longs.  Shorter vectors end in zeros.  Rows that repeat an id are rows of their own.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstile.llm.meet import Streamed, meet
from turnstile.llm.text import scratch
from turnstile.llm.vectors import dimension, finite, lists, matrix

SCALE = 256
LABELS = 10
ANCHOR, SHIFTED = 100, 7
KEEP = 5
#: A window: from 4/5 of the positive's score up to it.
LOW = (4, 5)
BLOCK = 4_096
ZONE = 64
#: Zone maps that a task holds, and anchors that it meets.
PAGE = 4_096
PAGE_ANCHORS = 2_048
#: The curve: dimensions, bits of each, and how many dimensions are looked at for it.
CURVE_DIMS, CURVE_BITS, CURVE_FROM = 8, 4, 256
#: Anchors that meet a block at a time.
SLICE = 256
EXACT = 2.0**53


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of non-negative ``cells`` below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    n, bit = len(x), 1 << (bits - 1)
    while bit > 1:  # turn the sub-cubes so that the curve enters and leaves them at neighbours
        low = bit - 1
        for i in range(n):
            flip = (x[i] & bit) > 0
            swapped = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swapped)
            x[i] ^= swapped
        bit >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn, bit = np.zeros(x.shape[1], dtype=np.int64), 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn
    place = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def _curve(d: int, dims: list[int], low: np.ndarray, step: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("v"), d)[:, dims]
            cells = np.clip((rows - low) / step, 0, (1 << CURVE_BITS) - 1)
            place = pa.array(hilbert(cells, CURVE_BITS))
            yield pa.RecordBatch.from_arrays([*batch.columns, place], names=[*batch.schema.names, "place"])

    return run


def prepared(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``label`` and integer ``v`` of the rows that take part."""
    rows = table.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col(vector).alias("v")
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    label = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    whole = F.transform("v", lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("bigint"))
    return rows.select("vec_id", label.alias("label"), whole.alias("v"))


def blocked(rows: DataFrame, d: int) -> DataFrame:
    """``rows`` with a number ``at`` of their own and their ``block``, written in the order of label and curve."""
    spread = rows.agg(*(F.struct(F.var_pop(x), F.avg(x)) for x in (F.get("v", F.lit(i)) for i in range(min(d, CURVE_FROM))))).first()
    variance, mean = np.array([[x or 0.0 for x in pair] for pair in spread]).T
    dims = np.argsort(-variance, kind="stable")[:CURVE_DIMS].tolist()
    width = 2 * np.sqrt(variance[dims]) + 1e-9
    step = 2 * width / (1 << CURVE_BITS)
    ddl = "vec_id bigint, label bigint, v array<bigint>, place bigint"
    placed = rows.mapInArrow(_curve(d, dims, mean[dims] - width, step), ddl)
    ordered = placed.repartitionByRange("label", "place", "vec_id").sortWithinPartitions("label", "place", "vec_id")
    at = F.monotonically_increasing_id()
    numbered = ordered.drop("place").withColumn("at", at)
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return scratch(numbered.withColumn("block", F.shiftleft(part, 33) + F.shiftright(row, BLOCK.bit_length() - 1)), "negatives-blocks")


def _zones(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column("v"), d, np.int64)
            block, label = batch.column("block").to_numpy(), batch.column("label").to_numpy()
            new = np.concatenate(([True], (block[1:] != block[:-1]) | (label[1:] != label[:-1])))
            first = np.nonzero(new)[0]
            within = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
            first = np.nonzero(within % ZONE == 0)[0]
            low, high = np.minimum.reduceat(rows, first), np.maximum.reduceat(rows, first)
            arrays = [pa.array(block[first]), pa.array(label[first]), lists(low), lists(high)]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "label", "low", "high"])

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, as longs."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if not a.size or not b.size or np.abs(x).max() * np.abs(y).max() * a.shape[1] < EXACT:
        return (x @ y.T).astype(np.int64)
    return a @ b.T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Least and greatest possible score of each anchor with a row of each zone; None where doubles are not exact."""
    a, low, high = (x.astype(np.float64) for x in (anchors, low, high))
    if a.size and low.size and np.abs(a).max() * max(np.abs(low).max(), np.abs(high).max()) * a.shape[1] >= EXACT:
        return None
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _first(score: np.ndarray, vec_id: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Places of the first ``KEEP`` allowed rows, by score and id."""
    at = np.nonzero(allowed)[0]
    if len(at) > KEEP:
        s = score[at]
        at = at[s >= np.partition(s, len(s) - KEEP)[len(s) - KEEP]]
    return at[np.lexsort((vec_id[at], -score[at]))[:KEEP]]


class _Block:
    def __init__(self, resident: pa.Table, d: int):
        self.rows = matrix(resident.column("v"), d, np.int64)
        self.vec_id, self.label, self.at = (resident.column(c).to_numpy() for c in ("vec_id", "label", "at"))

    def meetings(self, streamed: Streamed, d: int):
        """Per anchor: its batch, its place there, its scores with the block's rows."""
        for batch in streamed:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                scores = products(matrix(part.column("a_v"), d, np.int64), self.rows)
                names = {c: part.column(c).to_pylist() for c in part.schema.names if c in ("anchor", "a_label", "positives")}
                yield names, scores


POSITIVE = "anchor bigint, score bigint, vec_id bigint, at bigint"


def _positives(d: int, only_floor: bool):
    def run(_key: tuple, resident: pa.Table, streamed: Streamed) -> Iterator[pa.RecordBatch]:
        block = _Block(resident, d)
        for names, scores in block.meetings(streamed, d):
            out = []
            for anchor, label, score in zip(names["anchor"], names["a_label"], scores):
                found = _first(score, block.vec_id, (block.label == label) & (block.at != anchor))
                if only_floor:
                    found = found[KEEP - 1 :]
                out += [(anchor, score[i], block.vec_id[i], block.at[i]) for i in found]
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "score", "vec_id", "at"])

    return run


def in_window(positive, score):
    """Whether ``score`` is at most the positive's and at least 4/5 of it."""
    return (score <= positive) & (LOW[0] * positive <= LOW[1] * score)


NEGATIVE = "anchor bigint, positive int, positive_id bigint, positive_score bigint, score bigint, vec_id bigint, at bigint"


def _negatives(d: int):
    def run(_key: tuple, resident: pa.Table, streamed: Streamed) -> Iterator[pa.RecordBatch]:
        block = _Block(resident, d)
        names_out = [f.split()[0] for f in NEGATIVE.split(", ")]
        for names, scores in block.meetings(streamed, d):
            out = []
            for anchor, label, positives, score in zip(names["anchor"], names["a_label"], names["positives"], scores):
                other = block.label != label
                for p in positives:
                    allowed = other & in_window(p["score"], score)
                    for i in _first(score, block.vec_id, allowed) if allowed.any() else ():
                        out.append((anchor, p["rank"], p["vec_id"], p["score"], score[i], block.vec_id[i], block.at[i]))
            columns = list(zip(*out)) if out else [[]] * 7
            arrays = [pa.array(c, pa.int32() if n == "positive" else pa.int64()) for n, c in zip(names_out, columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=names_out)

    return run


def _choose(d: int, wanted):
    """Which blocks each anchor must read: those with a zone that ``wanted`` marks."""

    def run(_key: tuple, resident: pa.Table, streamed: Streamed) -> Iterator[pa.RecordBatch]:
        low, high = (matrix(resident.column(c), d, np.int64) for c in ("low", "high"))
        label, block = resident.column("label").to_numpy(), resident.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        low, high, label, block = low[order], high[order], label[order], block[order]
        first = np.nonzero(np.concatenate(([True], block[1:] != block[:-1])))[0]
        for batch in streamed:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                reach = bounds(matrix(part.column("a_v"), d, np.int64), low, high)
                marked = np.logical_or.reduceat(wanted(part, label, reach), first, axis=1)
                who, which = np.nonzero(marked)
                taken = part.select(["anchor"]).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(block[first[which]])], names=["anchor", "block"])

    return run


def _may_be_positive(part: pa.RecordBatch, label: np.ndarray, reach) -> np.ndarray:
    same = part.column("a_label").to_numpy()[:, None] == label
    if reach is None:
        return same
    floor = np.array([-np.inf if f is None else f for f in part.column("floor").to_pylist()])
    return same & (reach[1] >= floor[:, None])


def _may_be_negative(part: pa.RecordBatch, label: np.ndarray, reach) -> np.ndarray:
    other = part.column("a_label").to_numpy()[:, None] != label
    if reach is None:
        return other
    met = np.zeros_like(other)
    for i, positives in enumerate(part.column("positives").to_pylist()):
        for p in positives:
            met[i] |= (reach[0][i] <= p["score"]) & (LOW[1] * reach[1][i] >= LOW[0] * p["score"])
    return other & met


def _chosen(anchors: DataFrame, zones: DataFrame, pages: int, salts: int, d: int, wanted) -> DataFrame:
    """``anchors`` once for each block they must read."""
    salt = F.pmod(F.xxhash64("anchor"), F.lit(salts))
    everywhere = anchors.withColumns({"page": F.explode(F.sequence(F.lit(0), F.lit(pages - 1))), "salt": salt.cast("int")})
    copies = zones.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # What only the anchors of the second choice have is null in the first.
    pairs = meet(copies, everywhere, ["page", "salt"], _choose(d, wanted), "anchor bigint, block bigint")
    return pairs.join(anchors, "anchor")


def _ranked(found: DataFrame, by: list[str]) -> DataFrame:
    """The first ``KEEP`` of each group over all blocks."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "at")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= KEEP)


def mine(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``."""
    rows = prepared(table, vector)
    d = dimension(rows)
    blocks = blocked(rows, d)
    resident = blocks.select("block", "vec_id", "label", "at", "v")
    found = blocks.select("block", "label", "v").mapInArrow(_zones(d), "block bigint, label bigint, low array<bigint>, high array<bigint>")
    zones = scratch(found, "negatives-zones")
    pages = max(1, -(-zones.count() // PAGE))
    zones = zones.withColumn("page", F.pmod(F.xxhash64("block"), F.lit(pages)).cast("int"))
    anchors = scratch(
        blocks.where(F.col("vec_id") % ANCHOR == 0).select(
            F.col("at").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("a_label"), F.col("v").alias("a_v"), "block"
        ),
        "negatives-anchors",
    )
    salts = max(1, -(-anchors.count() // PAGE_ANCHORS))
    floors = meet(resident, anchors, ["block"], _positives(d, only_floor=True), POSITIVE)
    asking = anchors.drop("block").join(floors.select("anchor", F.col("score").alias("floor")), "anchor", "left")
    asking = scratch(asking, "negatives-floors")
    reading = _chosen(asking, zones, pages, salts, d, _may_be_positive)
    positives = _ranked(meet(resident, reading, ["block"], _positives(d, only_floor=False), POSITIVE), ["anchor"])
    windows = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    asking = scratch(asking.drop("floor").join(windows, "anchor"), "negatives-windows")
    reading = _chosen(asking, zones, pages, salts, d, _may_be_negative)
    negatives = _ranked(meet(resident, reading, ["block"], _negatives(d), NEGATIVE), ["anchor", "positive"])
    names = anchors.select("anchor", "anchor_id")
    return negatives.join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
