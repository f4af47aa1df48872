"""Bounded-space best-fit packing of token sequences.

A document's tokens, ended by token 2, become pieces of at most ``MAX_TOKENS``; only a longer document is cut, and then
its first piece may be shorter than the others.  Full pieces are sequences by themselves.  The others are dealt at random
over tasks of about ``PIECES_PER_TASK`` and packed there as they come, into at most ``OPEN_BINS`` open sequences: those
are kept in a bit set by free space, so the best fit is the lowest bit at or above the piece's length.  When all are
open and none fits, the fullest is closed.  Memory is bounded by the number of open sequences, and tasks grow in number,
not in size.

Packing reads lengths only, from a table written once; texts are tokenised once and never shuffled.

Null and empty texts have one token, the end.  Rows that repeat an id are packed like others.  An empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from turnstile.llm.text import scratch

MAX_TOKENS = 1024
END = 2
PIECES_PER_TASK = 32_768
OPEN_BINS = 64
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit words.

    The vocabulary is published in two forms with the same ids, as a file of the ``tokenizers`` library and as a table of
    ranks.  Ids are those of the file; they are computed from the ranks, which takes a quarter of the time.  Tests hold
    the two together.  As in the file, the special token's string in a text is that token.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in pairs}
        self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})

    def encode(self, text: str | None) -> bytes:
        return self.encoding.encode_to_numpy(text or "", allowed_special="all").astype("<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def _pieces(path: str, pattern: str, limit: int):
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path, pattern)
        encoder = _encoders[path]
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("_llm_text")):
                ids = encoder.encode(text.as_py()) + end
                total = len(ids) // 4
                piece, at, stop = 0, 0, (total - 1) % limit + 1
                while at < total:
                    found = (key, piece, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop]))
                    for values, value in zip(out.values(), found):
                        values.append(value)
                    piece, at, stop = piece + 1, stop, stop + limit
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(v, k) for v, k in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=list(out))

    return run


def pieces(docs: DataFrame, path: str | None = None, limit: int = MAX_TOKENS) -> DataFrame:
    """The pieces of every row of ``docs``: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""
    import public_tokenizers

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").alias("_llm_text"))
    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return slim.mapInArrow(_pieces(path or ranks_path(), public_tokenizers.PATTERN, limit), ddl)


class Bins:
    """At most ``limit`` open sequences of ``size`` tokens, by free space; ``place`` gives a sequence and an offset."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits, self.open, self.made = 0, 0, 0

    def _pop(self, free: int) -> int:
        stack = self.free[free]
        found = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._pop(free)
        else:
            if self.open == self.limit:
                self._pop((self.bits & -self.bits).bit_length() - 1)
            free, sequence, self.made = self.size, self.made, self.made + 1
        left = free - length
        if left:
            self.free[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
        return sequence, self.size - free


def _packed(limit: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Bins(limit, bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([base + s for s, _ in placed], pa.int64()),
                    pa.array([o for _, o in placed], pa.int64()),
                ],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    return run


def place(cut: DataFrame, limit: int = MAX_TOKENS, per_task: int = PIECES_PER_TASK, bins: int = OPEN_BINS) -> DataFrame:
    """``sequence_id`` and ``offset`` for each piece; ``cut`` is read twice and should be a table."""
    loose = cut.where(F.col("length") < limit)
    tasks = max(1, -(-loose.count() // per_task))
    dealt = loose.repartition(tasks, F.xxhash64("doc_id", "ids_crc32"))
    # In the order of a digest, so that reruns agree.
    ordered = dealt.sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "ids_crc32")
    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    packed = ordered.mapInArrow(_packed(limit, bins), ddl)
    own = F.monotonically_increasing_id() + F.lit(1 << 62)
    full = cut.where(F.col("length") >= limit).select("*", own.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionAll(full)


def pack(docs: DataFrame, path: str | None = None, limit: int = MAX_TOKENS) -> DataFrame:
    """Every piece of ``docs`` and its place: ``sequence_id`` and ``offset`` in that sequence."""
    return place(scratch(pieces(docs, path, limit), "pieces"), limit)
