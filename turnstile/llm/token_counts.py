"""Token counts of texts under a unigram model, by dynamic programming on a trie.

A text is cut into pre-tokens by the tokenizers' public pattern, and each pre-token into the pieces with the best sum of
scores.  Pieces are those of a public byte-level vocabulary; a piece's score is its log probability if ranks follow Zipf's
law, -ln(rank + ``ZIPF_SHIFT``).  Nothing is trained.  Every byte is a piece, so that every text has a segmentation.

The distinct pre-tokens of a task are inserted in a trie.  A node stands for a prefix and stores its forward score (the
best of any segmentation that ends there) and the pieces of that segmentation, so that a prefix is scored once for all
pre-tokens that share it; at the last node of a pre-token stands its count.  A task's trie is bounded: beyond
``MAX_NODES`` it starts anew, which costs time and changes nothing.  Pre-tokens beyond ``TRIE_BYTES`` are scored along
their bytes alone, keeping as many scores as the longest piece has bytes.  Nothing is shuffled.

Of equal scores the fewer pieces win.  Null and empty texts have no tokens.  Repeated rows are counted each; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import math
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
ZIPF_SHIFT = 2.7
MAX_NODES = 1_000_000
TRIE_BYTES = 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_scores(path: str) -> dict[bytes, float]:
    """Piece -> log probability up to a constant."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(piece): -math.log(int(rank) + ZIPF_SHIFT) for piece, rank in pairs}


class Trie:
    """Pre-tokens as UTF-8 bytes -> pieces of their best segmentation.

    ``nodes`` has each inserted prefix, with the score and the pieces of its best segmentation.
    """

    def __init__(self, scores: dict[bytes, float], max_nodes: int = MAX_NODES, trie_bytes: int = TRIE_BYTES):
        self.max_nodes, self.trie_bytes, self.longest = max_nodes, trie_bytes, max(map(len, scores))
        #: Every suffix of a piece; its score if it is a piece.  What is no suffix ends no piece.
        self.suffixes = {piece[i:]: scores.get(piece[i:]) for piece in scores for i in range(len(piece))}
        self.nodes = {b"": (0.0, 0)}

    def count(self, word: bytes) -> int:
        if len(word) > self.trie_bytes:
            return self._count_alone(word)
        nodes, suffixes = self.nodes, self.suffixes
        if word not in nodes and len(nodes) > self.max_nodes:
            self.nodes = nodes = {b"": (0.0, 0)}
        known = len(word)
        while word[:known] not in nodes:
            known -= 1
        for end in range(known + 1, len(word) + 1):
            best, fewest = -math.inf, 0
            for start in range(end - 1, -1, -1):
                piece = word[start:end]
                if piece not in suffixes:
                    break
                own = suffixes[piece]
                if own is not None:
                    score, pieces = nodes[word[:start]]
                    score += own
                    if score > best or (score == best and pieces + 1 < fewest):
                        best, fewest = score, pieces + 1
            nodes[word[:end]] = (best, fewest)
        return nodes[word][1]

    def _count_alone(self, word: bytes) -> int:
        """As ``count``, holding no more scores than the longest piece needs, and none afterwards."""
        held = deque([(0.0, 0)], maxlen=self.longest)
        for end in range(1, len(word) + 1):
            best, fewest = -math.inf, 0
            for back in range(1, len(held) + 1):
                piece = word[end - back : end]
                if piece not in self.suffixes:
                    break
                own = self.suffixes[piece]
                if own is not None:
                    score, pieces = held[-back]
                    score += own
                    if score > best or (score == best and pieces + 1 < fewest):
                        best, fewest = score, pieces + 1
            held.append((best, fewest))
        return held[-1][1]


_tries: dict[str, Trie] = {}


def _count(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tries:
            _tries[path] = Trie(read_scores(path))
        trie, cut = _tries[path], regex.compile(pattern)
        for batch in batches:
            pretokens, tokens = [], []
            for text in batch.column("_llm_text"):
                found = Counter(cut.findall(text.as_py() or ""))
                pretokens.append(found.total())
                tokens.append(sum(n * trie.count(word.encode()) for word, n in found.items()))
            columns = [batch.column("doc_id"), pa.array(pretokens, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id``, ``n_pretokens``, ``n_tokens`` of each row of ``docs``."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").alias("_llm_text"))
    ddl = "doc_id bigint, n_pretokens bigint, n_tokens bigint"
    return slim.mapInArrow(_count(path or vocabulary_path(), pattern), ddl)
