"""Language identification by prediction by partial matching (PPM).

Per language, a context tree over bytes holds how often each byte followed each context of up to ``ORDER`` bytes in the
training texts; the statistics are then frozen.  The code length of a byte is that under its longest known context, or,
if the byte never followed it, the length of an escape plus that under the next shorter context, down to eight bits for
a byte never seen.  Escapes have probability distinct / (total + distinct) (method C).  A text's language is the one with
the shortest code, with the length of naming the language by its share of the training rows; the score is its posterior.

A code length depends on the last ``ORDER`` + 1 bytes only, so a batch of texts is scored by its distinct byte runs: each
is looked up once per order for all languages, and summed over the places where it stands.

Training: of each language about ``TRAIN_ROWS`` rows, chosen by a digest of their id (a documented bound; all rows, if it
has no more).  Runs seen once in the longer contexts are left out.  The tree that reaches the driver and the tasks is
bounded by the sample.

A text that is null or has no letter is ``und`` with score 0, as is any if nothing was learned.  Rows are scored one by
one, so ties, repeated rows and extra columns change nothing; an empty table gives an empty result.  Of equal code
lengths the first language by name wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from turnstile.llm.text import scratch

ORDER = 4
TRAIN_ROWS = 1_500
#: Least count of a run of more than ``ALWAYS`` bytes.
LEAST, ALWAYS = 2, 3
UNDETERMINED = "und"
SEED = 11
BYTES_AT_ONCE = 1 << 20
_OTHER = re.compile(r"[\W\d_]+")


def normal_form(text: str | None) -> bytes:
    """Lower-case letters, all else between them one space, with a full context of spaces before."""
    return b" " * ORDER + _OTHER.sub(" ", (text or "").lower()).strip().encode() + b" "


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def runs(data: np.ndarray, length: int) -> np.ndarray:
    """Per place from ``ORDER`` on, the ``length`` bytes that end there, as one number."""
    n = len(data) - ORDER
    out = np.zeros(n, dtype=np.uint64)
    for back in range(length - 1, -1, -1):
        out = out << np.uint64(8) | data[ORDER - back : ORDER - back + n]
    return out


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("_llm_text").to_pylist()):
            if has_letter(text):
                by_lang.setdefault(lang, []).append(normal_form(text))
        for lang, texts in by_lang.items():
            for length in range(1, ORDER + 2):
                found = np.concatenate([runs(np.frombuffer(t, np.uint8), length) for t in texts])
                values, n = np.unique(found, return_counts=True)
                columns = [
                    pa.array([lang] * len(values), pa.string()),
                    pa.array(np.full(len(values), length, np.int32)),
                    pa.array(values.astype(np.int64)),
                    pa.array(n.astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "length", "run", "n"])


@dataclass
class Model:
    """Languages, their prior code lengths, and per order the known runs and contexts with their code lengths."""

    langs: list[str]
    prior: np.ndarray
    runs: list[np.ndarray]
    bits: list[np.ndarray]  # per run and language; NaN where the language has no such run
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]  # per context and language; 0 where the language has no such context

    def lengths(self, found: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Code lengths of the last byte of each of ``found`` (runs of ``order`` + 1 bytes) per language."""
        if order < 0:
            return np.full((len(found), len(self.langs)), 8.0)
        shorter = found & np.uint64((1 << (8 * order)) - 1)
        out = self.lengths(shorter, order - 1)
        out += _lookup(self.contexts[order], self.escapes[order], found >> np.uint64(8), 0.0)
        own = _lookup(self.runs[order], self.bits[order], found, np.nan)
        return np.where(np.isnan(own), out, own)


def _lookup(keys: np.ndarray, rows: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), rows.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], rows[at], missing)


def build_model(shares: dict[str, float], counts: list[tuple[str, int, int, int]]) -> Model:
    """``counts``: (lang, length, run, n)."""
    langs = sorted(shares)
    place = {lang: i for i, lang in enumerate(langs)}
    model = Model(langs, np.array([-np.log2(shares[lang]) for lang in langs]), [], [], [], [])
    for order in range(ORDER + 1):
        own = [(place[lang], run, n) for lang, length, run, n in counts if length == order + 1]
        of = np.array([o[0] for o in own], dtype=np.int64)
        run = np.array([o[1] for o in own], dtype=np.int64).astype(np.uint64)
        n = np.array([o[2] for o in own], dtype=np.float64)
        keys, at = np.unique(run, return_inverse=True)
        contexts, context_at = np.unique(run >> np.uint64(8), return_inverse=True)
        total = np.zeros((len(contexts), len(langs)))
        distinct = np.zeros((len(contexts), len(langs)))
        np.add.at(total, (context_at, of), n)
        np.add.at(distinct, (context_at, of), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            escapes = np.where(distinct > 0, -np.log2(distinct / (total + distinct)), 0.0)
        bits = np.full((len(keys), len(langs)), np.nan)
        bits[at, of] = -np.log2(n / (total + distinct)[context_at, of])
        model.runs.append(keys)
        model.bits.append(bits)
        model.contexts.append(contexts)
        model.escapes.append(escapes)
    return model


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    if not model.langs:
        return out
    held, size = [], 0
    for i, text in enumerate(texts):
        if has_letter(text):
            held.append((i, normal_form(text)))
            size += len(held[-1][1])
        if held and (size >= BYTES_AT_ONCE or i == len(texts) - 1):
            _score(model, held, out)
            held, size = [], 0
    if held:
        _score(model, held, out)
    return out


def _score(model: Model, held: list[tuple[int, bytes]], out: list) -> None:
    data = np.frombuffer(b"".join(form for _, form in held), np.uint8)
    values, at = np.unique(runs(data, ORDER + 1), return_inverse=True)
    lengths = model.lengths(values)
    starts = np.cumsum([0, *(len(form) for _, form in held)])
    for (i, form), start in zip(held, starts):
        places = at[start : start + len(form) - ORDER]
        bits = model.prior + lengths[places].sum(axis=0)
        best = int(np.argmin(bits))
        out[i] = (model.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()))


def learnable(docs: DataFrame, allowed: Column) -> DataFrame:
    slim = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").alias("_llm_text")
    )
    return slim.where(allowed & F.col("lang").isNotNull())


def train(docs: DataFrame, allowed: Column, rows: int = TRAIN_ROWS) -> Model:
    """The model of the rows of ``docs`` that ``allowed`` (over doc_id) lets in and that have a language."""
    able = learnable(docs, allowed)
    counted = scratch(able.groupBy("lang").agg(F.count("*").alias("n_rows")), "languages")
    found = {r["lang"]: r["n_rows"] for r in counted.collect()}
    if not found:
        return build_model({}, [])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    sample = able.join(counted, "lang").where(draw < F.lit(float(rows)) / F.col("n_rows")).select("lang", "_llm_text")
    counts = sample.mapInArrow(_count_runs, "lang string, length int, run bigint, n bigint")
    counts = counts.groupBy("lang", "length", "run").agg(F.sum("n").alias("n"))
    kept = counts.where((F.col("length") <= ALWAYS) | (F.col("n") >= LEAST))
    total = sum(found.values())
    return build_model({k: n / total for k, n in found.items()}, [tuple(r) for r in kept.collect()])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict(shared.value, batch.column("_llm_text").to_pylist())
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], names=["doc_id", "lang_pred", "score"]
            )

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").alias("_llm_text"))
    return slim.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
