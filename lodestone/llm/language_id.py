"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; what is not a letter counts as a blank; the features are the 1-, 2- and 3-grams
of code points within words, with one blank at a word's edge, hashed into ``BUCKETS``.  Every task counts its own
training texts with numpy, Spark sums the counts by language and bucket, and the matrix of log
probabilities (languages x buckets, both bounded) is broadcast.  Scoring adds a text's log
probabilities in windows of bounded length, so a text's length bounds the memory only by its own copy.

``score`` is the posterior of the chosen language with log-likelihoods divided by the square root of the
number of n-grams, as n-grams of one text are far from independent.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the language that
comes first by code point; rows without a language are not learned from; with nothing to learn every row is ``und``;
an empty table gives an empty table; repeated rows get equal results; other columns are not carried over.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 256
#: Positions scored at once.
WINDOW = 1 << 18
_FACTORS = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]  # odd multipliers of the n-gram hash
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, blanks as 0 and one between texts; the text of each."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    owner = np.concatenate((owner, owner[-1:]))
    return np.where(letters()[points], points, 0).astype(np.uint32), owner


def grams(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, position) of the n-grams, window by window; positions ascend within a window."""
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    for at in range(0, len(points), WINDOW):
        part = points[at : at + WINDOW + max(ORDERS) - 1]
        blank = part == 0
        for n in ORDERS:
            count = min(WINDOW, len(part) - n + 1)
            if count <= 0:
                continue
            value = np.full(count, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                value = (value ^ part[k : k + count]) * _FACTORS[k]
                value ^= value >> np.uint32(15)
            # within a word, with one blank at an edge at most
            inner = np.zeros(count, bool)
            for k in range(1, n - 1):
                inner |= blank[k : k + count]
            ends = blank[:count] & blank[n - 1 : n - 1 + count]
            keep = np.flatnonzero(~(inner | ends))
            yield ((value * _FACTORS[0]) >> shift)[keep].astype(np.int64), keep + at


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # languages x buckets
    prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n, k = len(texts), len(self.languages)
        points, owner = code_points(texts)
        total, seen = np.zeros((k, n)), np.zeros(n)
        for bucket, at in grams(points):
            doc = owner[at]
            seen += np.bincount(doc, minlength=n)
            for row, table in zip(total, self.table, strict=True):
                row += np.bincount(doc, weights=table[bucket], minlength=n)
        if not k:
            return ["und"] * n, [0.0] * n
        best = np.argmax(total + self.prior[:, None], axis=0)
        soft = (total + self.prior[:, None]) / np.sqrt(np.maximum(seen, 1))
        soft = np.exp(soft - soft.max(axis=0))
        score = soft[best, np.arange(n)] / soft.sum(axis=0)
        known = seen > 0
        return [self.languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)], np.where(known, score, 0.0).tolist()


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over every row of ``labelled`` that has a language."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(text_col, lang_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for start, n in slices(batch.column(0), 1 << 20):
                points, owner = code_points(batch.column(0).slice(start, n).to_pylist())
                names, code = np.unique(langs[start : start + n].astype(str), return_inverse=True)
                for name in names:
                    if name not in counts:
                        if len(counts) >= MAX_LANGUAGES:
                            raise ValueError(f"more than {MAX_LANGUAGES} languages")
                        counts[name] = np.zeros(BUCKETS + 1, np.int64)
                for k, name in enumerate(names):
                    counts[name][BUCKETS] += int((code == k).sum())
                for bucket, at in grams(points):
                    both = np.bincount(code[owner[at]] * BUCKETS + bucket, minlength=len(names) * BUCKETS)
                    for k, name in enumerate(names):
                        counts[name][:BUCKETS] += both[k * BUCKETS : (k + 1) * BUCKETS]
        for name, held in counts.items():
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(held[some], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    summed = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a row per language and bucket that occurs: both are bounded
    found = summed.toPandas()
    languages = sorted(found["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(languages), BUCKETS + 1))
    counts[[languages.index(x) for x in found["lang"]], found["bucket"].to_numpy()] = found["n"].to_numpy()
    seen, docs = counts[:, :BUCKETS] + 1.0, counts[:, BUCKETS]
    table = np.log(seen) - np.log(seen.sum(axis=1, keepdims=True)) if languages else seen
    return Model(languages, table, np.log(docs / docs.sum()) if languages else docs)


def fold(id_col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % of


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: the id, ``lang_pred``, ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(id_col, text_col)
    kind = kept.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(1), 1 << 20):
                part = batch.slice(at, n)
                langs, scores = shared.value.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=[id_col, "lang_pred", "score"],
                )

    return kept.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
