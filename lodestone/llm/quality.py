"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded as a vector of surface measures and
hashed byte pairs; a gated attention layer weighs the passages (softmax of w . (tanh(V h) * sigmoid(U h))), and a
logistic layer scores the weighted mean.  Encoder, attention and classifier are learned together from the labels of
documents (Adam on the cross-entropy).  Whole texts are encoded, in fitting and in scoring.

The fit runs on a bounded sample of labelled rows: the first ``SAMPLE`` documents by a hash of the id, up to ``MOST_PASSAGES`` passages
together, which bounds what reaches the driver (a document of more passages than that takes no part in the fit).  So long documents are fitted like
short ones.  Scoring covers every row in tasks.

Defined results: a null or an empty text has one empty passage and is scored like any other; without labels the
score is 0.5 everywhere, with one label only it is that label's smoothed share; an id with several labels has their
rounded mean (half: 1), null labels are ignored; repeated rows get equal scores; an empty table gives an empty
table; other columns are not carried over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.arrays import words_of
from lodestone.llm.common import slices, written

PASSAGE = 64
SAMPLE = 6000
MOST_PASSAGES = 150_000
PAIRS = 32
CLASSES = 8
WIDTH = CLASSES + 10 + PAIRS
HIDDEN, ATTENTION = 24, 16
EPOCHS, BATCH, RATE = 30, 128, 0.01
THRESHOLD = 0.3

_CLASS = np.full(256, 5, np.int64)  # other symbols
_CLASS[[ord(c) for c in ".,;:'-?()\""]] = 4
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[0x80:] = 3
_CLASS[ord("!")] = 6
_CLASS[ord("|")] = 7


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Passages x ``WIDTH``, and the number of passages of each text (1 at least)."""
    words = words_of(texts)
    counts = np.diff(words.first)
    bags = np.maximum(1, -(-counts // PASSAGE))
    out = np.zeros((int(bags.sum()), WIDTH), np.float32)
    n = len(words.start)
    if not n:
        return out, bags
    doc = words.doc
    passage = (np.cumsum(bags) - bags)[doc] + (np.arange(n) - words.first[doc]) // PASSAGE
    size = words.end - words.start
    rows = len(out)
    total = lambda x, w=None: np.bincount(x, weights=w, minlength=rows)
    held = np.maximum(total(passage), 1)
    of = np.repeat(passage, size)
    at = np.repeat(words.start - (np.cumsum(size) - size), size) + np.arange(len(of))
    kinds = _CLASS[words.data[at]]
    n_bytes = np.maximum(total(of), 1)
    out[:, :CLASSES] = np.bincount(of * CLASSES + kinds, minlength=rows * CLASSES).reshape(rows, CLASSES) / n_bytes[:, None]
    hashes = words.hashes()
    same = np.zeros(n, bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    every = np.lexsort((hashes, passage))
    new = np.ones(n, bool)
    new[1:] = (hashes[every][1:] != hashes[every][:-1]) | (passage[every][1:] != passage[every][:-1])
    first, last = _CLASS[words.data[words.start]], _CLASS[words.data[words.end - 1]]
    mean = total(passage, size) / held
    more = [
        np.log1p(total(passage)),
        mean,
        np.sqrt(np.maximum(total(passage, size.astype(float) ** 2) / held - mean**2, 0)),
        total(passage, same) / held,
        total(passage[every], new) / held,
        total(passage, first == 1) / held,
        total(passage, last == 4) / held,
        total(passage, (last == 5) | (last == 6)) / held,
        total(passage, words.data[words.start - 1] == 10) / held,
        total(passage, size == 1) / held,
    ]
    out[:, CLASSES : CLASSES + 10] = np.stack(more, axis=1)
    pair = (words.data[at].astype(np.uint32) * np.uint32(31) + words.data[np.minimum(at + 1, len(words.data) - 1)]) * np.uint32(2654435761)
    bucket = (pair >> np.uint32(27)).astype(np.int64)
    out[:, CLASSES + 10 :] = np.sqrt(np.bincount(of * PAIRS + bucket, minlength=rows * PAIRS).reshape(rows, PAIRS) / n_bytes[:, None])
    return out, bags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Without ``weights`` the score is ``share`` everywhere."""

    share: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None

    def score(self, passages: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(bags), self.share)
        return forward(self.weights, np.clip((passages - self.mean) / self.scale, -6, 6), bags)["p"]


def forward(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
    starts = np.cumsum(bags) - bags
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    s = (t * g) @ w["w"]
    a = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), bags))
    a /= np.repeat(np.add.reduceat(a, starts), bags)
    z = np.add.reduceat(h * a[:, None], starts)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["b"][0]), "starts": starts}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(w, x, bags)
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * w["c"]
    dz_each = np.repeat(dz, bags, axis=0)
    da = (dz_each * f["h"]).sum(axis=1)
    ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["starts"]), bags))
    dt, dg = ds[:, None] * w["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * w["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = dz_each * f["a"][:, None] + dt @ w["V"].T + dg @ w["U"].T
    dx = dh * (1 - f["h"] ** 2)
    return {
        "E": x.T @ dx, "e": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
        "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ d, "b": np.array([d.sum()]),
    }


def fit(bags_of: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Model:
    """``bags_of``: the passages of each document; ``labels``: 0 or 1."""
    ones, n = int(labels.sum()), len(labels)
    if ones in (0, n):
        return Model((ones + 1) / (n + 2))
    every = np.concatenate(bags_of)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {
        "E": normal(WIDTH, HIDDEN), "e": np.zeros(HIDDEN), "V": normal(HIDDEN, ATTENTION), "U": normal(HIDDEN, ATTENTION),
        "w": normal(ATTENTION), "c": normal(HIDDEN), "b": np.array([np.log(ones / (n - ones))]),
    }
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    sizes, step = np.array([len(b) for b in bags_of]), 0
    x = [np.clip((b - mean) / scale, -6, 6) for b in bags_of]
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for at in range(0, n, BATCH):
            own = order[at : at + BATCH]
            step += 1
            for k, v in gradients(w, np.concatenate([x[i] for i in own]), sizes[own], labels[own]).items():
                v = v + 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(ones / n, mean, scale, w)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE
) -> Model:
    """Fits on ``sample`` labelled documents at most, the first by a hash of the id; of rows that repeat an id the least text counts."""
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.floor(F.avg(label_col) + 0.5).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    # a bounded number of ids
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    # one row an id: ids that are repeated, if there are any, give their least text
    several = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id")
    if not several.isEmpty():
        once = rows.join(F.broadcast(several), "_id", "left_anti")
        rows = once.unionByName(rows.join(F.broadcast(several), "_id", "left_semi").groupBy("_id", "_label").agg(F.min("_text").alias("_text")))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(2), 1 << 20):
                part = batch.slice(at, n)
                passages, bags = encode(part.column(2).to_pylist())
                ends = np.cumsum(bags)
                held = [passages[e - b : e].tobytes() if b <= MOST_PASSAGES else b"" for e, b in zip(ends, bags, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1).cast(pa.int32()), pa.array(bags, pa.int64()), pa.array(held, pa.binary())], names=["id", "label", "n", "bag"]
                )

    # in the order of the hash while the passages fit; no more than the bounds come to the driver
    held = written(docs.sparkSession, rows.select("_id", "_label", "_text").mapInArrow(run, f"id {kind}, label int, n long, bag binary"), "quality-bags")
    fitting = held.filter(F.col("n") <= MOST_PASSAGES)
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    fitting = fitting.select("id", "n").withColumn("_upto", upto).filter(F.col("_upto") <= MOST_PASSAGES).select("id")
    found = held.join(F.broadcast(fitting), "id", "left_semi").collect()
    found.sort(key=lambda r: (str(r["id"]), bytes(r["bag"])))
    bags = [np.frombuffer(bytes(r["bag"]), np.float32).reshape(-1, WIDTH) for r in found]
    return fit(bags, np.array([r["label"] for r in found], float))


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: the id, ``score`` and ``predicted`` (1 from ``threshold``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(id_col, text_col)
    kind = kept.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(1), 1 << 20):
                part = batch.slice(at, n)
                score = shared.value.score(*encode(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                    names=[id_col, "score", "predicted"],
                )

    return kept.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def scored_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose score reaches ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for at, n in slices(texts, 1 << 20):
                score = shared.value.score(*encode(texts.slice(at, n).to_pylist()))
                yield batch.slice(at, n).filter(pa.array(score >= threshold))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
