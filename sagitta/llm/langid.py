"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are its byte n-grams of 2 to 4 inside and across letter runs (case folded for A-Z, everything that is
no letter one space), hashed into ``BUCKETS`` rows of an embedding. Their mean goes through a linear softmax; embedding
and softmax are trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows. As the
model is linear, scoring sums one row of class scores for each n-gram. Rows set aside from training fix a temperature,
so that the score is a probability, and a threshold under which a prediction is rejected.

Null texts, and texts without a letter, are ``und`` with score 0. With no labelled rows every text is ``und``; of equally
probable languages the first by code point is predicted. Long texts are read whole (training sees windows of them); repeated rows give
repeated results, an empty table an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagitta.llm.common import blocks, bounded_sample, excerpt, fold, has_letter, read, utf8

BUCKETS = 1 << 16
WIDTH = 16
SIZES = (2, 3, 4)
#: The sample that training sees: rows of each language, and languages (the most frequent). Of long texts it sees windows.
SAMPLE_ROWS = 1500
LANGUAGES = 1000
EPOCHS = 6
REJECT_SHARE = 0.01

CLASSES = np.full(256, 32, np.uint8)
CLASSES[97:123] = np.arange(97, 123)
CLASSES[65:91] = np.arange(97, 123)
CLASSES[128:] = np.arange(128, 256)


def ngrams(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the bucket at every place (0 for a place that is none), and the texts' offsets."""
    x = CLASSES[data].astype(np.uint32)
    gap = x == 32
    for n in SIZES:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, n, np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= x[k : len(x) - n + 1 + k]
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(16)
        # no n-gram of a lone letter between gaps or of two gaps, and none over the end of a text
        bad = gap[: len(h)] & gap[1 : len(h) + 1]
        for k in range(1, n - 1):
            bad |= gap[k : len(h) + k] & gap[k + 1 : len(h) + k + 1]
        ends = offs[1:-1]
        for k in range(1, n):
            at = ends - k
            bad[at[(at >= 0) & (at < len(h))]] = True
        h[bad] = 0
        yield h.astype(np.intp), np.minimum(offs, len(h))


def summed(table: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its n-grams' rows of table, whose row 0 is zero, and how many there are."""
    total = np.zeros((len(offs) - 1, table.shape[1]))
    count = np.zeros(len(offs) - 1, np.int64)
    for h, at in ngrams(data, offs):
        full = at[1:] > at[:-1]
        if full.any():
            total[full] += np.add.reduceat(table[h], at[:-1][full], axis=0)
            count[full] += np.add.reduceat((h > 0).astype(np.int64), at[:-1][full])
    return total, count


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        total, count = summed(self.table, data, offs)
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model | None:
    """Trains on four fifths of the rows (whole texts and pieces of them) and calibrates on the rest."""
    languages = sorted(set(langs))
    if not languages:
        return None
    labels = np.searchsorted(languages, langs)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    kept = order[: max(1, len(order) // 5)] if len(order) >= 50 else order
    learn = order[len(kept) :] if len(order) >= 50 else order
    examples = []
    for i in learn:
        raw = texts[i].encode()
        cuts = [raw] + [raw[a : a + 120] for a in rng.integers(0, max(1, len(raw) - 120), 2)]
        for c in cuts:
            h = [x for x, _ in ngrams(np.frombuffer(c, np.uint8), np.array([0, len(c)]))]
            buckets, count = np.unique(np.concatenate(h) if h else np.zeros(0, np.intp), return_counts=True)
            buckets, count = buckets[buckets > 0], count[buckets > 0]
            if len(buckets):
                examples.append((buckets, (count / count.sum()).astype(np.float32), labels[i]))
    k = len(languages)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    embed[0] = 0
    weight = np.zeros((WIDTH, k), np.float32)
    weight[: min(WIDTH, k), : min(WIDTH, k)] = np.eye(min(WIDTH, k))
    bias = np.zeros(k, np.float32)
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for j in rng.permutation(len(examples)):
            buckets, share, y = examples[j]
            rate = np.float32(1 - done / steps)
            mean = share @ embed[buckets]
            z = mean @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weight @ p
            weight -= 0.5 * rate * np.outer(mean, p)
            bias -= 0.05 * rate * p
            embed[buckets] -= (20 * rate * share)[:, None] * back
            done += 1
    table = (embed @ weight).astype(np.float32)
    table[0] = 0
    model = Model(languages, table, bias)
    raw = [texts[i].encode() for i in kept]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    truth, best = labels[kept], np.inf
    for t in np.geomspace(0.25, 8, 26):
        model.temperature = float(t)
        p = model.probabilities(data, offs)
        loss = -np.log(np.maximum(p[np.arange(len(p)), truth], 1e-12)).mean()
        if loss < best:
            best, chosen = loss, float(t)
    model.temperature = chosen
    p = model.probabilities(data, offs)
    right = p.argmax(axis=1) == truth
    model.threshold = float(np.quantile(p.max(axis=1)[right], REJECT_SHARE)) if right.any() else 0.0
    return model


def fit(docs: DataFrame, learnable: Column, sample_rows: int = SAMPLE_ROWS, languages: int = LANGUAGES) -> Model | None:
    """A model from at most sample_rows of each of at most so many languages among the learnable rows."""
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", excerpt(F.col("text")).alias("text"), "lang")
    got = sorted((r.doc_id, r.text, r.lang) for r in bounded_sample(rows, sample_rows, "lang", languages).toLocalIterator())
    return train([t for _, t, _ in got], [x for _, _, x in got])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and accepted (false: the calibrated threshold rejects it)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offs = utf8(batch.column(1))
            n = batch.num_rows
            best, score = np.full(n, -1), np.zeros(n)
            if m:
                for a, b, part, at in blocks(data, offs):
                    p = m.probabilities(part, at)
                    best[a:b], score[a:b] = p.argmax(axis=1), p.max(axis=1)
            none = ~has_letter(batch.column(1))
            best[none], score[none] = -1, 0
            names = [*(m.languages if m else []), "und"]
            accepted = (best >= 0) & (score >= (m.threshold if m else 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[i] for i in best], pa.string()), pa.array(score), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, lang_pred string, score double, accepted boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, fold(F.col("doc_id"), 3) != 1)
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
