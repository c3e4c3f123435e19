"""Quality by weak labels: overlapping heuristic labellers, their accuracies by expectation-maximisation, a hashed scorer.

Each labeller turns one statistic of a text into a vote: good, bad or none. Over the counts of all documents' vote
patterns, of which there are at most 3 to the number of labellers, expectation-maximisation estimates how often each
labeller votes what on good and on bad documents, without any given label; that gives every pattern a posterior. The
posteriors label a bounded sample of documents for a logistic scorer on hashed features: words, word shapes, pairs of
shapes and the statistics' levels. The scorer, not the votes, scores the corpus, so it also judges documents on which
the labellers abstain.

Null and empty texts have no words: the labeller of length calls them bad, all others abstain. With no documents there is
no scorer and no row. Texts are read whole (the scorer's training sees windows of long ones), repeated rows give repeated results, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagitta.llm.common import LOWER, blocks, bounded_sample, excerpt, mixed, read, utf8, word_hashes, word_spans

#: Labeller: statistic; (lowest, highest) value for a good vote; the same for a bad one. Between them it abstains.
LABELLERS = {
    "symbols": ((0.0, 0.06), (0.12, 1.0)),
    "capitals": ((0.0, 0.15), (0.5, 1.0)),
    "distinct": ((0.45, 1.0), (0.0, 0.25)),
    "top_word": ((0.0, 0.12), (0.25, 1.0)),
    "repeats": ((0.0, 0.02), (0.08, 1.0)),
    "bars": ((0.0, 0.001), (0.05, 1.0)),
    "marks": ((0.0, 0.02), (0.15, 1.0)),
    "sentences": ((0.02, 0.3), (0.5, 1.0)),
    "words": ((3, np.inf), (0, 0)),
    "lines": ((0.0, 0.15), (0.4, 1.0)),
}
NAMES = list(LABELLERS)
#: In fewer words shares say little.
FEW_WORDS = 10
BITS = 15
TABLE = 4 << BITS
#: Documents in the scorer's training sample at most. Of long texts it sees windows; statistics and votes are always the whole text's.
SAMPLE_ROWS = 6000

SHAPES = np.arange(256, dtype=np.uint8)
SHAPES[97:123] = SHAPES[128:] = 97
SHAPES[65:91] = 65
SHAPES[48:58] = 48
LETTER = (SHAPES == 97) | (SHAPES == 65)
CAPITAL = SHAPES == 65
SYMBOL = ~LETTER & (SHAPES != 48) & ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
IS_LINE = np.ones(256, bool)
IS_LINE[[10, 13]] = False


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x between places, 0 for none."""
    total = np.concatenate([[0], np.cumsum(x)])
    return total[first[1:]] - total[first[:-1]]


def _counted(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of distinct hashes and the most frequent one's occurrences."""
    distinct, most = np.zeros(len(first) - 1, np.int64), np.zeros(len(first) - 1, np.int64)
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            part = np.sort(h[a:b])
            ends = np.flatnonzero(np.concatenate([part[1:] != part[:-1], [True]]))
            distinct[d], most[d] = len(ends), np.diff(ends, prepend=-1).max()
    return distinct, most


def measured(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The statistics (texts by labellers), the words' hashed features and the texts' offsets among the words."""
    low = LOWER[data]
    s, e, first = word_spans(low, offs)
    h = word_hashes(low, s, e)
    n = np.maximum(np.diff(first), 1)
    letters, symbols, capitals = (np.maximum(_sums(t[data], offs), 0) for t in (LETTER, SYMBOL, CAPITAL))
    distinct, most = _counted(h, first)
    again = np.zeros(len(h), np.int64)
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][first[:-1] < len(h)]] = 0
    end = data[e - 1] if len(e) else np.zeros(0, np.uint8)
    long = e - s > 1
    last_but_one = data[np.maximum(e - 2, 0)] if len(e) else end
    marks = (SYMBOL[end] & long & (last_but_one == end)).astype(np.int64)
    bars = ((e - s == 1) & SYMBOL[end]).astype(np.int64)
    stops = np.isin(end, [33, 46, 63]).astype(np.int64)
    ls, le, lines = word_spans(data, offs, IS_LINE)
    different, _ = _counted(word_hashes(data, ls, le), lines)
    count = np.maximum(np.diff(lines), 1)
    stats = np.stack([
        symbols / np.maximum(symbols + letters, 1), capitals / np.maximum(letters, 1), distinct / n, most / n, _sums(again, first) / n, _sums(bars, first) / n,
        _sums(marks, first) / n, _sums(stops, first) / n, np.diff(first), 1 - different / count], axis=1).astype(float)
    shape = SHAPES[data]
    kept = np.ones(len(data), bool)
    kept[1:] = shape[1:] != shape[:-1]
    kept[offs[:-1][offs[:-1] < len(data)]] = True
    thin = np.concatenate([[0], np.cumsum(kept)])
    at = thin[offs]
    ss, se, _ = word_spans(shape[kept], at)
    g = word_hashes(shape[kept], ss, se)
    before = np.concatenate([np.zeros(1, np.uint64), g])[:-1]
    before[first[:-1][first[:-1] < len(g)]] = 0
    pair = mixed(g + before * np.uint64(3))
    place = lambda x, k: (k << BITS) + (x >> np.uint64(64 - BITS)).astype(np.int64)
    return stats, [place(h, 0), place(g, 1), place(pair, 2)], first


def votes(stats: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, 2 none; only the labeller of length votes on a text of few words."""
    out = np.full(stats.shape, 2, np.int64)
    for k, (good, bad) in enumerate(LABELLERS.values()):
        out[(stats[:, k] >= good[0]) & (stats[:, k] <= good[1]), k] = 1
        out[(stats[:, k] >= bad[0]) & (stats[:, k] <= bad[1]), k] = 0
    few = stats[:, NAMES.index("words")] < FEW_WORDS
    out[np.ix_(few, [k for k, n in enumerate(NAMES) if n != "words"])] = 2
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def patterns(docs: DataFrame) -> DataFrame:
    """doc_id and the pattern of its votes, a whole number of as many base-3 digits as there are labellers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            found = [pattern(votes(measured(p, at)[0])) for _, _, p, at in blocks(data, offs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())], ["doc_id", "pattern"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, pattern long")


def accuracies(found: np.ndarray, count: np.ndarray, labellers: int, turns: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: posteriors of good, vote shares (kind, labeller, vote) and prior.

    It starts from the votes' majority, so that good stays good.
    """
    v = found[:, None] // 3 ** np.arange(labellers) % 3
    good, bad = (v == 1).sum(1), (v == 0).sum(1)
    post = (good + 1) / (good + bad + 2)
    shares, prior = np.full((2, labellers, 3), 1 / 3), 0.5
    for _ in range(turns):
        for y in (0, 1):
            w = count * (post if y else 1 - post)
            for x in range(3):
                shares[y, :, x] = ((v == x) * w[:, None]).sum(0) + 1
        shares /= shares.sum(axis=2, keepdims=True)
        prior = float((count * post).sum() + 1) / (count.sum() + 2)
        logs = [np.log(shares[y][np.arange(labellers), v]).sum(1) + np.log(prior if y else 1 - prior) for y in (0, 1)]
        now = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(now - post).max(initial=0.0) < 1e-9:
            break
        post = now
    return post, shares, prior


def levels(stats: np.ndarray) -> np.ndarray:
    """A feature for each statistic's level: twentieths, for the words doublings."""
    steps = np.floor(stats * 20).astype(np.int64)
    k = NAMES.index("words")
    steps[:, k] = np.floor(np.log2(stats[:, k] + 1))
    return (3 << BITS) + np.arange(stats.shape[1]) * 64 + np.clip(steps, 0, 63)


def _added(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x between places, each in its own order: equal texts get equal sums wherever they stand."""
    out, full = np.zeros(len(first) - 1), first[1:] > first[:-1]
    if full.any():
        out[full] = np.add.reduceat(x, first[:-1][full])
    return out


def rated(weights: np.ndarray, stats: np.ndarray, places: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    n = np.maximum(np.diff(first), 1)
    return weights[-1] + weights[levels(stats)].sum(axis=1) + sum(_added(weights[p], first) / n for p in places)


def train(texts: list[str], stats: np.ndarray, posts: np.ndarray, epochs: int = 8, seed: int = 3) -> np.ndarray:
    """The scorer's weights, the last one its bias, by stochastic gradient descent on posterior labels. stats: the whole texts'."""
    weights = np.zeros(TABLE + 1)
    examples = []
    for t, s, y in zip(texts, stats, posts, strict=True):
        raw = np.frombuffer(t.encode(), np.uint8)
        _, places, _ = measured(raw, np.array([0, len(raw)]))
        row, n = np.unique(np.concatenate(places), return_counts=True)
        row = np.concatenate([row, levels(s[None])[0], [TABLE]])
        examples.append((row, np.concatenate([n / max(1, len(places[0])), np.ones(len(s) + 1)]), y))
    rng, done, total = np.random.default_rng(seed), 0, max(1, epochs * len(examples))
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            row, x, y = examples[k]
            p = 1 / (1 + np.exp(-np.clip(x @ weights[row], -30, 30)))
            weights[row] += 0.3 * (1 - done / total) * (y - p) * x
            done += 1
    return weights


def sampled(docs: DataFrame, rows: int) -> tuple[list[str], np.ndarray]:
    """Excerpts and whole texts' statistics of at most so many documents, in an order of their own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            found = [measured(p, at)[0] for _, _, p, at in blocks(data, offs)]
            stats = np.concatenate(found) if found else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(stats), pa.list_(pa.float64()))], ["doc_id", "excerpt", "stats"])

    chosen = bounded_sample(docs.select("doc_id", "text"), rows).select("doc_id", "text", excerpt(F.coalesce("text", F.lit(""))).alias("excerpt"))
    made = chosen.mapInArrow(work, "doc_id long, excerpt string, stats array<double>")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.excerpt, r.stats) for r in made.toLocalIterator())
    return [t for *_, t, _ in got], np.array([s for *_, s in got], float).reshape(-1, len(NAMES))


def scored(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, weak_score (the posterior of its votes) and score (the scorer's), 0 to 1, higher is better."""
    spark = docs.sparkSession
    tallied = patterns(docs).groupBy("pattern").count().orderBy("pattern").toPandas()
    found, count = tallied["pattern"].to_numpy(np.int64), tallied["count"].to_numpy(np.int64)
    post, _, _ = accuracies(found, count, len(NAMES))
    texts, stats = sampled(docs, sample_rows)
    weights = train(texts, stats, post[np.searchsorted(found, pattern(votes(stats)))] if len(texts) else np.zeros(0))
    shared = spark.sparkContext.broadcast((weights, found, post))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, f, p = shared.value
        for batch in batches:
            data, offs = utf8(batch.column(1))
            weak, score = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for a, b, part, at in blocks(data, offs):
                stats, places, first = measured(part, at)
                weak[a:b] = p[np.searchsorted(f, pattern(votes(stats)))]
                score[a:b] = 1 / (1 + np.exp(-np.clip(rated(w, stats, places, first), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak), pa.array(score)], ["doc_id", "weak_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, weak_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "weak_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
