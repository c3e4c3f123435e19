"""Toxicity by maximum-scoring segments.

Tokens are letter runs. From labelled documents each token gets a log-odds ratio between toxic and clean documents
under an informative Dirichlet prior (the tokens' shares over both kinds); tokens whose counts stand out by the signed
root of their log-likelihood ratio keep it (a standard error would punish tokens that no clean document has), all others
are pooled and share the pool's own, slightly negative, ratio. How far they must stand out is chosen by the rows that also
calibrate. A linear-time scan
over a text's scores finds every maximal scoring segment: the toxic passages. As scores are log ratios of
probabilities, the segments' scores in clean text follow an extreme-value law with rate 1, whose constant is estimated
from clean documents; it turns a passage's score and the text's length into an expected number of such passages by
chance. The documents' statistic, minus the log of the joint significance, is calibrated by a logistic curve on labelled
rows that the token scores have not seen.

Null and empty texts have no passages; their score is the curve's value there. With no labels of one kind every score
is the smoothed share of toxic labels. An empty table gives an empty result. Texts are read whole; repeated rows give repeated results; extra columns are
ignored; a document with several labels counts once for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagitta.llm.common import LOWER, SALTS, blocks, bounded_sample, cut, done, fold, read, utf8, word_hashes, word_spans

#: Labelled rows of each kind that training sees, at most about.
SAMPLE_ROWS = 10_000
LEXICON = 4096
#: How far a token's counts must stand out: the value that serves the calibration rows best.
LEAST_Z = (2.0, 2.5, 3.0, 3.5, 4.0, 5.0)
LEAST_DOCUMENTS = 3
LEAST_ODDS = 1.0
#: The prior's weight as a share of all token counts.
PRIOR_SHARE = 0.02
CHANCE = 1e-2

LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True


def segments(places: list[int], scores: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence that is ``scores`` at ``places`` and ``gap`` (< 0) at all others.

    Linear time: each step either opens a segment or merges earlier ones into it. Segments are (first, last, score).
    """
    left: list[float] = []  # running sums before and after each open segment, and its ends
    right: list[float] = []
    first: list[int] = []
    last: list[int] = []
    link: list[int] = []  # for each open segment, the nearest earlier one whose left sum is smaller
    total, seen = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        total += gap * (place - seen)
        seen = place + 1
        before, total = total, total + score
        a, lo = place, before
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = link[j]
            if j < 0 or right[j] >= total:
                break
            a, lo = first[j], left[j]
            del left[j:], right[j:], first[j:], last[j:], link[j:]
        left.append(lo), right.append(total), first.append(a), last.append(place), link.append(j)
    return [(a, b, r - x) for a, b, r, x in zip(first, last, right, left, strict=True)]


@dataclass
class Model:
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    gap: float = -1e-3
    constant: float = 1.0
    slope: float = 0.0
    base: float = 0.0

    def __post_init__(self):
        self.mask = np.zeros(1 << 16, bool)
        self.mask[(self.tokens & np.uint64(0xFFFF)).astype(np.intp)] = True

    def scan(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """For each text: its number of tokens and its segments, as byte spans with scores."""
        low = LOWER[data]
        s, e, first = word_spans(low, offs, LETTERS)
        h = word_hashes(low, s, e)
        hit = np.flatnonzero(self.mask[(h & np.uint64(0xFFFF)).astype(np.intp)])
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, h[hit]), len(self.tokens) - 1)
            same = self.tokens[at] == h[hit]
            hit, w = hit[same], self.weights[at[same]]
        else:
            hit, w = hit[:0], np.zeros(0)
        bounds = np.searchsorted(hit, first)
        for d in range(len(offs) - 1):
            a, b = bounds[d], bounds[d + 1]
            found = segments((hit[a:b] - first[d]).tolist(), w[a:b].tolist(), self.gap) if b > a else []
            yield int(first[d + 1] - first[d]), [(int(s[first[d] + x] - offs[d]), int(e[first[d] + y - 0] - offs[d]), v) for x, y, v in found]

    def chance(self, n: int, score: float) -> float:
        """How many segments of this score or more n tokens of clean text have on average."""
        return self.constant * n * float(np.exp(-score))

    def statistic(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Minus the log of the joint chance of the significant segments."""
        logs = [np.log(max(self.constant * n, 1e-300)) - v for _, _, v in found]
        return float(-sum(x for x in logs if x < np.log(CHANCE)))

    def probability(self, statistic: float) -> float:
        return float(1 / (1 + np.exp(-(self.base + self.slope * np.log1p(statistic)))))


def token_counts(rows: DataFrame) -> DataFrame:
    """From (text, toxic, weight): for each token's hash the toxic and clean documents that have it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(0))
            toxic = np.asarray(batch.column(1)).astype(np.int64)
            for a, _, part, at in blocks(data, offs):
                low = LOWER[part]
                s, e, first = word_spans(low, at, LETTERS)
                doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
                order = np.lexsort((doc, h := word_hashes(low, s, e)))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, y = h[new], toxic[a + doc[new]]
                start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.intp)
                if len(start):
                    n1 = np.add.reduceat(y, start)
                    n0 = np.add.reduceat(1 - y, start)
                    yield pa.RecordBatch.from_arrays([pa.array(h[start].view(np.int64)), pa.array(n1), pa.array(n0)], ["token", "toxic", "clean"])

    counted = rows.select("text", "toxic").mapInArrow(work, "token long, toxic long, clean long")
    return counted.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def standing_out(counts: DataFrame, least_z: float = min(LEAST_Z), size: int = LEXICON) -> tuple[list, int, int]:
    """The tokens (token, toxic, clean, odds, z) that may tell toxic documents, at most size; and the counts of both kinds."""
    n1, n0 = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not n1 or not n0:
        return [], n1 or 0, n0 or 0
    prior, whole = (F.col("toxic") + F.col("clean")) * PRIOR_SHARE, (n1 + n0) * PRIOR_SHARE
    odds = lambda y, n: F.log((y + prior) / (n + whole - y - prior))
    found = counts.withColumn("odds", odds(F.col("toxic"), n1) - odds(F.col("clean"), n0))
    # how far the counts are from those of a token that both kinds have alike
    excess = lambda y, n: F.when(y > 0, y * F.log(y * (n1 + n0) / ((F.col("toxic") + F.col("clean")) * n))).otherwise(0.0)
    surprise = F.greatest(2 * (excess(F.col("toxic"), n1) + excess(F.col("clean"), n0)), F.lit(0.0))
    found = found.withColumn("z", F.signum("odds") * F.sqrt(surprise))
    top = found.where((F.col("toxic") >= LEAST_DOCUMENTS) & (F.col("z") >= least_z) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "token").limit(size)
    return top.select("token", "toxic", "clean", "odds", "z").collect(), n1, n0


def lexicon(found: list, n1: int, n0: int, least_z: float) -> Model:
    """A model of the tokens that stand out by least_z: their log-odds, and those of all others together."""
    top = sorted((r for r in found if r.z >= least_z), key=lambda r: r.token % 2**64)
    if not top:
        return Model()
    in1, in0 = sum(r.toxic for r in top), sum(r.clean for r in top)
    gap = float(np.log((1 - (in1 + 0.5) / (n1 + 1)) / (1 - (in0 + 0.5) / (n0 + 1))))
    return Model(np.array([r.token for r in top], np.int64).view(np.uint64), np.array([r.odds for r in top]), min(gap, -1e-6))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, base: float) -> tuple[float, float]:
    """Base and slope (0 at least) of a logistic curve, by Newton's steps from a flat one."""
    a, b = base, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([np.sum(w * (y - p)), np.sum(w * (y - p) * x) - 1e-2 * b])
        v = w * p * (1 - p) + 1e-9
        hess = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-2]])
        step = np.linalg.solve(hess, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return a, max(0.0, b)


def calibrate(model: Model, n_tokens: np.ndarray, logs: list[list[float]], y: np.ndarray, totals: dict[int, int]) -> float:
    """Sets the model's constant and curve from rows that its lexicon has not seen; returns their loss, each half's by the other's curve."""
    if not len(model.tokens) or y.sum() in (0, len(y)):
        return np.inf
    clean = y == 0
    level = float(np.median(model.weights))
    best = np.array([max(v, default=0.0) for v in logs])
    model.constant = float((np.sum(best[clean] >= level) + 1) * np.exp(level) / max(1, n_tokens[clean].sum()))
    x = np.array([np.log1p(model.statistic(n, [(0, 0, v) for v in found])) for n, found in zip(n_tokens, logs, strict=True)])
    # rows of a kind stand for all of that kind
    w = np.where(y == 1, totals[1] / y.sum(), totals[0] / clean.sum())
    w /= w.mean()
    loss, half = 0.0, np.arange(len(y)) % 2 == 0
    for part in (half, ~half):
        a, b = logistic(x[~part], y[~part], w[~part], model.base)
        p = np.clip(1 / (1 + np.exp(-(a + b * x[part]))), 1e-9, 1 - 1e-9)
        loss -= float(np.sum(w[part] * (y[part] * np.log(p) + (1 - y[part]) * np.log(1 - p))))
    model.base, model.slope = logistic(x, y, w, model.base)
    return loss


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labels (doc_id, toxic) and their documents: token scores from three quarters, the rest calibrates.

    The calibration rows also choose how far a token must stand out to be scored.
    """
    labels = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    totals = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    chosen = bounded_sample(labels, sample_rows, "toxic", text="toxic")
    # the sample is bounded by its parameter, so it may go to every executor; documents that share an id are bounded once more
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    salt = F.pmod(F.xxhash64(F.lit("salt"), "doc_id", "text"), F.lit(SALTS))
    own = F.row_number().over(Window.partitionBy("toxic", "salt").orderBy(F.xxhash64(F.lit("own"), "doc_id", "text"), "doc_id"))
    rows = rows.withColumn("salt", salt).withColumn("own", own).where(F.col("own") <= max(1, 2 * sample_rows // SALTS))
    rows = cut(rows.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(4))).drop("own", "salt"), "toxicity-sample")
    found, n1, n0 = standing_out(token_counts(rows.where("part > 0")))
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    base = float(np.log(share / (1 - share)))
    models = [lexicon(found, n1, n0, z) for z in LEAST_Z]
    for m in models:
        m.base = base
    if not found:
        return models[0]
    seen = statistics(rows.where("part = 0"), models).toPandas().sort_values(["doc_id", "key"])
    done(rows)
    losses = []
    for k, m in enumerate(models):
        own = seen[seen["model"] == k]
        losses.append(calibrate(m, own["n_tokens"].to_numpy(), [list(v) for v in own["logs"]], own["toxic"].to_numpy(float), totals))
    # of equal ones the strictest
    return min(zip(losses, (-z for z in LEAST_Z), models, strict=True), key=lambda t: t[:2])[2]


def statistics(rows: DataFrame, models: list[Model]) -> DataFrame:
    """For each row of (doc_id, toxic, text) and each model: doc_id, key (the text's hash), toxic, model, n_tokens and the segments' scores (logs)."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    names = ["doc_id", "key", "toxic", "model", "n_tokens", "logs"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(3))
            for k, m in enumerate(shared.value):
                told = [(n, [v for *_, v in found]) for _, _, part, at in blocks(data, offs) for n, found in m.scan(part, at)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([k] * len(told), pa.int32()), pa.array([n for n, _ in told], pa.int64()), pa.array([v for _, v in told], pa.list_(pa.float64()))], names)

    return rows.select("doc_id", F.xxhash64("text").alias("key"), "toxic", "text").mapInArrow(work, "doc_id long, key long, toxic int, model int, n_tokens long, logs array<double>")


def scored(rows: DataFrame, model: Model, extra: list[str] = ()) -> DataFrame:
    """doc_id, extra columns, n_tokens, statistic, score and passages (character spans, score, chance).

    Columns of rows that are not among extra do not get in the way, whatever their names.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))
    names = ["doc_id", *extra, "n_tokens", "statistic", "score", "passages"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offs = utf8(batch.column(1))
            counts, stats, scores, spans = [], [], [], []
            for _, _, part, at in blocks(data, offs):
                for d, (n, found) in enumerate(m.scan(part, at)):
                    if found:
                        raw = part[at[d] : at[d + 1]]
                        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    x = m.statistic(n, found)
                    counts.append(n), stats.append(x), scores.append(m.probability(x))
                    spans.append([{"start": int(chars[a]), "stop": int(chars[b]), "score": v, "chance": m.chance(n, v)} for a, b, v in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(k + 2) for k in range(len(extra))), pa.array(counts, pa.int64()), pa.array(stats, pa.float64()), pa.array(scores, pa.float64()), pa.array(spans, passage)], names)

    kinds = dict(rows.dtypes)
    schema = ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in extra), "n_tokens long, statistic double, score double, passages array<struct<start:long,stop:long,score:double,chance:double>>"])
    return rows.select("doc_id", "text", *extra).mapInArrow(work, schema)


def learn(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model from the labels that may be learned from: those whose id's crc32 mod 5 is not 0."""
    return fit(docs, read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = scored(docs, learn(spark, docs, sf_dir))
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size(F.expr(f"filter(passages, p -> p.chance < {CHANCE})")).cast("long").alias("n_passages"))
