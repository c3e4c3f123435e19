"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). The most frequent tokens are classes of their own, the other
named ones (the next in frequency) share classes of about equal mass by frequency, all rarer words share classes by their last
letters. Both factors are maximum-entropy models with n-gram and skip features:

* The class factor's are the previous token, the one before it (a skip) and the hashed pair of both; rare tokens stand for themselves by
  hashed endings. Its weights begin with smoothed log ratios of counts over all training documents and take rounds of synchronous updates:
  every partition sums the gradient of its share of the round's documents at the same weights, the sums are added up in a tree and the driver
  takes one step, preconditioned by the counts. Every training document is in one round.
* The word factor's are the previous token's class and the class of the one before, for each named word. What it
  needs of the corpus is counts of (word, class before), (word, class before that) and (class, both), so its updates, by iterative scaling, run
  on these sums alone. A rare word has its smoothed share of its class, which holds one more place for all words not seen.

Counts are exact (by 64-bit hash) over all training documents. How many tokens are named and how many hashed pairs there are
grows with the square root of the training tokens, up to bounds that keep the weights in a worker's memory. No sum depends on how the documents are dealt to partitions but
for rounding. Counting and joining are spread over the cluster: the ``HEAD`` most frequent tokens, a bounded table, go to every
executor, only the rarer ones are joined by a shuffle, so no key of that join is frequent.

Null texts are empty texts: one token, the end. With nothing to learn from, N and V are 0 and the classes' weights are
flat. Texts are read whole; rows with one id are rows of their own; a null id is neither held out nor learned from; tokens of equal
counts rank by their hashes; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagitta.llm.common import LOWER, blocks, cut, fold, mixed, read, utf8, word_hashes, word_spans

SINGLE, FREQUENCY, ENDING = 64, 32, 32
CLASSES = SINGLE + FREQUENCY + ENDING
#: Contexts of the word factor: the classes, and the start of a text.
PLACES = CLASSES + 1
#: Least and most named tokens (one less) and hashed pairs: they double with every fourfold of four million training tokens.
NAMED, PAIRS, ENDINGS = (1 << 10, 1 << 13), (1 << 12, 1 << 16), 1024
HEAD = 1 << 20
END = np.uint64(1)
BATCH = 4096
#: Bytes of texts whose tokens are batched together.
BLOCK = 4 << 20
#: Rounds of gradient updates, their step, and the weight of each kind of feature at the start.
ROUNDS, RATE, START_WEIGHTS = 3, 0.6, (0.5, 0.3, 0.3)
#: Smoothing: tokens' worth of the classes' shares behind every feature, the least preconditioner, tokens' worth behind a word's contexts.
PRIOR, LEAST, WORD_PRIOR = 10.0, 2.0, 2.0
WORD_TURNS = 20
#: Partitions whose sums are added in one task, and numbers of a sum that travel together.
FAN, PIECE = 32, 1 << 13


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's tokens as hashes, words and then one end; a hash of each one's ending; the texts' offsets."""
    low = LOWER[data]
    s, e, first = word_spans(low, offs)
    h = word_hashes(low, s, e)
    padded = np.concatenate([np.zeros(2, np.uint8), low]).astype(np.uint64)
    tail = padded[e + 1] | padded[np.maximum(e, s + 2)] << np.uint64(8)  # the last byte and, if there is one, the one before
    at = first + np.arange(len(first))
    words = np.arange(len(h)) + np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full(at[-1], END, np.uint64)
    ending = np.zeros(at[-1], np.int32)
    out[words], ending[words] = h, (mixed(tail + np.uint64(9)) >> np.uint64(33)).astype(np.int32)
    return out, ending, at


def counts(docs: DataFrame) -> DataFrame:
    """token (hash), ending and its number of occurrences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for _, _, part, at in blocks(data, offs, 16 << 20):
                hs, es = [], []
                for _, _, p, a in blocks(part, at):
                    h, ending, _ = tokens(p, a)
                    hs.append(h), es.append(ending)
                h, where, n = np.unique(np.concatenate(hs), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate(es)[where]), pa.array(n.astype(np.int64))], ["token", "ending", "n"])

    found = docs.select("text").mapInArrow(work, "token long, ending int, n long")
    return found.groupBy("token").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent tokens in order of hash, with their counts and ranks; totals of all tokens and of the classes."""

    head: np.ndarray
    count: np.ndarray
    rank: np.ndarray
    total: int
    distinct: int
    named: int  # ranks under it are named
    own_class: np.ndarray  # for each named rank its class
    places: np.ndarray  # for each class of rare words their occurrences, words and a place for the unseen

    @property
    def pairs(self) -> int:
        return PAIRS[0] << _doublings(self.total, *PAIRS)

    @property
    def context(self) -> int:
        return self.named + 1 + ENDINGS

    @property
    def features(self) -> int:
        return 2 * self.context + self.pairs

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ranks of tokens; rank -1 where the head lacks one."""
        if not len(self.head):
            return np.zeros(len(h), np.int64), np.full(len(h), -1)
        seen, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.head, seen), len(self.head) - 1)
        there = self.head[at] == seen
        return np.where(there, self.count[at], 0)[back], np.where(there, self.rank[at], -1)[back]

    def short(self) -> Vocabulary:
        """With the named tokens only, as training needs them."""
        few = self.rank < self.named
        return Vocabulary(self.head[few], self.count[few], self.rank[few], self.total, self.distinct, self.named, self.own_class, self.places)

    def classes(self, rank: np.ndarray, ending: np.ndarray) -> np.ndarray:
        rare = SINGLE + FREQUENCY + ending % ENDING
        if not len(self.own_class):
            return rare
        return np.where((rank >= 0) & (rank < len(self.own_class)), self.own_class[np.clip(rank, 0, len(self.own_class) - 1)], rare)

    def by_rank(self) -> np.ndarray:
        """The named tokens' counts, plus one each, in order of rank."""
        few = self.rank < len(self.own_class)
        out = np.zeros(len(self.own_class))
        out[self.rank[few]] = self.count[few] + 1.0
        return out


def _doublings(total: int, least: int, most: int) -> int:
    return min(int(np.log2(most / least)), max(0, (max(total, 1).bit_length() - 22) // 2))


def vocabulary(counted: DataFrame, head: int = HEAD) -> Vocabulary:
    """The head is every token from a class of counts on, sixteen classes to a doubling: as many as come to head at most."""
    total, distinct = counted.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    level = F.floor(F.log2("n") * 16).cast("int")
    least, held = None, 0
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += r["count"]
        if held > head:
            break
        least = r.level
    top = counted.where(level >= least if least is not None else F.lit(False)).select("token", "n", "ending").toArrow()
    h, n, ending = (top.column(c).to_numpy() for c in ("token", "n", "ending"))
    by_count = np.lexsort((h, -n))
    h, n, ending = h[by_count].view(np.uint64), n[by_count], ending[by_count]
    named = (NAMED[0] << _doublings(total, *NAMED)) - 1
    mass = n[SINGLE:named] + 1.0
    shared = np.searchsorted(mass.sum() * np.arange(1, FREQUENCY) / FREQUENCY, np.cumsum(mass) - mass / 2)
    own = np.concatenate([np.arange(min(SINGLE, len(h))), SINGLE + shared]).astype(np.int64)
    places = np.ones(CLASSES)
    for r in counted.groupBy((F.col("ending") % ENDING).alias("c")).agg(F.sum(F.col("n") + 1).alias("n")).collect():
        places[SINGLE + FREQUENCY + r.c] += r.n
    np.subtract.at(places, SINGLE + FREQUENCY + ending[:named] % ENDING, n[:named] + 1)
    order = np.argsort(h)
    return Vocabulary(h[order], n[order], order.astype(np.int64), total, distinct, named, own, places)


def back(own: np.ndarray, at: np.ndarray, start: int) -> np.ndarray:
    """For each token what stands one and two places before it in its text; start where there is nothing."""
    out = np.full((2, len(own)), start, np.int64)
    place = np.arange(len(own)) - np.repeat(at[:-1], np.diff(at))
    for k in (1, 2):
        there = place[k:] >= k
        out[k - 1, k:][there] = own[: max(0, len(own) - k)][there]
    return out


def features(v: Vocabulary, rank: np.ndarray, ending: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The three feature rows of each token's history."""
    own = np.where((rank >= 0) & (rank < v.named), rank, v.named + 1 + ending % ENDINGS)
    one, two = back(own, at, v.named)
    pair = (mixed((one * v.context + two).astype(np.uint64)) % np.uint64(v.pairs)).astype(np.int64)
    return np.stack([one, v.context + two, 2 * v.context + pair])


class Space:
    """Room for a batch's scores, used again for every batch."""

    def __init__(self):
        self.z, self.t = np.empty((BATCH, CLASSES), np.float32), np.empty((BATCH, CLASSES), np.float32)

    def scores(self, weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Every class's score for each token of a batch, at most 0."""
        z, t = self.z[: f.shape[1]], self.t[: f.shape[1]]
        np.take(weights, f[0], axis=0, out=z, mode="clip")
        for rows in f[1:]:
            np.take(weights, rows, axis=0, out=t, mode="clip")
            z += t
        z += bias
        z -= z.max(axis=1, keepdims=True)
        return z


def log_shares(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The log of every class's probability, for each token of a batch."""
    z = Space().scores(weights, bias, f)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def histories(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different histories of a block, in order: the place of one token of each, each token's history, and how many tokens have it.

    Few of a block's histories are different, and the classes' scores depend on nothing else.
    """
    _, one, own, count = np.unique(f[0] * (f[1].max(initial=0) + 1) + f[1], return_index=True, return_inverse=True, return_counts=True)
    return one, own, count


def chosen_logs(weights: np.ndarray, bias: np.ndarray, f: np.ndarray, y: np.ndarray, space: Space) -> np.ndarray:
    """The log of the probability of each token's own class."""
    out, (one, own, count) = np.empty(len(y)), histories(f)
    order, ends = np.argsort(own, kind="stable"), np.concatenate([[0], np.cumsum(count)])
    for i in range(0, len(one), BATCH):
        z = space.scores(weights, bias, f[:, one[i : i + BATCH]])
        mine = order[ends[i] : ends[i + len(z)]]
        row = own[mine] - i
        chosen = z[row, y[mine]]
        np.exp(z, out=z)
        out[mine] = chosen - np.log(z.sum(axis=1))[row]
    return out


def run_sums(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of runs of rows in double precision: long runs one by one, short ones together, place by place."""
    size = np.diff(np.append(start, len(x)))
    out = x[start].astype(np.float64)
    for k in np.flatnonzero(size > 16):
        x[start[k] : start[k] + size[k]].sum(axis=0, dtype=np.float64, out=out[k])
    short = np.flatnonzero((size > 1) & (size <= 16))
    place = 1
    while len(short):
        out[short] += x[start[short] + place]
        place += 1
        short = short[size[short] > place]
    return out


def sorted_rows(rows: np.ndarray) -> np.ndarray:
    """The order of whole numbers under 2**32, by their halves of 16 bits, which numpy sorts by radix."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    if rows.max(initial=0) < 1 << 16:
        return order
    return order[np.argsort((rows[order] >> 16).astype(np.uint16), kind="stable")]


def add_gradient(total: np.ndarray, weights: np.ndarray, bias: np.ndarray, f: np.ndarray, y: np.ndarray, space: Space) -> None:
    """Adds a block's gradient: for each of its feature rows, the expected less the observed classes."""
    flat_ = total.reshape(-1)
    for rows in f:
        np.subtract.at(flat_, rows * CLASSES + y, 1.0)
    one, _, count = histories(f)
    for i in range(0, len(one), BATCH):
        few = f[:, one[i : i + BATCH]]
        g = space.scores(weights, bias, few)
        np.exp(g, out=g)
        g *= (count[i : i + BATCH] / g.sum(axis=1)).astype(np.float32)[:, None]
        for rows in few:
            order = sorted_rows(rows)
            row = rows[order]
            start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            total[row[start]] += run_sums(np.take(g, order, axis=0, out=space.t[: len(row)], mode="clip"), start)


def summed(docs: DataFrame, size: int, fill: Callable[[np.ndarray, np.ndarray, np.ndarray], None], kind: type) -> np.ndarray:
    """The sum, over all partitions, of ``size`` numbers that fill(numbers, data, offsets) adds each block of texts to.

    Partitions send pieces that are not all zero, as numbers of the given kind; they are added in double precision, up to FAN in a task.
    """
    schema, names = "part long, piece int, data binary", ["part", "piece", "data"]

    def table(part: int, numbers: np.ndarray, pieces: list[int]) -> pa.RecordBatch:
        data = [numbers[k * PIECE : (k + 1) * PIECE].astype(kind).tobytes() for k in pieces]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(pieces), pa.int64()), pa.array(pieces, pa.int32()), pa.array(data, pa.binary())], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(size, np.float64 if kind is np.float32 else np.int64), None
        for batch in batches:
            if batch.num_rows:
                part = batch.column(1)[0].as_py()
                data, offs = utf8(batch.column(0))
                for _, _, p, a in blocks(data, offs, BLOCK):
                    fill(total, p, a)
        if part is not None:
            some = [k for k in range(-(-size // PIECE)) if total[k * PIECE : (k + 1) * PIECE].any()]
            for i in range(0, len(some), 64):
                yield table(part, total, some[i : i + 64])

    def added(kept: type) -> Callable[[pa.Table], pa.Table]:
        def work(rows: pa.Table) -> pa.Table:
            out = sum(np.frombuffer(x.as_buffer(), kept).astype(np.float64) for x in rows.column("data"))
            return pa.table([rows.column("part").slice(0, 1), rows.column("piece").slice(0, 1), pa.array([out.tobytes()], pa.binary())], names)

        return work

    part = F.spark_partition_id().cast("long")
    parts = (docs.select(part.alias("part")).agg(F.max("part")).first()[0] or 0) + 1
    made, kept = docs.select("text", part.alias("part")).mapInArrow(work, schema), kind
    while True:
        made = made.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part", "piece").applyInArrow(added(kept), schema)
        parts, kept = -(-parts // FAN), np.float64
        if parts <= 1:
            break
    out = np.zeros(size)
    for r in made.select("piece", "data").toLocalIterator():
        x = np.frombuffer(r["data"], np.float64)
        out[r.piece * PIECE : r.piece * PIECE + len(x)] = x
    return out


@dataclass
class Model:
    """The class factor's weights and bias; the word factor's, by named word beyond the single ones, and its normalisers."""

    weights: np.ndarray
    bias: np.ndarray
    before: np.ndarray  # word by class before
    further: np.ndarray  # word by the class before that
    share: np.ndarray  # log of each word's count
    norms: np.ndarray  # frequency class by both contexts, the log of the sum over its words

    def word_logs(self, v: Vocabulary, rank: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The log of the probability of named tokens within their frequency classes, 0 for all others."""
        out = np.zeros(len(y))
        mine = np.flatnonzero((y >= SINGLE) & (y < SINGLE + FREQUENCY))
        w, c, one, two = rank[mine] - SINGLE, y[mine] - SINGLE, k[0, mine], k[1, mine]
        out[mine] = self.share[w] + self.before[w, one] + self.further[w, two] - self.norms[c, one, two]
        return out


def scaled(words: np.ndarray, one: np.ndarray, two: np.ndarray, both: np.ndarray, turns: int = WORD_TURNS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word factor of one class by iterative scaling: weights by context before and before that, and log normalisers.

    words: counts that stand for a word without context; one, two: (word, context) counts; both: (context, context) counts of the class.
    Each turn moves a weight by half the log ratio of observed to expected counts, both with WORD_PRIOR added.
    """
    a, b, u = np.zeros(one.shape), np.zeros(two.shape), words[:, None]
    for _ in range(turns):
        ea, eb = np.exp(a), np.exp(b)
        each = both / ((u * ea).T @ eb)
        expected_one, expected_two = u * ea * (eb @ each.T), u * eb * (ea @ each)
        a += 0.5 * np.log((one + WORD_PRIOR) / (expected_one + WORD_PRIOR))
        b += 0.5 * np.log((two + WORD_PRIOR) / (expected_two + WORD_PRIOR))
    return a, b, np.log((u * np.exp(a)).T @ np.exp(b))


def flat(known: Vocabulary) -> Model:
    """The model before any training: shares by counts alone."""
    n = known.by_rank()
    words = n[SINGLE:]
    mass = np.ones(CLASSES)
    np.add.at(mass, known.own_class, n)
    mass[SINGLE + FREQUENCY :] = known.places[SINGLE + FREQUENCY :]
    inside = np.bincount(known.own_class[SINGLE:] - SINGLE, weights=words, minlength=FREQUENCY) if len(words) else np.zeros(FREQUENCY)
    norms = np.repeat(np.log(np.maximum(inside, 1.0)), PLACES * PLACES).reshape(FREQUENCY, PLACES, PLACES)
    none = np.zeros((len(words), PLACES))
    return Model(np.zeros((known.features, CLASSES), np.float32), np.log(mass / mass.sum()).astype(np.float32), none, none.copy(), np.log(words), norms)


def train(docs: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> Model:
    """The model of all of docs: counts, the word factor from them, and rounds of gradient updates for the class factor."""
    spark, made = docs.sparkSession, flat(known)
    if not known.total:
        return made
    shared = spark.sparkContext.broadcast(known.short())
    words, wide = len(made.share), known.features * CLASSES
    ends = np.cumsum([wide, words * PLACES, words * PLACES, FREQUENCY * PLACES * PLACES])

    def seen(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        v = shared.value
        h, ending, at = tokens(data, offs)
        _, rank = v.look_up(h)
        return rank, v.classes(rank, ending), features(v, rank, ending, at), at

    def count(total: np.ndarray, data: np.ndarray, offs: np.ndarray) -> None:
        rank, y, f, at = seen(data, offs)
        for row in f:
            np.add.at(total, row * CLASSES + y, 1)
        mine = np.flatnonzero((y >= SINGLE) & (y < SINGLE + FREQUENCY))
        one, two = back(y, at, CLASSES)[:, mine]
        w = (rank[mine] - SINGLE) * PLACES
        np.add.at(total, ends[0] + w + one, 1)
        np.add.at(total, ends[1] + w + two, 1)
        np.add.at(total, ends[2] + ((y[mine] - SINGLE) * PLACES + one) * PLACES + two, 1)

    observed, one, two, both = np.split(summed(docs, int(ends[-1]), count, np.int32), ends[:-1])
    observed, one, two, both = observed.reshape(-1, CLASSES), one.reshape(-1, PLACES), two.reshape(-1, PLACES), both.reshape(FREQUENCY, PLACES, PLACES)
    for c in range(FREQUENCY):
        of = np.flatnonzero(known.own_class[SINGLE:] == SINGLE + c)
        if len(of):
            made.before[of], made.further[of], made.norms[c] = scaled(np.exp(made.share[of]), one[of], two[of], both[c])
    share = np.exp(made.bias.astype(np.float64))
    smooth = observed + PRIOR * share
    kinds = np.repeat(START_WEIGHTS, [known.context, known.context, known.pairs])[:, None]
    weights = (kinds * np.log(smooth / ((observed.sum(axis=1, keepdims=True) + PRIOR) * share))).astype(np.float32)
    # a round has its share of the documents, so fewer partitions send sums
    parts = docs.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0] + 1
    few = max(-(-parts // rounds), min(parts, spark.sparkContext.defaultParallelism))
    for turn in range(rounds):
        now = spark.sparkContext.broadcast(weights)

        def gradient(total: np.ndarray, data: np.ndarray, offs: np.ndarray, now=now, space=[]) -> None:  # noqa: B006
            if not space:
                space.append(Space())
            _, y, f, _ = seen(data, offs)
            total = total.reshape(-1, CLASSES)
            add_gradient(total, now.value, made.bias, f, y, space[0])

        mine = docs.where(F.pmod(F.xxhash64(F.lit("round"), "doc_id", "text"), F.lit(rounds)) == turn).coalesce(few)
        total = summed(mine, wide, gradient, np.float32).reshape(-1, CLASSES)
        weights = (weights - np.clip(RATE * total / (smooth / rounds + LEAST), -1, 1)).astype(np.float32)
        now.destroy()
    made.weights = weights
    return made


def score(docs: DataFrame, counted: DataFrame, known: Vocabulary, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast((known, model))
    names = ["row", "doc_id", "n_tokens", "n_known", "plain", "model", "rare"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shared.value
        inside, space = np.log10(v.places), Space()
        for batch in batches:
            data, offs = utf8(batch.column(2))
            for lo, hi, p, a in blocks(data, offs, BLOCK):
                h, ending, at = tokens(p, a)
                n, rank = v.look_up(h)
                y, f, first = v.classes(rank, ending), features(v, rank, ending, at), at[:-1]
                plain = np.log10(n + 1.0)
                logs = chosen_logs(m.weights, m.bias, f, y, space) + m.word_logs(v, rank, y, back(y, at, CLASSES))
                logs = logs / np.log(10) + np.where(y < SINGLE + FREQUENCY, 0.0, plain - inside[y])
                far = rank < 0
                ends = np.concatenate([[0], np.cumsum(np.add.reduceat(far.astype(np.int64), first))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(at).astype(np.int64)), pa.array(np.add.reduceat((n > 0).astype(np.int64), first)),
                    pa.array(np.add.reduceat(plain, first)), pa.array(np.add.reduceat(logs, first)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[far].view(np.int64)))], names)

    local = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    local = cut(local.mapInArrow(work, "row long, doc_id long, n_tokens long, n_known long, plain double, model double, rare array<long>"), "scored")
    rare = local.select("row", F.explode("rare").alias("token")).join(counted.select("token", "n"), "token")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("add"))
    added = F.coalesce(F.col("add"), F.lit(0.0))
    return local.drop("rare").join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("plain") + added - F.col("n_tokens") * F.lit(float(np.log10(known.total + known.distinct + 1)))).alias("base_score"), (F.col("model") + added).alias("score"),
    )


def scored(docs: DataFrame, learnable: Column) -> DataFrame:
    """Scores for all rows of docs by a model of its learnable ones."""
    learn = docs.where(F.coalesce(learnable, F.lit(False)))
    counted = cut(counts(learn), "counts")
    known = vocabulary(counted)
    return score(docs, counted, known, train(learn, known))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    out = scored(docs, fold(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
