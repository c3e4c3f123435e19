"""Nearest neighbours: one query or many, with filters, thresholds, paging and projections; results are exact.

Order is by nearness, then by id. Filters, thresholds and offsets are applied before the limit, so a search returns as
many results as there are up to the limit. A single search is an ordinary plan (filter, score, take ordered): each
partition keeps its own best and only those meet. A batch of searches scores blocks of vectors against blocks of
queries by matrix products and keeps each block's best per query before the one shuffle, by query: what is shuffled
does not grow with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagitta.functions import vectors as V
from sagitta.operators import filters

#: Bytes of queries that go to every executor at once; more are done in turns, a scan each.
QUERY_BYTES = 64 << 20
#: The range of ids that one row of an inverted index covers.
POSTINGS = 100_000
MOST_LIMIT = 10_000
MOST_OFFSET = 1_000_000


@dataclass
class Request:
    """One search."""

    vector: list[float]
    limit: int = 10
    offset: int = 0
    metric: str = "cosine"
    filter: filters.Condition | Column | None = None
    threshold: float | None = None
    with_vector: bool = False
    with_payload: bool | list[str] = False
    exclude_payload: list[str] = field(default_factory=list)

    def check(self, dim: int | None = None) -> None:
        if not self.vector or not all(np.isfinite(self.vector)):
            raise ValueError("the query vector must have finite components")
        if dim is not None and len(self.vector) != dim:
            raise ValueError(f"the query vector has {len(self.vector)} components, not {dim}")
        if not 1 <= self.limit <= MOST_LIMIT:
            raise ValueError(f"limit must be from 1 to {MOST_LIMIT}")
        if not 0 <= self.offset <= MOST_OFFSET:
            raise ValueError(f"offset must be from 0 to {MOST_OFFSET}")


def search(points: DataFrame, request: Request, id_column: str = "id", vector: str = "vector", payload: str = "payload") -> DataFrame:
    """rank (from 1), id, score and distance of the nearest points, and what the request asks for besides."""
    request.check()
    return _found(points, request, id_column, vector, payload)


def _found(points: DataFrame, request: Request, id_column: str = "id", vector: str = "vector", payload: str = "payload") -> DataFrame:
    m = V.metric(request.metric)
    found = filters.where(points, request.filter, payload)
    found = found.withColumn("score", m.value(vector, request.vector)).where("score is not null")
    if request.threshold is not None:
        found = found.where(m.passes("score", request.threshold))
    best = found.orderBy(m.order("score"), id_column).offset(request.offset).limit(request.limit)
    rank = F.row_number().over(Window.orderBy(m.order("score"), id_column)) + request.offset
    distance = 1 - F.col("score") if m is V.COSINE else -F.col("score") if m.more_is_nearer else F.col("score")
    columns = [rank.alias("rank"), F.col(id_column), F.col("score"), distance.alias("distance")]
    if request.with_vector:
        columns.append(F.col(vector))
    if request.with_payload:
        include = request.with_payload if isinstance(request.with_payload, list) else None
        columns.append(filters.projected(F.col(payload), include, request.exclude_payload).alias(payload))
    return best.select(*columns)


def _scores(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows of x against rows of q; more is nearer."""
    if metric == "dot":
        return x @ q.T
    if metric == "cosine":
        nx, nq = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        norms = nx[:, None] * nq
        return np.divide(x @ q.T, norms, out=np.zeros((len(x), len(q))), where=norms > 0)
    if metric == "manhattan":
        return -np.stack([np.abs(x - row).sum(axis=1) for row in q], axis=1)
    squares = np.stack([np.square(x - row).sum(axis=1) for row in q], axis=1)
    return -squares if metric == "squared_l2" else -np.sqrt(squares)


def search_batch(points: DataFrame, queries: DataFrame, limit: int = 10, metric: str = "cosine", id_column: str = "id", vector: str = "vector", query_id: str = "query_id", by: str | None = None, skip_self: bool = False, condition: filters.Condition | Column | None = None, threshold: float | None = None, payload: str = "payload") -> DataFrame:
    """query_id, rank, id and score of each query's nearest points.

    by: a column of both tables; only points that agree with the query in it count. skip_self: a point is no neighbour of
    the query of its own id. condition: only points that it lets pass count; threshold: only scores that reach it. Queries are read in
    blocks of ``QUERY_BYTES``, each of which is sent to the executors and met by one scan of the points.
    """
    m = V.metric(metric)
    name = m.name
    extra = [by] if by else []
    kinds = dict(points.dtypes) | {query_id: dict(queries.dtypes)[query_id]}
    schema = f"{query_id} {kinds[query_id]}, {id_column} {kinds[id_column]}, score double"
    points = filters.where(points, condition, payload)
    rows = queries.select(query_id, vector, *extra).where(F.col(vector).isNotNull())
    parts: list[DataFrame] = []

    def block(held: list) -> DataFrame:
        ids = [r[0] for r in held]
        groups: dict = {}
        for k, r in enumerate(held):
            groups.setdefault((len(r[1]), r[2] if by else None), []).append(k)
        packed = {g: (np.array(k), np.array([held[i][1] for i in k], float)) for g, k in groups.items()}
        shared = points.sparkSession.sparkContext.broadcast((ids, packed))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, sets = shared.value
            for batch in batches:
                point_ids = np.array(batch.column(0).to_pylist(), object)
                raw = batch.column(1)
                size = np.array(raw.value_lengths().fill_null(-1))
                label = np.array(batch.column(2).to_pylist(), object) if by else None
                values = np.asarray(raw.flatten(), dtype=float)
                ends = np.cumsum(np.maximum(size, 0))
                out_q, out_i, out_s = [], [], []
                for (n, want), (which, q) in sets.items():
                    mine = np.flatnonzero((size == n) & ((label == want) if by else True))
                    if not len(mine):
                        continue
                    x = values[(ends[mine] - n)[:, None] + np.arange(n)]
                    for a in range(0, len(which), 256):
                        s = _scores(name, x, q[a : a + 256])
                        k = min(limit + skip_self, len(mine))
                        least = np.partition(s, len(mine) - k, axis=0)[len(mine) - k]
                        for j, w in enumerate(which[a : a + 256]):
                            top = np.flatnonzero(s[:, j] >= least[j])
                            if len(top) > k:  # among equals the smaller ids
                                top = np.array(sorted(top, key=lambda t: (-s[t, j], point_ids[mine[t]]))[:k])  # noqa: B023
                            out_q += [names[w]] * len(top)
                            out_i += point_ids[mine[top]].tolist()
                            out_s.append(s[top, j])
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(out_q), pa.array(out_i), pa.array(np.concatenate(out_s))], [query_id, id_column, "score"])

        return points.select(id_column, vector, *extra).mapInArrow(work, schema)

    held: list = []
    size = 0
    for r in rows.toLocalIterator():
        held.append(r)
        size += 8 * len(r[1]) + 32
        if size >= QUERY_BYTES:
            parts.append(block(held))
            held, size = [], 0
    if held or not parts:
        parts.append(block(held))
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    if skip_self:
        near = near.where(F.col(query_id) != F.col(id_column))
    if threshold is not None:
        near = near.where(m.passes(F.col("score") if m.more_is_nearer else -F.col("score"), threshold))
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id_column))
    sign = F.col("score") if m.more_is_nearer else -F.col("score")
    return near.withColumn("rank", place).where(F.col("rank") <= limit).select(query_id, "rank", id_column, sign.alias("score"))


def explore(collections: dict[str, DataFrame], request: Request, **columns: str) -> DataFrame:
    """The nearest points of several collections together: collection, rank, id, score and distance."""
    m = V.metric(request.metric)
    request.check()
    within = Request(**{**request.__dict__, "limit": request.limit + request.offset, "offset": 0})
    parts = [_found(points, within, **columns).withColumn("collection", F.lit(name)) for name, points in sorted(collections.items())]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    id_column = columns.get("id_column", "id")
    best = union.orderBy(m.order("score"), "collection", id_column).offset(request.offset).limit(request.limit)
    rank = F.row_number().over(Window.orderBy(m.order("score"), "collection", id_column)) + request.offset
    return best.withColumn("rank", rank)


def scroll(points: DataFrame, limit: int, start: int | None = None, condition: filters.Condition | Column | None = None, id_column: str = "id", payload: str = "payload") -> tuple[DataFrame, int | None]:
    """A page of points by ascending id from start on, and the id at which the next page begins (null: none)."""
    rows = filters.where(points if start is None else points.where(F.col(id_column) >= start), condition, payload)
    ids = [r[0] for r in rows.select(id_column).orderBy(id_column).limit(limit + 1).collect()]
    page = rows.where(F.col(id_column) <= ids[min(limit, len(ids)) - 1]) if ids else rows.limit(0)
    return page.orderBy(id_column).limit(limit), ids[limit] if len(ids) > limit else None


def retrieve(points: DataFrame, ids: list[int], id_column: str = "id") -> DataFrame:
    """The points of a list of ids, in its order; ids without a point are left out."""
    order = F.array_position(F.array(*(F.lit(i).cast("long") for i in ids)), F.col(id_column).cast("long"))
    return points.where(F.col(id_column).isin(ids)).withColumn("ordinal", order).orderBy("ordinal")


def similarity_stats(points: DataFrame, query: list[float], vector: str = "vector", metric: str = "cosine") -> DataFrame:
    """mean, least and most of the points' scores against one vector."""
    s = points.select(V.metric(metric).value(vector, query).alias("s"))
    return s.agg(F.avg("s").alias("mean"), F.min("s").alias("least"), F.max("s").alias("most"))


def fused(points: DataFrame, queries: list[list[float]], weights: list[float], limit: int = 10, id_column: str = "id", vector: str = "vector") -> DataFrame:
    """The nearest points by cosine similarity to the weighted sum of several query vectors."""
    score = V.cosine_similarity(vector, V.weighted_sum(queries, weights))
    return points.select(id_column, score.alias("score")).orderBy(F.desc("score"), id_column).limit(limit)


def count(points: DataFrame, condition: filters.Condition | Column | None = None, payload: str = "payload") -> DataFrame:
    return filters.where(points, condition, payload).agg(F.count(F.lit(1)).alias("count"))


def selectivity(points: DataFrame, condition: filters.Condition | Column, payload: str = "payload") -> DataFrame:
    """The share of points that a condition lets pass, 0 for no points."""
    test = condition if isinstance(condition, Column) else condition.column(F.col(payload))
    return points.agg(F.coalesce(F.avg(F.when(test, 1.0).otherwise(0.0)), F.lit(0.0)).alias("selectivity"))


def estimated(kind: str, *parts: float) -> float:
    """The selectivity of a combination, its parts being independent: and, or, not."""
    out = parts[0]
    for p in parts[1:]:
        out = out * p if kind == "and" else out + p - out * p
    return 1 - out if kind == "not" else out


def inverted_index(points: DataFrame, metadata: str = "metadata", id_column: str = "id") -> DataFrame:
    """field, value, block and the ascending ids that have it, from a column of maps.

    Ids go to blocks of ``POSTINGS`` ids' width by their value, so a value of any number of points is many rows.
    """
    pairs = points.select(id_column, F.explode(metadata).alias("field", "value")).withColumn("block", F.floor(F.col(id_column) / POSTINGS))
    return pairs.groupBy("field", "value", "block").agg(F.sort_array(F.collect_set(id_column)).alias("ids"))


def hybrid(points: DataFrame, vector_query: list[float], words: list[str], alpha: float = 0.5, limit: int = 10, text: str = "text", id_column: str = "id", vector: str = "vector") -> DataFrame:
    """alpha times cosine similarity plus (1 - alpha) times the share of the words that the text contains."""
    low = F.lower(text)
    share = sum((low.contains(w.lower()).cast("int") for w in words), F.lit(0)) / max(1, len(words))
    score = alpha * V.cosine_similarity(vector, vector_query) + (1 - alpha) * F.coalesce(share, F.lit(0.0))
    return points.select(id_column, score.alias("score")).orderBy(F.desc("score"), id_column).limit(limit)


def custom(points: DataFrame, query: list[float], similarity, limit: int = 10, id_column: str = "id", vector: str = "vector") -> DataFrame:
    """The search by any measure: a function of two vector columns, more of which is nearer."""
    score = similarity(F.col(vector), V.column(query))
    return points.select(id_column, score.alias("score")).orderBy(F.desc("score"), id_column).limit(limit)
