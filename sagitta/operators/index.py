"""Indexes: inverted lists by centroid, random hyperplanes, advice on which to use, and a learned index of keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagitta.functions import vectors as V
from sagitta.operators import ordering, quantize


@dataclass
class Lists:
    """Inverted lists: every row belongs to its nearest centroid."""

    centroids: np.ndarray

    @classmethod
    def train(cls, rows: DataFrame, lists: int = 100, turns: int = 20, sample_rows: int = quantize.TRAIN_ROWS, id_column: str = "id", vector: str = "vector") -> Lists:
        """Centroids from a bounded sample of the rows."""
        return cls(quantize.k_means(quantize.sample(rows, vector, sample_rows, id_column), lists, turns))

    def assigned(self, rows: DataFrame, vector: str = "vector", probes: int = 0) -> DataFrame:
        """rows with a column list; written partitioned by it, a search reads the probed lists only.

        probes: an array of so many nearest lists instead, for queries.
        """
        shared = rows.sparkSession.sparkContext.broadcast(self.centroids)
        if probes:

            @F.pandas_udf("array<int>")
            def nearest(v):
                import pandas as pd

                if not len(v):
                    return pd.Series([], dtype=object)
                c = shared.value
                d = np.square(c).sum(1) - 2 * np.array(v.tolist(), float) @ c.T
                return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)))

            return rows.withColumn("list", nearest(F.col(vector)))

        @F.pandas_udf("int")
        def own(v):
            import pandas as pd

            return pd.Series(quantize.nearest(np.array(v.tolist(), float), shared.value) if len(v) else [], dtype="int32")

        return rows.withColumn("list", own(F.col(vector)))

    def probed(self, query: list[float], probes: int) -> list[int]:
        d = np.square(self.centroids - np.array(query)).sum(1)
        return [int(i) for i in np.argsort(d, kind="stable")[:probes]]

    def search(self, assigned: DataFrame, query: list[float], limit: int = 10, probes: int = 10, metric: str = "euclidean", id_column: str = "id", vector: str = "vector") -> DataFrame:
        m = V.metric(metric)
        near = assigned.where(F.col("list").isin(self.probed(query, probes)))
        return near.select(id_column, m.value(vector, query).alias("score")).orderBy(m.order("score"), id_column).limit(limit)

    def search_codes(self, assigned: DataFrame, codes: DataFrame, quantiser: quantize.Product, query: list[float], limit: int = 10, probes: int = 10, oversampling: float = 4.0, id_column: str = "id", vector: str = "vector") -> DataFrame:
        """The nearest of the probed lists' rows by product codes (id and codes), re-ranked by exact distances: id and distance."""
        near = assigned.where(F.col("list").isin(self.probed(query, probes)))
        return quantize.reranked(near, codes.join(near.select(id_column), id_column, "left_semi"), quantiser, query, limit, oversampling, id_column, vector)


def recall(points: DataFrame, queries: DataFrame, lists: Lists, limit: int = 10, probes: int = 8, id_column: str = "id", vector: str = "vector") -> DataFrame:
    """queries and recall: the share of the truly nearest points (Euclidean) that probing so many lists finds, over all queries.

    queries: query_id and vector. Both searches are batches over blocks; the probed lists of a query are looked up once.
    """
    from sagitta.operators import search

    exact = search.search_batch(points, queries, limit, "euclidean", id_column, vector)
    probed = lists.assigned(queries.select("query_id", vector), vector, probes).withColumn("list", F.explode("list"))
    near = search.search_batch(lists.assigned(points, vector), probed, limit, "euclidean", id_column, vector, by="list")
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("score", id_column))).where(F.col("place") <= limit)
    hit = exact.select("query_id", id_column).join(best.select("query_id", id_column, F.lit(1).alias("hit")), ["query_id", id_column], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def hyperplanes(rows: DataFrame, dim: int, bits: int = 16, tables: int = 4, seed: int = 1, id_column: str = "id", vector: str = "vector") -> DataFrame:
    """id, table and bucket: the sides of random hyperplanes on which the vector lies."""
    planes = np.random.default_rng(seed).normal(size=(dim, tables * bits))
    shared = rows.sparkSession.sparkContext.broadcast(planes)
    kind = dict(rows.dtypes)[id_column]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                side = (quantize.matrix(batch.column(1)) @ shared.value > 0).reshape(-1, tables, bits)
                bucket = (side * (1 << np.arange(bits, dtype=np.int64))).sum(2)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), tables)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)), pa.array(bucket.ravel())], [id_column, "table", "bucket"])

    return rows.where(F.col(vector).isNotNull()).select(id_column, vector).mapInArrow(work, f"{id_column} {kind}, table int, bucket long")


def bucket_search(rows: DataFrame, query: list[float], limit: int = 10, metric: str = "euclidean", bits: int = 8, tables: int = 12, seed: int = 1, id_column: str = "id", vector: str = "vector") -> DataFrame:
    """The nearest rows that share a hyperplane bucket with the query in any table: id and score. More tables, more found.

    The sides are computed for all rows here; ``hyperplanes`` makes a table of them that may be kept, bucketed by table and bucket.
    """
    m, planes = V.metric(metric), np.random.default_rng(seed).normal(size=(len(query), tables * bits))
    own = ((np.array(query, float) @ planes > 0).reshape(tables, bits) * (1 << np.arange(bits))).sum(1)
    buckets = hyperplanes(rows, len(query), bits, tables, seed, id_column, vector)
    mine = F.create_map(*(F.lit(int(x)) for pair in enumerate(own) for x in pair))
    near = buckets.where(F.col("bucket") == mine[F.col("table")]).select(id_column).distinct()
    return rows.join(near, id_column, "left_semi").select(id_column, m.value(vector, query).alias("score")).orderBy(m.order("score"), id_column).limit(limit)


def advice(points: int, dim: int, memory_mb: float | None = None) -> str:
    """Which search suits so many points: flat to 10,000, lists to a million, product codes where memory falls short."""
    if points <= 10_000:
        return "flat"
    if memory_mb is not None and points * dim * 4 / 2**20 > memory_mb:
        return "lists with product codes"
    return "lists" if points <= 1_000_000 else "lists, high recall"


def learned(rows: DataFrame, key: str, pieces: int = 4) -> DataFrame:
    """A piecewise linear map from keys to their ranks (from 0): piece, lowest key, slope and intercept of each.

    Ranks come from counts of distinct keys; a key that occurs often has its first rank.
    """
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordering.running(counted, [], [key], {"_end": F.col("_n"), "_no": F.lit(1).cast("long")})
    n = ranked.agg(F.coalesce(F.max("_no"), F.lit(0))).first()[0]
    # equal pieces of distinct keys, the first ones greater by one
    small, larger = divmod(n, pieces)
    at = F.col("_no") - 1
    piece = F.when(at < larger * (small + 1), F.floor(at / (small + 1))).otherwise(larger + F.floor((at - larger * (small + 1)) / max(small, 1))) + 1
    ranked = ranked.withColumns({"_rank": (F.col("_end") - F.col("_n")).cast("double"), "piece": piece.cast("int")})
    fit = ranked.groupBy("piece").agg(F.min(key).alias("low"), F.regr_slope("_rank", key).alias("slope"), F.regr_intercept("_rank", key).alias("intercept"), F.min("_rank").alias("first"))
    return fit.select("piece", "low", F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("intercept", "first").alias("intercept"))


def predicted(model: list, key: Column) -> Column:
    """The rank that a model of ``learned`` (collected) predicts for a key, 0 at least, cut to a whole number."""
    out = None
    for piece in sorted(model, key=lambda r: -r.low):
        value = F.floor(F.greatest(F.lit(0.0), key * piece.slope + piece.intercept))
        out = F.when(key >= piece.low, value) if out is None else out.when(key >= piece.low, value)
    return out.otherwise(0).cast("long")
