"""Quantisers: scalar, eight-bit, binary and product codes, residual codes, and search on codes with exact re-ranking.

Scalar and binary codes are expressions. Codebooks are trained on the driver from a bounded sample of rows, whose
size is a parameter; encoding and searching run over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagitta.functions import vectors as V

TRAIN_ROWS = 50_000
#: Compression ratios by name.
RATIOS = {"x4": 4, "x8": 8, "x16": 16, "x32": 32, "x64": 64}


def binary_codes(v: V.Vector) -> Column:
    """One bit for each component, set if it is positive, eight to a whole number, the first in the lowest bit."""
    v = V.column(v)
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / 8).cast("int") - 1, F.lit(0)))
    octet = lambda k: F.aggregate(F.slice(v, k * 8 + 1, F.lit(8)), F.struct(F.lit(0).alias("s"), F.lit(1).alias("w")), lambda a, x: F.struct((a.s + F.when(x > 0, a.w).otherwise(0)).alias("s"), (a.w * 2).alias("w")), lambda a: a.s)
    return F.when(F.size(v) > 0, F.transform(at, octet)).otherwise(F.array().cast("array<int>"))


def bounds(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """The least and greatest value of each component, as two arrays in one row."""
    each = rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    sorted_ = F.sort_array(F.collect_list(F.struct("pos", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))))
    return each.agg(sorted_.alias("s")).select(F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))


def scalar_codes(v: V.Vector, lo: list[float], hi: list[float], bits: int = 8) -> Column:
    """Each component's place between its bounds, cut to a whole number; a component without a span is 0."""
    if bits not in (4, 8):
        raise ValueError("bits are 4 or 8")
    top = 2**bits - 1
    spans = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(lo, hi, strict=True)))

    def code(x: Column, s: Column) -> Column:
        share = (x.cast("double") - s.a) / (s.b - s.a)
        return F.when(s.b > s.a, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * top)).otherwise(0).cast("int")

    return F.zip_with(V.column(v), spans, code)


def packed_nibbles(codes: Column) -> Column:
    """Codes of four bits, two to a whole number, the first one high."""
    at = F.sequence(F.lit(0), F.ceil(F.size(codes) / 2).cast("int") - 1)
    return F.transform(at, lambda k: F.get(codes, k * 2) * 16 + F.coalesce(F.get(codes, k * 2 + 1), F.lit(0)))


def scalar_decoded(codes: Column, lo: list[float], hi: list[float], bits: int = 8) -> Column:
    spans = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(lo, hi, strict=True)))
    return F.zip_with(codes, spans, lambda c, s: s.a + c / float(2**bits - 1) * (s.b - s.a))


def int8_codes(v: V.Vector, scale: float, offset: float = 0.0) -> Column:
    """(component - offset) * scale, rounded half away from zero, from -128 to 127."""
    return F.transform(V.column(v), lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.round((x.cast("double") - offset) * scale))).cast("int"))


def sample(rows: DataFrame, vector: str, n: int = TRAIN_ROWS, id_column: str = "id") -> np.ndarray:
    """At most about n vectors, chosen by a hash of the id, in order of id."""
    total = rows.count()
    part = F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) / float(1 << 30)
    got = rows.where(part < n / max(1, total)).select(id_column, vector).toPandas().sort_values(id_column)
    return np.array(got[vector].tolist(), float)


def k_means(x: np.ndarray, k: int, turns: int = 20) -> np.ndarray:
    """Centres that start from the first row and, in turn, the row farthest from all so far; then Lloyd's iterations."""
    chosen = [0]
    far = np.square(x - x[0]).sum(1)
    while len(chosen) < min(k, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.square(x - x[chosen[-1]]).sum(1))
    centres = x[chosen].copy()
    for _ in range(turns):
        own = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(centres))
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        if np.allclose(moved, centres, rtol=0, atol=1e-12):
            break
        centres = moved
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.square(centres).sum(1) - 2 * x @ centres.T).argmin(1)


@dataclass
class Product:
    """A product quantiser: for each part of the components a codebook of centres."""

    books: list[np.ndarray]

    @classmethod
    def train(cls, x: np.ndarray, parts: int = 8, centres: int = 256, turns: int = 20) -> Product:
        if x.shape[1] % parts:
            raise ValueError("the dimension must be a multiple of the number of parts")
        return cls([k_means(p, centres, turns) for p in np.split(x, parts, axis=1)])

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest(p, b) for p, b in zip(np.split(x, len(self.books), axis=1), self.books, strict=True)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[c] for b, c in zip(self.books, codes.T, strict=True)], axis=1)

    def table(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of a query's parts to all centres."""
        return np.stack([np.square(b - p).sum(1) for b, p in zip(self.books, np.split(q, len(self.books)), strict=True)])

    def ratio(self) -> float:
        """Bytes of a vector of four-byte components for each byte of its code."""
        return sum(b.shape[1] for b in self.books) * 4 / len(self.books)


@dataclass
class Residual:
    """Quantisers one after another, each for what the ones before leave over."""

    books: list[np.ndarray]

    @classmethod
    def train(cls, x: np.ndarray, stages: int = 2, centres: int = 64, turns: int = 20) -> Residual:
        books, left = [], x.copy()
        for _ in range(stages):
            books.append(k_means(left, centres, turns))
            left = left - books[-1][nearest(left, books[-1])]
        return cls(books)

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes, left = [], x
        for b in self.books:
            codes.append(nearest(left, b))
            left = left - b[codes[-1]]
        return np.stack(codes, axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(b[c] for b, c in zip(self.books, codes.T, strict=True))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def encoded(rows: DataFrame, quantiser: Product | Residual, id_column: str = "id", vector: str = "vector") -> DataFrame:
    """id, codes and error (the squared distance of the vector to its reconstruction)."""
    shared = rows.sparkSession.sparkContext.broadcast(quantiser)
    kind = dict(rows.dtypes)[id_column]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                codes = shared.value.encode(x)
                error = np.square(x - shared.value.decode(codes)).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(error)], [id_column, "codes", "error"])

    return rows.where(F.col(vector).isNotNull()).select(id_column, vector).mapInArrow(work, f"{id_column} {kind}, codes array<int>, error double")


def code_distance(codes: Column, table: np.ndarray) -> Column:
    """The distance of a query, by its table, to the vectors that codes stand for."""
    books = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in table))
    return F.sqrt(F.aggregate(F.zip_with(codes, books, lambda c, b: F.get(b, c)), F.lit(0.0), lambda s, x: s + x))


def reranked(rows: DataFrame, codes: DataFrame, quantiser: Product, query: list[float], limit: int = 10, oversampling: float = 4.0, id_column: str = "id", vector: str = "vector") -> DataFrame:
    """The nearest rows by exact distance among the limit * oversampling nearest by codes."""
    coarse = codes.select(id_column, code_distance(F.col("codes"), quantiser.table(np.array(query, float))).alias("coarse")).orderBy("coarse", id_column).limit(int(limit * oversampling))
    exact = rows.join(F.broadcast(coarse), id_column)
    return exact.select(id_column, V.euclidean(vector, query).alias("distance")).orderBy("distance", id_column).limit(limit)


def deltas(neighbours: Column) -> Column:
    """An ascending list as its first value and the steps from one to the next."""
    return F.transform(neighbours, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(neighbours, i - 1)))


def from_deltas(steps: Column) -> Column:
    return F.transform(steps, lambda x, i: F.aggregate(F.slice(steps, F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, y: s + y))


@dataclass
class Additive:
    """A vector as a sum of one centre from each of several books, found by a beam search over all of them."""

    books: list[np.ndarray]
    beam: int = 16

    @classmethod
    def train(cls, x: np.ndarray, stages: int = 2, centres: int = 64, turns: int = 20, beam: int = 16) -> Additive:
        return cls(Residual.train(x, stages, centres, turns).books, beam)

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes, left = np.zeros((len(x), 1, 0), int), x[:, None, :]
        for b in self.books:
            d = np.square(left).sum(2)[:, :, None] - 2 * left @ b.T + np.square(b).sum(1)
            flat = d.reshape(len(x), -1)
            best = np.argsort(flat, axis=1, kind="stable")[:, : self.beam]
            at, c = best // len(b), best % len(b)
            codes = np.concatenate([np.take_along_axis(codes, at[:, :, None], 1), c[:, :, None]], axis=2)
            left = np.take_along_axis(left, at[:, :, None], 1) - b[c]
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(b[c] for b, c in zip(self.books, codes.T, strict=True))


@dataclass
class Stacked:
    """Product codes of a vector, then of what they leave over."""

    layers: list[Product]

    @classmethod
    def train(cls, x: np.ndarray, layers: int = 2, parts: int = 4, centres: int = 16, turns: int = 20) -> Stacked:
        made, left = [], x
        for _ in range(layers):
            made.append(Product.train(left, parts, centres, turns))
            left = left - made[-1].decode(made[-1].encode(left))
        return cls(made)

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes, left = [], x
        for layer in self.layers:
            codes.append(layer.encode(left))
            left = left - layer.decode(codes[-1])
        return np.concatenate(codes, axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(layer.decode(c) for layer, c in zip(self.layers, np.split(codes, len(self.layers), axis=1), strict=True))
