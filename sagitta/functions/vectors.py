"""Distances and other functions of vectors, as columns. Sums run in double precision, in the order of the components.

A null vector gives null. Vectors of unequal length give null too (``calculate`` raises instead). A zero vector has
similarity 0 to every vector, cosine distance 1, and stays as it is when normalised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column | str | Iterable[float]


def column(v: Vector) -> Column:
    """A column of a column, its name, or the components of a constant vector."""
    if isinstance(v, str):
        return F.col(v)
    return v if isinstance(v, Column) else F.array(*(F.lit(float(x)) for x in v))


def _double(x: Column) -> Column:
    return x.cast("double")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _paired(a: Vector, b: Vector, f: Callable[[Column, Column], Column]) -> Column:
    a, b = column(a), column(b)
    return F.when(F.size(a) == F.size(b), total(F.zip_with(a, b, lambda x, y: f(_double(x), _double(y)))))


def dim(v: Vector) -> Column:
    return F.size(column(v))


def dot(a: Vector, b: Vector) -> Column:
    return _paired(a, b, lambda x, y: x * y)


def squared_l2(a: Vector, b: Vector) -> Column:
    return _paired(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Vector, b: Vector) -> Column:
    return F.sqrt(squared_l2(a, b))


def manhattan(a: Vector, b: Vector) -> Column:
    return _paired(a, b, lambda x, y: F.abs(x - y))


def norm(v: Vector) -> Column:
    return F.sqrt(total(F.transform(column(v), lambda x: _double(x) * _double(x))))


def cosine_similarity(a: Vector, b: Vector) -> Column:
    return _over(dot(a, b), norm(a) * norm(b))


def _over(inner: Column, norms: Column) -> Column:
    """inner / norms, each evaluated once; 0 for norms of 0."""
    return F.coalesce(F.try_divide(inner, norms), F.when(inner.isNotNull(), 0.0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for a row, also where a lambda inside body uses it for every element."""
    return F.transform(F.array(value), body)[0]


def cosine_distance(a: Vector, b: Vector) -> Column:
    return 1 - cosine_similarity(a, b)


def normalize(v: Vector) -> Column:
    v = column(v)
    return let(norm(v), lambda size: F.when(size > 0, F.transform(v, lambda x: _double(x) / size)).otherwise(F.transform(v, _double)))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Bits in which two arrays of whole numbers differ."""
    a, b = column(a), column(b)
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x))


def add(a: Vector, b: Vector) -> Column:
    return F.zip_with(column(a), column(b), lambda x, y: _double(x) + _double(y))


def subtract(a: Vector, b: Vector) -> Column:
    return F.zip_with(column(a), column(b), lambda x, y: _double(x) - _double(y))


def scale(v: Vector, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(column(v), lambda x: _double(x) * by)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def ones(n: int) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def random(n: int, seed: int) -> Column:
    """n components from -1 to 1, other ones in each row."""
    return F.array(*(F.rand(seed + k) * 2 - 1 for k in range(n)))


def weighted_sum(vectors: list[Vector], weights: list[float]) -> Column:
    """The fusion of embeddings of several kinds: the sum of weight times vector."""
    if len(vectors) != len(weights) or not vectors:
        raise ValueError("as many weights as vectors are needed, one at least")
    out = scale(vectors[0], weights[0])
    for v, w in zip(vectors[1:], weights[1:], strict=True):
        out = add(out, scale(v, w))
    return out


class Metric:
    """A measure of nearness: its value, whether more of it is nearer, and the names under which requests know it."""

    def __init__(self, name: str, value: Callable[[Vector, Vector], Column], more_is_nearer: bool):
        self.name, self.value, self.more_is_nearer = name, value, more_is_nearer

    def order(self, score: Column | str) -> Column:
        score = column(score)
        return score.desc_nulls_last() if self.more_is_nearer else score.asc_nulls_last()

    def passes(self, score: Column | str, threshold: float) -> Column:
        return column(score) >= threshold if self.more_is_nearer else column(score) <= threshold


COSINE = Metric("cosine", cosine_similarity, True)
DOT = Metric("dot", dot, True)
EUCLIDEAN = Metric("euclidean", euclidean, False)
MANHATTAN = Metric("manhattan", manhattan, False)
SQUARED = Metric("squared_l2", squared_l2, False)

#: The names of metrics in the requests of the dialects.
NAMES = {
    "l2": EUCLIDEAN, "euclid": EUCLIDEAN, "euclidean": EUCLIDEAN, "l2-squared": SQUARED,
    "ip": DOT, "dot": DOT, "cosine": COSINE, "manhattan": MANHATTAN, "l1": MANHATTAN,
}


def metric(name: str | Metric) -> Metric:
    """A metric by name, in any case; an unknown name is cosine."""
    return name if isinstance(name, Metric) else NAMES.get(name.lower(), COSINE)


def calculate(name: str | Metric, a: Vector, b: Vector) -> Column:
    """The distance of two vectors (dot: the product): an error for unequal lengths."""
    m = metric(name)
    value = cosine_distance(a, b) if m is COSINE else m.value(a, b)
    return F.when(dim(a) == dim(b), value).otherwise(F.raise_error(F.lit("vectors of unequal length")).cast("double"))


def text_vector(text: Column | str, width: int = 512) -> Column:
    """A fixed encoding of a text: component i is (code point + i) / 1000, zeros after its end."""
    letters = F.slice(F.split(column(text), ""), 1, width)
    codes = F.transform(F.filter(letters, lambda c: c != ""), lambda c, i: (F.ascii(c) + i) / 1000.0)
    return F.concat(codes, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(codes)))
