"""Filters over payloads, compiled to columns that Catalyst can push down and prune by.

A payload is a variant column. Conditions are two-valued: a missing payload or field makes a condition false, so that
must_not lets it pass. Matching is strict about types: the number 3 is not the text "3". Dotted keys reach into objects,
``key[]`` means any element of an array, also with a key inside it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _path(key: str) -> str:
    return "$" + "".join(f"['{part}']" for part in key.split("."))


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_integer(value: Column) -> Column:
    return _type(value).rlike("^(TINYINT|SMALLINT|INT|BIGINT)$")


def _text(value: Column) -> Column:
    return F.when(_type(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _number(value: Column) -> Column:
    return F.when(_type(value).rlike(NUMBERS), F.try_variant_get(value, "$", "double"))


class Condition:
    """One test; ``column`` is its truth for a payload, never null."""

    def column(self, payload: Column) -> Column:
        raise NotImplementedError

    def fields(self) -> set[str]:
        return set()


@dataclass
class FieldCondition(Condition):
    """A test of the value at a key."""

    key: str

    def holds(self, value: Column) -> Column:
        raise NotImplementedError

    def column(self, payload: Column) -> Column:
        head, star, tail = self.key.partition("[]")
        value = F.try_variant_get(payload, _path(head), "variant")
        if star:
            items = F.try_variant_get(value, "$", "array<variant>")
            tail = tail.lstrip(".")
            inner = lambda x: F.try_variant_get(x, _path(tail), "variant") if tail else x
            return F.coalesce(F.exists(items, lambda x: F.coalesce(self.holds(inner(x)), F.lit(False))), F.lit(False))
        return F.coalesce(self.holds(value), F.lit(False))

    def fields(self) -> set[str]:
        return {self.key.partition("[]")[0].partition(".")[0]}


@dataclass
class Match(FieldCondition):
    """Equal to a text or whole number, or to any element of an array."""

    value: Any

    def one(self, value: Column) -> Column:
        if isinstance(self.value, bool):
            return (_type(value) == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == self.value)
        if isinstance(self.value, int):
            return _is_integer(value) & (F.try_variant_get(value, "$", "bigint") == self.value)
        return _text(value) == str(self.value)

    def holds(self, value: Column) -> Column:
        items = F.when(_type(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
        return F.coalesce(self.one(value), F.lit(False)) | F.coalesce(F.exists(items, lambda x: F.coalesce(self.one(x), F.lit(False))), F.lit(False))


@dataclass
class MatchAny(FieldCondition):
    """Equal to one of several values."""

    values: list[Any]

    def holds(self, value: Column) -> Column:
        return reduce(lambda a, b: a | b, (Match(self.key, v).holds(value) for v in self.values), F.lit(False))


@dataclass
class MatchInteger(FieldCondition):
    """Equal to a whole number; arrays do not match."""

    value: int

    def holds(self, value: Column) -> Column:
        return _is_integer(value) & (F.try_variant_get(value, "$", "bigint") == self.value)


@dataclass
class MatchText(FieldCondition):
    """A text that contains another, whatever the case."""

    text: str

    def holds(self, value: Column) -> Column:
        return F.lower(_text(value)).contains(self.text.lower())


@dataclass
class Range(FieldCondition):
    """A number within bounds; without bounds, any number."""

    gt: float | None = None
    gte: float | None = None
    lt: float | None = None
    lte: float | None = None

    def holds(self, value: Column) -> Column:
        x = _number(value)
        tests = [x > self.gt if self.gt is not None else None, x >= self.gte if self.gte is not None else None, x < self.lt if self.lt is not None else None, x <= self.lte if self.lte is not None else None]
        return reduce(lambda a, b: a & b, (t for t in tests if t is not None), x.isNotNull())


@dataclass
class Exists(FieldCondition):
    """The key is there, whatever its value."""

    def holds(self, value: Column) -> Column:
        return value.isNotNull()


@dataclass
class IsNull(FieldCondition):
    """The key is there and null."""

    def holds(self, value: Column) -> Column:
        return F.is_variant_null(value)


@dataclass
class IsEmpty(FieldCondition):
    """No key, a null, or an array without elements."""

    def column(self, payload: Column) -> Column:
        value = F.try_variant_get(payload, _path(self.key), "variant")
        return value.isNull() | F.is_variant_null(value) | F.coalesce(F.size(F.try_variant_get(value, "$", "array<variant>")) == 0, F.lit(False))


@dataclass
class HasId(Condition):
    """The row's id is one of a list."""

    ids: list[int]
    id_column: str = "id"

    def column(self, payload: Column) -> Column:
        return F.coalesce(F.col(self.id_column).isin(self.ids), F.lit(False)) if self.ids else F.lit(False)


@dataclass
class Filter(Condition):
    """All of must, any of should (if there are any), none of must_not."""

    must: list[Condition] = field(default_factory=list)
    should: list[Condition] = field(default_factory=list)
    must_not: list[Condition] = field(default_factory=list)

    def column(self, payload: Column) -> Column:
        out = F.lit(True)
        for c in self.must:
            out = out & c.column(payload)
        if self.should:
            out = out & reduce(lambda a, b: a | b, (c.column(payload) for c in self.should))
        for c in self.must_not:
            out = out & ~c.column(payload)
        return out

    def fields(self) -> set[str]:
        return set().union(*(c.fields() for c in [*self.must, *self.should, *self.must_not]))


def where(points: DataFrame, condition: Condition | Column | None, payload: str = "payload") -> DataFrame:
    """The points that a condition lets pass; none: all."""
    if condition is None:
        return points
    return points.where(condition if isinstance(condition, Column) else condition.column(F.col(payload)))


def by_ids(points: DataFrame, ids: DataFrame, id_column: str = "id") -> DataFrame:
    """The points whose id is in a table: the form of HasId for many ids."""
    return points.join(ids.select(id_column).distinct(), id_column, "left_semi")


# The algebra over maps of texts.


class Meta:
    """A test of a map<string,string> column: ``column(map)``, and the fields it names."""

    def __init__(self, column, names: set[str]):
        self.column, self.fields = column, names

    def __and__(self, other: Meta) -> Meta:
        return Meta(lambda m: self.column(m) & other.column(m), self.fields | other.fields)

    def __or__(self, other: Meta) -> Meta:
        return Meta(lambda m: self.column(m) | other.column(m), self.fields | other.fields)

    def __invert__(self) -> Meta:
        return Meta(lambda m: ~self.column(m), self.fields)


def _meta(name: str, test) -> Meta:
    return Meta(lambda m: F.coalesce(test(m[name]), F.lit(False)), {name})


def eq(name: str, value: str) -> Meta:
    return _meta(name, lambda v: v == value)


def ne(name: str, value: str) -> Meta:
    """Another value, or none at all."""
    return ~eq(name, value)


def _numeric(name: str, test) -> Meta:
    return _meta(name, lambda v: test(v.try_cast("double")))


def gt(name: str, value: float) -> Meta:
    return _numeric(name, lambda v: v > value)


def gte(name: str, value: float) -> Meta:
    return _numeric(name, lambda v: v >= value)


def lt(name: str, value: float) -> Meta:
    return _numeric(name, lambda v: v < value)


def lte(name: str, value: float) -> Meta:
    return _numeric(name, lambda v: v <= value)


def among(name: str, values: list[str]) -> Meta:
    return _meta(name, lambda v: v.isin(values))


def contains(name: str, part: str) -> Meta:
    return _meta(name, lambda v: v.contains(part))


def all_of(*tests: Meta) -> Meta:
    return reduce(lambda a, b: a & b, tests, Meta(lambda m: F.lit(True), set()))


def any_of(*tests: Meta) -> Meta:
    return reduce(lambda a, b: a | b, tests, Meta(lambda m: F.lit(False), set()))


def projected(payload: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """A payload with some of its keys only, or without some, as a variant. None of both: as it is."""
    if include is None and not exclude:
        return payload
    entries = F.map_filter(F.try_variant_get(payload, "$", "map<string,variant>"), lambda k, v: k.isin(include) if include is not None else ~k.isin(exclude))
    return F.when(payload.isNotNull(), F.parse_json(F.to_json(entries)))
