"""Records on their way in: transformations, validation and the extraction of vectors from JSON.

A record is an id, a vector of floats and metadata, a map<string,string> or a JSON text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of a valid record.
KEY = r"^[a-zA-Z_][a-zA-Z0-9_]*$"
BAD_ID = r"[/\\?%*:|\"<>\x00]"
MOST_METADATA_BYTES = 1024 * 1024
MOST_TEXT_BYTES = 10_000
MOST_ELEMENTS = 1000
MOST_KEYS = 100
MOST_ID = 255
TINY, HUGE = 1e-6, 1000.0
# Names under which sources keep a record's parts; the first that is there counts.
ID_NAMES = ["id", "_id", "uuid"]
VECTOR_NAMES = ["vector", "embedding", "embeddings", "vec"]
METADATA_NAMES = ["metadata", "payload"]
# How much longer a strategy takes than a plain copy.
STRATEGIES = {"stop_and_copy": 1.0, "dual_write": 2.5, "blue_green": 2.0, "incremental": 1.5}


def renamed(metadata: Column, old: str, new: str) -> Column:
    """A key under another name; it replaces what that name had."""
    moved = F.map_concat(F.map_filter(metadata, lambda k, v: ~k.isin(old, new)), F.create_map(F.lit(new), metadata[old]))
    return F.when(F.map_contains_key(metadata, old), moved).otherwise(metadata)


def mapped(metadata: Column, key: str, values: dict[str, str]) -> Column:
    """A key's value replaced by what a table has for it, if anything."""
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair)) if values else None
    if table is None:
        return metadata
    return F.transform_values(metadata, lambda k, v: F.when(k == key, F.coalesce(table[v], v)).otherwise(v))


def converted(value: Column, how: str) -> Column:
    """A text as a number, a number as a text, an array as a text with commas, or such a text as an array."""
    if how == "string_to_number":
        return value.try_cast("double")
    if how == "number_to_string":
        return value.cast("string")
    if how == "array_to_string":
        return F.array_join(value, ",")
    if how == "string_to_array":
        return F.transform(F.split(value, ","), lambda x: F.trim(x))
    raise ValueError(f"unknown conversion: {how}")


def reduced(vector: Column, n: int) -> Column:
    """The first n components."""
    return F.slice(vector, 1, n)


def field_test(value: Column, how: str, argument=None) -> Column:
    """exists, not_null, min_length, max_length or regex, never null."""
    tests = {"exists": lambda: value.isNotNull(), "not_null": lambda: value.isNotNull(), "min_length": lambda: F.length(value) >= argument, "max_length": lambda: F.length(value) <= argument, "regex": lambda: value.rlike(argument)}
    if how not in tests:
        raise ValueError(f"unknown test: {how}")
    return F.coalesce(tests[how](), F.lit(False))


def numeric_id(text: Column) -> Column:
    """A text id as a whole number: itself if it is one, else its hash."""
    return F.coalesce(text.try_cast("bigint"), F.xxhash64(text))


def errors(id_: Column, vector: Column, metadata: Column, dim: int | None = None) -> Column:
    """What makes a record invalid, an array of names; empty for a valid one. metadata: a map of texts."""
    size = F.octet_length(F.to_json(metadata))
    infinite = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    tests = {
        "empty id": F.coalesce(id_ == "", F.lit(True)),
        "long id": F.length(id_) > MOST_ID,
        "bad id": id_.rlike(BAD_ID),
        "empty vector": F.coalesce(F.size(vector) == 0, F.lit(True)),
        "dimension": F.size(vector) != dim if dim is not None else F.lit(False),
        "not finite": infinite,
        "bad key": F.exists(F.map_keys(metadata), lambda k: ~k.rlike(KEY)),
        "many keys": F.size(metadata) > MOST_KEYS,
        "long text": F.exists(F.map_values(metadata), lambda v: F.octet_length(v) > MOST_TEXT_BYTES),
        "large metadata": size > MOST_METADATA_BYTES,
    }
    return F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())), lambda x: x.isNotNull())


def metadata_errors(payload: Column) -> Column:
    """What makes metadata of any JSON (a variant) invalid, an array of names; empty for a valid one, or none.

    A text may have MOST_TEXT_BYTES, an array MOST_ELEMENTS, an object MOST_KEYS, whose names are checked too, and the whole MOST_METADATA_BYTES as JSON.
    """
    fields = F.try_variant_get(payload, "$", "map<string,variant>")
    values = F.map_values(fields)
    items = lambda v: F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")), F.lit(0))
    inner = lambda v: F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    kind = lambda v, k: F.schema_of_variant(v).startswith(k)
    bad = lambda k: ~k.rlike(KEY)
    tests = {
        "no object": ~F.schema_of_variant(payload).startswith("OBJECT") & ~F.is_variant_null(payload),
        "bad key": F.exists(F.map_keys(fields), bad) | F.exists(values, lambda v: kind(v, "OBJECT") & F.exists(inner(v), bad)),
        "many keys": (F.size(fields) > MOST_KEYS) | F.exists(values, lambda v: kind(v, "OBJECT") & (F.size(inner(v)) > MOST_KEYS)),
        "long text": F.exists(values, lambda v: kind(v, "STRING") & (F.octet_length(F.try_variant_get(v, "$", "string")) > MOST_TEXT_BYTES)),
        "long array": F.exists(values, lambda v: kind(v, "ARRAY") & (items(v) > MOST_ELEMENTS)),
        "large metadata": json_size(payload) > MOST_METADATA_BYTES,
    }
    return F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())), lambda x: x.isNotNull())


def json_size(payload: Column) -> Column:
    """The bytes of a variant as compact JSON."""
    return F.octet_length(F.to_json(payload))


def warnings(vector: Column) -> Column:
    """zero, tiny or huge by magnitude; null for an ordinary vector."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size == 0, "zero").when(size < TINY, "tiny").when(size > HUGE, "huge")


def first_of_id(records: DataFrame, id_column: str, position: str) -> DataFrame:
    """records with a column duplicate: whether an earlier record has the id."""
    return records.withColumn("duplicate", F.row_number().over(Window.partitionBy(id_column).orderBy(position)) > 1)


def report(records: DataFrame, found: str = "errors", duplicate: str = "duplicate") -> DataFrame:
    """total, valid, invalid and duplicate records, with the shares of each."""
    bad = F.size(found) > 0
    out = records.agg(F.count(F.lit(1)).alias("total"), F.count_if(~bad & ~F.col(duplicate)).alias("valid"), F.count_if(bad).alias("invalid"), F.count_if(duplicate).alias("duplicates"))
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    return out.withColumns({"success_rate": share("valid"), "error_rate": share("invalid"), "duplicate_rate": share("duplicates")})


def json_type(value: Column) -> Column:
    """String, Number, Boolean, Array, Object or Null: the type of a variant."""
    t = F.schema_of_variant(value)
    return F.when(t == "STRING", "String").when(t == "BOOLEAN", "Boolean").when(t.startswith("ARRAY"), "Array").when(t.startswith("OBJECT"), "Object").when(t == "VOID", "Null").otherwise("Number")


def schema_errors(payload: Column, schema: dict[str, str], strict: bool = True) -> Column:
    """Against field types: missing, of another type, and (if strict) unexpected fields. A null counts as a String."""
    tests = []
    for name, kind in schema.items():
        value = F.try_variant_get(payload, f"$['{name}']", "variant")
        real = F.when(json_type(value) == "Null", "String").otherwise(json_type(value))
        tests.append(F.when(value.isNull(), F.lit(f"missing {name}")).when(real != kind, F.lit(f"type of {name}")))
    found = F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")
    if strict:
        keys = F.map_keys(F.try_variant_get(payload, "$", "map<string,variant>"))
        other = F.transform(F.sort_array(F.filter(keys, lambda k: ~k.isin(list(schema)))), lambda k: F.concat(F.lit("unexpected "), k))
        found = F.concat(found, F.coalesce(other, F.array().cast("array<string>")))
    return found


def vector_of(payload: Column, names: list[str] = VECTOR_NAMES) -> Column:
    """The vector in a JSON payload (variant): an array under the first of the names that has one."""
    return F.coalesce(*(F.try_variant_get(payload, f"$['{n}']", "array<float>") for n in names))


def resolved(rows: DataFrame) -> DataFrame:
    """rows of any of the usual column names as id (text), vector and metadata (JSON text or null)."""
    def found(names: list[str]) -> str | None:
        return next((n for n in names if n in rows.columns), None)

    id_, vector, meta = found(ID_NAMES), found(VECTOR_NAMES), found(METADATA_NAMES)
    if id_ is None or vector is None:
        raise ValueError("no column with an id or a vector")
    kind = dict(rows.dtypes).get(meta) if meta else None
    text = F.lit(None).cast("string") if meta is None else F.col(meta) if kind == "string" else F.to_json(F.col(meta))
    return rows.select(F.col(id_).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"), text.alias("metadata"))


def differences(source: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Records that two tables of the same columns do not share: the key and missing, unexpected or different."""
    others = [c for c in source.columns if c != key]
    side = lambda df, p: df.select(F.col(key), F.struct(*others).alias(p))
    both = side(source, "_s").join(side(target, "_t"), key, "full_outer")
    how = F.when(F.col("_t").isNull(), "missing").when(F.col("_s").isNull(), "unexpected").when(F.col("_s") != F.col("_t"), "different")
    return both.select(key, how.alias("difference")).where("difference is not null")


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """rate (a second), share and remaining seconds of a copy, as a struct."""
    rate = F.when(seconds > 0, done / seconds).otherwise(0.0)
    return F.struct(rate.alias("rate"), F.when(total > 0, done / total).otherwise(0.0).alias("share"), F.when(rate > 0, (total - done) / rate).alias("remaining"))


def estimated_seconds(records: Column, strategy: str, rate: float = 1000.0) -> Column:
    return records / rate * STRATEGIES[strategy]


def duration(seconds: Column) -> Column:
    """Hours, minutes and seconds as text, without leading parts that are zero."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    part = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    return F.when(h > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"), part(s % 60, "s"))).when(m > 0, F.concat_ws(" ", part(m, "m"), part(s % 60, "s"))).otherwise(part(s, "s"))
