"""Records in files: JSON lines, Parquet, CSV and a binary format, read and written by Spark's own readers or a data source.

A record has id (text), vector (floats) and metadata (a JSON text or null).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagitta.functions import records
from sagitta.sources import binary, files

#: Formats by the endings of file names.
ENDINGS = {"jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "h5": "hdf5", "hdf5": "hdf5", "bin": "binary", "binary": "binary", "csv": "csv"}


def format_of(path: str) -> str | None:
    return ENDINGS.get(os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower())


def read_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records from JSON objects, one a line, blank lines apart: fields besides id and vector are metadata.

    Strict: a line that is no such record is an error. Otherwise ids may be numbers or under _id, one without is
    "unknown", and a missing vector is empty.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select((F.parse_json("value") if strict else F.try_parse_json("value")).alias("v"))
    names = ["id"] if strict else ["id", "_id"]
    id_ = F.coalesce(*(F.try_variant_get("v", f"$.{n}", "string") for n in names))
    vector = records.vector_of(F.col("v"), ["vector"] if strict else records.VECTOR_NAMES)
    if strict:
        id_ = F.when(F.schema_of_variant(F.try_variant_get("v", "$.id", "variant")) == "STRING", id_).otherwise(F.raise_error(F.lit("a record needs a text id")))
        vector = F.coalesce(vector, F.raise_error(F.lit("a record needs a vector")).cast("array<float>"))
    else:
        id_, vector = F.coalesce(id_, F.lit("unknown")), F.coalesce(vector, F.array().cast("array<float>"))
    rest = F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, _: ~k.isin([*names, *records.VECTOR_NAMES]))
    flat = F.when(F.size(rest) > 0, F.to_json(rest))
    return parsed.select(id_.alias("id"), vector.alias("vector"), flat.alias("metadata"))


def _json_line() -> Column:
    """id, vector and metadata's fields in one object."""
    head = F.to_json(F.struct("id", "vector"))
    meta = F.trim(F.coalesce("metadata", F.lit("{}")))
    return F.when(meta.rlike(r"^\{\s*\}$"), head).otherwise(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(","), F.substr(meta, F.lit(2))))


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.select(_json_line().alias("value")).write.text(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return records.resolved(spark.read.parquet(path))


def write_parquet(rows: DataFrame, path: str) -> None:
    rows.select("id", "vector", "metadata").write.option("compression", "zstd").parquet(path)


def _cell(value: Column) -> Column:
    """A cell as JSON: a number, a truth value or a text."""
    number = value.try_cast("double").isNotNull() & value.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+)\s*$")
    quoted = F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', "$1")
    return F.when(number, F.regexp_replace(F.trim(value), r"^\+|^0+(?=[0-9])", "")).when(F.lower(value).isin("true", "false"), F.lower(value)).otherwise(quoted)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records from a CSV with a header: the vector as a JSON array or with semicolons, other cells metadata.

    Rows of another number of cells are left out. A row without an id gets one of its own.
    """
    rows = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("escape", '"').csv(path)
    id_name = next((n for n in ("id", "_id") if n in rows.columns), None)
    vector_name = next((n for n in records.VECTOR_NAMES[:3] if n in rows.columns), None)
    if vector_name is None:
        raise ValueError("no column with a vector")
    v = F.col(vector_name)
    vector = F.when(F.trim(v).startswith("["), F.from_json(v, "array<float>")).otherwise(F.transform(F.split(v, ";"), lambda x: F.trim(x).try_cast("float")))
    id_ = F.concat(F.lit("csv_row_"), F.monotonically_increasing_id()) if id_name is None else F.col(id_name)
    others = [c for c in rows.columns if c not in (id_name, vector_name)]
    pairs = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f'"{c}":'), _cell(F.col(f"`{c}`")))) for c in others]
    meta = F.when(F.coalesce(*(F.col(f"`{c}`") for c in others)).isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))) if others else F.lit(None).cast("string")
    return rows.select(id_.alias("id"), vector.alias("vector"), meta.alias("metadata"))


#: Different metadata keys that become columns, at most.
MOST_COLUMNS = 10_000


def write_csv(rows: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """id, vector with semicolons and a column for each metadata key in order; keys: those to write, else all there are (MOST_COLUMNS at most)."""
    meta = F.from_json("metadata", "map<string,string>")
    if keys is None:
        keys = sorted(r[0] for r in rows.select(F.explode(F.map_keys(meta))).distinct().limit(MOST_COLUMNS + 1).collect())
        if len(keys) > MOST_COLUMNS:
            raise ValueError(f"over {MOST_COLUMNS} metadata keys: name those to write")
    cells = [F.coalesce(meta[k], F.lit("")).alias(k) for k in keys]
    rows.select("id", F.concat_ws(";", F.transform("vector", lambda x: x.cast("string"))).alias("vector"), *cells).write.option("header", True).option("escape", '"').csv(path)


def read_binary(spark: SparkSession, path: str, magic: bytes = binary.MAGIC) -> DataFrame:
    """Files of vector records, or folders of them, in any store that Spark reads; a task holds one file at a time."""
    import pyarrow as pa

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin*").load(path).select("content")
    names, step = ["id", "vector", "metadata"], 10_000

    def work(batches):
        for batch in batches:
            for content in batch.column(0):
                held = list(binary.unpacked(content.as_py(), magic))
                for a in range(0, len(held), step):
                    ids, vectors, meta = zip(*held[a : a + step], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(vectors, pa.list_(pa.float32())), pa.array(meta, pa.string())], names)

    return raw.mapInArrow(work, binary.SCHEMA)


def write_binary(rows: DataFrame, path: str) -> None:
    binary.register(rows.sparkSession)
    rows.select("id", "vector", "metadata").write.format("vector-records").mode("append").save(path)


READERS = {"jsonl": read_jsonl, "parquet": read_parquet, "csv": read_csv, "binary": read_binary}
WRITERS = {"jsonl": write_jsonl, "parquet": write_parquet, "csv": write_csv, "binary": write_binary}


def check_conversion(source: str, target: str) -> None:
    if source not in READERS or target not in WRITERS:
        raise ValueError(f"cannot convert {source} to {target}")
    if (source, target) == ("csv", "binary"):
        raise ValueError("CSV has no types to write as binary")


def convert(spark: SparkSession, source: str, target: str, source_format: str | None = None, target_format: str | None = None) -> int:
    """Reads one file or folder and writes another; returns the number of records."""
    a, b = source_format or format_of(source), target_format or format_of(target)
    check_conversion(a, b)
    WRITERS[b](READERS[a](spark, source), target)
    return READERS[b](spark, target).count()


def fetched(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """A batch of records by position in order of id."""
    return rows.orderBy("id").offset(offset).limit(limit)


def parquet_info(spark: SparkSession, path: str) -> DataFrame:
    """For each file of a Parquet table: its rows, row groups, columns and bytes, from its footer alone.

    The footers are read by Hadoop's file system in the driver's JVM, a few kilobytes a file.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for status in files.listed(spark, path, ".parquet"):
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(status, conf))
        try:
            meta = reader.getFooter()
            out.append((status.getPath().getName(), reader.getRecordCount(), meta.getBlocks().size(), meta.getFileMetaData().getSchema().getColumns().size(), status.getLen()))
        finally:
            reader.close()
    return spark.createDataFrame(out, "file string, rows long, row_groups long, columns long, bytes long")
