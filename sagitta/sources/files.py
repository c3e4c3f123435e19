"""Small files and folders in whatever store Spark reads, by way of Hadoop's file systems."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder in ascending order; none for a folder that does not exist."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def listed(spark: SparkSession, path: str, ending: str = "") -> list:
    """The statuses of the files at or under a path whose names have that ending, in order of path."""
    fs, p = _at(spark, path)
    out, found = [], fs.listFiles(p, True)
    while found.hasNext():
        status = found.next()
        if status.getPath().getName().endswith(ending) and not status.getPath().getName().startswith(("_", ".")):
            out.append(status)
    return sorted(out, key=lambda s: s.getPath().toString())


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the file and renames, so that a reader sees the old text or the new one."""
    fs, p = _at(spark, path)
    _, beside = _at(spark, path + ".new")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"cannot write {path}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none it is set here: on one machine to a temporary folder, on a cluster to one in the warehouse.
    """
    kept = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not kept:
        if re.match(r"local(\[|$)", spark.sparkContext.master):
            kept = tempfile.mkdtemp(prefix="sagitta-")
        else:
            kept = f"{spark.conf.get('spark.sql.warehouse.dir')}/_temporary-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(kept)
    return kept


def temporary(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other has; what is there goes when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: its lineage ends there."""
    path = temporary(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def counted(df: DataFrame, name: str, *sums: Column) -> tuple:
    """As cut: the frame, its number of rows, and the values of any aggregates more, all taken while it is written, without a job of their own."""
    seen, kept = Observation(), [F.count(F.lit(1)), *sums]
    out = cut(df.observe(seen, *(c.alias(f"seen_{k}") for k, c in enumerate(kept))), name)
    told = seen.get
    return out, *(told[f"seen_{k}"] for k in range(len(kept)))


def done(*frames: DataFrame | None) -> None:
    """Deletes the files of frames that cut has written, once nothing will read them."""
    for df in frames:
        if path := getattr(df, "kept_at", None):
            delete(df.sparkSession, path)
