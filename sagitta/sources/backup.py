"""Backups of whole folders: named copies beside each other, restored as they were."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession

from sagitta.operators.collections import check_name
from sagitta.sources import files


def _copy(spark: SparkSession, source: str, target: str) -> None:
    fs, a = files._at(spark, source)
    other, b = files._at(spark, target)
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, other, b, False, True, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError(f"cannot copy {source} to {target}")


def create(spark: SparkSession, source: str, folder: str, name: str | None = None) -> str:
    """Copies a folder to folder/name/data."""
    name = name or f"backup-{time.time_ns():020d}"
    check_name(name)
    if files.exists(spark, f"{folder}/{name}"):
        raise ValueError(f"there is a backup {name}")
    _copy(spark, source, f"{folder}/{name}/data")
    files.write_text(spark, f"{folder}/{name}/meta.json", json.dumps({"name": name, "source": source, "created": time.time()}))
    return name


def restore(spark: SparkSession, folder: str, name: str, target: str) -> None:
    """Puts a backup in the place of target; what is there goes."""
    if not files.exists(spark, f"{folder}/{name}/meta.json"):
        raise ValueError(f"there is no backup {name}")
    files.delete(spark, target)
    _copy(spark, f"{folder}/{name}/data", target)


def listed(spark: SparkSession, folder: str) -> list[dict]:
    return [json.loads(files.read_text(spark, f"{folder}/{n}/meta.json")) for n in files.names(spark, folder) if files.exists(spark, f"{folder}/{n}/meta.json")]
