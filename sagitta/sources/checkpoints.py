"""How far a copy has come: one small JSON file for each job, saved, loaded, listed and removed."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession

from sagitta.operators.collections import check_name
from sagitta.sources import files


class Checkpoints:
    """The checkpoints in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def save(self, job: str, offset: int, processed: int, failed: int = 0, **other) -> None:
        check_name(job)
        files.write_text(self.spark, f"{self.folder}/{job}.json", json.dumps(other | {"job": job, "offset": offset, "processed": processed, "failed": failed, "saved": time.time()}))

    def load(self, job: str) -> dict | None:
        path = f"{self.folder}/{job}.json"
        return json.loads(files.read_text(self.spark, path)) if files.exists(self.spark, path) else None

    def list(self) -> list[dict]:
        return [self.load(n.removesuffix(".json")) for n in files.names(self.spark, self.folder) if n.endswith(".json")]

    def remove(self, job: str) -> bool:
        return files.delete(self.spark, f"{self.folder}/{job}.json")

    def remove_older(self, seconds: float) -> int:
        old = [c["job"] for c in self.list() if time.time() - c["saved"] > seconds]
        return sum(self.remove(job) for job in old)

    def statistics(self) -> dict[str, int]:
        all_ = self.list()
        return {"jobs": len(all_), "processed": sum(c["processed"] for c in all_), "failed": sum(c["failed"] for c in all_)}
