"""Collections of points in Parquet: a catalog, upserts, deletes, reads, compaction and snapshots.

A collection is a folder: config.json, runs of data, and current.json, which names the runs in force, oldest first. A change writes
one run, of the rows that it adds or of tombstones, and then moves the pointer, so readers see all of a change or nothing of it and a small
change is a small write. Readers merge the runs; when there are ``MOST_RUNS`` of them a change merges them into one. Ids are whole
numbers; of several rows with one id in a batch the last one counts; a payload is a JSON text.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagitta.operators import filters, ordering, search
from sagitta.sources import files

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("payload", T.StringType())])
NAME = re.compile(r"^[A-Za-z0-9_-]{1,255}$")
RUN = T.StructType([*SCHEMA, T.StructField("deleted", T.BooleanType())])
MOST_DIM = 65_536
#: Runs that readers merge, at most; beyond, a change rewrites them as one.
MOST_RUNS = 8


def check_name(name: str) -> None:
    if not NAME.match(name):
        raise ValueError("a name has 1 to 255 letters, digits, dashes and underscores")


def check_dim(dim: int) -> None:
    if not 1 <= dim <= MOST_DIM:
        raise ValueError(f"a dimension is from 1 to {MOST_DIM}")


def latest(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """Of all rows of a key the one that comes last in order: an aggregation that combines before the shuffle."""
    others = [c for c in rows.columns if c != key]
    rank = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("_row"))
    return best.select(key, *(F.col("_row")[c].alias(c) for c in others)).select(*rows.columns)


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new in place of its own of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def deleted(old: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return old.join(ids.select(key).distinct(), key, "left_anti")


def scanned(points: DataFrame, start: int | None = None, end: int | None = None, key: str = "id") -> DataFrame:
    """The points from start to end, both included, by key."""
    if start is not None:
        points = points.where(F.col(key) >= start)
    return (points if end is None else points.where(F.col(key) <= end)).orderBy(key)


def compacted(runs: list[DataFrame], key: str = "id", tombstone: str = "deleted") -> DataFrame:
    """Runs from the oldest to the newest merged: of each key the newest row, none if that is a tombstone."""
    merged = None
    for k, run in enumerate(runs):
        run = run.withColumn("_run", F.lit(k))
        merged = run if merged is None else merged.unionByName(run)
    return latest(merged, key, "_run").where(~F.coalesce(F.col(tombstone), F.lit(False))).drop("_run")


def replaced_if(points: DataFrame, point_id: int, expected: list[float], new: list[float], epsilon: float = 1e-6) -> DataFrame:
    """points, with the vector of one id replaced if it is the expected one, each component to within epsilon."""
    same = F.forall(F.zip_with("vector", F.array(*map(F.lit, expected)), lambda x, y: F.coalesce(F.abs(x - y) <= epsilon, F.lit(False))), lambda t: t)
    return points.withColumn("vector", F.when((F.col("id") == point_id) & same, F.array(*map(F.lit, new)).cast("array<float>")).otherwise(F.col("vector")))


class Collection:
    """One collection, opened by its folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.config = json.loads(files.read_text(spark, f"{path}/config.json"))

    def _current(self) -> dict:
        return json.loads(files.read_text(self.spark, f"{self.path}/current.json"))

    @property
    def version(self) -> str | None:
        """A name of the state in force: the last run's."""
        runs = self._current()["runs"]
        return runs[-1] if runs else None

    def _rows(self) -> DataFrame:
        """id, vector and payload (a text) of all points."""
        runs = self._current()["runs"]
        if not runs:
            return self.spark.createDataFrame([], SCHEMA)
        read = [self.spark.read.schema(RUN).parquet(f"{self.path}/data/{r}") for r in runs]
        # the first run has one row an id and no tombstones
        return (read[0] if len(runs) == 1 else compacted(read)).select("id", "vector", "payload")

    def points(self) -> DataFrame:
        """id, vector and payload (a variant) of all points."""
        return self._rows().withColumn("payload", F.parse_json("payload"))

    def _write(self, rows: DataFrame, over: bool = True) -> None:
        """Writes a run and puts it into force: over the ones there are, or in their place."""
        now = self._current()
        runs = now["runs"] if over else []
        if len(runs) >= MOST_RUNS:
            read = [self.spark.read.schema(RUN).parquet(f"{self.path}/data/{r}") for r in runs]
            rows, runs = compacted([*read, self._run(rows)]), []
        name = uuid.uuid4().hex
        self._run(rows).write.parquet(f"{self.path}/data/{name}")
        files.write_text(self.spark, f"{self.path}/current.json", json.dumps({"runs": [*runs, name], "past": [now["runs"], *now.get("past", [])][:MOST_RUNS]}))

    def _run(self, rows: DataFrame) -> DataFrame:
        if "deleted" not in rows.columns:
            rows = rows.withColumn("deleted", F.lit(False))
        return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RUN))

    def check(self, rows: DataFrame) -> None:
        """Raises if any row has no id, a vector of another dimension or a component that is not finite."""
        bad = F.col("id").isNull() | (F.coalesce(F.size("vector"), F.lit(-1)) != self.config["dim"]) | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
        if not rows.where(F.coalesce(bad, F.lit(True))).isEmpty():
            raise ValueError(f"points need an id and {self.config['dim']} finite components")

    def upsert(self, rows: DataFrame, position: str | None = None) -> None:
        """Writes points; of one id the last by the column position. A payload is a JSON text or null."""
        order = position or "_place"
        if position is None:
            rows = rows.withColumn(order, F.monotonically_increasing_id())
        if "payload" not in rows.columns:
            rows = rows.withColumn("payload", F.lit(None).cast("string"))
        self.check(rows)
        self._write(latest(rows.select("id", "vector", "payload", order), "id", order).drop(order))

    def append(self, rows: DataFrame) -> None:
        """Writes points without ids: they get the ones after the highest."""
        top = self._rows().agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        self.upsert(ordering.placed(rows, "id").withColumn("id", F.col("id") + top + 1))

    def delete(self, ids: list[int] | None = None, condition: filters.Condition | None = None) -> None:
        """Deletes by ids or by a condition; what no id or condition names stays."""
        gone = None
        if ids is not None:
            gone = self.spark.createDataFrame([(i,) for i in set(ids)], "id long")
        elif condition is not None:
            gone = self.points().where(condition.column(F.col("payload"))).select("id")
        if gone is not None and self._current()["runs"]:
            self._write(gone.withColumn("deleted", F.lit(True)))

    def get(self, point_id: int) -> DataFrame:
        return self.points().where(F.col("id") == point_id)

    def scan(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """Points from start to end, both included, by id."""
        return scanned(self.points(), start, end)

    def search(self, request: search.Request) -> DataFrame:
        request.check(self.config["dim"])
        return search.search(self.points(), request)

    def count(self, condition: filters.Condition | None = None) -> int:
        return search.count(self.points(), condition).first()[0]

    def scroll(self, limit: int = 10, start: int | None = None, condition: filters.Condition | None = None) -> tuple[DataFrame, int | None]:
        return search.scroll(self.points(), limit, start, condition)

    def retrieve(self, ids: list[int]) -> DataFrame:
        return search.retrieve(self.points(), ids)

    def compact(self, keep: int = 1) -> None:
        """Rewrites the data in force as one run and removes runs that neither it nor the latest keep - 1 states before it name."""
        self._write(self._rows(), over=False)
        now = self._current()
        needed = {r for runs in [now["runs"], *now["past"][: keep - 1]] for r in runs}
        for old in files.names(self.spark, f"{self.path}/data"):
            if old not in needed:
                files.delete(self.spark, f"{self.path}/data/{old}")

    # snapshots

    def _digest(self, rows: DataFrame) -> dict:
        """The number of points and a sum over them that does not depend on their order."""
        n, s = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("id", "vector", "payload").cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
        return {"points": n, "checksum": s}

    def snapshot(self, name: str | None = None, since: str | None = None) -> str:
        """Writes a snapshot; since: only points that are new or changed, and tombstones, against that snapshot."""
        name = name or f"snapshot-{time.time_ns():020d}"
        check_name(name)
        rows, at = self._rows().withColumn("deleted", F.lit(False)), f"{self.path}/snapshots/{name}"
        if since:
            before = self._restored(since)
            changed = rows.join(before.select("id", F.xxhash64("vector", "payload").alias("_was")), "id", "left").where(~F.col("_was").eqNullSafe(F.xxhash64("vector", "payload"))).drop("_was")
            gone = before.join(rows.select("id"), "id", "left_anti").withColumn("deleted", F.lit(True))
            rows = changed.unionByName(gone)
        rows.write.option("compression", "zstd").parquet(f"{at}/data")
        told = self._digest(self.spark.read.parquet(f"{at}/data"))
        files.write_text(self.spark, f"{at}/meta.json", json.dumps(told | {"name": name, "since": since, "created": time.time(), "config": self.config}))
        return name

    def _meta(self, name: str) -> dict:
        return json.loads(files.read_text(self.spark, f"{self.path}/snapshots/{name}/meta.json"))

    def _restored(self, name: str) -> DataFrame:
        """The points of a snapshot, laid over those of the snapshots that it builds on."""
        chain, at = [], name
        while at:
            meta = self._meta(at)
            rows = self.spark.read.parquet(f"{self.path}/snapshots/{at}/data")
            told = self._digest(rows)
            if told != {k: meta[k] for k in told}:
                raise ValueError(f"snapshot {at} does not match its checksum")
            chain.append(rows)
            at = meta["since"]
        return compacted(chain[::-1]).drop("deleted")

    def restore(self, name: str) -> None:
        self._write(self._restored(name), over=False)

    def snapshots(self) -> list[dict]:
        return [self._meta(n) for n in files.names(self.spark, f"{self.path}/snapshots")]

    def delete_snapshot(self, name: str) -> bool:
        if any(s["since"] == name for s in self.snapshots()):
            raise ValueError(f"another snapshot builds on {name}")
        return files.delete(self.spark, f"{self.path}/snapshots/{name}")

    def keep_snapshots(self, latest: int) -> None:
        """Deletes all but the latest ones, and those that they build on."""
        all_ = sorted(self.snapshots(), key=lambda s: s["created"])
        needed = {s["name"] for s in all_[-latest:]} if latest else set()
        for s in reversed(all_):
            if s["name"] in needed and s["since"]:
                needed.add(s["since"])
        for s in reversed(all_):
            if s["name"] not in needed:
                files.delete(self.spark, f"{self.path}/snapshots/{s['name']}")


class Catalog:
    """The collections in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.loaded: dict[str, tuple[str | None, DataFrame]] = {}

    def create(self, name: str, dim: int, metric: str = "cosine", **schema) -> Collection:
        """A new collection; an error if there is one of that name. schema: whatever else its configuration holds."""
        check_name(name)
        check_dim(dim)
        if self.exists(name):
            raise ValueError(f"there is a collection {name}")
        at = f"{self.path}/{name}"
        files.write_text(self.spark, f"{at}/current.json", json.dumps({"runs": []}))
        files.write_text(self.spark, f"{at}/config.json", json.dumps(schema | {"name": name, "dim": dim, "metric": metric}))
        return Collection(self.spark, at)

    def open(self, name: str) -> Collection:
        if not self.exists(name):
            raise ValueError(f"there is no collection {name}")
        return Collection(self.spark, f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Removes a collection, if there is one."""
        files.delete(self.spark, f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return files.exists(self.spark, f"{self.path}/{name}/config.json")

    def list(self) -> list[str]:
        return [n for n in files.names(self.spark, self.path) if self.exists(n)]

    def describe(self, name: str) -> dict:
        c = self.open(name)
        return c.config | {"points": c.count(), "version": c.version}

    def update(self, name: str, **schema) -> dict:
        """Changes the configuration, but not the name or the dimension."""
        c = self.open(name)
        c.config |= {k: v for k, v in schema.items() if k not in ("name", "dim")}
        files.write_text(self.spark, f"{c.path}/config.json", json.dumps(c.config))
        return c.config

    def explore(self, request: search.Request, names: list[str] | None = None) -> DataFrame:
        """The nearest points of several collections (all) together."""
        return search.explore({n: self.open(n).points() for n in names or self.list()}, request)

    def load(self, name: str) -> DataFrame:
        """Keeps a collection's points, as they are now, in the executors' memory until it is released."""
        if name not in self.loaded:
            self.loaded[name] = (self.open(name).version, self.open(name).points().cache())
        return self.loaded[name][1]

    def release(self, name: str) -> None:
        if name in self.loaded:
            self.loaded.pop(name)[1].unpersist()

    def load_state(self, name: str) -> str:
        """loaded, stale (it has changed since) or not loaded; an error for a collection that does not exist."""
        now = self.open(name).version
        return "not loaded" if name not in self.loaded else "loaded" if self.loaded[name][0] == now else "stale"

    def find(self, point_id: int) -> DataFrame:
        """The points of one id in all collections, with the collection's name."""
        out = None
        for n in self.list():
            rows = self.open(n).get(point_id).withColumn("collection", F.lit(n))
            out = rows if out is None else out.unionByName(rows)
        return out


def promoted(points: DataFrame, key: str, kind: str) -> DataFrame:
    """An index on a payload key: the key as a typed column, which Parquet keeps statistics of. kind: keyword, text, integer, float, boolean."""
    types = {"keyword": "string", "text": "string", "integer": "bigint", "float": "double", "boolean": "boolean"}
    if kind not in types:
        raise ValueError(f"unknown kind of index: {kind}")
    return points.withColumn(key.replace(".", "_"), F.try_variant_get("payload", "$." + key, types[kind]))


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """rows with a number within each by, from 1, in order."""
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(by).orderBy(order)))
