"""A consistent hash ring: keys belong to the node whose next place on the ring they come before.

A place is the first 32 bits of a text's MD5. Each node has as many places as it has replicas, so a node that comes or goes moves
its own share of the keys only. The ring is small (nodes times replicas), so it goes to every executor.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICAS = 150


def place(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


@dataclass
class Ring:
    """Nodes by name and the places of their replicas."""

    nodes: list[str] = field(default_factory=list)
    replicas: int = REPLICAS

    def __post_init__(self):
        self.places = sorted((int(hashlib.md5(f"{n}#{k}".encode()).hexdigest()[:8], 16), n) for n in dict.fromkeys(self.nodes) for k in range(self.replicas))

    def add(self, node: str) -> Ring:
        return Ring([*self.nodes, node], self.replicas)

    def remove(self, node: str) -> Ring:
        return Ring([n for n in self.nodes if n != node], self.replicas)

    def assigned(self, rows: DataFrame, key: str, name: str = "node") -> DataFrame:
        """rows with the node of each key; null on an empty ring."""
        return rows.withColumn(name, self.lookup(rows, place(F.col(key)), 1)[0])

    def preferred(self, rows: DataFrame, key: str, n: int, name: str = "nodes") -> DataFrame:
        """rows with the n different nodes that come next, for copies of a key."""
        return rows.withColumn(name, self.lookup(rows, place(F.col(key)), n))

    def lookup(self, rows: DataFrame, at: Column, n: int) -> Column:
        ends = np.array([p for p, _ in self.places], np.int64)
        following: list[list[str]] = []
        for k in range(len(self.places)):
            names = dict.fromkeys(self.places[(k + j) % len(self.places)][1] for j in range(len(self.places)))
            following.append(list(names)[:n])
        shared = rows.sparkSession.sparkContext.broadcast((ends, following))

        @F.pandas_udf("array<string>")
        def own(places):
            import pandas as pd

            ends, following = shared.value
            if not len(ends):
                return pd.Series([None] * len(places))
            found = np.searchsorted(ends, places.fillna(0).to_numpy(np.int64)) % len(ends)
            return pd.Series([following[k] for k in found])

        return F.when(at.isNotNull(), own(at))

    def distribution(self, rows: DataFrame, key: str) -> DataFrame:
        """How many rows each node has, nodes without any included."""
        all_ = rows.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(self.nodes)], "node string")
        counted = self.assigned(rows, key, "node").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        return all_.join(counted, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))
