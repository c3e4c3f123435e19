"""Random histories by kind: registers, sets, lists, counters, bank accounts and transactions.

All draws are hashes of the seed and the operation's id, so a history is the same however many partitions make it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagitta.operators.history import hashed


@dataclass
class Workload:
    """Operations on ``count`` objects named <prefix>-<number>: reads in a share of cases, else the kind ``does`` with a value."""

    prefix: str
    does: str
    reads: float
    count: int = 10
    #: Values are from least to most; for others than these kinds of work they are plain numbers.
    least: int = 0
    most: int = 99
    #: Operations of a transaction at most; 1: no transactions.
    size: int = 1


# Prefixes of names, kinds of operation, and shares of reads where these are set.
KINDS = {
    "register": Workload("key", "write", 0.5),
    "set": Workload("set", "set_add", 0.0),
    "append": Workload("list", "append", 0.5),
    "bank": Workload("account", "transfer", 0.3, least=1, most=100),
    "counter": Workload("counter", "increment", 0.2, least=1, most=10),
    "read-write": Workload("rw-key", "write", 0.5, size=4),
}


def drawn(seed: int, what: str, *more: Column) -> Column:
    """A number from 0 up to 1 by the seed, a name and the columns."""
    return hashed(F.concat_ws(":", F.lit(seed).cast("string"), F.lit(what), *(c.cast("string") for c in more))) / 2**32


def below(n: Column | int, seed: int, what: str, *more: Column) -> Column:
    return F.floor(drawn(seed, what, *more) * n)


def history(spark: SparkSession, work: str | Workload, n: int, seed: int = 0) -> DataFrame:
    """id, step (the operation's place in its transaction), kind, key, to (a transfer's other account, null for others) and value.

    A transfer goes between two different accounts. A read has no value.
    """
    w = KINDS[work] if isinstance(work, str) else work
    at = (F.col("id"), F.col("step"))
    steps = F.sequence(F.lit(0).cast("long"), below(w.size, seed, "size", F.col("id")))
    rows = spark.range(n).withColumn("step", F.explode(steps))
    own = below(w.count, seed, "key", *at)
    other = F.pmod(own + 1 + below(w.count - 1, seed, "to", *at), F.lit(w.count))
    read = drawn(seed, "kind", *at) < w.reads
    name = lambda k: F.concat(F.lit(f"{w.prefix}-"), k.cast("string"))
    value = F.lit(w.least) + below(w.most - w.least + 1, seed, "value", *at)
    return rows.select(
        "id", "step", F.when(read, "read").otherwise(w.does).alias("kind"), name(own).alias("key"),
        F.when(~read & F.lit(w.does == "transfer"), name(other)).alias("to"), F.when(~read, value).alias("value"),
    )


def balances(history_: DataFrame, start: int = 0) -> DataFrame:
    """key and balance after all transfers of a bank's history: what the accounts hold together never changes."""
    moved = history_.where("kind = 'transfer'")
    both = moved.select("key", (-F.col("value")).alias("by")).unionByName(moved.select(F.col("to").alias("key"), F.col("value").alias("by")))
    return both.groupBy("key").agg((F.sum("by") + start).alias("balance"))
