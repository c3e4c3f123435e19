"""Replication: vector clocks, concurrent conflicts and their resolution, gaps in heartbeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagitta.operators import ordering

#: The kinds of operation that can be in conflict.
CONFLICTING = ("update", "delete")


def merged(a: Column, b: Column) -> Column:
    """The clock that is not behind either: the greater of each counter."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def compared(a: Column, b: Column) -> Column:
    """Less, Greater, Equal or Concurrent; a missing counter is 0."""
    pairs = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y"))))
    less, more = F.exists(pairs, lambda p: p.x < p.y), F.exists(pairs, lambda p: p.x > p.y)
    return F.when(less & more, "Concurrent").when(less, "Less").when(more, "Greater").otherwise("Equal")


def conflicts(ops: DataFrame, key: str = "key") -> DataFrame:
    """Concurrent updates or deletes of one key, by their clocks: key, a < b (the first operations of two clocks), and how many
    operations have each (a_ops, b_ops). Every operation of the one clock is in conflict with every one of the other.

    ops: op_id, key, kind, clock. Operations of a key with equal clocks are one row from the start; ``clock_classes`` tells whose
    they are. What is left of a key is compared in blocks.
    """
    classes = clock_classes(ops, key).groupBy(key, "_clock").agg(F.min("op_id").alias("op"), F.count(F.lit(1)).alias("ops"))
    a, b = ordering.block_pairs(classes.withColumn("clock", F.map_from_entries("_clock")), key, "op")
    a, b = (side.select(key, "_i", "_j", *(F.col(c).alias(p + c) for c in ("op", "ops", "clock"))) for side, p in ((a, "a_"), (b, "b_")))
    once = (F.col("_i") != F.col("_j")) | (F.col("a_op") < F.col("b_op"))
    found = a.join(b, [key, "_i", "_j"]).where(once & (compared(F.col("a_clock"), F.col("b_clock")) == "Concurrent"))
    turned = F.col("a_op") > F.col("b_op")
    pick = lambda c: (F.when(turned, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")), F.when(turned, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")))
    (low, high), (low_ops, high_ops) = pick("op"), pick("ops")
    return found.select(key, low.alias("a"), high.alias("b"), low_ops.alias("a_ops"), high_ops.alias("b_ops"))


def clock_classes(ops: DataFrame, key: str = "key") -> DataFrame:
    """op_id, key and _clock of updates and deletes: the clock's counters that are not 0, in order, so equal clocks are equal."""
    counters = F.sort_array(F.filter(F.map_entries("clock"), lambda e: e["value"] != 0))
    return ops.where(F.col("kind").isin(*CONFLICTING)).select("op_id", key, counters.alias("_clock"))


def resolved(ops: DataFrame, how: str = "last", key: str = "key", time: str = "time", tie: str = "op_id", priority: dict[str, int] | None = None, region: str = "region") -> DataFrame:
    """The operation of each key that wins: last or first by time, or of the region of highest priority, then the last.

    Of equal times the higher tie wins, as the one that came in later.
    """
    if how == "priority":
        rank = F.create_map(*(x for r, p in (priority or {}).items() for x in (F.lit(r), F.lit(p)))) if priority else None
        order = F.struct(F.coalesce(rank[F.col(region)], F.lit(-(2**31))) if rank is not None else F.lit(0), F.col(time), F.col(tie))
    else:
        order = F.struct(F.col(time) if how == "last" else -F.unix_micros(F.col(time).cast("timestamp")), F.col(tie))
    best = ops.groupBy(key).agg(F.max_by(F.struct(*[c for c in ops.columns if c != key]), order).alias("_w"))
    return best.select(key, "_w.*").select(*ops.columns)


def merged_clocks(ops: DataFrame, key: str = "key") -> DataFrame:
    """For each key the merge of all its operations' clocks."""
    counters = ops.select(key, F.explode("clock").alias("node", "n")).groupBy(key, "node").agg(F.max("n").alias("n"))
    return counters.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("node", "n")))).alias("clock"))


def custom(ops: DataFrame, resolver: Callable, key: str = "key") -> DataFrame:
    """The rows that a function of a key's operations (a pandas frame) returns, of the same columns."""
    return ops.groupBy(key).applyInPandas(lambda frame: resolver(frame), ops.schema)


def silent(beats: DataFrame, node: str, time: str, interval: int, misses: int = 3) -> DataFrame:
    """Gaps of more than misses intervals (seconds) between a node's heartbeats: node, start and end."""
    before = F.lag(time).over(Window.partitionBy(node).orderBy(time))
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("_from").cast("timestamp"))
    return beats.withColumn("_from", before).where(gap > interval * misses * 1_000_000).select(node, F.col("_from").alias("start"), F.col(time).alias("end"))
