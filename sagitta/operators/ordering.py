"""Running sums and windows of rows over tables that no single task could sort.

Rows are dealt by ranges of their order; each range's sums stand on one row, and the sums before a range are added to those within it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagitta.sources.files import cut


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each of sums, the sum up to and with the row, in order within by; a null in by is a group as any other.

    Rows that are equal in by and order stand in any order.
    """
    names = [f"_w{k}" for k in range(len(sums))]
    dealt = rows.withColumns(dict(zip(names, sums.values(), strict=True)))
    dealt = cut((dealt.repartitionByRange(*by, *order) if by or order else dealt).withColumn("_range", F.spark_partition_id()), "ranged")
    parts = cut(dealt.groupBy(*by, "_range").agg(*(F.sum(n).alias(n) for n in names)), "range-sums")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = parts.select(*(F.col(b).alias(f"_by{k}") for k, b in enumerate(by)), F.col("_range").alias("_at"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in names))
    same = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"_by{k}")) for k, b in enumerate(by)), F.col("_range") == F.col("_at"))
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumns({f"{n}_here": F.sum(n).over(within) for n in names}).join(offsets, same)
    return summed.select(*rows.columns, *((F.col(f"{n}_here") + F.col(f"{n}_before")).alias(name) for n, name in zip(names, sums, strict=True)))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number within by, from 1, in order."""
    return running(rows, by, order, {name: F.lit(1).cast("long")})


def placed(rows: DataFrame, name: str) -> DataFrame:
    """rows with numbers from 0 without gaps, in the order in which the partitions hold them."""
    held = cut(rows.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}), "placed")
    parts = cut(held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")), "parts")
    starts = parts.select(F.col("_part").alias("_at"), "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return held.join(starts, F.col("_part") == F.col("_at")).select(*rows.columns, (F.col("_id") - F.col("_first") + F.col("_before")).alias(name))


def blocks(rows: DataFrame, by: list[str], order: list[str], before: int, after: int = 0, size: int = 100_000) -> DataFrame:
    """rows for windows of ``before`` rows before and ``after`` behind, dealt in blocks: a window over (by, _block) in order of
    _no has them all. Rows near a block's ends are in the block beside it too, as guests (_guest), which are to be left out.
    """
    size = max(size, before, after, 1)
    at = numbered(rows, by, order, "_no").withColumn("_own", F.floor((F.col("_no") - 1) / size))
    place = F.pmod(F.col("_no") - 1, F.lit(size))
    also = F.filter(F.array(F.when(place >= size - before, F.col("_own") + 1) if before else F.lit(None).cast("long"), F.when((place < after) & (F.col("_own") > 0), F.col("_own") - 1) if after else F.lit(None).cast("long")), lambda x: x.isNotNull())
    dealt = at.withColumn("_block", F.explode(F.concat(F.array("_own"), also)))
    return dealt.withColumn("_guest", F.col("_block") != F.col("_own")).drop("_own")


def block_pairs(rows: DataFrame, key: str, value: str, size: int = 2048) -> tuple[DataFrame, DataFrame]:
    """rows twice, dealt to pairs of blocks of a key: joined on key, _i and _j, any two rows of a key meet once.

    In a pair of one block with itself (_i = _j) they meet from both sides. A key of any number of rows is spread over tasks.
    """
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).alias("_blocks"))
    held = rows.join(sizes, key).withColumn("_block", F.pmod(F.xxhash64(value), F.col("_blocks")))
    a = held.withColumn("_other", F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1))).withColumns({"_i": F.col("_block"), "_j": F.col("_other")})
    b = held.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_block")))).withColumns({"_i": F.col("_other"), "_j": F.col("_block")})
    return a.drop("_blocks", "_block", "_other"), b.drop("_blocks", "_block", "_other")


