"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

Sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3 ... and share the words of all documents; a target stops at
``most`` times its source's words and the excess goes to the others by weight. Each document's expected number of
copies is its source's target over its source's words. The expected copies are summed along the source, a random
offset is added to the sum, and a document is emitted once for each whole number that its stretch of the sum crosses.
Documents stand along the source by size class, so every stretch of sizes gets its share and the words taken come
near the target, then by a hash of the id. Rows of one id, source and text are counted first and are one stretch of the sum
together. The stretches are dealt by ranges of their order: sums over ranges are taken on one row a range and source, sums within a
range on its own rows, so no task needs all rows of a source or of an id.

Null texts have size 0. Null sources are one source. Repeated rows are documents of their own; rows that are equal in
id, source and text may change places without any effect on the result, and so may rows without an id. An empty table gives an
empty result; with no words at all every target is 0 and nothing is taken. Texts are read whole; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagitta.llm.common import WORD_PATTERN, cut, done, fresh, read

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
#: Equal rows are dealt anew in blocks of so many.
BLOCK_ROWS = 100_000
#: Up to so many documents, their numbers of copies are sent to all executors; beyond, the join is a shuffle.
BROADCAST_ROWS = 500_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Eight classes to each doubling, in ascending order: whole-number arithmetic only."""
    bits = F.length(F.bin(size))
    top = (size / F.pow(F.lit(2.0), F.greatest(bits - 4, F.lit(0)))).cast("long")
    return F.when(size < 16, size).otherwise(bits * 8 + top - 8).cast("long")


def hashed(*parts: Column) -> Column:
    """32 bits of the md5 of the parts, as a whole number; a null part counts as a line feed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("\n")) for p in parts))), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each source: source_key, source_size, target. sizes has source_key and size, as many rows as it likes.

    A common level L with sum(min(most * size, L * weight)) = all words fixes the targets: sources in order of
    size / weight reach their limit first, so L comes from running sums over one row for each source.
    """
    by_source = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    at = Window.orderBy(F.col("source_key").asc())
    ranked = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(at) - 1) % len(weights) + 1).cast("int")).cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.col("open").cast("double"))
        .withColumn("under", F.col("level") * F.col("weight") <= F.col("source_size") * most)
        .withColumn("common", F.max(F.when(F.col("under"), F.struct(-F.col("source_size") / F.col("weight"), F.col("level")))).over(everything)["level"])
    )
    return ranked.select("source_key", "source_size", F.least(F.col("common") * F.col("weight"), (F.col("source_size") * most).cast("double")).alias("target"))


def _source_key(source: Column) -> Column:
    """A key that sorts by code point with null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def stretches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """For each different (doc_id, source_key, size, text_key) its number of rows, source_size, target, rate, offset and end.

    Of the source's places the rows have those from end - rows + 1 to end; a place is taken as often as rate * place + offset
    passes a whole number there.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), _source_key(F.col(source)).alias("source_key"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("text_key"))
    counted = sized.groupBy("doc_id", "source_key", "size", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    placed = cut(counted.withColumn("band", size_class(F.col("size"))).withColumn("order", hashed(F.lit(seed), F.col("doc_id"))), "mix-counted")
    along = ["band", "order", "doc_id", "size", "text_key"]
    ranged = cut(placed.repartitionByRange("source_key", *along).withColumn("range", F.spark_partition_id()), "mix-ranged")
    sums = cut(ranged.groupBy("source_key", "range").agg(F.sum("rows").alias("count"), F.sum(F.col("size") * F.col("rows")).alias("size")), "mix-sums")
    done(placed)
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).join(targets(sums, weights, most), "source_key")
    offsets = offsets.select("source_key", "range", "before", "source_size", "target")
    within = Window.partitionBy("source_key", "range").orderBy(*along).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    out = ranged.withColumn("end", F.sum("rows").over(within)).join(offsets, ["source_key", "range"])
    return out.select(
        "doc_id", "source_key", "size", "text_key", "rows", "source_size", "target", rate.alias("rate"),
        (hashed(F.lit(seed), F.col("source_key")) / F.lit(float(2**32))).alias("offset"), (F.col("before") + F.col("end")).alias("end"),
    )


def _passed(place: Column) -> Column:
    return F.floor(F.col("rate") * place + F.col("offset"))


def mix(docs: DataFrame, most: int = MOST, **options) -> DataFrame:
    """For each document: doc_id, size, source_size, target (its source's) and copies, how often the mix takes it."""
    found = cut(stretches(docs, most=most, **options), "mix-stretches")
    blocks = found.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / BLOCK_ROWS))))
    if (found.agg(F.max("rows")).first()[0] or 0) > BLOCK_ROWS:
        blocks = blocks.repartition("doc_id", "source_key", "text_key", "block")
    first = F.col("end") - F.col("rows") + F.col("block") * BLOCK_ROWS + 1
    each = blocks.withColumn("place", F.explode(F.sequence(first, F.least(first + BLOCK_ROWS - 1, F.col("end")))))
    copies = F.least(_passed(F.col("place")) - _passed(F.col("place") - 1), F.lit(most)).cast("long")
    return each.select("doc_id", "size", "source_size", "target", copies.alias("copies"))


def emit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST, **options) -> DataFrame:
    """The mix itself: docs, each row as often as it is taken.

    Rows that are equal in id, source and text share their copies evenly; what does not divide goes to one of them, as they
    are alike but for extra columns.
    """
    found = stretches(docs, doc_id, text, source, most=most, **options)
    copies = F.least(_passed(F.col("end")) - _passed(F.col("end") - F.col("rows")), most * F.col("rows")).cast("long")
    names = fresh(docs, "id_", "source_", "text_", "each", "rest", "copy")
    i, s, t, each, rest, copy = names
    found = found.withColumn("copies", copies).where("copies > 0")
    taken = cut(found.select(F.col("doc_id").alias(i), F.col("source_key").alias(s), F.col("text_key").alias(t), F.floor(F.col("copies") / F.col("rows")).alias(each), (F.col("copies") % F.col("rows")).alias(rest)), "mix-taken")
    n, uneven = taken.agg(F.count(F.lit(1)), F.max(rest)).first()
    same = F.col(doc_id).eqNullSafe(F.col(i)) & (_source_key(F.col(source)) == F.col(s)) & (F.xxhash64(text) == F.col(t))
    joined = docs.join(F.broadcast(taken) if n <= BROADCAST_ROWS else taken, same)
    many = lambda rows, c: rows.where(F.col(c) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(c)))).drop(*names)
    out = many(joined, each)
    return out if not uneven else out.unionByName(many(joined.where(F.col(rest) > 0).dropDuplicates([i, s, t]), rest))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def sql(weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> str:
    """The same mix for DuckDB, with plain windows over each source."""
    choose = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights))
    return f"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
banded AS (
  SELECT *, CASE WHEN size < 16 THEN size ELSE len(bin(size)) * 8 + (size >> (len(bin(size)) - 4)::INT) - 8 END AS band,
         CAST('0x' || substr(md5('{seed}|' || doc_id), 1, 8) AS BIGINT) AS ord FROM sized),
sources AS (SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
weighted AS (SELECT *, CASE (row_number() OVER (ORDER BY source_key) - 1) % {len(weights)} {choose} END AS weight FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum({most} * source_size) OVER b, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM weighted WINDOW b AS (ORDER BY source_size / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT arg_min(level, source_size / weight) AS level FROM levels WHERE level * weight <= {most} * source_size),
targets AS (SELECT source_key, source_size, least(common.level * weight, ({most} * source_size)::DOUBLE) AS target FROM weighted, common),
ranked AS (
  SELECT doc_id, size, source_size, target, source_key,
         row_number() OVER (PARTITION BY source_key ORDER BY band, ord, doc_id, size) AS place,
         CASE WHEN source_size > 0 THEN least(target / source_size, {float(most)}) ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('{seed}|' || source_key), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS shift
  FROM banded JOIN targets USING (source_key))
SELECT doc_id, size, source_size, target,
       CAST(size * least(floor(rate * place + shift) - floor(rate * (place - 1) + shift), {most}) AS BIGINT) AS taken
FROM ranked"""
