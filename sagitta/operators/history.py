"""Operation histories and other series: percentiles, rates, windows, overlaps, orderings and consistency checks.

Percentiles are values of the data at place floor(n * q) in ascending order, the last one at most. They come from the
ranks of distinct values and running counts, not from lists of all values.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagitta.operators import ordering

# Upper bounds of latency classes, in seconds.
BOUNDS = [0.001, 0.002, 0.003, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0, 2.0, 5.0, 10.0]


def statistics(rows: DataFrame, value: str, by: Iterable[str] = (), quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """count, min, max, mean, and for each quantile q a column p<100 q> (median is p50), for each group.

    Equal values are counted first and running counts go over ranges of values, so no task has all of a group; nulls do not count.
    """
    by = list(by)
    tallied = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = ordering.running(tallied, by, ["_v"], {"_end": F.col("_n")})
    totals = tallied.groupBy(*by).agg(F.sum("_n").alias("_all")).select(*(F.col(b).alias(f"_t{k}") for k, b in enumerate(by)), "_all")
    same = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"_t{k}")) for k, b in enumerate(by)), F.lit(True))
    placed = placed.join(totals, same) if by else placed.join(F.broadcast(totals))  # one row
    at = [F.min(F.when(F.col("_end") > F.least(F.floor(F.col("_all") * q), F.col("_all") - 1), F.col("_v"))).alias(f"p{q * 100:g}".replace(".", "_")) for q in quantiles]
    return placed.groupBy(*by).agg(F.sum("_n").alias("count"), F.min("_v").alias("min"), F.max("_v").alias("max"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"), *at)


def rolling_quantile(rows: DataFrame, value: str, order: list[str], by: str, size: int = 1000, q: float = 0.95) -> DataFrame:
    """rows with a column rolling: the quantile over the last size rows of the same by, the row's own included.

    The rows of a by are worked on in blocks, each with the size - 1 rows before it.
    """
    window = Window.partitionBy(by, "_block").orderBy("_no").rowsBetween(-(size - 1), 0)
    values = F.sort_array(F.collect_list(value).over(window))
    n = F.size(values)
    found = ordering.blocks(rows, [by], order, size - 1).withColumn("rolling", F.get(values, F.least(F.floor(n * q).cast("int"), n - 1)))
    return found.where("not _guest").drop("_block", "_guest", "_no")


def rates(rows: DataFrame, by: str, failed: Column, succeeded: Column) -> DataFrame:
    """For each by: total, errors, successes, and their shares."""
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("errors"), F.count_if(succeeded).alias("successes"))
    return out.withColumns({"error_rate": F.col("errors") / F.col("total"), "success_rate": F.col("successes") / F.col("total")})


def counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("count"))


def by_key(rows: DataFrame, keys: str) -> DataFrame:
    """One row for each key of an array column: an operation on several keys counts for each."""
    return rows.withColumn("key", F.explode(F.array_distinct(keys)))


def histogram(rows: DataFrame, value: str, bounds: list[float] = BOUNDS) -> DataFrame:
    """bound (null: none) and how many values are not over it."""
    all_ = rows.agg(*(F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(bounds)), F.count(value).alias("b_all"))
    pairs = F.array(*(F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{k}").alias("count")) for k, b in enumerate(bounds)), F.struct(F.lit(None).cast("double").alias("bound"), F.col("b_all").alias("count")))
    return all_.select(F.inline(pairs))


def throughput(rows: DataFrame, time: str, seconds: int) -> DataFrame:
    """start, count and rate of half-open windows of so many seconds, from the first time on; empty windows too."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    size = seconds * 1_000_000
    ends = rows.agg(F.min(micros).alias("first"), F.max(micros).alias("last"))
    spans = ends.where("first is not null").select("first", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - F.col("first")) / size))).alias("no"))
    first = ends.first()["first"]
    tallied = rows.where(F.col(time).isNotNull()).groupBy(F.floor((micros - F.lit(first)) / size).alias("no")).agg(F.count(F.lit(1)).alias("count"))
    out = spans.join(tallied, "no", "left")
    n = F.coalesce("count", F.lit(0))
    return out.select(F.timestamp_micros(F.col("first") + F.col("no") * size).alias("start"), n.alias("count"), (n / float(seconds)).alias("rate"))


def overlapping(rows: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Groups of intervals that overlap one another in a chain, within each by: by, start, end and size of those over 1.

    An interval joins the group before it if it starts before the latest end so far.
    """
    along = Window.partitionBy(by).orderBy(start, end)
    latest = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(latest.isNull() | (F.col(start) >= latest), 1).otherwise(0))
    grouped = marked.withColumn("_group", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy(by, "_group").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("_group")


def window_rate(rows: DataFrame, time: str, value: str, by: str, seconds: int, most: int | None = None) -> DataFrame:
    """rows with a column rate: the growth of value from the first to this row of the last so many seconds, a second.

    most: of the last so many rows, this one included, if these are fewer.
    """
    rows = rows.withColumn("_at", F.unix_micros(F.col(time).cast("timestamp")))
    along = Window.partitionBy(by).orderBy("_at")
    first = F.min(F.struct("_at", value)).over(along.rangeBetween(-seconds * 1_000_000, 0))
    if most:
        held = F.min(F.struct("_at", value)).over(Window.partitionBy(by).orderBy("_at", value).rowsBetween(-(most - 1), 0))
        first = F.greatest(first, held)
    found = rows.withColumn("_first", first)
    elapsed = (F.col("_at") - F.col("_first._at")) / 1e6
    return found.withColumn("rate", F.when(elapsed > 0, (F.col(value) - F.col(f"_first.{value}")) / elapsed).otherwise(0.0)).drop("_at", "_first")


def out_of_order(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value is under that of the row before, within by."""
    return rows.withColumn("before", F.lag(value).over(Window.partitionBy(by).orderBy(order))).where(F.col(value) < F.col("before"))


def repeats(rows: DataFrame, by: str, order: str, kind: str) -> DataFrame:
    """For each by: repeats, how many rows are of the kind of the row before."""
    before = F.lag(kind).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_before", before).groupBy(by).agg(F.count_if(F.col(kind) == F.col("_before")).alias("repeats"))


def sequences(rows: DataFrame, process: str, time: str, op: str, block: int = 10_000) -> DataFrame:
    """For each process its operations in order of time, in blocks: no (from 0), first number, count and their ids.

    A process of any number of operations has as many rows as it needs.
    """
    at = ordering.numbered(rows, [process], [time, op], "_no").withColumn("no", F.floor((F.col("_no") - 1) / block))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_no", op))), lambda s: s[op])
    return at.groupBy(process, "no").agg(F.min("_no").alias("first"), F.count(F.lit(1)).alias("count"), listed.alias("ops"))


def distribution(rows: DataFrame, node: Column) -> DataFrame:
    """How rows spread over nodes: nodes, min, max, mean and population deviation of their counts."""
    per = rows.groupBy(node.alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("nodes"), F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"))


def hashed(key: Column) -> Column:
    """32 bits of the key's MD5, as a whole number."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def shard(key: Column, n: int) -> Column:
    """The shard of a key, from 0."""
    return hashed(key) % n


def sampled(key: Column, rate: float) -> Column:
    """Whether a trace of this id is kept: the same answer wherever it is asked."""
    return hashed(key) % 10_000 < rate * 10_000


def stale_reads(rows: DataFrame, key: str, time: str, kind: str, ok: str) -> DataFrame:
    """Reads that failed right after a write of the same key, in order of start."""
    before = F.lag(kind).over(Window.partitionBy(key).orderBy(time))
    return rows.withColumn("before", before).where((F.col("before") == "write") & (F.col(kind) == "read") & ~F.col(ok))


def register_violations(rows: DataFrame, key: str, order: list[str], kind: str, value: str) -> DataFrame:
    """Reads of a register that do not return its last write before them (null before the first).

    For histories of reads and writes; ``replayed`` takes compare-and-sets too.
    """
    written = F.when(F.col(kind) != "read", F.struct(F.col(value).alias("v")))
    last = F.last(written, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("expected", last["v"]).where((F.col(kind) == "read") & ~F.col(value).eqNullSafe(F.col("expected")))


def replayed(rows: DataFrame, key: str, order: list[str], kind: str, value: str, old: str, ok: str) -> DataFrame:
    """The operations that a register of its key, replayed in order, contradicts: rows with expected, the value before them.

    Kinds are read, write and cas, any other is passed over; ok is whether an operation took effect. A read must return the value, null
    before the first write; a cas that took effect must have found old, and one that did not changes nothing. After a
    contradiction the replay goes on: a read leaves the value as it was, a cas that took effect sets its own. One pass over sorted partitions holds the current key's
    value only.
    """
    kept = [c for c in rows.columns if c != "expected"]
    ready = rows.select(*kept).repartition(key).sortWithinPartitions(key, *order)
    kinds = dict(rows.dtypes)
    schema = T.StructType([*ready.schema, T.StructField("expected", ready.schema[value].dataType)])
    if kinds[value] != kinds[old]:
        raise ValueError("old and new values must be of one type")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            bad, expected = [], []
            for i, (k, what, new, was, took) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key, kind, value, old, ok)), strict=True)):
                if k != now:
                    now, state = k, None
                wrong = took and (what == "read" and new != state or what == "cas" and was != state)
                if wrong:
                    bad.append(i)
                    expected.append(state)
                if took and what in ("write", "cas"):
                    state = new
            if bad:
                some = batch.take(pa.array(bad))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), pa.array(expected, batch.column(value).type)], [*kept, "expected"])

    return ready.mapInArrow(work, schema)


def conflicts(rows: DataFrame, transaction: str, keys: str) -> DataFrame:
    """Pairs (a, b), a before b, of transactions that share a key, once each. As many rows as pairs: see ``cliques``."""
    flat = rows.select(F.col(transaction).alias("t"), F.explode(F.array_distinct(keys)).alias("_key"))
    a, b = ordering.block_pairs(flat, "_key", "t")
    both = a.withColumnRenamed("t", "a").join(b.withColumnRenamed("t", "b"), ["_key", "_i", "_j"])
    return both.where((F.col("a") < F.col("b")) | (F.col("_i") != F.col("_j"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def cliques(rows: DataFrame, transaction: str, keys: str) -> DataFrame:
    """The same conflicts without listing pairs: key, transaction, first (the least transaction of the key) and others.

    Any two transactions with a key in common are in conflict; a key that only one has gives no row.
    """
    flat = rows.select(transaction, F.explode(F.array_distinct(keys)).alias("key")).distinct()
    of = flat.groupBy("key").agg(F.min(transaction).alias("first"), (F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    return flat.join(of, "key").select("key", transaction, "first", "others")


def selected(rows: DataFrame, kinds: list[str] | None = None, start=None, end=None, process: int | None = None, ok: bool | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """A history's operations by kind, time (both ends included), process and outcome."""
    name = {"kind": "kind", "time": "time", "process": "process", "ok": "ok"} | (columns or {})
    if kinds is not None:
        rows = rows.where(F.col(name["kind"]).isin(kinds))
    if start is not None:
        rows = rows.where(F.col(name["time"]) >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col(name["time"]) <= F.lit(end))
    if process is not None:
        rows = rows.where(F.col(name["process"]) == process)
    return rows if ok is None else rows.where(F.col(name["ok"]) == ok)


# The kinds of generated operations and their weights.
WORKLOAD = {"read": 0.4, "write": 0.3, "cas": 0.1, "transaction": 0.1, "append": 0.05, "increment": 0.05}


def _drawn(seed: int, what: int) -> Column:
    """A number from 0 up to 1 by the row's id: the same whatever the partitions."""
    return hashed(F.concat_ws(":", F.lit(seed).cast("string"), F.lit(what).cast("string"), F.col("id").cast("string"))) / 2**32


def workload(spark, n: int, keys: int = 10, processes: int = 5, seed: int = 0, weights: dict[str, float] | None = None) -> DataFrame:
    """A random history of n operations: id, process, key, kind and value; the same for the same seed."""
    weights = weights or WORKLOAD
    draw = _drawn(seed, 0) * sum(weights.values())
    kind, bound = None, 0.0
    for k, w in weights.items():
        bound += w
        kind = F.when(F.col("_draw") < bound, k) if kind is None else kind.when(F.col("_draw") < bound, k)
    rows = spark.range(n).withColumn("_draw", draw).withColumn("process", F.floor(_drawn(seed, 1) * processes)).withColumn("key", F.floor(_drawn(seed, 2) * keys))
    return rows.withColumn("kind", kind.otherwise("read")).withColumn("value", F.floor(_drawn(seed, 3) * 100)).drop("_draw")


def fault_tolerance(nodes: Column, violations: Column) -> Column:
    """max(0, (n - v) / n - v / n)."""
    return F.greatest(F.lit(0.0), (nodes - violations) / nodes - violations / nodes)


def window_limited(rows: DataFrame, by: str, time: str, limit: int, seconds: int, tie: str | None = None) -> DataFrame:
    """rows with a column allowed: at most limit rows of a window, which begins with the first row after the last one's end.

    Where a window begins depends on all rows before it. Rows are dealt by ``by`` and sorted, and one pass over each
    partition holds only the state of the current key: a key of any number of rows is streamed, not collected.
    """
    size = seconds * 1_000_000
    kept = [c for c in rows.columns if c != "allowed"]
    ready = rows.select(*kept).withColumn("_at", F.unix_micros(F.col(time).cast("timestamp")))
    ready = ready.repartition(by).sortWithinPartitions(by, "_at", *([tie] if tie else []))
    schema = T.StructType([*ready.select(*kept).schema, T.StructField("allowed", T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, began, n = object(), 0, 0
        for batch in batches:
            out = []
            for k, t in zip(batch.column(by).to_pylist(), batch.column("_at").to_pylist(), strict=True):
                if k != key or t is not None and t - began >= size:
                    key, began, n = k, t or 0, 0
                n += 1
                out.append(n <= limit)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.bool_())], [*kept, "allowed"])

    return ready.mapInArrow(work, schema)


def too_many(rows: DataFrame, metric: str, label: str, most: int) -> DataFrame:
    """The metrics whose labels have over most different values, by an estimate: metric and values."""
    return rows.groupBy(metric).agg(F.approx_count_distinct(label, 0.01).alias("values")).where(F.col("values") > most)
