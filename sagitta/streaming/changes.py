"""Change streams on Structured Streaming: change events, the latest state they add up to, windows over event time.

An event has event_id, collection, vector_id, change_type (insert, update or delete), vector, previous_vector, ts and
sequence, which grows within a collection across batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sagitta.operators import ordering
from sagitta.operators.collections import latest
from sagitta.sources import files

EVENT = "event_id string, collection string, vector_id long, change_type string, vector array<float>, previous_vector array<float>, ts timestamp, transaction_id string, sequence long"


def difference(before: DataFrame, after: DataFrame, collection: str, transaction_id: str | None = None, start: int = 0, at: Column | None = None) -> DataFrame:
    """The events that turn one state (id, vector) into another, numbered from start on in order of id."""
    a, b = before.select("id", F.col("vector").alias("_a"), F.lit(1).alias("_in_a")), after.select("id", F.col("vector").alias("_b"), F.lit(1).alias("_in_b"))
    kind = F.when(F.col("_in_a").isNull(), "insert").when(F.col("_in_b").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    rows = a.join(b, "id", "full_outer").withColumn("change_type", kind).where("change_type is not null")
    rows, number = ordering.numbered(rows, [], ["id"], "_no"), F.col("_no") - 1 + start
    return rows.select(
        F.concat_ws("-", F.lit(collection), number.cast("string")).alias("event_id"), F.lit(collection).alias("collection"), F.col("id").alias("vector_id"), "change_type",
        F.col("_b").alias("vector"), F.col("_a").alias("previous_vector"), (at if at is not None else F.current_timestamp()).alias("ts"), F.lit(transaction_id).cast("string").alias("transaction_id"), number.cast("long").alias("sequence"),
    )


def sequenced(events: DataFrame, by: str, order: list[str], start: dict | None = None) -> DataFrame:
    """events with a sequence within each by, from 0 or from where start (value: number) leaves off."""
    first = F.coalesce(F.create_map(*(F.lit(x) for pair in start.items() for x in pair))[F.col(by)], F.lit(0)) if start else F.lit(0)
    return events.withColumn("sequence", (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1 + first).cast("long"))


def append(events: DataFrame, log: str) -> None:
    """Publishes a batch: files appended to the log, a folder of Parquet that keeps collections apart."""
    events.write.mode("append").partitionBy("collection").parquet(log)


def subscribe(spark: SparkSession, log: str, collection: str | None = None, per_batch: int | None = None) -> DataFrame:
    """The log as a stream, of one collection or of all; per_batch limits the new files of a turn. Nothing is lost to slow readers."""
    reader = spark.readStream.schema(EVENT)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    stream = reader.parquet(log)
    return stream if collection is None else stream.where(F.col("collection") == collection)


def gaps(events: DataFrame) -> DataFrame:
    """Where a log's sequence numbers leave out or repeat some: collection, sequence and before, the number that came before it (null: the first, over 0).

    A replay of the log is whole if there are none.
    """
    along = Window.partitionBy("collection").orderBy("sequence")
    told = events.select("collection", "sequence", F.lag("sequence").over(along).alias("before"))
    return told.where(F.col("sequence") != F.coalesce("before", F.lit(-1)) + 1)


def state(events: DataFrame) -> DataFrame:
    """collection, vector_id and vector after all events: the last of each vector counts, deleted ones are gone."""
    rows = events.withColumn("_key", F.struct("collection", "vector_id"))
    last = latest(rows, "_key", "sequence")
    return last.where("change_type != 'delete'").select("collection", "vector_id", "vector", "sequence")


def materialise(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest state of a stream in path/v<batch>; a repeated batch rewrites its own version and changes nothing else."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("_key", F.struct("collection", "vector_id"))
        last = latest(new, "_key", "sequence").select("collection", "vector_id", "vector", "sequence", (F.col("change_type") == "delete").alias("deleted"))
        if number:
            old = spark.read.parquet(f"{path}/v{number - 1}")
            both = old.unionByName(last).withColumn("_key", F.struct("collection", "vector_id"))
            last = latest(both, "_key", "sequence").drop("_key")
        last.write.mode("overwrite").parquet(f"{path}/v{number}")
        # a repeated batch reads the version before its own; older ones are of no use
        files.delete(spark, f"{path}/v{number - 2}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deliver(stream: DataFrame, send, checkpoint: str) -> StreamingQuery:
    """Hands every event to send as a JSON text, on the executors, at least once."""

    def out(batch: DataFrame, _: int) -> None:
        batch.select(F.to_json(F.struct("*")).alias("json")).foreachPartition(lambda rows: [send(r.json) for r in rows] and None)

    return stream.writeStream.foreachBatch(out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, time: str, length: str, by: str | None = None, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """start, (by and) count of windows over event time; in a stream, rows later than late are left out."""
    rows = events.withColumn("_time", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_time", late)
    w = F.window("_time", length, slide) if slide else F.window("_time", length)
    return rows.groupBy(w.alias("_w"), *([by] if by else [])).agg(F.count(F.lit(1)).alias("count")).select(F.col("_w.start").alias("start"), *([by] if by else []), "count")


def sessions(events: DataFrame, time: str, gap: str, by: str, late: str = "10 minutes") -> DataFrame:
    """start, end and count of each by's sessions: rows less than gap apart."""
    rows = events.withColumn("_time", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_time", late)
    out = rows.groupBy(F.session_window("_time", gap).alias("_w"), by).agg(F.count(F.lit(1)).alias("count"))
    return out.select(by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "count")


def limited(stream: DataFrame, by: str, time: str, limit: int, seconds: int) -> DataFrame:
    """by, at and allowed for each row of a stream: at most limit rows of a window that begins with its first row.

    A key's rows of one micro-batch are taken in order of time, whatever frames they come in: their times, eight bytes a row, are
    held together, so the source's limit of rows a batch bounds what a task holds.
    """
    size, step = pd.Timedelta(seconds=seconds), 10_000

    def turn(key: tuple, frames: Iterator[pd.DataFrame], state_) -> Iterator[pd.DataFrame]:
        began, n = state_.get if state_.exists else (None, 0)
        began = pd.Timestamp(began) if began is not None else None
        times = pd.Series(np.sort(np.concatenate([np.zeros(0, "datetime64[us]"), *(f[time].to_numpy("datetime64[us]") for f in frames)])))
        for a in range(0, len(times), step):
            out = []
            for t in times[a : a + step]:
                if began is None or t - began >= size:
                    began, n = t, 0
                n += 1
                out.append(n <= limit)
            yield pd.DataFrame({by: [key[0]] * len(out), "at": times[a : a + step].to_numpy(), "allowed": out})
        state_.update((None if began is None else began.to_pydatetime(), n))

    kind = dict(stream.dtypes)[by]
    return stream.groupBy(by).applyInPandasWithState(turn, f"{by} {kind}, at timestamp, allowed boolean", "began timestamp, n int", "append", "NoTimeout")
