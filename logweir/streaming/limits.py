"""Flow control of micro-batches: the batch operator, started from stored buckets.

Spark follows one stateful step per stream, and merging lines is that step.
So the buckets live in a small table: each micro-batch reads what the ones
before left, decides its arrivals with ``flow.follow``, and adds the buckets it
moved, which makes a replayed batch decide as it did before.  A bucket that
holds for the whole fleet is spread over ranges like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.operators.flow import drop_report, follow
from logweir.rules import FlowControl, duration_ms
from logweir.session import staged
from logweir.streaming.sinks import Sink
from logweir.streaming.state_table import ADDED, StateTable, newest_per, table_step

_PLACE = ("file_key", "start_offset")


def buckets(folder: str) -> StateTable:
    """The buckets after each micro-batch, the newest per key."""
    return StateTable(f"{folder}/buckets", "key string, parts string, last long", newest_per("key"))


def dropped_counts(folder: str) -> StateTable:
    """Refused records per report window and micro-batch; they add up."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("window_start", "window_end").agg(F.sum("dropped").alias("dropped"), F.max(ADDED).alias(ADDED))

    return StateTable(f"{folder}/dropped", "window_start timestamp, window_end timestamp, dropped long", merge)


def reported_drops(spark: SparkSession, folder: str) -> DataFrame:
    """One row per report window: refused records of all micro-batches together."""
    return dropped_counts(folder).before(spark).drop(ADDED)


def limited_sink(sink: Sink, options: FlowControl, folder: str, key: Column, *, place: tuple[str, ...] = _PLACE) -> Sink:
    """Pass on what the buckets admit; waits and counts of refused records become tables.

    In block mode every record goes on with ``admit_ts``, the moment it may
    leave; in drop mode refused records are counted per ``report_interval``.
    ``place`` tells the records of a batch apart.
    """
    held, counts = buckets(folder), dropped_counts(folder)

    def send(batch: DataFrame, batch_id: int | str) -> None:
        spark, step = batch.sparkSession, table_step(batch_id)
        # Written, not cached: a lost executor must not make its rows anew in another order.
        batch = staged(batch.withColumn("_key", key.cast("string")), "limited")
        narrow = batch.select(F.col("_key").alias("key"), F.col("ts").cast("timestamp").alias("ts"), *place)
        found = follow(
            narrow, ["key"], options, order=("ts", *place), entry=held.before(spark, step), with_buckets=True
        )
        decided = found.records.select(*place, "admitted", F.timestamp_micros("admit_us").alias("admit_ts"))
        rows = batch.drop("_key").join(decided, list(place))
        if options.mode == "drop":
            refused = found.records.where("not admitted")
            counts.put(drop_report(refused, interval=f"{duration_ms(options.report_interval) / 1000} seconds"), step)
        sink(rows.where("admitted").drop("admitted"), batch_id)
        held.put(found.buckets, step)

    return send
