"""Delivery outcomes and the redelivery schedule as a table job."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.rules import Retry, duration_ms

# Month names in HTTP dates.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds of a Retry-After text: seconds or one of the HTTP dates; else 0."""
    seconds = F.when(F.rlike(value, F.lit(r"^\d+(\.\d+)?\z")), F.floor(value.try_cast("double") * 1000))
    long_form = r"^\w+, (\d{2})[ -](\w{3})[ -](\d{2,4}) (\d{2}:\d{2}:\d{2}) GMT\z"
    short_form = r"^\w{3} (\w{3}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})\z"

    def pick(first: int, second: int) -> Column:
        return F.coalesce(
            F.nullif(F.regexp_extract(value, long_form, first), F.lit("")),
            F.nullif(F.regexp_extract(value, short_form, second), F.lit("")),
        )

    year = pick(3, 4)
    full_year = F.when(F.length(year) == 4, year).when(
        F.length(year) == 2, F.concat(F.when(year >= "69", F.lit("19")).otherwise("20"), year)
    )
    month = F.array_position(F.array(*[F.lit(name) for name in MONTHS]), pick(2, 1)).cast("string")
    stamp = F.concat(
        full_year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(pick(1, 2), 2, "0"),
        F.lit("T"), pick(4, 3), F.lit("Z"),
    )
    until = F.floor((F.unix_micros(F.try_to_timestamp(stamp)) - F.unix_micros(now)) / 1000)
    return F.coalesce(seconds, F.greatest(until, F.lit(0)), F.lit(0)).cast("long")


def classify(status: Column, rejected: Column | None = None) -> Column:
    """Outcome of one attempt; a null status means that no answer came."""
    part = F.coalesce(rejected, F.lit(0)) > 0 if rejected is not None else F.lit(False)
    return (
        F.when(status.isNull(), "retry_network")
        .when(status.between(200, 299), F.when(part, "retry_partial").otherwise("ok"))
        .when(status.isin(408, 429) | (status >= 500), "retry_status")
        .otherwise("permanent")
    )


def schedule(attempts: DataFrame, retry: Retry = Retry()) -> DataFrame:
    """Last outcome of each batch and when to send it again.

    ``attempts`` has ``batch_id, attempt`` (from 1), ``at, status,
    retry_after_ms`` and optionally ``rejected``.  The wait doubles after each
    failure up to the longest interval; a longer Retry-After raises the wait
    and is not capped.  Doubling reaches the longest interval after a fixed
    number of failures, so only that many attempts of a batch need their
    history; all later ones have it by definition.
    """
    initial = int(duration_ms(retry.initial_interval)) or 1_000
    longest = int(duration_ms(retry.max_interval)) or 30_000
    elapsed_limit = int(duration_ms(retry.max_elapsed_time))
    early = max(1, math.ceil(math.log2(max(longest / initial, 1))) + 1)

    rejected = F.col("rejected") if "rejected" in attempts.columns else None
    rows = attempts.withColumn("outcome", classify(F.col("status"), rejected)).withColumn(
        # Only an answer with a status can raise the wait.
        "_asked", F.when(F.col("outcome") == "retry_status", F.coalesce(F.col("retry_after_ms"), F.lit(0))).otherwise(0).cast("long")
    )
    history = Window.partitionBy("batch_id").orderBy("attempt").rowsBetween(-early, -1)
    before = F.aggregate(
        F.collect_list("_asked").over(history),
        F.lit(initial).cast("long"),
        lambda wait, asked: F.least(F.lit(longest).cast("long"), F.greatest(wait, asked) * 2),
    )
    first_rows = rows.where(F.col("attempt") <= early).withColumn("_wait", before)
    later_rows = rows.where(F.col("attempt") > early).withColumn("_wait", F.lit(longest).cast("long"))
    waited = first_rows.unionByName(later_rows).withColumn("_wait", F.greatest("_wait", "_asked"))

    started = rows.groupBy("batch_id").agg(F.min("at").alias("_started"))
    elapsed = F.floor((F.unix_micros("at") - F.unix_micros("_started")) / 1000)
    failed = F.startswith("outcome", F.lit("retry"))
    if not retry.enabled:
        exhausted = failed
    elif elapsed_limit > 0:
        exhausted = failed & (elapsed + F.col("_wait") > elapsed_limit)
    else:
        exhausted = F.lit(False)
    judged = waited.join(started, "batch_id").withColumn(
        "outcome", F.when(exhausted, F.lit("gave_up")).otherwise(F.col("outcome"))
    )
    # A batch ends at its first final outcome; attempts after it do not count.
    final = F.col("outcome").isin("ok", "permanent", "gave_up")
    row = F.struct("attempt", "outcome", "at", "_wait")
    return (
        judged.groupBy("batch_id")
        .agg(F.min_by(row, F.when(final, F.col("attempt"))).alias("_end"), F.max_by(row, "attempt").alias("_last"))
        .withColumn("_row", F.coalesce("_end", "_last"))
        .select(
            "batch_id",
            F.col("_row.attempt").alias("attempts"),
            F.col("_row.outcome").alias("outcome"),
            F.when(F.col("_end").isNull(), F.col("_row._wait")).alias("wait_ms"),
            F.when(
                F.col("_end").isNull(),
                F.timestamp_micros(F.unix_micros(F.col("_row.at").cast("timestamp")) + F.col("_row._wait") * 1000),
            ).alias("next_at"),
        )
    )


def reply_outcome(status: Column, errcode: Column) -> Column:
    """Outcome of an alert: a 2xx answer whose error code is 0."""
    return (
        F.when(status.isNull(), "network_error")
        .when(~status.between(200, 299), "http_error")
        .when(errcode.isNull(), "bad_answer")
        .when(errcode != 0, "rejected")
        .otherwise("ok")
    )
