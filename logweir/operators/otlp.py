"""OTLP log requests: batches by count and bytes, grouping by resource, JSON."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions import text
from logweir.operators.cut import greedy_cut
from logweir.operators.enrich import with_record_size
from logweir.operators.ordered import running
from logweir.rules import ExportOptions

SCOPE = "logweir"


def key_values(values: Column) -> Column:
    """Attributes as a list of key and string value, in key order."""
    return F.transform(
        text.sorted_entries(values),
        lambda entry: F.struct(
            entry["key"].alias("key"), F.struct(entry["value"].alias("stringValue")).alias("value")
        ),
    )


def _unless_empty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def log_record(
    *, time_unix_nano: str = "time_unix_nano", observed_ts: str = "observed_ts", body: str = "body"
) -> Column:
    """One log record in the OTLP JSON mapping.

    64-bit numbers are text, the trace id is hex, and fields that hold their
    default are null, which ``to_json`` leaves out.
    """
    trace = F.lower(F.hex("trace_id"))
    return F.struct(
        F.col(time_unix_nano).cast("string").alias("timeUnixNano"),
        (F.unix_micros(observed_ts) * 1000).cast("string").alias("observedTimeUnixNano"),
        F.when(F.col("severity_number") != 0, F.col("severity_number")).alias("severityNumber"),
        F.nullif(F.col("severity_text"), F.lit("")).alias("severityText"),
        F.struct(F.col(body).alias("stringValue")).alias("body"),
        _unless_empty(key_values(F.col("attributes"))).alias("attributes"),
        F.nullif(trace, F.lit("")).alias("traceId"),
    )


def pack_batches(
    records: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    options: ExportOptions = ExportOptions(),
    *,
    block: Column | None = None,
    block_rows: int = 65536,
    hold: Callable[[DataFrame], DataFrame] = lambda places: places,
) -> DataFrame:
    """Add ``pos`` and ``batch``: greedy batches of at most ``batch_size`` records
    and ``max_batch_bytes`` estimated bytes per key, in the given order.

    Which records share a batch has no meaning further on, so choose keys that
    spread well, such as source and hour; ``order`` must tell the records of a
    key apart.  The batch is the place of its first record, the same on every
    run, so a lost task can be repeated safely.  Places are found for keys,
    order and sizes alone; the records move once, to meet theirs.  The cuts read
    the places several times: ``hold`` may keep them, so that the order is found
    once.
    """
    sized = records if "size" in records.columns else with_record_size(records)
    place = list(dict.fromkeys([*keys, *order]))
    narrow = running(
        sized.select(*place, "size"), keys, order, sums={"_pos": F.lit(1).cast("long")}, block=block, exclusive=True
    )
    cuts = greedy_cut(
        hold(narrow), keys, pos="_pos", size=F.col("size"), max_rows=options.batch_size, max_bytes=options.max_batch_bytes,
        out="batch", block_rows=block_rows, carry=[name for name in order if name not in keys],
    )
    named = cuts.select(
        *[F.col(name).alias(f"_o{at}") for at, name in enumerate(place)], F.col("_pos").alias("pos"), "batch"
    )
    same = [F.col(name).eqNullSafe(F.col(f"_o{at}")) for at, name in enumerate(place)]
    return sized.join(named, same).drop(*[f"_o{at}" for at in range(len(place))])


def resource_logs(batched: DataFrame, keys: Sequence[str], *, scope: str = SCOPE) -> DataFrame:
    """One request per batch: records grouped by resource, one scope each.

    Both groupings use one shuffle, on the batch.  The lists are bounded by
    the batch limits.
    """
    batch_keys = [*keys, "batch"]
    grouped = (
        batched.select(*batch_keys, "pos", "resource_key", "resource", log_record().alias("record"))
        .repartition(*batch_keys)
        .groupBy(*batch_keys, "resource_key")
        .agg(
            F.first("resource").alias("resource"),
            F.sort_array(F.collect_list(F.struct("pos", "record"))).alias("records"),
        )
    )
    one = F.struct(
        F.struct(_unless_empty(key_values(F.col("resource"))).alias("attributes")).alias("resource"),
        F.array(
            F.struct(
                F.struct(F.lit(scope).alias("name")).alias("scope"),
                F.transform("records", lambda item: item["record"]).alias("logRecords"),
            )
        ).alias("scopeLogs"),
    )
    lists = F.sort_array(F.collect_list(F.struct("resource_key", one.alias("entry"))))
    return (
        grouped.groupBy(*batch_keys)
        .agg(F.transform(lists, lambda item: item["entry"]).alias("resourceLogs"))
    )


def requests(batched: DataFrame, keys: Sequence[str], *, scope: str = SCOPE) -> DataFrame:
    """One JSON document per batch, in column ``request``."""
    return resource_logs(batched, keys, scope=scope).select(
        *keys, "batch", F.to_json(F.struct("resourceLogs")).alias("request")
    )


def write_requests(documents: DataFrame, path: str, *, compression: str = "") -> None:
    """Write one request document per line, gzipped when asked."""
    if compression not in ("", "gzip"):
        raise ValueError("unknown compression, only gzip can be named")
    writer = documents.select("request").write.mode("errorifexists")
    writer.option("compression", compression or "none").text(path)
