"""Registered streaming queries: each runs a stream over the tables to its end."""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.operators import targets
from logweir.plans import queries as batch
from logweir.plans import views
from logweir.rules import ExportOptions, FileRule, FlowControl, Limits, Multiline, Retry, RuleSet
from logweir.session import mounted_path, scratch_dir, staged
from logweir.sources.tail_source import tail_lines
from logweir.streaming import job, limits, sinks
from logweir.streaming.redelivery import Outbox
from logweir.streaming.stateful import merge_stream, open_records


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream; a pattern that only its name fits makes the single file a listing."""
    schema = views.table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def _run(stream: DataFrame, where: str) -> None:
    """Read all that is there, write it as parquet, keep the checkpoint.

    One round, not ``availableNow``: with processing-time timers pending that
    trigger would go on with empty batches and never end.
    """
    query = (
        stream.writeStream.format("parquet").option("path", f"{where}/out")
        .option("checkpointLocation", f"{where}/checkpoint").trigger(once=True).start()
    )
    query.awaitTermination()


# ---------------------------------------------------------------- multi-line


def _merged_stream(spark: SparkSession, folder: str, name: str, **limits: int) -> DataFrame:
    docs = _stream(spark, folder, "documents")
    lines = docs.select(
        F.col("doc_id").alias("file_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("long"))
    where = scratch_dir(spark, name)
    _run(merge_stream(lines, "^[A-M]", order="line_no", **limits), where)
    # Closed records from the sink, open ones from the state: the final flush.
    return spark.read.parquet(f"{where}/out").unionByName(open_records(spark, f"{where}/checkpoint"))


def streamed_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _merged_stream(spark, folder, "streamed")


def streamed_documents_limited(spark: SparkSession, folder: str) -> DataFrame:
    return _merged_stream(spark, folder, "streamed-limited", max_size=700, max_lines=3)


# ---------------------------------------------------------------- tail


def _write_files(parts: DataFrame, target: str, *, half: bool) -> None:
    """Write one file per fifty documents: its first half, or the rest after it.

    Each task writes at fixed places, so a repeated task changes nothing.
    """

    def write(docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("doc_id")
        data = "".join(text + "\n" for text in docs["text"]).encode()
        cut = len(data) // 2
        path = f"{target}/{int(docs['part'].iloc[0])}.log"
        with open(path, "wb" if half else "r+b") as file:
            file.seek(0 if half else cut)
            file.write(data[:cut] if half else data[cut:])
        return pd.DataFrame({"part": [int(docs["part"].iloc[0])]})

    parts.groupBy("part").applyInPandas(write, "part long").agg(F.count(F.lit(1))).collect()


#: What a round reads of one file, as the rules have it.
_ROUND_BYTES = Limits().max_read_bytes_per_file


def _rounds(folder: str) -> int:
    largest = max((os.path.getsize(os.path.join(folder, name)) for name in os.listdir(folder)), default=0)
    return 1 + largest // _ROUND_BYTES


def _tailed(spark: SparkSession, folder: str, name: str, *, rounds: int, shards: int) -> DataFrame:
    """Files that grow between two runs, read in so many rounds each; the second resumes where the first stopped."""
    where = mounted_path(scratch_dir(spark, name))
    os.makedirs(f"{where}/in", exist_ok=True)
    parts = views.table(spark, folder, "documents").select(
        F.floor(F.col("doc_id") / 50).cast("long").alias("part"), "doc_id", "text"
    )
    for half in (True, False):
        _write_files(parts, f"{where}/in", half=half)
        largest = max((os.path.getsize(os.path.join(f"{where}/in", name)) for name in os.listdir(f"{where}/in")), default=0)
        cap = _ROUND_BYTES if rounds == 1 else max(1, largest // rounds)
        lines = tail_lines(
            spark, include=[f"{where}/in/*.log"], start_at="beginning", max_bytes_per_file=cap, shards=shards,
            progress=f"{where}/progress",
        )
        # A round ends at the cap of a file; further rounds follow until nothing is left.
        for _ in range(1 + largest // cap):
            _run(lines, where)
    part = F.regexp_extract("path", r"/(\d+)\.log$", 1).cast("long")
    return spark.read.parquet(f"{where}/out").select(part.alias("part"), "start_offset", "end_offset", "line")


def tailed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Listed by the driver, a half of each file in one round."""
    return _tailed(spark, folder, "tailed", rounds=1, shards=0)


def tailed_in_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Listed by tasks, and with a cap below the size of the files."""
    return _tailed(spark, folder, "tailed-rounds", rounds=3, shards=4)


def drained(spark: SparkSession, folder: str) -> DataFrame:
    """Files that grow between two runs of the job, each run drained: what was exported per file, twice what must be once.

    The record that is open at the first drain goes on in the second run.
    """
    where = mounted_path(scratch_dir(spark, "drained"))
    os.makedirs(f"{where}/in", exist_ok=True)
    rule = FileRule(
        name="docs", include=(f"{where}/in/*.log",), start_at="beginning", multiline=Multiline(start_pattern="^[A-M]", flush_after="1h"),
    )
    rules = RuleSet(files=(rule,))
    parts = views.table(spark, folder, "documents").select(
        F.floor(F.col("doc_id") / 50).cast("long").alias("part"), "doc_id", "text"
    )
    for half in (True, False):
        _write_files(parts, f"{where}/in", half=half)
        for _ in range(_rounds(f"{where}/in")):
            job.start(spark, rules, rule, folder=f"{where}/job", once=True).awaitTermination()
        job.drain(spark, rules, rule, folder=f"{where}/job")
    # Nothing is left to send.
    job.drain(spark, rules, rule, folder=f"{where}/job")
    record = "struct<body: struct<stringValue: string>>"
    attribute = "array<struct<key: string, value: struct<stringValue: string>>>"
    schema = f"resourceLogs array<struct<resource: struct<attributes: {attribute}>, scopeLogs: array<struct<logRecords: array<{record}>>>>>"
    deep = spark.read.option("recursiveFileLookup", "true").text(f"{where}/job/export")
    entry = deep.select(F.explode(F.from_json("value", schema)["resourceLogs"]).alias("entry"))
    path = F.filter("entry.resource.attributes", lambda item: item["key"] == "log.file.path")[0]["value"]["stringValue"]
    bodies = entry.select(path.alias("path"), F.explode(F.flatten("entry.scopeLogs.logRecords")).alias("r"))
    found = bodies.select("path", F.explode(F.split("r.body.stringValue", "\n")).alias("line")).where("line <> ''")
    return found.groupBy(F.regexp_extract("path", r"/(\d+)\.log$", 1).cast("long").alias("part")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("line").cast("long")).alias("bytes")
    )


def process_records(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents as files that processes hold open or globs match: all rules in one stream."""
    found = staged(
        targets.discover(
            batch.RULES, processes=views.processes(spark, folder), open_files=views.open_files(spark, folder),
            files=batch.listing(spark, folder),
        ),
        "targets",
    )
    letter = F.array(*map(F.lit, ("f", "o", "p")))[(F.col("doc_id") % 3).cast("int")]
    path = F.concat(F.lit("/data/"), letter, F.lit("/"), (F.col("doc_id") % 4000).cast("string"), F.lit(".log"))
    lines = _stream(spark, folder, "documents").select(
        F.col("doc_id").alias("file_key"), path.alias("path"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("long"))
    where = scratch_dir(spark, "process-records")
    merged = job.merged_targets(job.with_targets(lines, found.where("host = 'node1'")), batch.RULES, order="line_no")
    _run(merged, where)
    still = open_records(spark, f"{where}/checkpoint", (*job.FIRST, "rule")).withColumnRenamed("first_line", "start_offset")
    bodies = spark.read.parquet(f"{where}/out").unionByName(still)
    records = job.finish_targets(bodies, batch.RULES, found.where("host = 'node1'"))
    return records.select(
        F.col("file_key").alias("doc_id"), F.col("start_offset").alias("line_no"), "rule", "body", batch.flat(F.col("resource")).alias("resource")
    )


# ---------------------------------------------------------------- flow control


def _arrivals(spark: SparkSession, folder: str, mode: str, name: str) -> tuple[str, sinks.Sink]:
    """Folder of a limited run, and the sink that takes its micro-batches."""
    where = scratch_dir(spark, name)
    options = FlowControl(enabled=True, mode=mode, rate_per_second=batch.USER_RATE, burst=batch.USER_BURST, report_interval="6h")
    if name.startswith("fleet"):
        options = replace(options, rate_per_second=batch.FLEET_RATE, burst=batch.FLEET_BURST)

    def keep(passed: DataFrame, batch_id: int) -> None:
        passed.select("seq", F.unix_micros("admit_ts").alias("admit_us")).write.mode("overwrite").parquet(f"{where}/out/batch={batch_id}")

    key = F.lit("all") if name.startswith("fleet") else F.col("key")
    return where, limits.limited_sink(keep, options, where, key, place=("seq",))


def _passed(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.parquet(f"{where}/out").drop("batch")


def _limited(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    """One bucket per user over a stream of the events."""
    where, sink = _arrivals(spark, folder, mode, f"user-{mode}")
    events = _stream(spark, folder, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.timestamp_micros(views.micros("ts")).alias("ts")
    )
    writer = events.writeStream.option("checkpointLocation", f"{where}/checkpoint").foreachBatch(sink)
    writer.trigger(availableNow=True).start().awaitTermination()
    return views.arrivals(spark, folder).join(_passed(spark, where), "seq", "left")


def _fleet_batches(spark: SparkSession, folder: str, mode: str) -> str:
    """One bucket for all events, over quarters of their days as micro-batches, one of them replayed."""
    where, sink = _arrivals(spark, folder, mode, f"fleet-{mode}")
    events = views.arrivals(spark, folder).withColumn("day", F.to_date("ts"))
    bounds = events.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    if bounds["first"] is None:
        return where
    span = (bounds["last"] - bounds["first"]).days + 1
    quarter = F.floor(F.datediff("day", F.lit(bounds["first"])) * 4 / span).cast("int")
    for number in (0, 1, 1, 2, 3):
        sink(events.where(quarter == number).drop("day"), number)
    return where


def limited_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Drop mode with one fleet-wide bucket that goes from micro-batch to micro-batch."""
    passed = _passed(spark, _fleet_batches(spark, folder, "drop"))
    return views.arrivals(spark, folder).join(passed, "seq", "left").select("seq", F.col("admit_us").isNotNull().alias("admitted"))


def limited_waits(spark: SparkSession, folder: str) -> DataFrame:
    """Block mode with one fleet-wide bucket that goes from micro-batch to micro-batch."""
    return _passed(spark, _fleet_batches(spark, folder, "block"))


def reported_drops(spark: SparkSession, folder: str) -> DataFrame:
    """Refused records per report window, windows that several micro-batches share added up."""
    found = limits.reported_drops(spark, _fleet_batches(spark, folder, "drop"))
    return found.select(F.unix_micros("window_start").alias("start_us"), "dropped")


def streamed_admissions(spark: SparkSession, folder: str) -> DataFrame:
    found = _limited(spark, folder, "drop")
    return found.select("key", "seq", F.col("admit_us").isNotNull().alias("admitted"))


def streamed_waits(spark: SparkSession, folder: str) -> DataFrame:
    return _limited(spark, folder, "block").select("key", "seq", "admit_us")


# ---------------------------------------------------------------- sinks


def _records(spark: SparkSession, folder: str) -> str:
    """Records of the event lines as a table that a stream can read."""
    where = scratch_dir(spark, "records")
    kept = batch.enrich.drop_levels(batch.records(spark, folder))
    kept.withColumn("pod", F.regexp_extract("path", "(pod[0-9]+)_", 1)).write.parquet(where)
    return where


def _each_batch(spark: SparkSession, source: str, sink: sinks.Sink, where: str) -> None:
    records = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    writer = records.writeStream.option("checkpointLocation", f"{where}/checkpoint").foreachBatch(sink)
    writer.trigger(availableNow=True).start().awaitTermination()


def fanned_out(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts, a sink that fails and export: the failure stops neither of the others."""
    where = scratch_dir(spark, "fan-out")

    def broken(frame: DataFrame, batch_id: int) -> None:
        raise RuntimeError("sink is down")

    sink = sinks.fan_out(
        {
            "alerts": sinks.alert_sink(f"{where}/alerts", batch.POLICY),
            "broken": broken,
            "export": sinks.export_sink(f"{where}/export", ExportOptions(compression="gzip"), ["pod"], ["line_no"]),
        },
        f"{where}/outcomes",
    )
    _each_batch(spark, _records(spark, folder), sink, where)
    deep = spark.read.option("recursiveFileLookup", "true")
    alerts = deep.text(f"{where}/alerts").agg(F.count(F.lit(1)).alias("written"))
    bodies = F.regexp_count("value", F.lit('"timeUnixNano"')).cast("long")
    export = deep.text(f"{where}/export").agg(F.sum(bodies).alias("written"))
    written = alerts.withColumn("sink", F.lit("alerts")).unionByName(export.withColumn("sink", F.lit("export")))
    outcomes = sinks.read_outcomes(spark, f"{where}/outcomes").select("sink", "outcome", "error").distinct()
    return outcomes.join(written, "sink", "left").withColumn("written", F.coalesce("written", F.lit(0)))


def ignored_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts that an ignored keyword holds back, as the stream's side table has them."""
    where = scratch_dir(spark, "ignored")
    _each_batch(spark, _records(spark, folder), sinks.alert_sink(f"{where}/alerts", batch.POLICY), where)
    deep = spark.read.option("recursiveFileLookup", "true").parquet(f"{where}/alerts-ignored")
    return deep.select("line_no", "severity_text", "ignored_by")


#: Seconds between micro-batches, and those at which the output of ``redelivered`` is down.
_EVERY, _DOWN = 15, (30, 45, 60)


def redelivered(spark: SparkSession, folder: str) -> DataFrame:
    """Which call sent each event: eight micro-batches, three while the output is down, sent again when their wait is over."""
    where = scratch_dir(spark, "redelivered")
    started = dt.datetime(2031, 1, 1, tzinfo=dt.timezone.utc)
    passed = [0]

    def export(frame: DataFrame, batch_id: int | str) -> None:
        if passed[0] in _DOWN:
            raise RuntimeError("down")
        frame.select("seq").write.mode("overwrite").parquet(f"{where}/out/sent={batch_id}")

    box = Outbox(
        f"{where}/box", Retry(initial_interval="10s", max_interval="20s", max_elapsed_time="5m"),
        clock=lambda: started + dt.timedelta(seconds=passed[0]),
    )
    events = views.arrivals(spark, folder)
    for number in range(8):
        passed[0] = number * _EVERY
        try:
            box.guard(export)(events.where(F.col("seq") % 8 == number), number)
        except RuntimeError:
            pass
    return spark.read.parquet(f"{where}/out").select("seq", F.col("sent").cast("string").alias("sent"))


def refreshed_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Three rounds: a policy, an invalid table that is ignored, another policy."""
    where, source = scratch_dir(spark, "policy"), _records(spark, folder)
    policy = sinks.PolicyTable(f"{where}/policy", replace(batch.POLICY, enabled=False))
    columns = "enabled boolean, title string, severity_levels array<string>, ignore_keywords array<string>"
    rounds = [
        (True, "one", ["WARN"], []),
        (True, "two", ["LOUD"], []),
        (True, "three", ["error", "info"], ["req1"]),
    ]
    out = None
    for number, row in enumerate(rounds):
        spark.createDataFrame([row], columns).write.mode("overwrite").parquet(policy.path)
        target = f"{where}/round{number}"
        _each_batch(spark, source, sinks.alert_sink(f"{target}/alerts", policy), target)
        message = F.from_json("value", "markdown struct<content: string>")["markdown"]["content"]
        sent = spark.read.option("recursiveFileLookup", "true").text(f"{target}/alerts").select(
            F.lit(number).alias("round"), F.regexp_extract(message, r"^### 🚨 (\w+)", 1).alias("title")
        ).groupBy("round", "title").agg(F.count(F.lit(1)).alias("sent"))
        out = sent if out is None else out.unionByName(sent)
    return out


QUERIES = {
    function.__name__: function
    for function in (
        streamed_documents, streamed_documents_limited, tailed_documents, tailed_in_rounds, streamed_admissions, streamed_waits,
        drained, process_records, limited_batches, limited_waits, reported_drops, fanned_out, ignored_alerts, redelivered,
        refreshed_policy,
    )
}
