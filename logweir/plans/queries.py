"""Registered batch queries: each operator over the whole of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions import paths, text
from logweir.operators import alerts, enrich, flow, lines, multiline, otlp, outbox, positions, targets
from logweir.operators.cri import parse_cri, with_cri_attributes
from logweir.plans import views
from logweir.rules import (
    AlertPolicy,
    Multiline,
    ExportOptions,
    Extractor,
    FileRule,
    FlowControl,
    ProcessRule,
    Retry,
    RuleSet,
    TraceId,
)
from logweir.session import scratch_dir, staged
from logweir.sources.text_lines import scan_lines

POD_RULE = FileRule(
    name="pods",
    include=("/var/log/containers/*.log",),
    format="cri",
    start_at="beginning",
    attributes={"service.name": "shop", "deployment.environment": "test"},
    extractors=(
        Extractor("request.id", r" - (req\d+) - "),
        Extractor("event.type", r" - ([a-z]+) trace_id="),
    ),
    trace_id=TraceId(r"trace_id=([0-9a-fA-F]+)", completion=True),
    drop_levels=("TRACE",),
)
PROCESS_RULES = (
    ProcessRule(
        name="building", comm_regex="^building$", include_regex=r"\.(log|tmp)$", exclude_regex=r"\.tmp$",
        max_files=3, attributes={"team": "b"}, start_at="beginning",
    ),
    ProcessRule(
        name="nations", comm_regex="^(machinery|house)", cmdline_regex=r"--nation=1\d$", include_regex=r"^/data/[of]/",
        attributes={"team": "n"}, multiline=Multiline(start_pattern=r"^\d", flush_after="250ms"),
    ),
    ProcessRule(name="seven", cmdline_regex=r"7\.jar", include_regex=r"\.log$", max_files=2),
)
FILE_RULES = (
    FileRule(name="finished", include=("/data/f/*.log", "/data/f/1*.tmp"), exclude=("/data/f/*9.log",)),
    FileRule(name="all", include=("/data/?/*.log",), format="cri"),
)
RULES = RuleSet(processes=PROCESS_RULES, files=FILE_RULES, containers=(POD_RULE,))
NOW = "2024-02-01 00:00:00"
NOW_MICROS = 1_706_745_600_000_000
POLICY = AlertPolicy(
    enabled=True, title="Shop `alerts`", environment="test", host="node1",
    severity_levels=("ERROR", "WARN"), ignore_keywords=("req11", "req2"),
    error_type_keywords=("purchase", "error"), max_content_length=4000,
)
EXPORT = ExportOptions(batch_size=20, max_batch_bytes=8000)


def _now() -> Column:
    return F.timestamp_micros(F.lit(NOW_MICROS))


def flat(values: Column) -> Column:
    """A map as text, in key order."""
    return F.array_join(F.transform(text.sorted_entries(values), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return parse_cri(views.event_lines(spark, folder))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Enriched records of the event lines, before any level is dropped."""
    enriched = enrich.enrich(_parsed(spark, folder), [POD_RULE])
    return enrich.stamp(enrich.with_resource(enriched, [POD_RULE], "container"), now=_now())


# ---------------------------------------------------------------- lines


def scan_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as text files by source, then scanned by glob."""
    where = scratch_dir(spark, "scan")
    views.table(spark, folder, "documents").select("source", "text").write.partitionBy("source").text(where)
    found = scan_lines(spark, [f"{where}/source=src1*/*.txt", f"{where}/source=src11/*"], [f"{where}/source=src1[5-9]/*"])
    source = F.regexp_extract("path", "source=([^/]+)/", 1)
    return found.groupBy(source.alias("source"), "line").agg(F.count(F.lit(1)).alias("n"))


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files of fifty documents each, with their byte ranges."""
    where = scratch_dir(spark, "offsets")
    (
        views.table(spark, folder, "documents")
        .select(F.floor(F.col("doc_id") / 50).cast("long").alias("part"), "doc_id", "text")
        .repartition("part").sortWithinPartitions("part", "doc_id")
        .select("part", "text").write.partitionBy("part").text(where)
    )
    placed = lines.with_scan_offsets(scan_lines(spark, [f"{where}/part=*/*.txt"]))
    return placed.withColumn("part", F.regexp_extract("path", r"part=(\d+)/", 1).cast("long"))


def scan_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return lines.complete_lines(_scanned(spark, folder)).select("part", "line_no", "start_offset", "end_offset", "line")


def resumed_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A round over scanned files: from stored offsets, some beyond the end of their file, and no more than a cap."""
    found = _scanned(spark, folder)
    files = found.select("file_key", "file_size", "part").distinct()
    stored = files.where("part % 5 <> 4").select(
        "file_key", F.when(F.col("part") % 5 == 3, F.col("file_size") + 10).otherwise(F.floor(F.col("file_size") / 2)).alias("offset")
    )
    mode = F.when(F.col("part") % 2 == 0, "end").otherwise("beginning")
    return positions.resume_lines(found, stored, start_at=mode, max_bytes=20_000).select("part", "line_no", "start_offset", "end_offset")


def _part() -> Column:
    """Long documents are handled some thousand lines at a time."""
    return F.floor(F.col("line_no") / 4096)


def _doc_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return lines.with_offsets(views.doc_lines(spark, folder), order=["line_no"], block=_part())


def incomplete_tail(spark: SparkSession, folder: str) -> DataFrame:
    return lines.complete_lines(_doc_offsets(spark, folder)).select("file_key", "line_no", "start_offset", "end_offset")


def incomplete_tail_quick(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows found from one total per file."""
    docs = views.doc_lines(spark, folder).withColumns({"block_start": F.lit(0).cast("long"), "row_id": F.col("line_no")})
    return lines.drop_incomplete_tail(docs).select("file_key", "line_no", "line")


def clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every third line gets a bad byte and a carriage return first."""
    damaged = F.unhex(F.concat(F.hex("line"), F.lit("FF0D"))).cast("string")
    docs = views.doc_lines(spark, folder).withColumn(
        "line", F.when(F.col("line_no") % 3 == 0, damaged).otherwise(F.col("line"))
    )
    return lines.clean_lines(docs, max_log_size=60).select("file_key", "line_no", "line")


def round_cap(spark: SparkSession, folder: str) -> DataFrame:
    return lines.cap_round(views.doc_lines(spark, folder), max_bytes=2048, block=_part()).select("file_key", "line_no", "line")


def resumed_lines(spark: SparkSession, folder: str) -> DataFrame:
    mode = F.when(F.col("file_key") % 2 == 0, "end").otherwise("beginning")
    return positions.resume_lines(
        _doc_offsets(spark, folder), views.positions(spark, folder), start_at=mode
    ).select("file_key", "line_no", "start_offset", "end_offset")


def _committed(spark: SparkSession, folder: str) -> DataFrame:
    complete = lines.complete_lines(_doc_offsets(spark, folder)).withColumn("path", views.doc_path("file_key"))
    return positions.committed(complete, now=F.expr(f"timestamp_ntz'{NOW}'"))


def _shown(table: DataFrame) -> DataFrame:
    return table.select("file_key", "path", "offset", views.micros("updated_at").alias("updated_us"))


def committed_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_committed(spark, folder))


def merged_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Positions after a round, written to a new table and read back."""
    where = scratch_dir(spark, "positions")
    merged = positions.merge_positions(views.positions(spark, folder), _committed(spark, folder))
    positions.write_positions(merged, where)
    return _shown(spark.read.parquet(where))


def pruned_positions(spark: SparkSession, folder: str) -> DataFrame:
    cutoff = F.expr(f"timestamp_ntz'{views.DAY}' + interval 30 hours")
    return positions.prunable(views.positions(spark, folder), views.live_files(spark, folder), cutoff=cutoff).select(
        "file_key", "path", "offset"
    )


# ---------------------------------------------------------------- multi-line


def line_groups(spark: SparkSession, folder: str) -> DataFrame:
    return multiline.boundary_groups(views.doc_lines(spark, folder), "^[A-M]", block=_part()).select("file_key", "line_no", "group")


def merged_documents(spark: SparkSession, folder: str) -> DataFrame:
    return multiline.merge_lines(views.doc_lines(spark, folder), "^[A-M]", block=_part())


def merged_documents_limited(spark: SparkSession, folder: str) -> DataFrame:
    """The same with limits that cut most groups."""
    return multiline.merge_lines(views.doc_lines(spark, folder), "^[A-M]", max_size=700, max_lines=3, block=_part())


def merged_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a conversation; a long one is handled some thousand lines at a time."""
    return multiline.merge_lines(views.conv_lines(spark, folder), "^user> ", block=_part())


# ---------------------------------------------------------------- rows


def cri_fields(spark: SparkSession, folder: str) -> DataFrame:
    return with_cri_attributes(parse_cri(views.mixed_lines(spark, folder))).select(
        "line_no", "path", flat(F.col("attributes")).alias("attributes"), "cri_ok", F.unix_micros("ts").cast("string").alias("ts_us"),
        F.col("time_unix_nano").cast("string").alias("time_unix_nano"), "stream", "flag", "body",
    )


def cri_varied(spark: SparkSession, folder: str) -> DataFrame:
    """Offsets, a comma before the fraction, nanoseconds and partial lines."""
    return parse_cri(views.varied_lines(spark, folder)).select(
        "line_no", F.unix_micros("ts").alias("ts_us"), "time_unix_nano", "utc_offset", "stream", "flag", "body"
    )


def trace_id_widths(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of 16 digits are filled up, of 32 kept; other widths and zeros are none."""
    found = text.trace_id(F.col("body"), r"id=([0-9a-f]+)\.", True)
    return parse_cri(views.varied_lines(spark, folder)).select("line_no", F.lower(F.hex(found)).alias("trace_id"))


def severities(spark: SparkSession, folder: str) -> DataFrame:
    found = enrich.with_severity(_parsed(spark, folder))
    return found.select(
        "line_no", "severity_text", "severity_number", flat(text.level_attribute(F.col("severity_text"))).alias("level")
    )


def document_severities(spark: SparkSession, folder: str) -> DataFrame:
    """Severity of whole documents, with a level word put into the first line of some."""
    word = F.expr(
        "element_at(array('[warning]', 'x=Err:', 'alert', 'superpanic ', 'CRIT\\n', '\\nERROR', '(notice) fatal'), "
        "cast(doc_id % 7 as int) + 1)"
    )
    docs = views.table(spark, folder, "documents").select("doc_id", F.concat(word, "text").alias("body"))
    return enrich.with_severity(docs).select("doc_id", "severity_text", "severity_number")


def extracted_attributes(spark: SparkSession, folder: str) -> DataFrame:
    found = enrich.enrich(_parsed(spark, folder), [POD_RULE])
    return found.select("line_no", flat(F.col("attributes")).alias("attributes"))


def trace_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Completed ids and the raw text of a shorter match."""
    body = F.col("body")
    return _parsed(spark, folder).select(
        "line_no",
        F.lower(F.hex(text.trace_id(body, r"trace_id=([0-9a-f]+)", True))).alias("completed"),
        F.lower(F.hex(text.trace_id(body, r"- req([0-9a-f]+)", True))).alias("too_short"),
        F.decode(text.trace_id(body, r"- (req\d+)"), "UTF-8").alias("raw"),
    )


def event_times(spark: SparkSession, folder: str) -> DataFrame:
    stamped = enrich.stamp(parse_cri(views.mixed_lines(spark, folder)), now=_now())
    return stamped.select(
        "line_no", "time_unix_nano", F.unix_micros("ts").alias("ts_us"), F.unix_micros("observed_ts").alias("observed_us")
    )


def container_names(spark: SparkSession, folder: str) -> DataFrame:
    found = views.event_lines(spark, folder).select("path").distinct()
    return found.select("path", flat(paths.container_attributes(F.col("path"))).alias("attributes"))


def resources(spark: SparkSession, folder: str) -> DataFrame:
    found = views.event_lines(spark, folder).select("path").distinct()
    reported = found.withColumn("path", paths.reported_path(F.lit(""), F.col("path")))
    return enrich.with_resource(reported, [POD_RULE], "container").select(
        "path", F.replace(F.col("resource_key"), F.lit("\0"), F.lit("|")).alias("resource_key")
    )


def record_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.with_record_size(records(spark, folder)).select("line_no", "size")


def document_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of multi-byte texts in bytes."""
    docs = views.table(spark, folder, "documents")
    size = text.record_size(F.col("text"), F.lit(None).cast("binary"), F.create_map(F.col("lang"), F.col("source")))
    return docs.select("doc_id", size.alias("size"))


def log_records(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("line_no", F.to_json(otlp.log_record()).alias("record"))


def kept_records(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.drop_levels(records(spark, folder)).select("line_no", "severity_text", "body")


def severity_by_resource(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: lines to enriched, filtered records, counted by resource and level."""
    kept = enrich.drop_levels(records(spark, folder))
    key = F.replace(F.col("resource_key"), F.lit("\0"), F.lit("|")).alias("resource")
    return kept.groupBy(key, "severity_text").agg(F.count(F.lit(1)).alias("records"))


# ---------------------------------------------------------------- targets


def rule_matches(spark: SparkSession, folder: str) -> DataFrame:
    return targets.match_processes(views.processes(spark, folder), PROCESS_RULES).select(
        "host", "pid", "comm", "cmdline", F.col("rule_idx").cast("int").alias("rule_idx"), "rule"
    )


def opened_paths(spark: SparkSession, folder: str) -> DataFrame:
    matched = targets.match_processes(views.processes(spark, folder), PROCESS_RULES)
    opened = matched.join(views.open_files(spark, folder), ["host", "pid"])
    return targets.select_paths(opened, PROCESS_RULES).select("host", "pid", "rule", "fd_order", "path")


def process_targets(spark: SparkSession, folder: str) -> DataFrame:
    found = targets.process_targets(views.processes(spark, folder), views.open_files(spark, folder), PROCESS_RULES)
    return found.select("host", "pid", "rule", "fd_order", "path", flat(F.col("resource")).alias("resource"))


def process_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Files of isolated processes, read below the root of the process and reported as it sees them."""
    opened = views.open_files(spark, folder)
    below = F.concat(F.lit("/proc/"), F.col("pid").cast("string"), F.lit("/root"), paths.strip_deleted(F.col("path")))
    opened = opened.withColumn("read_path", F.when(F.col("fd_order") % 3 == 0, below))
    found = targets.process_targets(views.processes(spark, folder), opened, PROCESS_RULES)
    return found.select("host", "pid", "rule", "fd_order", "path", "reported_path", flat(F.col("resource")).alias("resource"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    opened = views.open_files(spark, folder).where(F.startswith("path", F.lit("/")))
    return opened.select("host", paths.strip_deleted(F.col("path")).alias("path")).distinct()


def first_targets(spark: SparkSession, folder: str) -> DataFrame:
    found = targets.discover(
        RULES, processes=views.processes(spark, folder), open_files=views.open_files(spark, folder),
        files=listing(spark, folder),
    )
    return found.select("host", "path", "source_type", "rule", "process_idx", "include_idx")


def new_targets(spark: SparkSession, folder: str) -> DataFrame:
    seen = views.live_files(spark, folder)
    listed = views.table(spark, folder, "documents").select("doc_id", views.doc_path().alias("path"))
    return targets.new_targets(listed, seen).select("doc_id", "path")


def excluded_paths(spark: SparkSession, folder: str) -> DataFrame:
    listed = listing(spark, folder)
    return targets.exclude_paths(listed, listed.where(paths.matches_any(F.col("path"), ["/data/[of]/1*.log"]))).select("host", "path")


def seen_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Last sight of every log path; those a day older than the last moment go."""
    lines_seen = parse_cri(views.event_lines(spark, folder)).select("path", F.col("ts").alias("seen"))
    now = F.timestamp_micros(F.lit(NOW_MICROS - 86_400_000_000))
    found = views.event_lines(spark, folder).select("path").where(F.col("path").contains("pod3_")).distinct()
    kept = targets.update_seen(lines_seen, found, now=now, ttl_seconds=36_000)
    return kept.select("path", F.unix_micros("seen").alias("seen_us"))


def rule_options(spark: SparkSession, folder: str) -> DataFrame:
    options = RULES.options_frame(spark).select("rule", "start_at", "flush_after_ms")
    matched = targets.match_processes(views.processes(spark, folder), PROCESS_RULES)
    return targets.attach_options(matched, options).select("host", "pid", "rule", "start_at", "flush_after_ms")


# ---------------------------------------------------------------- export


def oversize_records(spark: SparkSession, folder: str) -> DataFrame:
    fits, rejected = enrich.split_oversize(records(spark, folder), max_bytes=760)
    marked = fits.select("line_no", "size", F.lit(True).alias("fits")).unionByName(
        rejected.select("line_no", "size", F.lit(False).alias("fits"))
    )
    return marked


def _batched(spark: SparkSession, folder: str) -> DataFrame:
    """Packed records; the packing passes read them from a written table."""
    kept = enrich.drop_levels(records(spark, folder))
    kept = kept.withColumn("pod", F.regexp_extract("path", "(pod[0-9]+)_", 1))
    kept = staged(enrich.with_record_size(kept), "records")
    return otlp.pack_batches(kept, ["pod"], ["line_no"], EXPORT, block=F.floor(F.col("line_no") / 100_000))


def export_batches(spark: SparkSession, folder: str) -> DataFrame:
    return _batched(spark, folder).select("pod", "line_no", "pos", "size", "batch")


def batch_resources(spark: SparkSession, folder: str) -> DataFrame:
    """Records per batch and resource, in the order of the request."""
    grouped = otlp.resource_logs(_batched(spark, folder), ["pod"])
    one = grouped.select("pod", "batch", F.posexplode("resourceLogs").alias("nth", "entry"))
    scope = one.select("pod", "batch", "nth", "entry.resource", F.explode("entry.scopeLogs").alias("scope"))
    path = F.filter("resource.attributes", lambda item: item["key"] == "log.file.path")[0]["value"]["stringValue"]
    return scope.select(
        "pod", "batch", "nth", path.alias("path"), F.size("scope.logRecords").alias("records"),
        F.array_join(F.transform("scope.logRecords", lambda item: item["timeUnixNano"]), ",").alias("times"),
    )


def exported_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Request documents written gzipped, read back and opened again."""
    where = scratch_dir(spark, "export")
    documents = otlp.requests(_batched(spark, folder), ["pod"])
    otlp.write_requests(documents, where, compression="gzip")
    attribute = "array<struct<key: string, value: struct<stringValue: string>>>"
    record = (
        "struct<timeUnixNano: string, observedTimeUnixNano: string, severityNumber: int, severityText: string, "
        f"body: struct<stringValue: string>, attributes: {attribute}, traceId: string>"
    )
    schema = (
        f"resourceLogs array<struct<resource: struct<attributes: {attribute}>, "
        f"scopeLogs: array<struct<scope: struct<name: string>, logRecords: array<{record}>>>>>"
    )
    opened = spark.read.text(where).select(F.from_json("value", schema).alias("request"))
    entry = opened.select(F.explode("request.resourceLogs").alias("entry"))
    scope = entry.select("entry.resource", F.explode("entry.scopeLogs").alias("scope"))
    rows = scope.select("resource", F.col("scope.scope.name").alias("scope"), F.explode("scope.logRecords").alias("r"))

    def joined(column: str) -> Column:
        return F.array_join(
            F.transform(column, lambda item: F.concat(item["key"], F.lit("="), item["value"]["stringValue"])), ";"
        )

    return rows.select(
        "scope", joined("resource.attributes").alias("resource"), joined("r.attributes").alias("attributes"),
        F.col("r.timeUnixNano").alias("time"), F.col("r.observedTimeUnixNano").alias("observed"),
        F.col("r.severityNumber").alias("severity_number"), F.col("r.severityText").alias("severity_text"),
        F.col("r.body.stringValue").alias("body"), F.col("r.traceId").alias("trace_id"),
    )


def delivery_schedule(spark: SparkSession, folder: str) -> DataFrame:
    retry = Retry(initial_interval="30s", max_interval="20m", max_elapsed_time="50m")
    found = outbox.schedule(views.attempts(spark, folder), retry)
    # -1 where the batch has come to an end, so that the columns have no nulls.
    ended = F.lit(-1).cast("long")
    return found.select(
        "batch_id", "attempts", "outcome", F.coalesce("wait_ms", ended).alias("wait_ms"),
        F.coalesce(F.unix_micros("next_at"), ended).alias("next_us"),
    )


def retry_waits(spark: SparkSession, folder: str) -> DataFrame:
    """Retry-After texts of all forms: seconds, the three HTTP dates, some in the past, and nonsense."""
    moment = F.timestamp_micros(views.micros("ts"))
    # The fixed values of an HTTP date, whatever the language of the session.
    month = F.array(*map(F.lit, outbox.MONTHS))[F.month(moment) - 1]
    day, clock = F.date_format(moment, "dd"), F.date_format(moment, "HH:mm:ss")
    texts = [
        (F.col("event_id") % 100).cast("string"),
        F.concat((F.col("event_id") % 10).cast("string"), F.lit(".25")),
        F.concat(F.lit("Mon, "), day, F.lit(" "), month, F.date_format(moment, " yyyy "), clock, F.lit(" GMT")),
        F.concat(F.lit("Monday, "), day, F.lit("-"), month, F.date_format(moment, "-yy "), clock, F.lit(" GMT")),
        F.concat(F.lit("Mon "), month, F.lit(" "), F.lpad(F.dayofmonth(moment).cast("string"), 2, " "), F.lit(" "), clock, F.date_format(moment, " yyyy")),
        F.lit("soon"),
    ]
    said = F.array(*texts)[(F.col("event_id") % len(texts)).cast("int")]
    return views.table(spark, folder, "events").select("event_id", outbox.retry_after_ms(said, _now()).alias("wait_ms"))


def reply_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of webhook answers: status and error code."""
    status = F.when(F.col("event_id") % 5 != 0, F.array(*map(F.lit, (200, 204, 404, 500)))[(F.col("event_id") % 4).cast("int")])
    code = F.when(F.col("event_id") % 3 != 0, F.when(F.col("event_type") == "error", 93000).otherwise(0))
    return views.table(spark, folder, "events").select("event_id", outbox.reply_outcome(status, code).alias("outcome"))


# ---------------------------------------------------------------- alerts


def alert_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the alert levels and the ignored keyword found first."""
    return alerts.select_alerts(records(spark, folder), POLICY).select("line_no", "severity_text", "ignored_by")


def error_types(spark: SparkSession, folder: str) -> DataFrame:
    """First keyword of a list in each whole document."""
    docs = views.table(spark, folder, "documents")
    found = text.first_keyword(F.col("text"), ["shanti", "worthless", "keiten", "ould", "the", "le"])
    return docs.select("doc_id", found.alias("keyword"))


def alert_messages(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.messages(records(spark, folder), POLICY).select("line_no", "content", "payload")


def alert_messages_bounded(spark: SparkSession, folder: str) -> DataFrame:
    """Messages whose budget falls short at a different part for each record."""
    sent = alerts.with_fields(alerts.split_ignored(alerts.select_alerts(records(spark, folder), POLICY))[0], POLICY)
    limits = (40, 120, 200, 290, 400)
    shown = F.lit(None).cast("string")
    for index, limit in enumerate(limits):
        shown = F.when(F.col("line_no") % len(limits) == index, alerts.render(limit)).otherwise(shown)
    return sent.select("line_no", shown.alias("content"))


def document_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents as alert bodies, without a budget that cuts them."""
    docs = views.table(spark, folder, "documents").select(
        "doc_id", F.col("text").alias("body"), F.lit("ERROR").alias("severity_text"),
        F.timestamp_micros(F.lit(NOW_MICROS)).alias("ts"),
        F.create_map(F.lit("request.id"), F.col("source")).alias("attributes"),
        F.create_map(F.lit("log.file.path"), views.doc_path()).alias("resource"),
    )
    policy = AlertPolicy(error_type_keywords=("keiten",))
    return alerts.with_fields(docs, policy).select("doc_id", alerts.render(10_000_000).alias("content"))


def written_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alert documents written as text, one per line, and read back."""
    where = scratch_dir(spark, "alerts")
    alerts.write_messages(alerts.messages(records(spark, folder), POLICY), where)
    content = F.from_json("value", "msgtype string, markdown struct<content: string>")
    opened = spark.read.text(where).select(content.alias("m"))
    return opened.select("m.msgtype", F.col("m.markdown.content").alias("content"))


# ---------------------------------------------------------------- flow control

USER_RATE, USER_BURST = 0.00002, 3
FLEET_RATE, FLEET_BURST = 0.003, 20


def _fleet(spark: SparkSession, folder: str) -> DataFrame:
    return views.arrivals(spark, folder).withColumn("key", F.lit("fleet"))


def admitted_late(spark: SparkSession, folder: str) -> DataFrame:
    """Block mode per user: when each record gets its token."""
    found = flow.admit_times(views.arrivals(spark, folder), ["key"], rate=USER_RATE, burst=USER_BURST)
    return found.select("key", "seq", F.unix_micros("admit_ts").alias("admit_us"))


def admitted_late_fleet(spark: SparkSession, folder: str) -> DataFrame:
    """Block mode over all records as one source."""
    found = flow.admit_times(_fleet(spark, folder), ["key"], rate=FLEET_RATE, burst=FLEET_BURST)
    return found.select("seq", F.unix_micros("admit_ts").alias("admit_us"))


def admitted(spark: SparkSession, folder: str) -> DataFrame:
    """Drop mode per user."""
    found = flow.mark_admitted(views.arrivals(spark, folder), ["key"], rate=USER_RATE, burst=USER_BURST)
    return found.select("key", "seq", "admitted")


def admitted_fleet(spark: SparkSession, folder: str) -> DataFrame:
    """Drop mode over all records as one busy source."""
    found = flow.mark_admitted(_fleet(spark, folder), ["key"], rate=FLEET_RATE, burst=FLEET_BURST)
    return found.select("seq", "admitted")


def drop_report(spark: SparkSession, folder: str) -> DataFrame:
    options = FlowControl(enabled=True, mode="drop", rate_per_second=USER_RATE, burst=USER_BURST)
    _, dropped = flow.control(views.arrivals(spark, folder), ["key"], options)
    report = flow.drop_report(dropped, interval="6 hours")
    return report.select(F.unix_micros("window_start").alias("start_us"), "dropped")


def flow_switch(spark: SparkSession, folder: str) -> DataFrame:
    """Records that pass with flow control off, waiting and dropping."""
    out = []
    for name, options in {
        "off": FlowControl(enabled=False),
        "block": FlowControl(enabled=True, mode="block", rate_per_second=USER_RATE, burst=USER_BURST),
        "drop": FlowControl(enabled=True, mode="drop", rate_per_second=USER_RATE, burst=USER_BURST),
    }.items():
        passed, _ = flow.control(views.arrivals(spark, folder), ["key"], options)
        late = F.col("admit_ts") > F.col("ts")
        out.append(
            passed.groupBy(F.lit(name).alias("mode"), "key").agg(
                F.count(F.lit(1)).alias("passed"), F.count(F.when(late, 1)).alias("late")
            )
        )
    return out[0].unionByName(out[1]).unionByName(out[2])


QUERIES = {
    function.__name__: function
    for function in (
        scan_text_files, scan_offsets, resumed_scan, incomplete_tail, incomplete_tail_quick, clean_lines, round_cap, resumed_lines,
        committed_offsets, merged_positions, pruned_positions, line_groups, merged_documents, merged_documents_limited,
        merged_conversations, cri_fields, cri_varied, trace_id_widths, severities, document_severities, extracted_attributes, trace_ids, event_times,
        container_names, resources, record_sizes, document_sizes, log_records, kept_records, severity_by_resource,
        rule_matches, opened_paths, process_targets, process_paths, first_targets, new_targets, excluded_paths, seen_paths,
        rule_options, oversize_records, export_batches, batch_resources, exported_requests, delivery_schedule, retry_waits, reply_outcomes,
        alert_candidates, error_types, alert_messages, alert_messages_bounded, document_alerts, written_alerts,
        admitted_late, admitted_late_fleet, admitted, admitted_fleet, drop_report, flow_switch,
    )
}
