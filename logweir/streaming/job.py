"""The whole collection job, as a streaming query or over a batch: one rule, or all rules of a set at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweir.functions.patterns import java_pattern
from logweir.operators import enrich, lines, multiline
from logweir.operators.cri import parse_cri
from logweir.rules import FileRule, ProcessRule, RuleSet, duration_ms
from logweir.session import mounted_path, staged
from logweir.sources.tail_source import tail_lines
from logweir.streaming.limits import limited_sink
from logweir.streaming.redelivery import Outbox
from logweir.streaming.sinks import PolicyTable, Sink, alert_sink, export_sink, fan_out
from logweir.streaming.stateful import merge_stream, open_records, use_state_store
from logweir.streaming.state_table import StateTable, newest_per

#: What a body keeps of its first line.
FIRST = ("path", "ts", "time_unix_nano", "utc_offset", "stream", "flag")
_RESOURCE = ("path", "reported_path", "resource", "resource_key")


def _tail(spark: SparkSession, rules: RuleSet, *, progress: str | None, **options: object) -> DataFrame:
    return tail_lines(
        spark,
        max_bytes_per_file=rules.limits.max_read_bytes_per_file,
        max_line_chars=rules.limits.max_log_size,
        keep_seconds=duration_ms(rules.limits.cache_ttl) / 1000,
        progress=progress,
        **options,
    )


def rule_lines(spark: SparkSession, rules: RuleSet, rule: FileRule, *, progress: str | None = None) -> DataFrame:
    """Lines of the files of one rule; files of an earlier rule are left to it."""
    ordered = [*rules.files, *rules.containers]
    earlier = [[list(item.include), list(item.exclude)] for item in ordered[: ordered.index(rule)]]
    return _tail(
        spark, rules, include=list(rule.include), exclude=list(rule.exclude), skip=earlier,
        start_at=rule.start_at or "end", progress=progress,
    )


def set_lines(
    spark: SparkSession, rules: RuleSet, *, processes: Sequence[str] = (), progress: str | None = None
) -> DataFrame:
    """Lines of the files of all rules, each file once and from where its first rule says.

    ``processes`` are globs under which files of process targets lie.
    """
    starts = [
        [list(rule.include), list(rule.exclude), rule.start_at or "end"] for rule in [*rules.files, *rules.containers]
    ]
    if processes:
        # A file with no rule of its own is there for a process; targets say which rule that is.
        starts.append([list(processes), [], "beginning"])
    include = list(dict.fromkeys(glob for globs, _, _ in starts for glob in globs))
    return _tail(spark, rules, include=include, starts=starts, progress=progress)


def framed(source: DataFrame, rule: FileRule) -> DataFrame:
    """Lines as bodies: framing parsed when the rule says so."""
    if rule.format == "cri":
        return parse_cri(source).withColumn("line", F.col("body")).drop("body", "cri_ok")
    return source.withColumns(
        {
            "ts": F.lit(None).cast("timestamp"),
            "time_unix_nano": F.lit(None).cast("long"),
            "utc_offset": F.lit(None).cast("int"),
            "stream": F.lit(None).cast("string"),
            "flag": F.lit(None).cast("string"),
        }
    )


def framed_by_rule(source: DataFrame, rules: Sequence[FileRule | ProcessRule]) -> DataFrame:
    """The same where lines have a ``rule``: only lines of container formats are parsed."""
    cri = [rule.name for rule in rules if getattr(rule, "format", "") == "cri"]
    if not cri:
        return framed(source, FileRule(name="", include=()))
    is_cri = F.col("rule").isin(cri)
    raw = source.withColumn("_raw", F.col("line")).withColumn("line", F.when(is_cri, F.col("line")).otherwise(""))
    parsed = parse_cri(raw).withColumn("line", F.when(is_cri, F.col("body")).otherwise(F.col("_raw")))
    return parsed.drop("body", "cri_ok", "_raw")


def finish(bodies: DataFrame, rules: RuleSet, rule: FileRule, source_type: str) -> DataFrame:
    """Bodies to records: enriched, level-filtered, stamped; batch and stream alike."""
    kept = enrich.drop_levels(enrich.enrich(bodies, [rule]))
    return enrich.stamp(enrich.with_resource(kept, [rule], source_type))


def finish_targets(bodies: DataFrame, rules: RuleSet, found: DataFrame) -> DataFrame:
    """The same for bodies of several rules; each takes the resource of its target, which maps keep out of the merge."""
    known = bodies.join(found.select(*_RESOURCE), "path")
    return enrich.stamp(enrich.drop_levels(enrich.enrich(known, [rule for _, _, rule in rules.rules])))


def with_targets(source: DataFrame, found: DataFrame) -> DataFrame:
    """Lines with the rule of the target they were read for.

    ``found`` comes from ``targets.discover``; files without a target are left
    out.  Of a stream, each micro-batch joins the targets as they are then.
    """
    return source.join(found.select("path", "rule"), "path")


def merged_targets(source: DataFrame, rules: RuleSet, *, order: str = "start_offset") -> DataFrame:
    """Bodies of a stream of lines with targets, each file by the start pattern of its rule."""
    known = [rule for _, _, rule in rules.rules]
    pattern = enrich.by_rule(
        known, lambda rule: F.rlike("line", F.lit(java_pattern(rule.multiline.start_pattern))) if rule.multiline.start_pattern else F.lit(True)
    )
    alone = F.col("rule").isin([rule.name for rule in known if not rule.multiline.start_pattern])
    flush = enrich.by_rule(known, lambda rule: F.lit(rule.multiline.flush_after_ms).cast("long"))
    return merge_stream(
        framed_by_rule(source, known), pattern, order=order, max_size=rules.limits.max_multiline_size,
        max_lines=rules.limits.max_multiline_lines, flush_after_ms=flush, first=(*FIRST, "rule"), alone=alone,
    ).withColumnRenamed("first_line", "start_offset")


def rule_records(spark: SparkSession, rules: RuleSet, rule: FileRule, *, progress: str | None = None) -> DataFrame:
    """The record stream of one rule, before the outputs."""
    source = framed(rule_lines(spark, rules, rule, progress=progress), rule)
    limits = rules.limits
    if rule.multiline.start_pattern:
        bodies = merge_stream(
            source, rule.multiline.start_pattern, max_size=limits.max_multiline_size,
            max_lines=limits.max_multiline_lines, flush_after_ms=rule.multiline.flush_after_ms, first=FIRST,
        ).withColumnRenamed("first_line", "start_offset")
    else:
        bodies = source.withColumnRenamed("line", "body").withColumn("last_line", F.col("start_offset"))
    return bodies.select("file_key", "start_offset", "last_line", "body", *FIRST)


def _outputs(rules: RuleSet, folder: str, policy: PolicyTable | None, limit_key: str | None) -> Sink:
    sinks = {}
    if rules.alerts.enabled or policy is not None:
        sinks["alerts"] = alert_sink(f"{folder}/alerts", policy or rules.alerts)
    if rules.export.enabled:
        export = export_sink(f"{folder}/export", rules.export, ["file_key"], ["start_offset"])
        sinks["export"] = Outbox(f"{folder}/outbox", rules.export.retry).guard(export)
    sink = fan_out(sinks, f"{folder}/outcomes")
    if rules.flow_control.enabled:
        sink = limited_sink(sink, rules.flow_control, folder, F.col(limit_key) if limit_key else F.lit("all"))
    return sink


# ---------------------------------------------------------------- drain


def _drained(folder: str) -> StateTable:
    """Records that left by a drain while their file may still go on: how much of each is gone."""
    return StateTable(
        f"{folder}/drained", "file_key string, start_offset long, last_line long, gone long", newest_per("file_key", "start_offset")
    )


def _without_drained(bodies: DataFrame, folder: str, batch_id: int | None = None) -> DataFrame:
    """Bodies less what a drain sent before: nothing of them, or the lines that came since."""
    gone = _drained(folder).before(bodies.sparkSession, batch_id).select("file_key", "start_offset", F.col("last_line").alias("_last"), "gone")
    left = bodies.join(gone, ["file_key", "start_offset"], "left").where(F.col("gone").isNull() | (F.col("last_line") > F.col("_last")))
    # The lines since then begin after the newline that follows what is gone.
    rest = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.substring("body", F.col("gone") + 2, F.length("body")))
    return left.withColumn("body", rest).where(F.col("gone").isNull() | (F.length("body") > 0)).drop("_last", "gone")


def _last_batch(spark: SparkSession, folder: str) -> int:
    """Number of the last micro-batch that was committed."""
    jvm = spark._jvm.org.apache.hadoop.fs
    commits = jvm.Path(f"{folder}/checkpoint/commits")
    files = commits.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.listStatus(commits)] if files.exists(commits) else []
    return max((int(name) for name in names if name.isdigit()), default=-1)


def drain(
    spark: SparkSession,
    rules: RuleSet,
    rule: FileRule | None = None,
    *,
    folder: str,
    found: DataFrame | None = None,
    policy: PolicyTable | None = None,
    limit_key: str | None = None,
) -> None:
    """Send the open records of a stopped query through its limits and outputs, once.

    What went out is noted: a second drain sends nothing again, and a query
    that is started once more sends only the lines that came since.
    """
    use_state_store(spark)
    last = _last_batch(spark, folder)
    first = (*FIRST, "rule") if rule is None else FIRST
    # Written down once: each look at the state opens the store of every partition.
    bodies = staged(open_records(spark, f"{folder}/checkpoint", first).withColumnRenamed("first_line", "start_offset"), "open")
    fresh = staged(_without_drained(bodies, folder), "drained")
    if fresh.isEmpty():
        return
    _sent(fresh, rules, rule, found, _outputs(rules, folder, policy, limit_key), f"{last}-drain")
    marks = bodies.select("file_key", "start_offset", "last_line", F.length("body").cast("long").alias("gone"))
    _drained(folder).put(marks, last + 1)


def _sent(
    bodies: DataFrame, rules: RuleSet, rule: FileRule | None, found: DataFrame | None, sink: Sink, batch_id: int | str
) -> None:
    """Bodies to records, and those to the outputs."""
    if rule is None:
        records = finish_targets(bodies, rules, found)
    else:
        source_type = "container" if rule in rules.containers else "file"
        records = finish(bodies, rules, rule, source_type).withColumn("rule", F.lit(rule.name))
    sink(records.drop("last_line"), batch_id)


# ---------------------------------------------------------------- queries


def start(
    spark: SparkSession,
    rules: RuleSet,
    rule: FileRule | None = None,
    *,
    folder: str,
    found: DataFrame | None = None,
    processes: Sequence[str] = (),
    policy: PolicyTable | None = None,
    once: bool = False,
    limit_key: str | None = None,
) -> StreamingQuery:
    """Run one rule, or without one all rules at once: read, merge, enrich, limit, fan out.

    All rules share one source and one query; ``found`` then has the targets
    (``targets.discover``) with the resource of each file, also of files that
    processes hold open, which lie under the globs ``processes``.  A file goes
    by the rule of its target.

    ``folder`` is on a file system that all tasks mount and holds the
    checkpoint and the outputs.  A round starts every ``read_interval``; ``once`` runs a single round.
    The checkpoint carries offsets and open records over a restart, the folder
    ``buckets`` the flow control.  One bucket holds for all files, or one per
    value of ``limit_key``.  Refused records are counted in ``dropped``;
    records that had to wait carry ``admit_ts``.  A batch whose export fails is
    kept in ``outbox`` and sent again when its wait is over.  ``drain`` sends
    what a stopped query left open.
    """
    progress = f"{mounted_path(folder)}/progress"
    rules.validate(spark)
    if rule is not None:
        bodies = rule_records(spark, rules, rule, progress=progress)
    elif found is None:
        raise ValueError("all rules at once need the targets of their files")
    else:
        source = with_targets(set_lines(spark, rules, processes=processes, progress=progress), found)
        bodies = merged_targets(source, rules).select("file_key", "start_offset", "last_line", "body", *FIRST, "rule")
    sink = _outputs(rules, folder, policy, limit_key)

    def send(batch: DataFrame, batch_id: int) -> None:
        # Held from the first look on: the stateful step must not run again for every action on its rows.
        batch.persist()
        try:
            if not batch.isEmpty():
                _sent(_without_drained(batch, folder, batch_id + 1), rules, rule, found, sink, batch_id)
        finally:
            batch.unpersist()

    writer = (
        bodies.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(send)
        .queryName(f"logs {rule.name if rule else 'all rules'}")
    )
    if once:
        return writer.trigger(once=True).start()
    return writer.trigger(processingTime=f"{int(duration_ms(rules.limits.read_interval))} milliseconds").start()


# ---------------------------------------------------------------- batch


def batch_records(
    source: DataFrame, rules: RuleSet, rule: FileRule, source_type: str, *, block: Column | None = None
) -> DataFrame:
    """The records of a batch of scanned lines with offsets; open records are closed.

    Pass ``block=F.col("block_start")`` for files that do not fit a task.
    """
    limits = rules.limits
    bodies = framed(lines.clean_lines(source, max_log_size=limits.max_log_size), rule)
    if rule.multiline.start_pattern:
        bodies = multiline.merge_lines(
            bodies, rule.multiline.start_pattern, max_size=limits.max_multiline_size,
            max_lines=limits.max_multiline_lines, block=block, first=("start_offset", *FIRST),
        )
    else:
        bodies = bodies.withColumnRenamed("line", "body")
    return finish(bodies.select("file_key", "start_offset", "body", *FIRST), rules, rule, source_type)
