"""Alerts: level and keyword filters, bounded Markdown messages, payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions import text
from logweir.rules import AlertPolicy

# Fixed values of the message format.
DEFAULT_TITLE = "日志异常告警"
DEFAULT_LEVELS = ("ERROR", "FATAL")
TITLE_PREFIX = "### 🚨 "
BODY_HEADING = "**日志内容**"
OPEN, CLOSE = '<font color="warning">', "</font>"
TRUNCATED = "...[truncated]"
# Column, label, highlighted; in the order of the message.
FIELDS = (
    ("environment", "环境", False),
    ("host", "主机", False),
    ("time", "时间", False),
    ("level", "日志级别", True),
    ("error_type", "错误类型", True),
    ("source", "日志来源", False),
    ("request_id", "请求 ID", True),
    ("file", "日志文件", False),
)


def select_alerts(records: DataFrame, policy: AlertPolicy) -> DataFrame:
    """Records of the alert levels, with the first ignored keyword they contain."""
    levels = [level.upper() for level in policy.severity_levels or DEFAULT_LEVELS]
    return records.where(F.col("severity_text").isin(levels)).withColumn(
        "ignored_by", text.first_keyword(F.col("body"), policy.ignore_keywords)
    )


def split_ignored(selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts to send and the side table of ignored ones."""
    sent = selected.where(F.col("ignored_by").isNull()).drop("ignored_by")
    return sent, selected.where(F.col("ignored_by").isNotNull())


def with_fields(records: DataFrame, policy: AlertPolicy, *, now: Column | None = None) -> DataFrame:
    """Add the title and the eight field values; an empty value is left out later.

    The time is shown in the zone written in the record (``utc_offset``
    seconds, when the column is there), otherwise in UTC.
    """
    moment = F.coalesce(F.col("ts"), F.current_timestamp() if now is None else now)
    if "utc_offset" in records.columns:
        moment = F.timestamp_micros(
            F.unix_micros(moment) + F.coalesce(F.col("utc_offset"), F.lit(0)).cast("long") * 1_000_000
        )
    shown = F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    values = {
        "environment": F.lit(policy.environment.strip()),
        "host": text.first_non_empty(F.element_at("resource", "host.name"), F.lit(policy.host)),
        "time": shown,
        "level": F.col("severity_text"),
        "error_type": text.first_keyword(F.col("body"), policy.error_type_keywords),
        "source": F.element_at("resource", "log.source.rule"),
        "request_id": F.element_at("attributes", "request.id"),
        "file": F.element_at("resource", "log.file.path"),
    }
    filled = {name: F.coalesce(value, F.lit("")) for name, value in values.items()}
    return records.withColumns({"title": F.lit(policy.title or DEFAULT_TITLE), **filled})


def escape(value: Column) -> Column:
    """Escape the characters that would change how the message is shown."""
    return F.regexp_replace(value, r"([\\`<>])", r"\\$1")


def truncate(value: Column, limit: Column) -> Column:
    """Cut to ``limit`` code points, closed by the mark when it fits."""
    size = len(TRUNCATED)
    return (
        F.when(F.length(value) <= limit, value)
        .when(limit <= size, F.substring(value, F.lit(1), limit))
        .otherwise(F.concat(F.substring(value, F.lit(1), limit - size), F.lit(TRUNCATED)))
    )


def _part(kind: str, prefix: Column, value: Column, suffix: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), prefix.alias("prefix"), value.alias("value"), suffix.alias("suffix")
    )


def _field_lines() -> list[Column]:
    """Title and fields as whole lines; null where the value is empty."""
    out = [F.concat(F.lit(TITLE_PREFIX), escape(F.col("title")))]
    for name, label, marked in FIELDS:
        prefix, suffix = (OPEN, CLOSE) if marked else ("", "")
        line = F.concat(F.lit(f"> **{label}：** {prefix}"), escape(F.col(name)), F.lit(suffix))
        out.append(F.when(F.col(name) != "", line))
    return out


def render(limit: int, *, body: str = "body") -> Column:
    """The message within ``limit`` code points.

    A message that fits is put together directly; only one that does not fit
    goes through the budget, part by part.
    """
    quoted = F.replace(escape(F.col(body)), F.lit("\n"), F.lit(f"{CLOSE}\n> {OPEN}"))
    whole = F.concat_ws(
        "\n", *_field_lines(), F.lit(""), F.lit(BODY_HEADING), F.concat(F.lit(f"> {OPEN}"), quoted, F.lit(CLOSE))
    )
    fits = (F.length(body) <= limit) & (F.length(whole) <= limit)
    return F.when(fits, whole).otherwise(_render_bounded(limit, body))


def _render_bounded(limit: int, body: str) -> Column:
    """The message cut to its budget.

    All parts share one budget and are written in order.  A title or field
    whose fixed text does not fit is skipped; the first body line that does not
    fit ends the message.  Each body line costs at least its fixed text, so
    lines beyond the ``limit``-th can never be written and are not folded.
    """
    blank = F.lit("")
    parts = [_part("line", F.lit(TITLE_PREFIX), escape(F.col("title")), blank)]
    for name, label, marked in FIELDS:
        prefix = f"> **{label}：** " + (OPEN if marked else "")
        field = _part("line", F.lit(prefix), escape(F.col(name)), F.lit(CLOSE if marked else ""))
        parts.append(F.when(F.col(name) != "", field))
    parts.append(_part("blank", blank, blank, blank))
    parts.append(_part("line", F.lit(BODY_HEADING), blank, blank))
    head = F.array_compact(F.array(*parts))
    lines = F.slice(F.split(F.col(body), "\n", limit + 1), 1, limit)
    tail = F.transform(lines, lambda line: _part("body", F.lit("> " + OPEN), escape(line), F.lit(CLOSE)))

    start = F.struct(
        F.lit("").alias("content"), F.lit(limit).alias("left"), F.lit(False).alias("stopped")
    )

    def write(acc: Column, part: Column) -> Column:
        separator = F.when(acc["content"] != "", F.lit("\n")).otherwise(F.lit(""))
        fixed = F.length(separator) + F.length(part["prefix"]) + F.length(part["suffix"])
        shown = truncate(part["value"], acc["left"] - fixed)
        written = F.concat(acc["content"], separator, part["prefix"], shown, part["suffix"])
        blank_fits = (acc["left"] > 0) & (acc["content"] != "")
        return (
            F.when(
                part["kind"] == "blank",
                F.struct(
                    F.when(blank_fits, F.concat(acc["content"], F.lit("\n"))).otherwise(acc["content"]).alias("content"),
                    F.when(blank_fits, acc["left"] - 1).otherwise(acc["left"]).alias("left"),
                    acc["stopped"].alias("stopped"),
                ),
            )
            .when(
                acc["stopped"] | (acc["left"] < fixed),
                F.struct(
                    acc["content"].alias("content"),
                    acc["left"].alias("left"),
                    (acc["stopped"] | (part["kind"] == "body")).alias("stopped"),
                ),
            )
            .otherwise(
                F.struct(
                    written.alias("content"),
                    (acc["left"] - fixed - F.length(shown)).alias("left"),
                    F.lit(False).alias("stopped"),
                )
            )
        )

    return F.aggregate(F.concat(head, tail), start, write, lambda acc: acc["content"])


def payload(content: Column) -> Column:
    """The message as the JSON document of a chat webhook."""
    return F.to_json(
        F.struct(F.lit("markdown").alias("msgtype"), F.struct(content.alias("content")).alias("markdown"))
    )


def messages(records: DataFrame, policy: AlertPolicy, *, now: Column | None = None) -> DataFrame:
    """Alert messages of a record frame: filters, fields, content, payload."""
    sent, _ = split_ignored(select_alerts(records, policy))
    return rendered(sent, policy, now=now)


def rendered(sent: DataFrame, policy: AlertPolicy, *, now: Column | None = None) -> DataFrame:
    """Content and payload of the alerts to send."""
    return with_fields(sent, policy, now=now).withColumn(
        "content", render(policy.max_content_length)
    ).withColumn("payload", payload(F.col("content")))


def write_messages(alerts: DataFrame, path: str) -> None:
    """Write one JSON message per line."""
    alerts.select("payload").write.mode("append").text(path)


def policy_from_rows(rows: Sequence) -> AlertPolicy:
    """A validated policy from the single row of a policy table."""
    if len(rows) != 1:
        raise ValueError("the policy table must have exactly one row")
    row = rows[0].asDict()
    known = AlertPolicy.__dataclass_fields__
    values = {name: tuple(value) if isinstance(value, list) else value for name, value in row.items() if name in known}
    unknown = sorted(set(row) - set(known))
    if unknown:
        raise ValueError(f"unknown policy columns: {', '.join(unknown)}")
    return AlertPolicy(**values).validate()
