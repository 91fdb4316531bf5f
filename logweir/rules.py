"""Rule set: sources, limits, outputs, with defaults and validation."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

from pyspark.sql import DataFrame, SparkSession

from logweir.functions.patterns import PatternError, capture_groups, compiles, java_pattern
from logweir.functions.text import LEVELS

# Spellings of the rule dialect that the quick check by Python does not know.
_ONLY_IN_RULES = re.compile(r"\\Q.*?(?:\\E|\Z)|\\z|\[:\^?\w+:\]|\\[pP](?:\{\^?\w+\}|\w)|\(\?[ims-]+\)", re.S)

_UNIT_MS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000}


class RuleError(ValueError):
    """A rule set that must not be used."""


def duration_ms(value: str | int | float) -> float:
    """Milliseconds of a duration such as ``200ms``, ``3s`` or ``1h30m``."""
    if isinstance(value, (int, float)):
        return float(value)
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", value)
    if value == "0":
        return 0.0
    if not parts or "".join(number + unit for number, unit in parts) != value.lstrip("+-"):
        raise RuleError(f"not a duration: {value!r}")
    total = sum(float(number) * _UNIT_MS[unit] for number, unit in parts)
    return -total if value.startswith("-") else total


@dataclass(frozen=True)
class Extractor:
    key: str
    pattern: str


@dataclass(frozen=True)
class TraceId:
    pattern: str = ""
    completion: bool = False


@dataclass(frozen=True)
class Multiline:
    start_pattern: str = ""
    flush_after: str = "0s"

    @property
    def flush_after_ms(self) -> int:
        """Idle time before an open group is emitted; 5 s when unset."""
        return int(duration_ms(self.flush_after)) or 5_000


@dataclass(frozen=True)
class FileRule:
    name: str
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    start_at: str = ""
    format: str = ""
    multiline: Multiline = Multiline()
    attributes: Mapping[str, str] = field(default_factory=dict)
    extractors: Sequence[Extractor] = ()
    trace_id: TraceId = TraceId()
    drop_levels: Sequence[str] = ()


@dataclass(frozen=True)
class ProcessRule:
    name: str
    comm_regex: str = ""
    cmdline_regex: str = ""
    include_regex: str = ""
    exclude_regex: str = ""
    max_files: int = 0
    start_at: str = ""
    multiline: Multiline = Multiline()
    attributes: Mapping[str, str] = field(default_factory=dict)
    extractors: Sequence[Extractor] = ()
    trace_id: TraceId = TraceId()
    drop_levels: Sequence[str] = ()

    format = ""


@dataclass(frozen=True)
class Limits:
    read_interval: str = "1s"
    max_read_bytes_per_file: int = 4 * 1024 * 1024
    max_log_size: int = 1024 * 1024
    max_multiline_size: int = 4 * 1024 * 1024
    max_multiline_lines: int = 1000
    cache_ttl: str = "24h"


@dataclass(frozen=True)
class FlowControl:
    enabled: bool = False
    rate_per_second: float = 1000
    burst: int = 2000
    mode: str = "block"
    report_interval: str = "10s"


@dataclass(frozen=True)
class Retry:
    enabled: bool = True
    initial_interval: str = "1s"
    max_interval: str = "30s"
    max_elapsed_time: str = "5m"


@dataclass(frozen=True)
class ExportOptions:
    enabled: bool = True
    compression: str = ""
    batch_size: int = 500
    max_batch_bytes: int = 4 * 1024 * 1024
    max_queue_bytes: int = 64 * 1024 * 1024
    retry: Retry = Retry()


@dataclass(frozen=True)
class AlertPolicy:
    enabled: bool = False
    title: str = "日志异常告警"
    environment: str = ""
    host: str = ""
    severity_levels: Sequence[str] = ("ERROR", "FATAL")
    ignore_keywords: Sequence[str] = ()
    error_type_keywords: Sequence[str] = ()
    max_content_length: int = 4000

    def validate(self) -> AlertPolicy:
        _require(self.max_content_length > 0, "alerts need a max_content_length above zero")
        _require(len(self.severity_levels) > 0, "alerts need at least one of severity_levels")
        _check_levels("alert severity_levels", self.severity_levels)
        _check_keywords("alert ignore_keywords", self.ignore_keywords)
        _check_keywords("alert error_type_keywords", self.error_type_keywords)
        return self


@dataclass(frozen=True)
class RuleSet:
    processes: Sequence[ProcessRule] = ()
    files: Sequence[FileRule] = ()
    containers: Sequence[FileRule] = ()
    limits: Limits = Limits()
    flow_control: FlowControl = FlowControl()
    export: ExportOptions = ExportOptions()
    alerts: AlertPolicy = AlertPolicy()

    @classmethod
    def from_dict(cls, values: Mapping[str, Any]) -> RuleSet:
        """Build from plain values; an unknown name is an error."""
        return _build(cls, values)

    @property
    def rules(self) -> list[tuple[str, int, ProcessRule | FileRule]]:
        """All rules as (source type, index in its family, rule)."""
        families = (("process", self.processes), ("file", self.files), ("container", self.containers))
        return [(kind, index, rule) for kind, family in families for index, rule in enumerate(family)]

    def validate(self, spark: SparkSession | None = None) -> RuleSet:
        """Refuse missing names, bad enums and bad patterns.

        With a session each pattern is also compiled once by Java.
        """
        _require(self.export.enabled or self.alerts.enabled, "nothing would leave: switch on export, alerts or both")
        if self.export.enabled:
            _check_export(self.export)
        if self.alerts.enabled:
            self.alerts.validate()
        _check_limits(self.limits)
        if self.flow_control.enabled:
            _check_flow(self.flow_control)
        names = [rule.name for _, _, rule in self.rules]
        again = sorted({name for name in names if name and names.count(name) > 1})
        _require(not again, f"rule names must differ, they key the rows of a rule: {', '.join(again)}")
        for kind, _, rule in self.rules:
            try:
                if kind == "process":
                    _require(
                        bool(rule.name and (rule.comm_regex or rule.cmdline_regex) and rule.include_regex),
                        "needs a name, an include_regex, and a comm_regex or cmdline_regex",
                    )
                else:
                    _require(bool(rule.name and rule.include), "needs a name and at least one include glob")
                    _require(rule.format in ("", "cri"), "unknown format, only cri can be named")
                _check_rule(rule, spark)
            except RuleError as error:
                raise RuleError(f"{kind} rule {rule.name!r}: {error}") from error
        return self

    def options_frame(self, spark: SparkSession) -> DataFrame:
        """One row per rule with its plain options, for a join on the rule."""
        rows = [
            (
                kind, rule.name, rule.start_at or "end", rule.format, rule.multiline.start_pattern,
                rule.multiline.flush_after_ms, [level.upper() for level in rule.drop_levels],
            )
            for kind, _, rule in self.rules
        ]
        schema = (
            "source_type string, rule string, start_at string, format string, "
            "start_pattern string, flush_after_ms long, drop_levels array<string>"
        )
        return spark.createDataFrame(rows, schema)


def _build(cls: type, values: Mapping[str, Any]) -> Any:
    hints = get_type_hints(cls)
    known = {item.name for item in fields(cls)}
    unknown = sorted(set(values) - known)
    _require(not unknown, f"unknown names for {cls.__name__}: {', '.join(unknown)}")
    parts = {"processes": ProcessRule, "files": FileRule, "containers": FileRule, "extractors": Extractor}
    out = {}
    for name, value in values.items():
        if name in parts:
            value = tuple(_build(parts[name], item) if isinstance(item, Mapping) else item for item in value)
        elif is_dataclass(hints[name]) and isinstance(value, Mapping):
            value = _build(hints[name], value)
        out[name] = value
    try:
        return cls(**out)
    except TypeError as error:
        raise RuleError(str(error)) from error


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise RuleError(message)


def _check_export(export: ExportOptions) -> None:
    _require(export.compression in ("", "gzip"), "unknown export compression, only gzip can be named")
    _require(
        min(export.batch_size, export.max_batch_bytes, export.max_queue_bytes) > 0,
        "export needs batch_size, max_batch_bytes and max_queue_bytes above zero",
    )
    _require(
        export.max_queue_bytes >= export.max_batch_bytes,
        "a full export batch has more bytes than max_queue_bytes allows",
    )


def _check_limits(limits: Limits) -> None:
    for item in fields(limits):
        value = getattr(limits, item.name)
        _require((duration_ms(value) if isinstance(value, str) else value) > 0, f"{item.name} has to be above zero")


def _check_flow(flow: FlowControl) -> None:
    _require(
        flow.rate_per_second > 0 and flow.burst > 0 and duration_ms(flow.report_interval) > 0,
        "flow control needs a rate, a burst and a report_interval above zero",
    )
    _require(flow.mode in ("block", "drop"), "flow control knows the modes block and drop")


def _check_levels(name: str, levels: Sequence[str]) -> None:
    upper = [level.upper() for level in levels]
    for level in upper:
        _require(level in LEVELS, f"{name} names {level!r}, which is none of {', '.join(LEVELS)}")
    _require(len(set(upper)) == len(upper), f"{name} names something twice")


def _check_keywords(name: str, keywords: Sequence[str]) -> None:
    _require(all(keyword.strip() for keyword in keywords), f"{name} has a blank keyword")
    _require(len(set(keywords)) == len(keywords), f"{name} names something twice")


def _check_pattern(name: str, pattern: str, spark: SparkSession | None, *, groups: int = 0) -> None:
    try:
        java_pattern(pattern)
        re.compile(_ONLY_IN_RULES.sub("x", pattern))
    except (PatternError, re.error) as error:
        raise RuleError(f"invalid {name}: {error}") from error
    _require(spark is None or compiles(spark, pattern), f"invalid {name}: {pattern!r}")
    _require(capture_groups(pattern) >= groups, f"{name} has no group to capture with")


def _check_rule(rule: ProcessRule | FileRule, spark: SparkSession | None) -> None:
    _require(rule.start_at in ("", "beginning", "end"), "start_at is neither beginning nor end")
    for name in ("comm_regex", "cmdline_regex", "include_regex", "exclude_regex"):
        if getattr(rule, name, ""):
            _check_pattern(name, getattr(rule, name), spark)
    if rule.multiline.start_pattern:
        _check_pattern("start_pattern", rule.multiline.start_pattern, spark)
    duration_ms(rule.multiline.flush_after)
    for item in rule.extractors:
        _require(bool(item.key and item.pattern), "an extractor needs a key and a pattern")
        _check_pattern(f"extractor {item.key!r}", item.pattern, spark, groups=1)
    keys = [item.key for item in rule.extractors]
    _require(len(set(keys)) == len(keys), "two extractors write one key")
    if rule.trace_id.pattern:
        _check_pattern("trace id pattern", rule.trace_id.pattern, spark, groups=1)
    _check_levels("drop_levels", rule.drop_levels)
