"""Records from bodies: severity, attributes, trace id, resource, drop mark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions import paths, text
from logweir.functions.patterns import java_pattern
from logweir.operators.steps import settle
from logweir.rules import FileRule, ProcessRule


def by_rule(rules: Sequence[FileRule | ProcessRule], make, *, rule: str | None = "rule") -> Column:
    """One branch per rule, so that every pattern is a literal compiled once.

    Rows of no known rule get null.  Without a rule column, named by a null
    ``rule``, all rows are of the only rule there is.
    """
    if rule is None:
        if len(rules) != 1:
            raise ValueError("several rules need a rule column")
        return make(rules[0])
    out = F.when(F.col(rule) == rules[0].name, make(rules[0]))
    for item in rules[1:]:
        out = out.when(F.col(rule) == item.name, make(item))
    return out


def rule_column(frame: DataFrame, name: str = "rule") -> str | None:
    """The rule column, null where a frame has none."""
    return name if name in frame.columns else None


def with_severity(records: DataFrame) -> DataFrame:
    return settle(records, severity_text=text.severity_text(F.col("body"))).withColumn(
        "severity_number", text.severity_number(F.col("severity_text"))
    )


def enrich(records: DataFrame, rules: Sequence[FileRule | ProcessRule]) -> DataFrame:
    """Add severity, attributes, trace id and ``dropped`` by the rule of the row.

    Needs ``body``; ``stream`` and ``flag`` of the framing when there are any;
    ``rule`` with more than one rule.  Later attributes win: framing, level,
    extractors in order.  Each pattern is evaluated once, in a projection of
    its own, before the map is put together from known names.
    """
    body, rule_name = F.col("body"), rule_column(records)
    leveled = with_severity(records)
    keys = sorted({item.key for rule in rules for item in rule.extractors})

    def extracted(key: str) -> Column:
        def value(rule) -> Column:
            patterns = [item.pattern for item in rule.extractors if item.key == key]
            if not patterns:
                return F.lit(None).cast("string")
            return F.nullif(F.regexp_extract(body, java_pattern(patterns[0]), 1), F.lit(""))

        return by_rule(rules, value, rule=rule_name)

    def traced(rule) -> Column:
        return text.trace_bytes(F.col("_trace"), rule.trace_id.completion)

    def dropped(rule) -> Column:
        levels = [level.upper() for level in rule.drop_levels]
        return F.col("severity_text").isin(levels) if levels else F.lit(False)

    trace = by_rule(rules, lambda rule: text.trace_match(body, rule.trace_id.pattern), rule=rule_name)
    matched = leveled.withColumns({"_trace": trace, **{f"_x{index}": extracted(key) for index, key in enumerate(keys)}})
    values = {"log.level": F.nullif(F.col("severity_text"), F.lit(""))}
    if "stream" in records.columns:
        values |= {"log.iostream": F.col("stream"), "log.cri.flag": F.col("flag")}
    for index, key in enumerate(keys):
        found = F.col(f"_x{index}")
        values[key] = F.coalesce(found, values[key]) if key in values else found
    return matched.withColumns(
        {
            "attributes": text.keyed_map(values),
            "trace_id": by_rule(rules, traced, rule=rule_name),
            # A row of no known rule is never dropped by it; see ``unmatched``.
            "dropped": F.coalesce(by_rule(rules, dropped, rule=rule_name), F.lit(False)),
        }
    ).drop("_trace", *[f"_x{index}" for index in range(len(keys))])


def drop_levels(records: DataFrame) -> DataFrame:
    """Keep the records whose level the rule does not drop."""
    return records.where(~F.coalesce("dropped", F.lit(False)))


def unmatched(records: DataFrame, rules: Sequence[FileRule | ProcessRule], *, rule: str = "rule") -> DataFrame:
    """Rows whose rule is none of these, for a side table: no extractor or drop list applies to them."""
    return records.where(~F.coalesce(F.col(rule).isin([item.name for item in rules]), F.lit(False)))


def stamp(records: DataFrame, *, now: Column | None = None) -> DataFrame:
    """Fill a missing event time and set the observed time."""
    moment = F.current_timestamp() if now is None else now
    return records.withColumns(
        {
            "time_unix_nano": F.coalesce(F.col("time_unix_nano"), F.unix_micros(moment) * 1000),
            "ts": F.coalesce(F.col("ts"), moment),
            "observed_ts": moment,
        }
    )


def resource_values(
    path: Column,
    rules: Sequence[FileRule | ProcessRule],
    source_type: str | Column,
    *,
    extra: Mapping[str, Column] | None = None,
    rule: str | None = "rule",
) -> dict[str, Column]:
    """Resource entries of a target: rule attributes, container or process parts, fixed names.

    Later parts win.  All names are known from the rules, so each gets one
    value expression.  A container target has its name parts in ``_name``.
    """
    names = sorted({name for item in rules for name in item.attributes})

    def attribute(name: str) -> Column:
        known = [(item.name, item.attributes[name]) for item in rules if name in item.attributes]
        if rule is None:
            return F.lit(known[0][1])
        # A map looks values up by rule, however many rules there are.
        return F.try_element_at(F.create_map(*[F.lit(part) for pair in known for part in pair]), F.col(rule))

    values = {name: attribute(name) for name in names}
    parts = dict(extra or {})
    if not isinstance(source_type, str):
        contained = paths.container_parts(F.col("_name"))
        parts |= {name: F.when(source_type == "container", value) for name, value in contained.items()}
    elif source_type == "container":
        parts |= paths.container_parts(F.col("_name"))
    for name, value in parts.items():
        values[name] = F.coalesce(value, values[name]) if name in values else value
    values["log.file.path"] = path
    values["log.source.type"] = F.lit(source_type) if isinstance(source_type, str) else source_type
    values["log.source.rule"] = F.lit(rules[0].name) if rule is None else F.col(rule)
    return values


def with_resource(
    records: DataFrame,
    rules: Sequence[FileRule | ProcessRule],
    source_type: str | Column,
    *,
    path: str = "path",
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ``resource`` and its canonical ``resource_key``; the source type may differ by row."""
    values = resource_values(F.col(path), rules, source_type, extra=extra, rule=rule_column(records))
    # Values first, so that the map and the key share them.
    columns = {name: f"_r{index}" for index, name in enumerate(sorted(values))}
    if not isinstance(source_type, str) or source_type == "container":
        records = records.withColumn("_name", paths.container_name_parts(F.col(path)))
    found = records.withColumns({columns[name]: value for name, value in values.items()})
    shared = {name: F.col(column) for name, column in columns.items()}
    return found.withColumns(
        {"resource": text.keyed_map(shared), "resource_key": text.keyed_text(shared)}
    ).drop("_name", *columns.values())


def with_record_size(records: DataFrame) -> DataFrame:
    size = text.record_size(F.col("body"), F.col("trace_id"), F.col("attributes"), F.col("resource"))
    return settle(records, size=size)


def split_oversize(records: DataFrame, *, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Records that fit the byte limit and those that do not."""
    sized = records if "size" in records.columns else with_record_size(records)
    return sized.where(F.col("size") <= max_bytes), sized.where(F.col("size") > max_bytes)
