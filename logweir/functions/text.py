"""Row-wise text functions: line clean-up, CRI framing, severity, ids, maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.functions.patterns import java_pattern

# Words, their level, and the level numbers.
SEVERITY_PATTERN = (
    r"(?i)(?:^|[\t\n\f\r \[\]():=\-])"
    r"(TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|ERR|FATAL|CRITICAL|CRIT|ALERT|EMERG|PANIC)"
    r"(?:\z|[\t\n\f\r \[\]():=\-])"
)
SEVERITY_WORDS = {
    "TRACE": "TRACE",
    "DEBUG": "DEBUG",
    "INFO": "INFO",
    "NOTICE": "INFO",
    "WARN": "WARN",
    "WARNING": "WARN",
    "ERROR": "ERROR",
    "ERR": "ERROR",
    "FATAL": "FATAL",
    "CRITICAL": "FATAL",
    "CRIT": "FATAL",
    "ALERT": "FATAL",
    "EMERG": "FATAL",
    "PANIC": "FATAL",
}
SEVERITY_NUMBERS = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17, "FATAL": 21}
LEVELS = tuple(SEVERITY_NUMBERS)

_EMPTY_MAP = "cast(map() as map<string,string>)"


def empty_map() -> Column:
    return F.expr(_EMPTY_MAP)


def literal_map(values: Mapping[str, str]) -> Column:
    """A map literal with keys in name order."""
    if not values:
        return empty_map()
    parts = [F.lit(part) for key in sorted(values) for part in (key, values[key])]
    return F.create_map(*parts)


# ---------------------------------------------------------------- lines


def strip_cr(line: Column) -> Column:
    """Drop one carriage return at the end of the line."""
    return F.when(F.endswith(line, F.lit("\r")), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def bound(line: Column, max_chars: int) -> Column:
    """Keep the first ``max_chars`` code points."""
    return F.when(F.length(line) > max_chars, F.substring(line, 1, max_chars)).otherwise(line)


# One well-formed UTF-8 sequence in hex, as in the Unicode standard, table 3-7.
_TAIL = "[89AB]."
_UTF8_HEX = (
    f"(?:[0-7].|(?:C[2-9A-F]|D.){_TAIL}"
    f"|(?:E0[AB].|E[1-9A-CEF]{_TAIL}|ED[89].){_TAIL}"
    f"|(?:F0[9AB].|F[1-3]{_TAIL}|F48.){_TAIL}{_TAIL})"
)


def repair_utf8(line: Column) -> Column:
    """Replace every byte that is not part of valid UTF-8 by U+FFFD.

    ``make_valid_utf8`` puts one mark for a whole cut-off sequence; here each
    bad byte gets its own.  Valid text, nearly all rows, is passed through.
    """
    fixed = F.regexp_replace(F.hex(line), rf"\G({_UTF8_HEX}*+)(..)", "$1EFBFBD")
    return F.when(F.is_valid_utf8(line), line).otherwise(F.unhex(fixed).cast("string"))


# ---------------------------------------------------------------- CRI


def cri_attributes(stream: Column, flag: Column) -> Column:
    """The attributes of a framed line; an empty map for a raw one."""
    return F.when(
        stream.isNotNull(),
        F.create_map(F.lit("log.iostream"), stream, F.lit("log.cri.flag"), flag),
    ).otherwise(empty_map())


# ---------------------------------------------------------------- severity


def _lookup(values: Mapping[str, Column]) -> Column:
    return F.create_map(*[part for name, value in values.items() for part in (F.lit(name), value)])


def severity_text(body: Column) -> Column:
    """Level named first in the first line of the body, or the empty string."""
    word = F.upper(F.regexp_extract(F.substring_index(body, "\n", 1), SEVERITY_PATTERN, 1))
    levels = _lookup({name: F.lit(level) for name, level in SEVERITY_WORDS.items()})
    return F.coalesce(F.element_at(levels, word), F.lit(""))


def severity_number(level: Column) -> Column:
    numbers = _lookup({name: F.lit(number) for name, number in SEVERITY_NUMBERS.items()})
    return F.coalesce(F.element_at(numbers, level), F.lit(0))


def level_attribute(level: Column) -> Column:
    """``log.level`` when the level is known."""
    return F.when(level != "", F.create_map(F.lit("log.level"), level)).otherwise(empty_map())


# ---------------------------------------------------------------- extraction


def extract_attributes(body: Column, extractors: Sequence[tuple[str, str]]) -> Column:
    """First capture group of each pattern over the whole body; '' adds nothing."""
    if not extractors:
        return empty_map()
    entries = F.array(
        *[
            F.struct(F.lit(key).alias("key"), F.regexp_extract(body, java_pattern(pattern), 1).alias("value"))
            for key, pattern in extractors
        ]
    )
    return F.map_from_entries(F.filter(entries, lambda entry: entry["value"] != ""))


def trace_match(body: Column, pattern: str | None) -> Column:
    """Text of the first capture group that names the trace; '' without one."""
    return F.regexp_extract(body, java_pattern(pattern), 1) if pattern else F.lit("")


def trace_bytes(found: Column, completion: bool = False) -> Column:
    """Trace id bytes of a match, or null.

    Without completion the matched text itself is the id.  With completion 16
    hex digits are padded to 32, 32 are decoded, the rest gives null.
    """
    if not completion:
        return F.when(found != "", F.encode(found, "UTF-8"))
    digits = F.octet_length(found)
    usable = F.rlike(found, F.lit(r"^[0-9A-Fa-f]+\z")) & ~F.rlike(found, F.lit(r"^0+\z"))
    return F.when(digits.isin(16, 32) & usable, F.unhex(F.lpad(found, 32, "0")))


def trace_id(body: Column, pattern: str | None, completion: bool = False) -> Column:
    """Trace id bytes from the first capture group of a pattern, or null."""
    return trace_bytes(trace_match(body, pattern), completion)


# ---------------------------------------------------------------- maps


def merge_maps(*maps: Column) -> Column:
    """Union of maps where the later map wins, whatever the session setting."""
    out = maps[0]
    for later in maps[1:]:
        out = F.map_concat(F.map_filter(out, lambda key, _: ~F.map_contains_key(later, key)), later)
    return out


def keyed_map(values: Mapping[str, Column]) -> Column:
    """A map of literal names, in name order; a null value leaves its name out.

    With every name known when the plan is built no map has to be merged or
    sorted at run time.
    """
    if not values:
        return empty_map()
    entries = [F.struct(F.lit(name).alias("key"), values[name].alias("value")) for name in sorted(values)]
    return F.map_from_entries(F.filter(F.array(*entries), lambda entry: entry["value"].isNotNull()))


def keyed_text(values: Mapping[str, Column]) -> Column:
    """``resource_key`` of the map that ``keyed_map`` makes of the same values."""
    zero = F.lit("\0")
    return F.concat_ws("", *[F.concat(F.lit(f"{name}\0"), values[name], zero) for name in sorted(values)])


def sorted_entries(values: Column) -> Column:
    """Map entries in key order; a null map has none."""
    return F.sort_array(F.map_entries(F.coalesce(values, empty_map())))


def resource_key(values: Column) -> Column:
    """Canonical text of a map: each name and value closed by a zero byte."""
    zero = F.lit("\0")
    return F.array_join(
        F.transform(sorted_entries(values), lambda e: F.concat(e["key"], zero, e["value"], zero)), ""
    )


def record_size(body: Column, trace: Column, *maps: Column) -> Column:
    """Estimated size in bytes: body, id and 128, and 32 more per map entry."""
    total = F.octet_length(body).cast("long") + F.coalesce(F.octet_length(trace), F.lit(0)) + 128
    for values in maps:
        names, texts = F.array_join(F.map_keys(values), ""), F.array_join(F.map_values(values), "")
        used = F.octet_length(names) + F.octet_length(texts) + F.size(values) * 32
        total = total + F.when(values.isNotNull(), used).otherwise(0)
    return total


def first_keyword(body: Column, keywords: Sequence[str]) -> Column:
    """First keyword of the list found in the body (exact case), or null."""
    out = F.lit(None).cast("string")
    for keyword in reversed(list(keywords)):
        out = F.when(F.contains(body, F.lit(keyword)), F.lit(keyword)).otherwise(out)
    return out


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(value, F.lit("")) for value in values])
