import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from logweir.functions import paths, text
from logweir.functions.patterns import PatternError, capture_groups, java_pattern
from logweir.operators.cri import parse_cri


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(value).alias(name) for name, value in values.items()])
    return frame.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "body, level, number",
    [
        ("Mar 03 07:41:12 gate-7 INFO door opened by badge", "INFO", 9),
        ("t=1709451672 severity=warning tank=low", "WARN", 13),
        ("ERROR pump 4 stopped\n   in valve_loop (pump.c, 218)", "ERROR", 17),
        ("panic: reactor gone", "FATAL", 21),
        ("the belt moved forty crates", "", 0),
        ("first line\nERROR on the second", "", 0),
        ("terror ERR", "ERROR", 17),
        ("notice", "INFO", 9),
        ("x ERROR", "", 0),
        ("x\x0bERROR", "", 0),
        ("ERROR\r", "ERROR", 17),
    ],
)
def test_severity(spark, body, level, number):
    found = one(spark, F.struct(text.severity_text(F.col("b")), text.severity_number(text.severity_text(F.col("b")))), b=body)
    assert tuple(found) == (level, number)


def test_extractor(spark):
    pattern = r"\border=([A-Z]{2}\d+);"
    body = "kiosk 12 | order=QX90417; items=3 | order=ZZ1; paid"
    column = text.extract_attributes(F.col("b"), [("shop.order", pattern), ("none", "(zzz)")])
    assert one(spark, column, b=body) == {"shop.order": "QX90417"}


@pytest.mark.parametrize(
    "value, completion, expected",
    [
        ("span <9e1b0c44d2f7a63b> done", True, "0" * 16 + "9e1b0c44d2f7a63b"),
        ("span <f0e1d2c3b4a5968778695a4b3c2d1e0f> done", True, "f0e1d2c3b4a5968778695a4b3c2d1e0f"),
        ("span <ghij> done", True, None),
        (f"span <{'0' * 32}> done", True, None),
        ("span <9e1b0c> done", True, None),
        ("span <9e1b0c44d2f7a63b> done", False, b"9e1b0c44d2f7a63b".hex()),
        ("no span here", False, None),
    ],
)
def test_trace_id(spark, value, completion, expected):
    found = one(spark, text.trace_id(F.col("b"), r"span <([^>]*)>", completion), b=value)
    assert (None if found is None else bytes(found).hex()) == expected


@pytest.mark.parametrize(
    "line, expected",
    [
        ("2031-11-05T23:59:01.000000042Z stderr F lamp out", ("stderr", "F", "lamp out", 42, 0)),
        ("2031-11-05T23:59:01Z stdout P ", ("stdout", "P", "", 0, 0)),
        ("2031-11-05T23:59:01,25+05:30 stdout F a b  c", ("stdout", "F", "a b  c", 250000000, 19800)),
        ("2031-11-05T3:59:01.1-00:30 stdout F x", ("stdout", "F", "x", 100000000, -1800)),
        ("2031-11-05T23:59:01+05:30 stdout F x", ("stdout", "F", "x", 0, 19800)),
        ("2031-11-05T23:59:01.9876543219-03:00 stdout F x", ("stdout", "F", "x", 987654321, -10800)),
        ("no frame at all", None),
        ("2031-02-29T23:59:01Z stdout F x", None),
        ("2031-11-05T23:59:01 stdout F x", None),
        ("2031-11-05T23:59:01Z stdlog F x", None),
        ("2031-11-05T23:59:01Z stdout X x", None),
        ("2031-11-05T23:59:01Z stdout F", None),
    ],
)
def test_cri(spark, line, expected):
    row = parse_cri(spark.createDataFrame([(line,)], "line string")).first()
    if expected is None:
        assert not row.cri_ok and row.body == line and row.ts is None and row.stream is None
        return
    stream, flag, body, nanos, offset = expected
    assert (row.stream, row.flag, row.body, row.utc_offset) == (stream, flag, body, offset)
    assert row.time_unix_nano % 1_000_000_000 == nanos
    zone = dt.timezone(dt.timedelta(seconds=offset))
    hour = 3 if "T3:" in line else 23
    moment = dt.datetime(2031, 11, 5, hour, 59, 1, tzinfo=zone)
    assert row.time_unix_nano // 1_000_000_000 == int(moment.timestamp())


def decode_go(data: bytes) -> str:
    """One mark per bad byte: decode the longest valid piece, skip one byte, go on."""
    out = ""
    while data:
        try:
            return out + data.decode("utf-8")
        except UnicodeDecodeError as error:
            out += data[: error.start].decode("utf-8") + "�"
            data = data[error.start + 1 :]
    return out


@pytest.mark.parametrize(
    "data",
    [b"A\xffB", b"\xe4\xbd", b"ok", "你好".encode(), b"\xf0\x9f\x98x", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80",
     "é".encode() + b"\x80\x80" + "🚨".encode() + b"\xe2\x82", b"x" * 20000 + b"\xff"],
)
def test_utf8_repair(spark, data):
    frame = spark.createDataFrame([(bytearray(data),)], "b binary").select(F.col("b").cast("string").alias("line"))
    assert frame.select(text.repair_utf8(F.col("line"))).first()[0] == decode_go(data)


def test_line_clean_up(spark):
    assert one(spark, text.bound(F.col("b"), 2), b="你好世界") == "你好"
    assert one(spark, text.bound(F.col("b"), 5), b="123456789") == "12345"
    assert one(spark, text.strip_cr(F.col("b")), b="a\r\r") == "a\r"
    assert one(spark, text.strip_cr(F.col("b")), b="a\rb") == "a\rb"


def test_maps(spark):
    merged = text.merge_maps(
        text.literal_map({"a": "1", "b": "2"}), text.literal_map({"b": "3"}), text.literal_map({"c": "4", "a": "5"})
    )
    assert one(spark, merged, x=1) == {"b": "3", "c": "4", "a": "5"}
    assert one(spark, text.resource_key(merged), x=1) == "a\x005\x00b\x003\x00c\x004\x00"
    size = text.record_size(F.lit("first"), F.lit(None).cast("binary"), text.empty_map(), text.literal_map({"ab": "é"}))
    assert one(spark, size, x=1) == 5 + 128 + 2 + 2 + 32


@pytest.mark.parametrize(
    "path, expected",
    [
        ("/var/log/containers/web-1_shop_nginx-abc123.log",
         {"k8s.pod.name": "web-1", "k8s.namespace.name": "shop", "k8s.container.name": "nginx", "container.id": "abc123"}),
        ("/x/p_n_side-car-9.log", {"k8s.pod.name": "p", "k8s.namespace.name": "n", "k8s.container.name": "side-car", "container.id": "9"}),
        ("/x/p_n_plain.log", {"k8s.pod.name": "p", "k8s.namespace.name": "n"}),
        ("/x/p_n_-id.log", {"k8s.pod.name": "p", "k8s.namespace.name": "n"}),
        ("/x/p_n_c_d-e", {"k8s.pod.name": "p", "k8s.namespace.name": "n", "k8s.container.name": "c_d", "container.id": "e"}),
        ("/x/p_n.log", {}),
    ],
)
def test_container_names(spark, path, expected):
    assert one(spark, paths.container_attributes(F.col("p")), p=path) == expected


def test_paths(spark):
    assert one(spark, paths.strip_deleted(F.col("p")), p="/a/b.log (deleted)") == "/a/b.log"
    assert one(spark, paths.reported_path(F.lit(""), F.col("p")), p="/a") == "/a"
    assert one(spark, paths.reported_path(F.lit("/b"), F.col("p")), p="/a") == "/b"
    assert one(spark, paths.local_path(F.col("p")), p="file:///a%20b/c+d.log") == "/a b/c+d.log"
    globs = {"/a/*.log": "/a/x.log", "/a/?.log": "/a/x.log", "/a/[a-c]x": "/a/bx", "/a/[^a-c]x": "/a/dx", r"/a/\*": "/a/*"}
    for glob, path in globs.items():
        assert one(spark, paths.matches_any(F.col("p"), [glob]), p=path), glob
    for glob, path in {"/a/*.log": "/a/b/x.log", "/a/?.log": "/a/xy.log", "/a/[^a-c]x": "/a/bx", r"/a/\*": "/a/b"}.items():
        assert not one(spark, paths.matches_any(F.col("p"), [glob]), p=path), glob


PATTERNS = [
    r"a$", r"\s+(x)", r"[\s,]+(\w+)", r"(?i)err(or)?", r"^(?:\d{4}-)?\d{2}", r"\bé", r"\b(\w+)\b", r"([[:alpha:]]+)",
    r"(.+)", r"(.+)$", r"(?P<name>[a-z]+)=", r"[[]x", r"[a&&b]+", r"(?m)^b", r"\S+\z", r"[^\s]+", r"(?s)(a.b)", r"x{2,3}", r"\Bx",
]
TEXTS = [
    "a", "a\n", "b\na", " \x0bx", "\tx", ",  y z", "ERROR err", "2026-08-24", "éé", "é word", "k1=v", "[x", "a&b", "a\r\nb",
    "line more", "xx xxx", "", "a\nb\n", "axb",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_agree_with_the_linear_dialect(spark, pattern):
    frame = spark.createDataFrame([(value,) for value in TEXTS], "t string")
    group = min(1, capture_groups(pattern))
    found = frame.select(
        F.rlike("t", F.lit(java_pattern(pattern))), F.regexp_extract("t", java_pattern(pattern), group)
    ).collect()
    with duckdb.connect() as db:
        for value, row in zip(TEXTS, found):
            expected = db.execute("select regexp_matches(?, ?), regexp_extract(?, ?, ?)", [value, pattern, value, pattern, group]).fetchone()
            assert (row[0], row[1]) == expected, (pattern, value)


@pytest.mark.parametrize("pattern", [r"(?=a)b", r"(?<!a)b", r"(a)\1", r"a*+", r"(?>a)", r"(?U)a", r"\Ga", r"a{2}+"])
def test_patterns_outside_the_dialect(pattern):
    with pytest.raises(PatternError):
        java_pattern(pattern)


def test_capture_groups():
    assert [capture_groups(p) for p in (r"a", r"(a)", r"(?:a)", r"(?P<x>a)(b)", r"[(]", r"\(", r"(?i)a")] == [0, 1, 0, 2, 0, 0, 0]
