"""Rules, targets, alerts, OTLP documents, delivery outcomes."""

import datetime as dt
import json
import re
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from logweir.operators import alerts, enrich, otlp, outbox, positions, targets
from logweir.rules import (
    AlertPolicy, ExportOptions, Extractor, FileRule, FlowControl, ProcessRule, RuleError, RuleSet, TraceId, duration_ms,
)
from logweir.sources.text_lines import scan_lines

RECORD = "body string, severity_text string, attributes map<string,string>, resource map<string,string>, ts timestamp"


def record(spark, body="request failed", level="ERROR", attributes=None, resource=None):
    moment = dt.datetime(2031, 11, 5, 23, 59, 1)
    return spark.createDataFrame([(body, level, attributes or {}, resource or {}, moment)], RECORD)


# ---------------------------------------------------------------- rules


def test_defaults():
    rules = RuleSet.from_dict({})
    assert rules.export.batch_size == 500 and duration_ms(rules.limits.read_interval) == 1000
    assert rules.flow_control.burst == 2000 and rules.alerts.severity_levels == ("ERROR", "FATAL")


@pytest.mark.parametrize("text, ms", [("200ms", 200), ("3s", 3000), ("1h30m", 5_400_000), ("0", 0), ("1.5s", 1500)])
def test_durations(text, ms):
    assert duration_ms(text) == ms


FILE = {"name": "f", "include": ["/a/*.log"]}
BAD = [
    {"unknown": 1},
    {"files": [{**FILE, "wrong": 1}]},
    {"files": [{"name": "f"}]},
    {"files": [{**FILE, "format": "json"}]},
    {"files": [{**FILE, "start_at": "middle"}]},
    {"files": [{**FILE, "multiline": {"start_pattern": "("}}]},
    {"files": [{**FILE, "extractors": [{"key": "k", "pattern": "abc"}]}]},
    {"files": [{**FILE, "extractors": [{"key": "k", "pattern": "(a)"}, {"key": "k", "pattern": "(b)"}]}]},
    {"files": [{**FILE, "trace_id": {"pattern": "abc"}}]},
    {"files": [{**FILE, "drop_levels": ["LOUD"]}]},
    {"files": [{**FILE, "drop_levels": ["debug", "DEBUG"]}]},
    {"files": [{**FILE, "extractors": [{"key": "k", "pattern": "(?=a)(b)"}]}]},
    {"processes": [{"name": "p", "include_regex": "x"}]},
    {"alerts": {"enabled": True, "ignore_keywords": [" "]}},
    {"alerts": {"enabled": True, "ignore_keywords": ["a", "a"]}},
    {"alerts": {"enabled": True, "severity_levels": []}},
    {"export": {"enabled": False}},
    {"export": {"compression": "zip"}},
    {"export": {"max_queue_bytes": 10}},
    {"flow_control": {"enabled": True, "mode": "wait"}},
    {"flow_control": {"enabled": True, "burst": 0}},
    {"limits": {"max_log_size": 0}},
]


@pytest.mark.parametrize("values", BAD, ids=str)
def test_bad_rule_sets(values):
    with pytest.raises(RuleError):
        RuleSet.from_dict(values).validate()


def test_good_rule_set(spark):
    rules = RuleSet.from_dict(
        {
            "files": [{**FILE, "drop_levels": ["debug"], "extractors": [{"key": "k", "pattern": r"(?i)\bx=(\S+)$"}]}],
            "processes": [{"name": "p", "comm_regex": "java", "include_regex": r"\.log$"}],
            "alerts": {"enabled": True}, "flow_control": {"enabled": True, "mode": "drop"},
        }
    ).validate(spark)
    assert [name for name, _, _ in rules.rules] == ["process", "file"]
    assert rules.options_frame(spark).where("rule = 'f'").first().drop_levels == ["DEBUG"]


# ---------------------------------------------------------------- enrichment


def test_rules_apply_to_their_own_rows(spark):
    rules = [
        FileRule("a", ("/a",), extractors=(Extractor("id", r"a=(\w+)"),), drop_levels=("DEBUG",), attributes={"x": "1"}),
        FileRule("b", ("/b",), extractors=(Extractor("log.level", r"b=(\w+)"),), trace_id=TraceId(r"t=(\w+)"), attributes={"log.source.rule": "no"}),
    ]
    rows = [("a", "DEBUG a=1 b=2 t=3", "/a"), ("b", "DEBUG a=1 b=2 t=3", "/b")]
    frame = spark.createDataFrame(rows, "rule string, body string, path string")
    found = {r.rule: r for r in enrich.with_resource(enrich.enrich(frame, rules), rules, "file").collect()}
    assert found["a"].attributes == {"id": "1", "log.level": "DEBUG"} and found["a"].dropped and found["a"].trace_id is None
    assert found["b"].attributes == {"log.level": "2"} and not found["b"].dropped and bytes(found["b"].trace_id) == b"3"
    assert found["a"].resource == {"x": "1", "log.file.path": "/a", "log.source.type": "file", "log.source.rule": "a"}
    assert found["b"].resource == {"log.file.path": "/b", "log.source.type": "file", "log.source.rule": "b"}
    assert found["b"].resource_key == "log.file.path\0/b\0log.source.rule\0b\0log.source.type\0file\0"


def test_missing_times_are_stamped(spark):
    frame = spark.createDataFrame([(None, None)], "ts timestamp, time_unix_nano long")
    row = enrich.stamp(frame, now=F.timestamp_micros(F.lit(5))).select(F.unix_micros("ts"), "time_unix_nano", F.unix_micros("observed_ts")).first()
    assert tuple(row) == (5, 5000, 5)


# ---------------------------------------------------------------- targets


def test_command_line_is_blank_when_no_rule_of_the_name_looks(spark):
    rules = [
        ProcessRule("a", comm_regex="^web$", include_regex="."), ProcessRule("b", comm_regex="^db$", cmdline_regex="prod", include_regex="."),
    ]
    frame = spark.createDataFrame([("h", 1, "web", "web --x"), ("h", 2, "db", "db prod"), ("h", 3, "db", "db test")], "host string, pid long, comm string, cmdline string")
    found = sorted((r.pid, r.rule, r.cmdline) for r in targets.match_processes(frame, rules).collect())
    assert found == [(1, "a", ""), (2, "b", "db prod")]


def test_scan_takes_first_glob_and_skips_folders(spark, tmp_path):
    for name in ("a.log", "b.log", "b.txt"):
        (tmp_path / name).write_bytes(name.encode() + b"\r\nlast")
    (tmp_path / "d.log").mkdir()
    (tmp_path / "d.log" / "inner").write_bytes(b"no\n")
    found = scan_lines(spark, [f"{tmp_path}/b.*", f"{tmp_path}/*.log", f"{tmp_path}/none*"], [f"{tmp_path}/*.txt"])
    rows = sorted((r.path.rsplit("/", 1)[1], r.include_idx, r.line) for r in found.collect())
    assert rows == [("a.log", 1, "a.log\r"), ("a.log", 1, "last"), ("b.log", 0, "b.log\r"), ("b.log", 0, "last")]


def test_excluded_files_are_not_read(spark, tmp_path):
    for name in ("keep.log", "skip.log"):
        (tmp_path / name).write_bytes(b"x" * 5000 + b"\n")
    found = scan_lines(spark, [f"{tmp_path}/*.log"], [f"{tmp_path}/skip*"])
    assert {row.path.rsplit("/", 1)[1] for row in found.collect()} == {"keep.log"}
    # The executed plan counts the files that its scans selected.
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    files = [leaves.apply(at).metrics().apply("numFiles").value() for at in range(leaves.size())]
    assert files == [1]


def test_positions_prune(spark):
    rows = [("k1", "/a", 1), ("k2", "/b", 1), ("k3", "/c", 9)]
    stored = spark.createDataFrame(rows, "file_key string, path string, day int").withColumn("updated_at", F.timestamp_seconds(F.col("day")))
    live = spark.createDataFrame([("k1", "/a"), ("other", "/b")], "file_key string, path string")
    cutoff = F.timestamp_seconds(F.lit(5))
    assert [r.file_key for r in positions.prunable(stored, live, cutoff=cutoff).collect()] == ["k2"]
    assert sorted(r.file_key for r in positions.prune(stored, live, cutoff=cutoff).collect()) == ["k1", "k3"]


# ---------------------------------------------------------------- alerts


def test_alert_message(spark):
    policy = AlertPolicy(title="Lager Süd", environment="Probe", host="other", error_type_keywords=("ScaleJam",))
    body = "ERROR - order 55 - ScaleJam: lane <B> of `hall_2` blocked\n   | crate 17"
    frame = record(spark, body, attributes={"request.id": "order-55"}, resource={"host.name": "hall-2", "log.source.rule": "scales", "log.file.path": "/srv/weights.log"})
    row = alerts.messages(frame, policy).first()
    head, *rest = row.content.split("\n")
    assert head == alerts.TITLE_PREFIX + "Lager Süd"
    for value in ("Probe", "hall-2", "ScaleJam", "scales", "/srv/weights.log", "order-55"):
        assert sum(value in line for line in rest if line.startswith("> **")) == 1, value
    assert any("\\<B\\> of \\`hall_2\\` blocked" in line for line in rest)
    assert rest[-1] == f"> {alerts.OPEN}   | crate 17{alerts.CLOSE}"
    assert json.loads(row.payload)["markdown"]["content"] == row.content


def test_alert_defaults_and_filters(spark):
    policy = AlertPolicy(host="hall-9", ignore_keywords=("drill",))
    sent = alerts.messages(record(spark), policy).first().content
    assert "hall-9" in sent and alerts.DEFAULT_TITLE in sent
    cases = [("INFO", "pump stopped", ("ERROR",), 0), ("ERROR", "a drill, pump stopped", ("ERROR",), 0), ("WARN", "pump slow", ("warn",), 1), ("ERROR", "pump stopped", ("warn",), 0)]
    for level, body, levels, count in cases:
        assert alerts.messages(record(spark, body, level=level), replace(policy, severity_levels=levels)).count() == count


def model_render(title, fields, body, limit):
    """The longest message within the limit: whole parts while they fit, then one part cut to the room left.

    A part is its fixed marks around a text.  The first part whose marks do not
    fit ends the body; a field that does not fit is left out.
    """

    def escaped(text):
        return re.sub(r"([\\`<>])", r"\\\1", text)

    def cut(text, room):
        tail = alerts.TRUNCATED if room > len(alerts.TRUNCATED) else ""
        return text if len(text) <= room else text[: room - len(tail)] + tail

    marked = [(f"> **{label}：** " + alerts.OPEN * strong, escaped(value), alerts.CLOSE * strong) for (_, label, strong), value in zip(alerts.FIELDS, fields) if value]
    lines = [("> " + alerts.OPEN, escaped(part), alerts.CLOSE) for part in body.split("\n")]
    content = ""
    for at, part in enumerate([(alerts.TITLE_PREFIX, escaped(title), ""), *marked, None, (alerts.BODY_HEADING, "", ""), *lines]):
        if part is None:
            content += "\n" if content and len(content) < limit else ""
            continue
        before, text, after = ("\n" if content else "") + part[0], part[1], part[2]
        room = limit - len(content + before + after)
        if room >= 0:
            content += before + cut(text, room) + after
        elif at > len(marked) + 2:
            break
    return content


def test_bounded_messages_equal_the_budget_model(spark):
    rng = random.Random(3)
    names = [name for name, _, _ in alerts.FIELDS]
    rows = []
    for _ in range(60):
        words = ["", "x", "`<y>`", "é" * rng.randint(1, 30), "\\ long text " * 3]
        rows.append((rng.choice(words[1:]), *[rng.choice(words) for _ in names], "\n".join(rng.choice(words) for _ in range(rng.randint(1, 12)))))
    schema = ", ".join(f"`{name}` string" for name in ["title", *names, "body"])
    frame = spark.createDataFrame(rows, schema)
    for limit in (1, 9, 20, 57, 150, 333, 5000):
        found = [row[0] for row in frame.select(alerts.render(limit)).collect()]
        assert found == [model_render(row[0], row[1:-1], row[-1], limit) for row in rows], limit


# ---------------------------------------------------------------- export


def test_request_documents(spark):
    moment = dt.datetime(2031, 11, 5, 23, 59, 1)
    schema = RECORD + ", severity_number int, trace_id binary, observed_ts timestamp, time_unix_nano long, resource_key string, k string, n long"
    rows = [
        ("hello", "ERROR", {}, {"service.name": "demo"}, moment, 17, bytearray(b"\x01" * 16), moment, 1, "r", "k", 0),
        ("world", "", {"b": "2", "a": "1"}, {"service.name": "demo"}, moment, 0, None, moment, 2, "r", "k", 1),
    ]
    frame = spark.createDataFrame(rows, schema)
    packed = otlp.pack_batches(frame, ["k"], ["n"], ExportOptions())
    document = json.loads(otlp.requests(packed, ["k"], scope="s").first().request)
    (entry,) = document["resourceLogs"]
    assert entry["resource"]["attributes"] == [{"key": "service.name", "value": {"stringValue": "demo"}}]
    (scope,) = entry["scopeLogs"]
    first, second = scope["logRecords"]
    assert scope["scope"] == {"name": "s"}
    assert first["traceId"] == "01" * 16 and first["severityNumber"] == 17 and "attributes" not in first
    assert [item["key"] for item in second["attributes"]] == ["a", "b"]
    assert "severityText" not in second and "severityNumber" not in second and "traceId" not in second


def test_oversize_records_are_rejected(spark):
    frame = spark.createDataFrame([("first", None, {}, {})], "body string, trace_id binary, attributes map<string,string>, resource map<string,string>")
    fits, rejected = enrich.split_oversize(frame, max_bytes=133)
    assert fits.first().size == 133 and rejected.count() == 0
    assert enrich.split_oversize(frame, max_bytes=132)[1].count() == 1


@pytest.mark.parametrize(
    "text, ms",
    [("5", 5000), ("1.5", 1500), ("", 0), (None, 0), ("soon", 0), ("Wed, 05 Nov 2031 23:59:11 GMT", 10_000),
     ("Wednesday, 05-Nov-31 23:59:02 GMT", 1_000), ("Wed Nov  5 23:59:03 2031", 2_000), ("Thu, 06 Nov 2031 00:00:01 GMT", 60_000),
     ("Wed, 05 Nov 2031 23:59:00 GMT", 0), ("-3", 0)],
)
def test_retry_after(spark, text, ms):
    frame = spark.createDataFrame([(text,)], "t string")
    now = F.timestamp_seconds(F.lit(int(dt.datetime(2031, 11, 5, 23, 59, 1, tzinfo=dt.timezone.utc).timestamp())))
    assert frame.select(outbox.retry_after_ms(F.col("t"), now)).first()[0] == ms


def test_outcomes(spark):
    rows = [(200, 0), (204, 2), (401, None), (408, None), (429, None), (500, None), (302, None), (None, None)]
    frame = spark.createDataFrame(rows, "status int, rejected int")
    found = [r[0] for r in frame.select(outbox.classify(F.col("status"), F.col("rejected"))).collect()]
    assert found == ["ok", "retry_partial", "permanent", "retry_status", "retry_status", "retry_status", "permanent", "retry_network"]
    replies = spark.createDataFrame([(200, 0), (200, 93000), (500, None), (200, None), (None, None)], "status int, code int")
    found = [r[0] for r in replies.select(outbox.reply_outcome(F.col("status"), F.col("code"))).collect()]
    assert found == ["ok", "rejected", "http_error", "bad_answer", "network_error"]
    assert FlowControl().mode == "block"
