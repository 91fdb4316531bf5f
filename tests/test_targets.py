"""Many rules over a listing, rows that keep to their rule, and all rules in one query."""

import json
import os
import random
from fnmatch import fnmatchcase

import pytest
from pyspark.sql import functions as F

from logweir.functions import paths
from logweir.operators import enrich, targets
from logweir.rules import ExportOptions, Extractor, FileRule, Multiline, ProcessRule, RuleSet
from logweir.streaming import job


def many_rules(count):
    rng = random.Random(6)
    rules = []
    for at in range(count):
        include = tuple(f"/var/{rng.choice('abc')}/{rng.choice(['*', 'x*', f'*{at % 7}*', '?1*'])}{rng.choice(['.log', '.txt', '*'])}" for _ in range(rng.randint(1, 3)))
        exclude = (f"/var/*/*{rng.randint(0, 9)}.log",) if rng.random() < 0.6 else ()
        rules.append(FileRule(name=f"r{at}", include=include, exclude=exclude, attributes={"n": str(at)}))
    return rules


def test_two_hundred_rules_over_one_listing(spark):
    rules = many_rules(200)
    rule_set = RuleSet(files=tuple(rules[:150]), containers=tuple(rules[150:]))
    rng = random.Random(7)
    listing = sorted({f"/var/{rng.choice('abcd')}/{rng.choice(['x', 'y', ''])}{rng.randint(0, 400)}{rng.choice(['.log', '.txt', '.gz'])}" for _ in range(400)})
    files = spark.createDataFrame([("h", path) for path in listing], "host string, path string")
    found = targets.discover(rule_set, processes=None, open_files=None, files=files)

    def fits(path, glob):
        # No star of these globs crosses a slash.
        return path.count("/") == glob.count("/") and all(map(fnmatchcase, path.split("/"), glob.split("/")))

    expected = {}
    for path in listing:
        for at, rule in enumerate(rules):
            hits = [nth for nth, glob in enumerate(rule.include) if fits(path, glob)]
            if hits and not any(fits(path, glob) for glob in rule.exclude):
                expected[path] = (rule.name, "file" if at < 150 else "container", at if at < 150 else at - 150, hits[0])
                break
    assert {row.path: (row.rule, row.source_type, row.rule_idx, row.include_idx) for row in found.collect()} == expected
    assert 50 < len(expected) < len(listing)
    assert all(row.resource["n"] == row.rule[1:] and row.resource["log.source.rule"] == row.rule for row in found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("Scan" in line for line in plan.splitlines()) == 1


def test_literal_ends():
    assert paths.literal_ends("/var/log/*.log") == ("/var/log/", ".log")
    assert paths.literal_ends("/var/[ab]x/?.log") == ("/var/", ".log")
    assert paths.literal_ends(r"/a\*b/c") == ("/a*b/c", "")


def test_rows_of_another_rule_keep_nothing_of_a_single_one(spark):
    rule = FileRule(name="own", include=("/x",), drop_levels=("INFO",), extractors=(Extractor("k", r"k=(\w+)"),))
    rows = spark.createDataFrame([("INFO k=1", "own"), ("INFO k=2", "other")], "body string, rule string")
    found = {row.rule: row for row in enrich.enrich(rows, [rule]).collect()}
    assert found["own"].dropped and found["own"].attributes == {"log.level": "INFO", "k": "1"}
    assert not found["other"].dropped and found["other"].attributes == {"log.level": "INFO"}
    # Without a rule column all rows are of the only rule.
    assert enrich.enrich(rows.drop("rule"), [rule]).where("dropped").count() == 2


def requests(spark, where):
    rows = spark.read.option("recursiveFileLookup", "true").text(f"{where}/export").collect()
    out = []
    for row in rows:
        for entry in json.loads(row.value)["resourceLogs"]:
            resource = {item["key"]: item["value"]["stringValue"] for item in entry["resource"]["attributes"]}
            for scope in entry["scopeLogs"]:
                out += [(resource, record["body"]["stringValue"]) for record in scope["logRecords"]]
    return out


def append(path, text):
    with open(path, "ab") as file:
        file.write(text.encode())


def test_all_rules_and_processes_in_one_query(spark, tmp_path):
    for name in ("apps", "pods", "procs"):
        os.mkdir(tmp_path / name)
    rules = RuleSet(
        processes=(ProcessRule(name="shop", comm_regex="^shop$", include_regex=r"\.log$", attributes={"team": "s"}),),
        files=(
            FileRule(name="merged", include=(f"{tmp_path}/apps/m*.log",), start_at="beginning", multiline=Multiline(start_pattern="^A", flush_after="1h")),
            FileRule(name="plain", include=(f"{tmp_path}/apps/*.log",), start_at="beginning", drop_levels=("DEBUG",)),
        ),
        containers=(FileRule(name="pods", include=(f"{tmp_path}/pods/*.log",), start_at="beginning", format="cri"),),
        export=ExportOptions(),
    )
    append(tmp_path / "apps/m1.log", "A one\n more\nA two\n tail\n")
    append(tmp_path / "apps/p1.log", "INFO line\n\nDEBUG gone\n")
    append(tmp_path / "pods/web_ns_c-1.log", "2031-01-01T00:00:00Z stdout F ERROR pod\n")
    append(tmp_path / "procs/9.log", "from a process\n")
    append(tmp_path / "procs/other.txt", "of no target\n")
    processes = spark.createDataFrame([("h", 9, "shop", "shop --all")], "host string, pid long, comm string, cmdline string")
    opened = spark.createDataFrame([("h", 9, 1, f"{tmp_path}/procs/9.log")], "host string, pid long, fd_order long, path string")
    listing = spark.createDataFrame(
        [("h", f"{tmp_path}/{name}") for name in ("apps/m1.log", "apps/p1.log", "pods/web_ns_c-1.log")], "host string, path string"
    )
    found = targets.discover(rules, processes=processes, open_files=opened, files=listing)
    where, globs = str(tmp_path / "job"), [f"{tmp_path}/procs/*"]
    run = {"folder": where, "found": found}
    job.start(spark, rules, processes=globs, once=True, **run).awaitTermination(120)
    first = requests(spark, where)
    assert sorted(body for _, body in first) == ["", "A one\n more", "ERROR pod", "INFO line", "from a process"]
    by_body = {body: resource for resource, body in first}
    assert by_body["from a process"]["process.name"] == "shop" and by_body["from a process"]["process.pid"] == "9"
    assert by_body["from a process"]["process.command_line"] == "" and by_body["from a process"]["team"] == "s"
    assert by_body["ERROR pod"]["k8s.pod.name"] == "web" and by_body["ERROR pod"]["log.source.type"] == "container"
    assert by_body["A one\n more"]["log.source.rule"] == "merged" and by_body["INFO line"]["log.source.rule"] == "plain"
    # The open record leaves with the drain, once, and what comes after it goes on from there.
    for _ in range(2):
        job.drain(spark, rules, **run)
    assert sorted(body for _, body in requests(spark, where))[1:3] == ["A one\n more", "A two\n tail"]
    append(tmp_path / "apps/m1.log", " late\nA three\nA four\n")
    job.start(spark, rules, processes=globs, once=True, **run).awaitTermination(120)
    bodies = sorted(body for _, body in requests(spark, where))
    assert bodies == ["", " late", "A one\n more", "A three", "A two\n tail", "ERROR pod", "INFO line", "from a process"]
    job.drain(spark, rules, **run)
    assert sorted(body for _, body in requests(spark, where)) == sorted([*bodies, "A four"])


def test_a_store_that_is_not_mounted_is_refused(spark):
    rule = FileRule(name="r", include=("/x/*.log",))
    with pytest.raises(ValueError, match="mounted"):
        job.start(spark, RuleSet(files=(rule,)), rule, folder="s3a://bucket/job")


def test_globs_are_tried_on_distinct_paths(spark):
    """A filter on what a glob says must not move below the step that makes the listing distinct."""
    rows = [("node1", f"/data/f/{n % 3}.log") for n in range(30)]
    listed = spark.createDataFrame(rows, "host string, path string").distinct()
    found = targets.file_targets(listed, [("file", (FileRule(name="all", include=("/data/?/*.log",)),))])
    assert found.count() == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "data" not in plan[plan.index("Aggregate"):]
