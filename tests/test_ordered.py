"""Order-dependent operators against step-by-step models on random input."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.operators import lines as L
from logweir.operators.cut import greedy_cut
from logweir.operators.bucket import Bucket, Held, Residues, Scale, fluid_after, fluid_block, refuse, residue_after, steps_of, wait
from logweir.operators.flow import admit_times, control, drop_report, follow, mark_admitted
from logweir.operators.multiline import boundary_groups, merge_lines
from logweir.operators.ordered import running
from logweir.operators.outbox import schedule
from logweir.rules import FlowControl, Retry
from logweir.sources.text_lines import scan_lines


def test_running_totals_do_not_depend_on_blocks(spark):
    rng = random.Random(1)
    rows = [(key, n, rng.randint(0, 9), rng.choice([None, rng.randint(0, 99)])) for key in "ab" for n in range(200)]
    frame = spark.createDataFrame(rows, "k string, n long, v long, m long")
    for exclusive in (False, True):
        spec = {"sums": {"s": F.col("v")}, "maxes": {"x": F.col("m")}, "exclusive": exclusive}
        plain = running(frame, ["k"], ["n"], **spec)
        cut = running(frame, ["k"], ["n"], block=F.floor(F.col("n") / 7), **spec)
        assert sorted(plain.collect()) == sorted(cut.select(plain.columns).collect())


# ------------------------------------------------------------- greedy cut


def model_cut(items, max_rows, max_bytes):
    """Segment start of each (size, empty, boundary) item, one after the other."""
    out, start, rows, used, text = [], 0, 0, 0, False
    for at, (size, empty, boundary) in enumerate(items):
        if text and (boundary or rows >= max_rows or used + size > max_bytes):
            start, rows, used, text = at, 0, 0, False
        rows += 1
        if text or not empty:
            used, text = used + size, True
        out.append(start)
    return out


def test_blocks_stay_whole_when_their_join_turns_into_a_broadcast(spark):
    """Long sequences whose join with the entry states is planned by shuffles and found small when it runs."""
    sizes = {key: [(7 * n + key) % 13 + 1 for n in range(300)] for key in range(5)}
    rows = [(key, n, size) for key, items in sizes.items() for n, size in enumerate(items)]
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        frame = spark.createDataFrame(rows, "k long, n long, size long").repartition(7, "n")
        cuts = greedy_cut(frame, ["k"], pos="n", size=F.col("size"), max_rows=4, max_bytes=25, block_rows=16).collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert len(cuts) == len(rows)
    for key, items in sizes.items():
        expected = model_cut([(size, False, False) for size in items], 4, 25)
        assert [row.segment for row in sorted(cuts, key=lambda row: row.n) if row.k == key] == expected


@pytest.mark.parametrize("seed", range(2))
def test_greedy_cut_equals_the_step_model(spark, seed):
    rng = random.Random(seed)
    max_rows, max_bytes = rng.randint(1, 6), rng.randint(4, 40)
    groups = {}
    for key in range(25):
        bare = rng.choice([0.0, 0.3, 0.9, 1.0])
        edges = rng.choice([0.0, 0.2, 0.6])
        items = []
        for _ in range(rng.choice([1, 5, 40, 170])):
            empty = rng.random() < bare
            items.append((1 if empty else rng.randint(1, 14), empty, rng.random() < edges))
        groups[key] = items
    rows = [(key, pos, *item) for key, items in groups.items() for pos, item in enumerate(items)]
    frame = spark.createDataFrame(rows, "k int, pos long, size long, bare boolean, edge boolean").repartition(5)
    for block_rows in (1, 8, 1000):
        found = greedy_cut(
            frame, ["k"], pos="pos", size=F.col("size"), max_rows=max_rows, max_bytes=max_bytes,
            empty=F.col("bare"), boundary=F.col("edge"), block_rows=block_rows,
        ).collect()
        assert len(found) == len(rows)
        by_key = {}
        for row in sorted(found):
            by_key.setdefault(row.k, []).append(row.segment)
        for key, items in groups.items():
            assert by_key[key] == model_cut(items, max_rows, max_bytes), (key, block_rows, max_rows, max_bytes, items)


# ------------------------------------------------------------- multi-line


def model_merge(lines, is_start, max_size, max_lines):
    """(first line with text, body) of each record: from each first text the longest stretch that may be one record."""
    lines = [line if len(line.encode()) <= max_size else line[:max_size] for line in lines]
    texts = [number for number, line in enumerate(lines) if line]
    out, begin = [], 0
    while any(number >= begin for number in texts):
        first = min(number for number in texts if number >= begin)

        def fits(end):
            inner = lines[first + 1 : end]
            skipped = first - begin
            size = sum(len(line.encode()) + 1 for line in lines[first:end]) - 1
            # Blank lines before the first text count as lines but have no bytes.
            return not any(map(is_start, inner)) and size <= max_size and skipped + end - first <= max_lines

        end = first + 1
        while end < len(lines) and fits(end + 1):
            end += 1
        out.append((first, "\n".join(lines[first:end])))
        begin = end
    return out


@pytest.mark.parametrize("seed, blocks", [(0, None), (1, 5), (2, 3)])
def test_merge_equals_the_step_model(spark, seed, blocks):
    rng = random.Random(seed)
    files = {}
    for key in range(30):
        count = rng.choice([1, 4, 30, 90])
        starts = rng.choice([0.0, 0.1, 0.5])
        files[f"f{key}"] = [
            rng.choice(["", "", "x", "yy é", "z" * rng.randint(1, 30)]) if rng.random() > starts else rng.choice(["A go", "A"])
            for _ in range(count)
        ]
    rows = [(key, number, line, number) for key, lines in files.items() for number, line in enumerate(lines)]
    frame = spark.createDataFrame(rows, "file_key string, line_no long, line string, mark long").repartition(5)
    max_size, max_lines = 25, 6
    found = merge_lines(
        frame, "^A", max_size=max_size, max_lines=max_lines, first=["mark"],
        block=None if blocks is None else F.floor(F.col("line_no") / blocks), block_rows=8,
    ).collect()
    got = sorted((row.file_key, row.first_line, row.mark, row.body) for row in found)
    expected = sorted(
        (key, first, first, body)
        for key, lines in files.items()
        for first, body in model_merge(lines, lambda line: line.startswith("A"), max_size, max_lines)
    )
    assert got == expected
    assert all(row.lines == row.body.count("\n") + 1 for row in found)


START = r"^(?:\[[a-z-]+\] )?(?:\d{1,2}\.\d{1,2}\.\d{2} |[A-Z][a-z]{2} {1,2}\d{1,2} |#)\d+"


def test_indented_dumps_merge_for_all_line_heads(spark):
    rest = ["  cause: crate 17 too heavy", "    | scale 3, lane B", "    | 412 kg of 400 kg"]
    heads = [("3.11.31 0742", "3.11.31 0743"), ("Nov  3 0742", "Nov  3 0801"), ("#17", "#18"), ("[lane-b] #17", "[lane-c] #2"), ("[x] 03.11.31 1", "#4")]
    rows, expected = [], []
    for key, (first, second) in enumerate(heads):
        lines = [first + " WARN scale halted", *rest, second + " INFO scale runs"]
        rows += [(str(key), number, line) for number, line in enumerate(lines)]
        expected += [(str(key), 0, "\n".join(lines[:4])), (str(key), 4, lines[4])]
    frame = spark.createDataFrame(rows, "file_key string, line_no long, line string")
    found = merge_lines(frame, START).collect()
    assert sorted((r.file_key, r.first_line, r.body) for r in found) == sorted(expected)


def test_boundary_groups(spark):
    rows = [("f", number, line) for number, line in enumerate(["x", "A1", "y", "A2", "A3"])]
    frame = spark.createDataFrame(rows, "file_key string, line_no long, line string")
    for block in (None, F.floor(F.col("line_no") / 2)):
        found = boundary_groups(frame, "^A", block=block).orderBy("line_no").collect()
        assert [row.group for row in found] == [0, 1, 1, 2, 3]


# ------------------------------------------------------------- offsets, caps


def test_offsets_tails_and_round_cap(spark):
    texts = {"a": "one\ntwo é\n\nlast", "b": "x\ny\n", "c": "", "d": "\n"}
    rows = [
        (key, number // 2, number, len(value.encode()), line)
        for key, value in texts.items()
        for number, line in enumerate(value.split("\n") if not value.endswith("\n") else value.split("\n")[:-1])
        if value
    ]
    frame = spark.createDataFrame(rows, "file_key string, block_start long, row_id long, file_size long, line string")
    placed = L.with_offsets(frame, block=F.col("block_start"))
    plain = L.with_offsets(frame)
    assert sorted(placed.select(plain.columns).collect()) == sorted(plain.collect())
    complete = sorted((r.file_key, r.line_no, r.start_offset, r.end_offset, r.line) for r in L.complete_lines(placed).collect())
    assert complete == [
        ("a", 0, 0, 4, "one"), ("a", 1, 4, 11, "two é"), ("a", 2, 11, 12, ""),
        ("b", 0, 0, 2, "x"), ("b", 1, 2, 4, "y"), ("d", 0, 0, 1, ""),
    ]
    quick = sorted((r.file_key, r.line) for r in L.drop_incomplete_tail(frame).collect())
    assert quick == sorted((key, line) for key, _, _, _, line in complete)
    capped = sorted((r.file_key, r.line_no) for r in L.cap_round(placed, max_bytes=5).collect())
    assert capped == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("d", 0)]


def test_scan_offsets_move_no_text(spark, tmp_path):
    """Splits of several files in few tasks: the places of whole files, and no exchange of lines."""
    rng = random.Random(3)
    texts = {f"f{n}.log": "".join("x" * rng.randint(0, 30) + rng.choice(["", "é\r"]) + "\n" for _ in range(rng.choice([0, 1, 700]))) + rng.choice(["", "open"]) for n in range(7)}
    for name, value in texts.items():
        (tmp_path / name).write_bytes(value.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        scanned = scan_lines(spark, [f"{tmp_path}/*.log"])
        found = L.with_scan_offsets(scanned)
        got = sorted((os.path.basename(r.path), r.line_no, r.start_offset, r.end_offset, r.line) for r in found.collect())
        plain = L.with_offsets(scanned, block=F.col("block_start"))
        assert got == sorted((os.path.basename(r.path), r.line_no, r.start_offset, r.end_offset, r.line) for r in plain.collect())
        assert scanned.select("file_key", "block_start").distinct().count() > 10
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line and "line#" in line]
        assert "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expected = []
    for name, value in texts.items():
        at = 0
        pieces = value.encode().split(b"\n")
        for number, piece in enumerate(pieces[:-1] if not pieces[-1] else pieces):
            expected.append((name, number, at, at + len(piece) + 1, piece.decode()))
            at += len(piece) + 1
    assert got == sorted(expected)


# ------------------------------------------------------------- flow control


def arrivals(spark, seed, gaps, count=240, keys=4):
    rng = random.Random(seed)
    rows = []
    for key in range(keys):
        at = 1_700_000_000_000_000
        for seq in range(count):
            at += rng.choice(gaps)
            rows.append((key, seq, at))
    frame = spark.createDataFrame(rows, "key int, seq long, at long").repartition(5)
    return rows, frame.withColumn("ts", F.timestamp_micros("at"))


GAPS = {
    "busy": [0, 1_000, 30_000],
    "near": [80_000, 100_000, 120_000, 100_001],
    "mixed": [0, 10_000, 100_000, 250_000, 3_000_000],
}


def step_by_step(rows, rate, burst, waits, held=None):
    """Who passes and when, one record after the other, and the buckets after them."""
    scale = Scale(rate, burst)
    parts = {key: value[0] for key, value in (held or {}).items()}
    last = {key: value[1] for key, value in (held or {}).items()}
    out = {}
    for key, seq, at in rows:
        now = max(at, last.get(key, at))
        have = min(scale.full, parts.get(key, scale.full) + (now - last.get(key, now)) * scale.gain)
        passes = waits or have >= scale.unit
        have -= scale.unit if passes else 0
        out[key, seq] = (passes, now + max(0, -(have // scale.gain)) if waits else now)
        parts[key], last[key] = have, now
    return out, {key: (parts[key], last[key]) for key in parts}


KINDS = [("busy", 10, 1), ("busy", 9.7, 5), ("near", 10, 3), ("near", 9.7, 1), ("mixed", 10, 3), ("mixed", 0.001, 1), ("mixed", 5000, 2)]


@pytest.mark.parametrize("kind, rate, burst", KINDS)
@pytest.mark.parametrize("mode", ["drop", "block"])
def test_flow_equals_the_step_model(spark, kind, rate, burst, mode):
    rows, frame = arrivals(spark, burst, GAPS[kind])
    expected, _ = step_by_step(rows, rate, burst, mode == "block")
    # Ranges longer and shorter than a key, and a single one.
    for parts in (1, 3, 40):
        options = FlowControl(enabled=True, mode=mode, rate_per_second=rate, burst=burst)
        found = follow(frame, ["key"], options, parts=parts).records.collect()
        assert {(r.key, r.seq): (r.admitted, r.admit_us) for r in found} == expected


def test_one_key_and_one_hour(spark):
    """A bucket of one token and a single key: nothing but ranges can split the work."""
    rng = random.Random(9)
    rows, at = [], 1_700_000_000_000_000
    for seq in range(6000):
        at += rng.choice([0, 1, 500_000, 700_000])
        rows.append(("all", seq, at))
    frame = spark.createDataFrame(rows, "key string, seq long, at long").withColumn("ts", F.timestamp_micros("at"))
    for mode in ("drop", "block"):
        expected, buckets = step_by_step(rows, 3, 1, mode == "block")
        options = FlowControl(enabled=True, mode=mode, rate_per_second=3, burst=1)
        found = follow(frame, ["key"], options, parts=16, with_buckets=True)
        assert {(r.key, r.seq): (r.admitted, r.admit_us) for r in found.records.collect()} == expected
        assert {r.key: (int(r.parts), r.last) for r in found.buckets.collect()} == buckets


@pytest.mark.parametrize("mode", ["drop", "block"])
def test_flow_goes_on_from_stored_buckets(spark, mode):
    """Batches one after the other decide like one sequence; late records count as equally old."""
    rng = random.Random(4)
    options = FlowControl(enabled=True, mode=mode, rate_per_second=10, burst=3)
    held, entry = {}, None
    for batch in range(3):
        rows = []
        for key in range(5 if batch else 3):
            at = 1_700_000_000_000_000 + batch * 3_000_000 - rng.choice([0, 2_000_000])
            for seq in range(rng.choice([1, 60, 200])):
                at += rng.choice(GAPS["mixed"])
                rows.append((key, batch * 1000 + seq, at))
        expected, held_now = step_by_step(rows, 10, 3, mode == "block", held)
        frame = spark.createDataFrame(rows, "key int, seq long, at long").withColumn("ts", F.timestamp_micros("at"))
        found = follow(frame, ["key"], options, entry=entry, parts=7, with_buckets=True)
        assert {(r.key, r.seq): (r.admitted, r.admit_us) for r in found.records.collect()} == expected
        got = {r.key: (int(r.parts), r.last) for r in found.buckets.collect()}
        assert got == {key: value for key, value in held_now.items() if key in got}
        held = held_now
        entry = spark.createDataFrame([(key, str(parts), last) for key, (parts, last) in held.items()], "key int, parts string, last long")


def test_wide_arrivals_are_decided_by_their_place(spark):
    rows, frame = arrivals(spark, 2, GAPS["mixed"], count=50)
    wide = frame.withColumns({"body": F.lit("x"), "key": F.when(F.col("key") > 0, F.col("key"))})
    found = mark_admitted(wide, ["key"], rate=10, burst=2)
    assert found.columns == [*wide.columns, "admitted"] and found.count() == len(rows)
    late = admit_times(wide, ["key"], rate=10, burst=2)
    assert late.where("admit_ts is null").count() == 0 and late.count() == len(rows)


def test_flow_of_nothing(spark):
    frame = spark.createDataFrame([], "key int, seq long, ts timestamp")
    options = FlowControl(enabled=True, mode="drop", rate_per_second=1, burst=1)
    found = follow(frame, ["key"], options, with_buckets=True)
    assert found.records.collect() == [] and found.buckets.collect() == []


@pytest.mark.parametrize("rate, burst", [(10, 1), (9.7, 5), (0.00002, 3), (50_000, 4), (123_456.789, 1000)])
def test_blocks_of_arrivals_equal_the_bucket(rate, burst):
    """Whole arrays against one record at a time, also where numbers outgrow 64 bits."""
    rng = random.Random(burst)
    scale = Scale(rate, burst)
    token = max(1, scale.unit // scale.gain)
    for _ in range(40):
        at, times = 1_700_000_000_000_000, []
        for _ in range(rng.choice([1, 47, 48, 200, 1000])):
            at += rng.choice([0, 1, token, token + 1, token // 2, 3 * token])
            times.append(at)
        for waits, step in ((False, refuse), (True, wait)):
            start = rng.choice([None, (rng.randrange(scale.full), times[0] - rng.choice([0, token]))])
            expected, after = step_by_step([(0, n, t) for n, t in enumerate(times)], rate, burst, waits, {0: start} if start else None)
            got, held = step(np.array(times), Held(*start) if start else None, scale)
            assert got.tolist() == [value[waits] for value in expected.values()]
            assert (held.parts, held.last) == after[0]


@pytest.mark.parametrize("burst", [1, 2, 5])
def test_block_steps_equal_the_bucket(burst):
    """From every content a block leaves the residue that its step says, in a list that stays short."""
    rng = random.Random(burst)
    scale = Scale(50_000, burst)  # twenty parts per token, one per microsecond
    longest = 0
    for _ in range(300):
        waits = [rng.choice([1, 3, 19, 20, 21, 40]) for _ in range(rng.randint(1, 400))]
        fluid = rng.randrange(0, scale.full - scale.unit + 1, scale.gain)
        times = np.cumsum(waits)
        run = Residues(fluid, scale)
        for low in range(0, len(waits), 150):
            run.add(steps_of(times[low : low + 150], int(times[low - 1]) if low else 0, scale))
        block = run.step()
        assert run.fluid == fluid_after(fluid, fluid_block(steps_of(times, 0, scale), scale))
        longest = max(longest, len(block["edges"]))
        for residue in range(0, scale.unit, scale.gain):
            bucket = Bucket(scale, fluid + (residue - fluid) % scale.unit)
            for wait_us in waits:
                bucket.take(wait_us)
            after = block["after"]
            if after is None:
                after = residue_after(residue, block["edges"], block["ends"], block["clock"], scale)
            assert bucket.parts % scale.unit == after
    assert longest <= 2 * scale.unit // scale.gain


def test_switch_and_report(spark):
    _, frame = arrivals(spark, 3, GAPS["busy"], count=10, keys=1)
    passed, dropped = control(frame, ["key"], FlowControl(enabled=False))
    assert passed.count() == 10 and dropped is None
    passed, dropped = control(frame, ["key"], FlowControl(enabled=True, mode="block", rate_per_second=1, burst=1))
    assert passed.count() == 10 and dropped is None
    passed, dropped = control(frame, ["key"], FlowControl(enabled=True, mode="drop", rate_per_second=0.001, burst=1))
    assert passed.count() == 1 and dropped.count() == 9
    assert drop_report(dropped, interval="10 seconds").agg(F.sum("dropped")).first()[0] == 9


# ------------------------------------------------------------- outbox


def model_schedule(attempts, retry_on, initial, longest, limit):
    """(attempts, outcome, wait) after the attempts of one batch, times in ms.

    Waits are written as a list first: the n-th is the initial wait doubled
    after each failure, or longer where an answer asked for more.
    """
    final = {number: "ok" for number, (_, status, _) in enumerate(attempts) if status in range(200, 300)}
    final |= {
        number: "permanent"
        for number, (_, status, _) in enumerate(attempts)
        if status is not None and status not in (408, 429, *range(200, 300)) and status < 500
    }
    waits = [initial]
    for _, status, asked in attempts:
        wait = max(waits.pop(), asked if status is not None else 0)
        waits += [wait, min(longest, 2 * wait)]
    for number, (at, _, _) in enumerate(attempts):
        if number not in final and (not retry_on or 0 < limit < at - attempts[0][0] + waits[number]):
            final[number] = "gave_up"
    if final:
        return min(final) + 1, final[min(final)], None
    return len(attempts), "retry_network" if attempts[-1][1] is None else "retry_status", waits[len(attempts) - 1]


@pytest.mark.parametrize("retry", [Retry(), Retry(max_elapsed_time="0s"), Retry(enabled=False), Retry(initial_interval="40s"), Retry(max_interval="1h", max_elapsed_time="2h")])
def test_schedule_equals_the_step_model(spark, retry):
    from logweir.rules import duration_ms

    rng = random.Random(5)
    rows, expected = [], {}
    for batch in range(60):
        at, attempts = 1_700_000_000_000, []
        for number in range(1, rng.choice([1, 3, 12, 40]) + 1):
            status = rng.choice([503, 503, 429, 500, None, 408] + ([200, 401, 302] if number > 3 else []))
            asked = rng.choice([0, 0, 0, 1_500, 45_000])
            attempts.append((at, status, asked))
            rows.append((batch, number, at, status, asked))
            at += rng.randint(500, 30_000)
        expected[batch] = model_schedule(
            attempts, retry.enabled, int(duration_ms(retry.initial_interval)), int(duration_ms(retry.max_interval)),
            int(duration_ms(retry.max_elapsed_time)),
        )
    frame = spark.createDataFrame(rows, "batch_id int, attempt int, at_ms long, status int, retry_after_ms long")
    found = schedule(frame.withColumn("at", F.timestamp_millis("at_ms")), retry).collect()
    assert {r.batch_id: (r.attempts, r.outcome, r.wait_ms) for r in found} == expected
