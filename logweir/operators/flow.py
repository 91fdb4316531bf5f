"""Token bucket flow control: wait (block), discard (drop) or off, and reports.

Whether and when a record passes depends on all records of its key before it.
Records are put in order once, in ranges that are even whatever the keys are
(``ranges``); a first pass turns the records that a range has of its first key
into one small step (``bucket``), the steps are followed range by range, and a
last pass decides every record from the bucket that its range starts with.
Passes stream through a range, so no task holds a range or a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.operators.bucket import (
    Held, Residues, Scale, fluid_after, fluid_block, joined, refuse, residue_after, steps_of, true_content, wait, waiting_block,
)
from logweir.operators.ranges import PART, PLACE, Run, in_order, runs
from logweir.rules import FlowControl
from logweir.session import staged

#: Columns of a bucket: parts as text, since they may need more than 64 bits, and the time of its last record.
_PARTS, _LAST = "parts", "last"
_EDGE = (
    (PART, pa.int32()), ("number", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("step", pa.list_(pa.string())),
    ("start", pa.list_(pa.string())), ("after", pa.string()),
)


@dataclass(frozen=True)
class Followed:
    """Decided records, and every bucket after its last one."""

    records: DataFrame
    buckets: DataFrame


def follow(
    arrivals: DataFrame,
    keys: Sequence[str],
    options: FlowControl,
    *,
    ts: str = "ts",
    order: Sequence[str] = ("ts", "seq"),
    entry: DataFrame | None = None,
    parts: int | None = None,
    with_buckets: bool = False,
) -> Followed:
    """Add ``admitted`` and ``admit_us`` to arrivals, in ``order`` within each key.

    ``entry`` has buckets of a call before (``keys, parts, last``): they are
    where the keys start, and a record older than a bucket's last one counts
    as equally old.  Keys without a bucket start with a full one.  ``order``
    must tell the records of a key apart; a record without a time counts as of
    the year 1970.  Arrivals are written to the shared folder: pass narrow
    ones.  With ``with_buckets`` the decisions are written too.
    """
    scale, waits, keys = Scale(options.rate_per_second, options.burst), options.mode == "block", list(keys)
    rows = arrivals.withColumn("_us", F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(0).cast("long")))
    columns = [name for name in order if name not in keys]
    if entry is not None:
        known = entry.select(*[F.col(name).alias(f"_k{at}") for at, name in enumerate(keys)], F.col(_PARTS).alias("_parts"), F.col(_LAST).alias("_last"))
        same = [F.col(name).eqNullSafe(F.col(f"_k{at}")) for at, name in enumerate(keys)]
        rows = rows.join(known, same, "left").drop(*[f"_k{at}" for at in range(len(keys))])
    else:
        rows = rows.withColumns({"_parts": F.lit(None).cast("string"), "_last": F.lit(None).cast("long")})
    ordered = in_order(rows, [*keys, *(columns or ["_us"])], parts=parts).withColumn("_us", F.greatest("_us", "_last"))
    entries = _entries(ordered, keys, scale, waits)
    marked = _marked(ordered, keys, scale, waits, entries, with_buckets)
    if with_buckets:
        marked = staged(marked, "decided")
    decided = marked.where("not _bucket").select(*arrivals.columns, "admitted", "admit_us")
    last = F.max_by(F.struct("_parts", "_last"), PART).alias("_held")
    after = marked.where("_bucket").groupBy(*keys).agg(last)
    buckets = after.select(*keys, F.col("_held._parts").alias(_PARTS), F.col("_held._last").alias(_LAST))
    return Followed(decided, buckets)


def _start(batch: pa.RecordBatch, row: int) -> Held | None:
    """The stored bucket of the key of a row."""
    parts = batch.column("_parts")[row].as_py()
    return None if parts is None else Held(int(parts), batch.column("_last")[row].as_py())


def _marked(
    ordered: DataFrame, keys: Sequence[str], scale: Scale, waits: bool, entries: dict[int, Held], with_buckets: bool
) -> DataFrame:
    """Every row decided; ``_bucket`` rows tell what a range leaves of a key."""
    added = [
        T.StructField("admitted", T.BooleanType()), T.StructField("admit_us", T.LongType()),
        T.StructField("_bucket", T.BooleanType()),
    ]
    schema = T.StructType([*ordered.schema.fields, *added])
    names = schema.fieldNames()

    def left(run, held: Held, types: pa.Schema) -> pa.RecordBatch:
        known = {PART: run.part, "_parts": str(held.parts), "_last": held.last, **dict(zip(keys, run.key))}
        values = [pa.array([known.get(name)], types.field(name).type) for name in types.names]
        flags = [pa.array([None], pa.bool_()), pa.array([None], pa.int64()), pa.array([True])]
        return pa.RecordBatch.from_arrays([*values, *flags], names=names)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_run, types, begun = None, None, None, set()
        for batch, found in runs(batches, keys):
            types, times = batch.schema, batch.column("_us").to_numpy()
            admitted, leaves, done = [], [], []
            for run in found:
                if run.begins:
                    if open_run is not None:
                        done.append(left(open_run, held, types))
                    held = entries.get(run.part) if run.part not in begun else None
                    held = held or _start(batch, run.low)
                    begun.add(run.part)
                open_run, at = run, times[run.low : run.high]
                if waits:
                    leave, held = wait(at, held, scale)
                    admitted.append(np.ones(len(at), bool))
                    leaves.append(leave)
                else:
                    flags, held = refuse(at, held, scale)
                    admitted.append(flags)
                    leaves.append(at)
            flags = [pa.array(np.concatenate(admitted)), pa.array(np.concatenate(leaves)), pa.array(np.zeros(len(times), bool))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *flags], names=names)
            if with_buckets:
                yield from done
        if with_buckets and open_run is not None:
            yield left(open_run, held, types)

    return ordered.mapInArrow(mark, schema)


# ---------------------------------------------------------------- from range to range


@dataclass(frozen=True)
class _Edge:
    """The first or last run of a range: its times, stored bucket, step, and its bucket if it began here."""

    part: int
    number: int
    key: tuple
    begin: int
    end: int
    start: Held | None
    step: tuple[int, ...]
    after: int


class _Surveyed:
    """A run of one key in a range, taken up piece by piece."""

    def __init__(self, run: Run, number: int, begin: int, start: Held | None):
        self.run, self.number, self.begin, self.end = run, number, begin, begin
        self.start, self.held, self.step = start, start, None

    def add(self, times: np.ndarray, scale: Scale, waits: bool) -> None:
        if waits:
            block = waiting_block(times, scale)
            self.step = block if self.step is None else (self.step[0] + block[0], max(self.step[1] + block[0], block[1]))
        else:
            block = fluid_block(steps_of(times, self.end, scale), scale)
            self.step = block if self.step is None else joined(self.step, block, scale)
            _, self.held = refuse(times, self.held, scale)
        self.end = int(times[-1])

    def row(self, keys: Sequence[str]) -> dict[str, object]:
        return {
            **dict(zip(keys, self.run.key)), PART: self.run.part, "number": self.number, "begin": self.begin,
            "end": self.end, "step": [str(value) for value in self.step],
            "start": None if self.start is None else [str(self.start.parts), str(self.start.last)],
            "after": str(self.held.parts) if self.held else None,
        }


def _entries(ordered: DataFrame, keys: Sequence[str], scale: Scale, waits: bool) -> dict[int, Held]:
    """The bucket that each range goes on with where its first key began in an earlier one.

    One or two small rows per range come to the driver, whatever the number of
    records and keys.
    """
    edges = _edges(ordered, keys, scale, waits)
    goes_on = {edge.part: before for before, edge in zip(edges, edges[1:]) if before.part != edge.part and before.key == edge.key}
    if waits:
        out, parts = {}, {}
        for edge in edges:
            before = goes_on.get(edge.part) if edge.part not in parts else None
            held = out.setdefault(edge.part, parts[before.part]) if before else edge.start
            empty = edge.begin * scale.gain - scale.full if held is None else held.last * scale.gain - held.parts
            empty = max(empty + edge.step[0], edge.step[1])
            parts[edge.part] = Held(edge.end * scale.gain - empty, edge.end)
        return out
    if not goes_on:
        return {}
    return _true_entries(ordered, keys, scale, edges, goes_on)


def _edges(ordered: DataFrame, keys: Sequence[str], scale: Scale, waits: bool) -> list[_Edge]:
    """First and last run of every range, in order."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, types = None, None
        for batch, found in runs(batches, keys):
            types = types or pa.schema([*[batch.schema.field(name) for name in keys], *[pa.field(*field) for field in _EDGE]])
            times = batch.column("_us").to_numpy()
            for nth, run in enumerate(found):
                inside = False
                if run.begins:
                    fresh = current is None or current.run.part != run.part
                    if current is not None and (current.number == 0 or fresh):
                        yield pa.RecordBatch.from_pylist([current.row(keys)], schema=types)
                    current = _Surveyed(run, 0 if fresh else 1, int(times[run.low]), _start(batch, run.low))
                    # Runs between the first and the last one of a range concern no other range.
                    inside = not fresh and nth + 1 < len(found) and found[nth + 1].part == run.part
                if not inside:
                    current.add(times[run.low : run.high], scale, waits)
        if current is not None:
            yield pa.RecordBatch.from_pylist([current.row(keys)], schema=types)

    fields = [ordered.schema[name] for name in keys]
    texts = T.ArrayType(T.StringType())
    schema = T.StructType(
        [
            *fields, T.StructField(PART, T.IntegerType()), T.StructField("number", T.IntegerType()),
            T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()),
            T.StructField("step", texts), T.StructField("start", texts), T.StructField("after", T.StringType()),
        ]
    )
    found = ordered.select(*keys, PART, PLACE, "_us", "_parts", "_last").mapInArrow(survey, schema)
    out = []
    for row in sorted(found.collect(), key=lambda row: (row[PART], row["number"])):
        start = None if row["start"] is None else Held(int(row["start"][0]), int(row["start"][1]))
        after = 0 if row["after"] is None else int(row["after"])
        out.append(
            _Edge(row[PART], row["number"], tuple(row[name] for name in keys), row["begin"], row["end"], start, tuple(map(int, row["step"])), after)
        )
    return out


def _true_entries(
    ordered: DataFrame, keys: Sequence[str], scale: Scale, edges: list[_Edge], goes_on: dict[int, _Edge]
) -> dict[int, Held]:
    """In drop mode: the fluid bucket range by range, then the residues it leaves open."""
    first = {}
    fluid_in, fluid_out = {}, {}
    for edge in edges:
        if edge.part not in first:
            first[edge.part] = edge
            before = goes_on.get(edge.part)
        else:
            before = None
        if before is not None:
            entry = Held(fluid_out[before.part], before.end).at(edge.begin, scale)
            fluid_in[edge.part] = entry
        else:
            entry = scale.full if edge.start is None else edge.start.at(edge.begin, scale)
        fluid_out[edge.part] = fluid_after(entry, edge.step)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        step, open_part, before, done = None, None, 0, set()

        def row() -> pa.RecordBatch:
            found = step.step()
            text = {name: None if found[name] is None else str(found[name]) for name in ("after", "clock")}
            lists = {name: [None if value is None else str(value) for value in found[name]] for name in ("edges", "ends")}
            return pa.RecordBatch.from_pylist([{PART: open_part, **text, **lists}], schema=types)

        types = pa.schema(
            [(PART, pa.int32()), ("after", pa.string()), ("clock", pa.string()), ("edges", pa.list_(pa.string())), ("ends", pa.list_(pa.string()))]
        )
        for batch, found in runs(batches, keys):
            times = batch.column("_us").to_numpy()
            for run in found:
                if run.begins:
                    if step is not None:
                        yield row()
                    step = None
                    if run.part in fluid_in and run.part not in done:
                        step, open_part, before = Residues(fluid_in[run.part], scale), run.part, int(times[run.low])
                    done.add(run.part)
                if step is not None:
                    step.add(steps_of(times[run.low : run.high], before, scale))
                    before = int(times[run.high - 1])
        if step is not None:
            yield row()

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after: dict[int, int] = {}
        for frame in frames:
            for found in frame.to_dict("records"):
                part = found[PART]
                edge, before = first[part], goes_on[part]
                # What the range before leaves: of a run that began there, or of the one followed here just now.
                parts = after[before.part] if before.number == 0 and before.part in after else before.after
                content = Held(parts, before.end).at(edge.begin, scale)
                yield pd.DataFrame({PART: [part], "parts": [str(parts)], "last": [before.end]})
                residue = content % scale.unit
                if found["after"] is not None:
                    residue = int(found["after"])
                else:
                    ends = [None if value is None else int(value) for value in found["ends"]]
                    residue = residue_after(residue, [int(value) for value in found["edges"]], ends, int(found["clock"]), scale)
                after[part] = true_content(fluid_after(fluid_in[part], edge.step), residue, scale.unit)

    texts = "after string, clock string, edges array<string>, ends array<string>"
    steps = ordered.select(*keys, PART, PLACE, "_us").mapInArrow(residues, f"{PART} int, {texts}")
    # One row per range, and a step follows the one before: a single task of small rows.
    chained = steps.repartition(1).sortWithinPartitions(PART).mapInPandas(chain, f"{PART} int, parts string, last long")
    return {row[PART]: Held(int(row["parts"]), row["last"]) for row in chained.collect()}


# ---------------------------------------------------------------- modes


def _decided(
    arrivals: DataFrame, keys: Sequence[str], options: FlowControl, ts: str, order: Sequence[str], parts: int | None
) -> DataFrame:
    """Decisions for arrivals of any width: only keys, time and order go through the passes."""
    narrow = list(dict.fromkeys([*keys, ts, *order]))
    if set(narrow) == set(arrivals.columns):
        return follow(arrivals, keys, options, ts=ts, order=order, parts=parts).records
    found = follow(arrivals.select(*narrow), keys, options, ts=ts, order=order, parts=parts).records
    place = list(dict.fromkeys([*keys, *order]))
    named = found.select(*[F.col(name).alias(f"_o{at}") for at, name in enumerate(place)], "admitted", "admit_us")
    same = [F.col(name).eqNullSafe(F.col(f"_o{at}")) for at, name in enumerate(place)]
    return arrivals.join(named, same).drop(*[f"_o{at}" for at in range(len(place))])


def admit_times(
    arrivals: DataFrame,
    keys: Sequence[str],
    *,
    rate: float,
    burst: int,
    ts: str = "ts",
    order: Sequence[str] = ("ts", "seq"),
    parts: int | None = None,
) -> DataFrame:
    """Add ``admit_ts``: when a token is there for the record; nothing is lost."""
    options = FlowControl(enabled=True, mode="block", rate_per_second=rate, burst=burst)
    found = _decided(arrivals, keys, options, ts, order, parts)
    return found.select(*arrivals.columns, F.timestamp_micros("admit_us").alias("admit_ts"))


def mark_admitted(
    arrivals: DataFrame,
    keys: Sequence[str],
    *,
    rate: float,
    burst: int,
    ts: str = "ts",
    order: Sequence[str] = ("ts", "seq"),
    parts: int | None = None,
) -> DataFrame:
    """Add ``admitted``: whether a whole token was there when the record came."""
    options = FlowControl(enabled=True, mode="drop", rate_per_second=rate, burst=burst)
    return _decided(arrivals, keys, options, ts, order, parts).select(*arrivals.columns, "admitted")


# ---------------------------------------------------------------- switch, report


def control(
    arrivals: DataFrame,
    keys: Sequence[str],
    options: FlowControl,
    *,
    ts: str = "ts",
    order: Sequence[str] = ("ts", "seq"),
    parts: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Records that go on, with ``admit_ts``, and those dropped (drop mode only)."""
    if not options.enabled:
        return arrivals.withColumn("admit_ts", F.col(ts).cast("timestamp")), None
    settings = {"rate": options.rate_per_second, "burst": options.burst, "ts": ts, "order": order, "parts": parts}
    if options.mode == "block":
        return admit_times(arrivals, keys, **settings), None
    marked = mark_admitted(arrivals, keys, **settings)
    passed = marked.where("admitted").withColumn("admit_ts", F.col(ts).cast("timestamp"))
    return passed.drop("admitted"), marked.where("not admitted").drop("admitted")


def drop_report(dropped: DataFrame, *, interval: str, ts: str = "ts", count: Column | None = None) -> DataFrame:
    """Dropped records per fixed interval of event time."""
    return (
        dropped.groupBy(F.window(F.col(ts), interval).alias("_window"))
        .agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("dropped"))
        .select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), "dropped")
    )
