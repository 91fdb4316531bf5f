"""Keyed stream state: open multi-line records.

State per file is one open record, bounded by the multi-line limits: a few
numbers, and its text in parts that are only added to, so a micro-batch writes
the lines that are new and never the whole body.  Files are dealt over a fixed
number of shards, the keys of the state: a micro-batch handles the rows of a
shard at once, and each file costs a look at its record and the writes of what
changed.  Rows of a file are put in order inside a micro-batch, whose size per
file the tail source limits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logweir.functions.patterns import java_pattern
from logweir.operators.cut import first_cuts, next_cuts, reached

_RECORD = [
    T.StructField("first_line", T.LongType()),
    T.StructField("last_line", T.LongType()),
    T.StructField("lines", T.LongType()),
    T.StructField("body", T.StringType()),
]
#: The open segment: first and last line, room used, rows, whether it has text yet, when it leaves if nothing comes, and
#: how many parts its text has.
_OPEN = [
    T.StructField("first_line", T.LongType()), T.StructField("last_line", T.LongType()), T.StructField("used", T.LongType()),
    T.StructField("held", T.LongType()), T.StructField("has_text", T.BooleanType()), T.StructField("due", T.LongType()),
    T.StructField("parts", T.LongType()),
]
#: Shards of files.  State is kept by them, so a stream keeps the number it began with.
_SHARDS = 1024
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def record_schema(lines: DataFrame, first: Sequence[str]) -> T.StructType:
    return T.StructType([lines.schema["file_key"], *_RECORD, *[lines.schema[name] for name in first]])


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with lists and timers needs the state store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _shown(value):
    """A value of a frame, with null for what stands for none."""
    return None if value is None or value is pd.NaT or value != value else value


class MergeProcessor(StatefulProcessor):
    """Joins the lines of the files of a shard to records; see ``merge_stream``."""

    def __init__(self, schema: T.StructType, first: Sequence[str], max_size: int, max_lines: int):
        self.schema, self.first = schema, list(first)
        self.max_size, self.max_lines = max_size, max_lines

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        file_key, carried = self.schema["file_key"], [self.schema[name] for name in self.first]
        self.open = handle.getMapState("open", T.StructType([file_key]), T.StructType([*_OPEN, *carried]))
        self.text = handle.getMapState("text", T.StructType([file_key, T.StructField("part", T.LongType())]), "text string")

    def close(self) -> None:
        pass

    # ------------------------------------------------------------ records

    def _record(self, key: tuple, begun: int, ended: int, text: list[str], carried: Sequence) -> tuple:
        body = "\n".join(text)
        return (*key, begun, ended, body.count("\n") + 1, body, *carried)

    def _frame(self, records: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(records, columns=self.schema.fieldNames()).astype(object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        files = pd.factorize(frame["file_key"])[0]
        order = np.lexsort((frame["at"].to_numpy(), files))
        frame, files = frame.iloc[order], files[order]
        begins = np.flatnonzero(np.append(True, files[1:] != files[:-1]))
        ends = np.append(begins[1:], len(files))
        # Files without a start pattern: every line is a record, nothing is open.
        single = frame["alone"].to_numpy(bool)[begins]
        if single.any():
            yield self._lines(frame[np.repeat(single, ends - begins)])
        if single.all():
            return
        now, held_any = timerValues.getCurrentProcessingTimeInMs(), self.open.exists()
        flush = frame["flush_ms"].to_numpy(np.int64)
        at, line = frame["at"].to_numpy(), frame["line"].tolist()
        size, edge = frame["size"].to_numpy(np.int64) + 1, frame["edge"].to_numpy(bool)
        names = frame["file_key"].tolist()
        carried = [frame[name].tolist() for name in self.first]
        done, timers = [], set()
        for low, high, skip in zip(begins.tolist(), ends.tolist(), single.tolist()):
            if skip:
                continue
            part, file = slice(low, high), (_shown(names[low]),)
            due = now + int(flush[high - 1])
            timers.add(due)
            values = [column[part] for column in carried]
            held = self.open.getValue(file) if held_any else None
            done += self._cut(file, held, at[part], line[part], size[part], edge[part], values, due)
        for due in sorted(timers):
            self.handle.registerTimer(due)
        if done:
            yield self._frame(done)

    def _lines(self, frame: pd.DataFrame) -> pd.DataFrame:
        """Every line as a record."""
        found = {"first_line": frame["at"], "last_line": frame["at"], "lines": frame["line"].str.count("\n") + 1, "body": frame["line"]}
        columns = {name: found[name] if name in found else frame[name] for name in self.schema.fieldNames()}
        return pd.DataFrame({name: values.astype(object).where(values.notna(), None) for name, values in columns.items()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Files that got lines since are due later; their own timer follows.
        over = [(file, held) for file, held in self.open.iterator() if held[5] <= expiredTimerInfo.getExpiryTimeInMs()]
        done = [self._record(file, held[0], held[1], self._text(file, held), held[7:]) for file, held in over if held[4]]
        for file, held in over:
            self._drop_text(file, held, 0)
            self.open.removeKey(file)
        if done:
            yield self._frame(done)

    # ------------------------------------------------------------ state

    def _text(self, file: tuple, held: tuple) -> list[str]:
        return [self.text.getValue((*file, part))[0] for part in range(held[6])]

    def _drop_text(self, file: tuple, held: tuple, kept: int) -> None:
        for part in range(kept, held[6]):
            self.text.removeKey((*file, part))

    def _keep(self, file: tuple, numbers: tuple, due: int, parts: int, added: list[str], values: Sequence) -> None:
        """The open record as it is now, and what its text has in addition to so many parts."""
        if added:
            self.text.updateValue((*file, parts), ("\n".join(added),))
        self.open.updateValue(file, (*numbers, due, parts + bool(added), *values))

    def _cut(self, file: tuple, held: tuple | None, at, line: list[str], size, edge, carried: list[list], due: int) -> list[tuple]:
        """Records that end in these lines; what stays open goes to the state, to leave when ``due``."""
        empty = size == 1
        count, max_bytes = len(line), self.max_size + 1
        first_text, cuts = next_cuts(size, empty, edge, self.max_lines, max_bytes)
        begin = 0
        if held is not None and held[4]:
            # Room and rows are used already, and any start ends the open record.
            by_bytes = int(np.searchsorted(np.cumsum(size), max_bytes - held[2], side="right"))
            marks = np.flatnonzero(edge)
            begin = min(max(self.max_lines - held[3], 0), by_bytes, int(marks[0]) if len(marks) else count)
        elif held is not None:
            head = int(first_text[0])
            begin = count
            if head < count:
                rows = np.array([min(held[3], self.max_lines)])
                begin = int(first_cuts(size, edge, head, rows, self.max_lines, max_bytes)[0])
        begin = min(begin, count)
        marked = reached(np.array([begin] if begin < count else [], np.int64), cuts)
        edges = [begin, *(np.flatnonzero(marked[begin + 1 :]) + begin + 1).tolist(), count] if begin < count else [begin]

        def opened(low: int, high: int) -> tuple:
            """The segment of these rows: its numbers, its text and what it takes from its first line with text."""
            text_at = int(first_text[low]) if low < high else high
            has_text = text_at < high
            row = text_at if has_text else high - 1
            values = tuple(_shown(column[row]) for column in carried)
            used = int(size[text_at:high].sum()) if has_text else 0
            return (int(at[row]), int(at[high - 1]), used, high - low, has_text), line[text_at:high], values

        done, added = [], []
        if begin > 0 and held is not None:
            # The open segment goes on with the first rows.
            if held[4]:
                numbers = (held[0], int(at[begin - 1]), held[2] + int(size[:begin].sum()), held[3] + begin, True)
                added, values = line[:begin], held[7:]
            else:
                numbers, added, values = opened(0, begin)
                numbers = (*numbers[:3], held[3] + begin, numbers[4])
            if begin == count:
                self._keep(file, numbers, due, held[6], added, values)
                return done
            held = (*numbers, due, held[6], *values)
        if held is not None and held[4]:
            done.append(self._record(file, held[0], held[1], [*self._text(file, held), *added], held[7:]))
        for low, high in zip(edges, edges[1:]):
            numbers, text, values = opened(low, high)
            if high < count:
                done.append(self._record(file, numbers[0], numbers[1], text, values))
            else:
                if held is not None:
                    self._drop_text(file, held, 1 if text else 0)
                self._keep(file, numbers, due, 0, text, values)
        return done


def merge_stream(
    lines: DataFrame,
    start_pattern: str | Column,
    *,
    order: str = "start_offset",
    max_size: int = 4 * 1024 * 1024,
    max_lines: int = 1000,
    flush_after_ms: int | Column = 5_000,
    first: Sequence[str] = (),
    alone: Column | None = None,
) -> DataFrame:
    """Streaming form of ``multiline.merge_lines`` with one open record per file.

    A record is emitted when the next one starts, at a limit, or when no line
    came for ``flush_after_ms``.  Start and wait may differ by file as columns;
    files that are ``alone`` have a record per line.  Columns in ``first`` must
    be of plain types.
    """
    use_state_store(lines.sparkSession)
    kept = F.when(F.octet_length("line") > max_size, F.substring("line", 1, max_size)).otherwise(F.col("line"))
    edge = F.rlike("line", F.lit(java_pattern(start_pattern))) if isinstance(start_pattern, str) else start_pattern
    flush = F.lit(flush_after_ms) if isinstance(flush_after_ms, int) else flush_after_ms
    source = lines.withColumn("line", kept).select(
        "file_key",
        F.col(order).alias("at"),
        "line",
        F.octet_length("line").cast("long").alias("size"),
        F.coalesce(edge, F.lit(False)).alias("edge"),
        F.coalesce(flush.cast("long"), F.lit(5_000).cast("long")).alias("flush_ms"),
        (F.lit(False) if alone is None else F.coalesce(alone, F.lit(False))).alias("alone"),
        *first,
    )
    output = record_schema(lines, first)
    shard = F.pmod(F.xxhash64("file_key"), F.lit(_SHARDS)).cast("int").alias("shard")
    return source.select(shard, "*").groupBy("shard").transformWithStateInPandas(
        MergeProcessor(output, first, max_size, max_lines), output, "Append", "ProcessingTime"
    )


def open_records(spark: SparkSession, checkpoint: str, first: Sequence[str] = (), *, operator: int = 0) -> DataFrame:
    """Open records in the state of a stopped stream: the final flush."""
    reader = spark.read.format("statestore").option("operatorId", operator)
    held = reader.option("stateVarName", "open").load(checkpoint).select("user_map_key.*", "user_map_value.*").where("has_text")
    text = reader.option("stateVarName", "text").load(checkpoint).select("user_map_key.*", "user_map_value.*")
    parts = F.sort_array(F.collect_list(F.struct("part", "text")))
    lines = text.groupBy("file_key").agg(F.array_join(F.transform(parts, lambda item: item["text"]), "\n").alias("body"))
    return held.join(lines, "file_key").select(
        "file_key", "first_line", "last_line",
        (F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"), "body", *first,
    )
