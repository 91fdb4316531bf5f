"""Lines of files: clean-up, order, byte offsets, incomplete tails, round caps.

A frame of lines has ``file_key``, a column that orders the lines of a file,
and ``line``.  The file scan also gives ``block_start``, ``row_id`` and
``file_size`` (see ``sources.text_lines``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.functions import text
from logweir.operators.ordered import running
from logweir.session import staged

#: So many splits, one small row each, may be sent to all tasks; with more, Spark joins them as it sees fit.
_SENT_SPLITS = 1_000_000


def clean_lines(lines: DataFrame, *, max_log_size: int, column: str = "line") -> DataFrame:
    """Drop the carriage return, repair the encoding, bound the length.

    Run it after offsets are known: they count the bytes as stored.
    """
    line = text.repair_utf8(text.strip_cr(F.col(column)))
    return lines.withColumn(column, text.bound(line, max_log_size))


def with_offsets(
    lines: DataFrame, *, order: Sequence[str] = ("block_start", "row_id"), block: Column | None = None
) -> DataFrame:
    """Line number and byte range of each line, the newline included.

    Scanned files pass ``block=F.col("block_start")``: the window then covers
    one split of a file, whatever the size of the file.
    """
    bytes_used = F.octet_length("line").cast("long") + 1
    out = running(
        lines,
        ["file_key"],
        list(order),
        sums={"end_offset": bytes_used, "_nth": F.lit(1).cast("long")},
        block=block,
    )
    return out.withColumns(
        {"start_offset": F.col("end_offset") - bytes_used, "line_no": F.col("_nth") - 1}
    ).drop("_nth")


def with_scan_offsets(lines: DataFrame) -> DataFrame:
    """The same for lines straight from ``scan_lines``, without moving any text.

    A task reads a split from its first line to its last, so places inside a
    split are running sums in the order of the scan.  What comes before the
    split in its file is known from one small row per split, which a first
    pass over the files counts.  Filters may come between, other steps not.
    """
    place = ["file_key", "block_start"]
    used = F.octet_length("line").cast("long") + 1
    totals = staged(lines.groupBy(*place).agg(F.sum(used).alias("_bytes"), F.count(F.lit(1)).alias("_lines")), "splits")
    bases = running(
        totals, ["file_key"], ["block_start"], sums={"_byte_base": F.col("_bytes"), "_line_base": F.col("_lines")}, exclusive=True
    ).select(*place, "_byte_base", "_line_base")
    if totals.count() <= _SENT_SPLITS:
        bases = F.broadcast(bases)
    added = [T.StructField(name, T.LongType()) for name in ("end_offset", "start_offset", "line_no")]
    numbered = lines.mapInArrow(_numbered, T.StructType([*lines.schema.fields, *added]))
    return numbered.join(bases, place).select(
        *lines.columns,
        (F.col("end_offset") + F.col("_byte_base")).alias("end_offset"),
        (F.col("start_offset") + F.col("_byte_base")).alias("start_offset"),
        (F.col("line_no") + F.col("_line_base")).alias("line_no"),
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and lines since the start of the split, whole columns at a time."""
    last, used, lines = None, 0, 0
    for batch in batches:
        count = batch.num_rows
        if not count:
            continue
        split = [batch.column(name).dictionary_encode().indices.to_numpy() for name in ("file_key", "block_start")]
        begins = np.zeros(count, bool)
        begins[1:] = (split[0][1:] != split[0][:-1]) | (split[1][1:] != split[1][:-1])
        first = (batch.column("file_key")[0].as_py(), batch.column("block_start")[0].as_py())
        if first != last:
            used, lines = 0, 0
        size = pc.binary_length(batch.column("line")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        total = np.cumsum(size) + used
        index = np.arange(count) + lines
        edges = np.flatnonzero(begins)
        # Each further split of the batch starts from what was counted before its first line.
        nth = np.cumsum(begins)
        before = np.concatenate(([0], total[edges] - size[edges]))[nth]
        skipped = np.concatenate(([0], index[edges]))[nth]
        ends, places = total - before, index - skipped
        last = (batch.column("file_key")[count - 1].as_py(), batch.column("block_start")[count - 1].as_py())
        used, lines = int(ends[-1]), int(places[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(ends), pa.array(ends - size), pa.array(places)],
            names=[*batch.schema.names, "end_offset", "start_offset", "line_no"],
        )


def complete_lines(lines: DataFrame) -> DataFrame:
    """Drop the text after the last newline of each file; offsets are known."""
    return lines.where(F.col("end_offset") <= F.col("file_size"))


def drop_incomplete_tail(lines: DataFrame) -> DataFrame:
    """The same without offsets: only one small row per file is shuffled.

    A file whose lines, each with a newline, take one byte more than the file
    has no newline at its end, so its last line is not complete.
    """
    place = F.struct("block_start", "row_id")
    files = lines.groupBy("file_key").agg(
        F.sum(F.octet_length("line").cast("long") + 1).alias("_bytes"),
        F.max("file_size").alias("_size"),
        F.max(place).alias("_last"),
    )
    open_files = files.where(F.col("_bytes") > F.col("_size")).select("file_key", "_last")
    return (
        lines.join(open_files, "file_key", "left")
        .where(F.col("_last").isNull() | (place != F.col("_last")))
        .drop("_last")
    )


def cap_round(
    lines: DataFrame, *, max_bytes: int, order: Sequence[str] = ("line_no",), block: Column | None = None
) -> DataFrame:
    """Lines read in one round: until the cap is reached, the crossing line included."""
    return (
        running(
            lines,
            ["file_key"],
            list(order),
            sums={"_before": F.octet_length("line").cast("long") + 1},
            block=block,
            exclusive=True,
        )
        .where(F.col("_before") < max_bytes)
        .drop("_before")
    )
