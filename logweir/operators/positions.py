"""Read positions as tables: resume, commit, merge, prune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def start_offset(offset: Column, size: Column, start_at: Column) -> Column:
    """Where to resume a file.

    A stored offset counts unless it lies beyond the file, which then was
    truncated.  A new file starts at its end or at its beginning.
    """
    return (
        F.when(offset.isNull() & (start_at == "end"), size)
        .when(offset > size, F.lit(0))
        .otherwise(F.coalesce(offset, F.lit(0)))
    )


def resume_lines(
    lines: DataFrame, positions: DataFrame, *, start_at: str | Column = "end", max_bytes: int | None = None
) -> DataFrame:
    """Lines at or after the resume offset of their file.

    Needs ``file_key, file_size, start_offset``.  With ``max_bytes`` a round
    ends there, the line that crosses it included: offsets say how much was
    read before a line, so nothing is summed up.  The join carries one row per
    file on the right; Spark broadcasts it only when its size allows.
    """
    mode = F.lit(start_at) if isinstance(start_at, str) else start_at
    known = positions.select("file_key", F.col("offset").alias("_offset"))
    start = start_offset(F.col("_offset"), F.col("file_size"), mode)
    reads = F.col("start_offset") >= start
    if max_bytes is not None:
        reads = reads & (F.col("start_offset") - start < max_bytes)
    return lines.join(known, "file_key", "left").where(reads).drop("_offset")


def committed(lines: DataFrame, *, now: Column) -> DataFrame:
    """Committed offset per file after a round."""
    return lines.groupBy("file_key").agg(
        F.max_by("path", "end_offset").alias("path"), F.max("end_offset").alias("offset"), F.max(now).alias("updated_at")
    )


def merge_positions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Positions after a round; a row with equal offset and path stays as it was."""
    left = old.select("file_key", F.struct("path", "offset", "updated_at").alias("_old"))
    right = new.select("file_key", F.struct("path", "offset", "updated_at").alias("_new"))
    same = (F.col("_old.path") == F.col("_new.path")) & (F.col("_old.offset") == F.col("_new.offset"))
    keep_old = F.col("_new").isNull() | F.coalesce(same, F.lit(False))
    row = F.when(keep_old, F.col("_old")).otherwise(F.col("_new"))
    return left.join(right, "file_key", "full_outer").select("file_key", row.alias("_row")).select("file_key", "_row.*")


def prunable(positions: DataFrame, live: DataFrame, *, cutoff: Column) -> DataFrame:
    """Positions to delete: older than the cutoff and their file gone or replaced."""
    old = positions.where(F.col("updated_at") < cutoff)
    return old.join(live.select("path", "file_key"), ["path", "file_key"], "left_anti")


def prune(positions: DataFrame, live: DataFrame, *, cutoff: Column) -> DataFrame:
    """Positions that stay."""
    alive = live.select("path", "file_key", F.lit(True).alias("_alive")).distinct()
    return (
        positions.join(alive, ["path", "file_key"], "left")
        .where(F.coalesce(F.col("_alive"), F.lit(False)) | (F.col("updated_at") >= cutoff))
        .drop("_alive")
    )


def write_positions(positions: DataFrame, path: str, *, format: str = "parquet") -> None:
    """Write the table to a new path; the caller then points readers at it."""
    positions.write.mode("errorifexists").format(format).save(path)
