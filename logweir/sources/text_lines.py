"""Batch scan of text logs: globs in, one row per line out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions import paths


def _listed(spark: SparkSession, glob: str) -> DataFrame | None:
    """The lines under a glob; one without a file is not an error."""
    try:
        return spark.read.option("lineSep", "\n").text(glob)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    return None


def scan_lines(spark: SparkSession, include: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Lines of all files matched by an include glob and by no exclude glob.

    Only the newline splits lines, so a carriage return stays in the line.
    ``row_id`` orders the lines of one split; together with ``block_start`` it
    orders the file.  ``include_idx`` is the first include glob that matches:
    a file matched twice is read under the first only.  Names that start with
    a dot or underscore are hidden from Spark listings.
    """
    schema = (
        "path string, file_key string, file_size long, block_start long, row_id long, include_idx int, line string"
    )
    out = None
    path = paths.local_path(F.col("_metadata.file_path"))
    for index, glob in enumerate(include):
        raw = _listed(spark, glob)
        if raw is None:
            continue
        # The filter uses file metadata alone and comes before anything numbered,
        # so that Spark drops files from the listing instead of reading them.
        # The glob itself counts again: a matched folder would list its files.
        kept = raw.where(
            paths.matches_any(path, [glob])
            & ~paths.matches_any(path, list(include[:index]))
            & ~paths.matches_any(path, list(exclude))
        )
        scan = kept.select(
            path.alias("path"),
            path.alias("file_key"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("row_id"),
            F.lit(index).alias("include_idx"),
            F.col("value").alias("line"),
        )
        out = scan if out is None else out.unionByName(scan)
    return spark.createDataFrame([], schema) if out is None else out
