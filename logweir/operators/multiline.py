"""Multi-line records: lines from one start pattern to the next, with limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions.patterns import java_pattern
from logweir.operators.cut import greedy_cut
from logweir.operators.ordered import running
from logweir.session import staged


def boundary_groups(
    lines: DataFrame, start_pattern: str, *, order: Sequence[str] = ("line_no",), block: Column | None = None
) -> DataFrame:
    """Add ``group``: how many lines so far match the start pattern."""
    hit = F.rlike("line", F.lit(java_pattern(start_pattern))).cast("long")
    return running(lines, ["file_key"], list(order), sums={"group": hit}, block=block)


def merge_lines(
    lines: DataFrame,
    start_pattern: str,
    *,
    max_size: int = 4 * 1024 * 1024,
    max_lines: int = 1000,
    block: Column | None = None,
    first: Sequence[str] = (),
    block_rows: int = 65536,
) -> DataFrame:
    """One row per record: ``file_key, first_line, last_line, lines, body``.

    ``first`` names columns taken from the first line with text (timestamp,
    attributes).  Empty lines before that line are left out of the body, a
    record of empty lines only is left out whole, and a record is cut where it
    would exceed ``max_lines`` lines or ``max_size`` bytes.

    Groups within the limits are merged by one aggregation.  Only groups that
    a limit may cut pass through :func:`greedy_cut`, which also splits a group
    that holds a whole file over many tasks.  Pass ``block`` for files that do
    not fit a task.
    """
    # Read several times below: written once, so that the groups are found once.
    group = staged(_line_groups(lines, start_pattern, max_size, block), "line-groups")
    # Rows that a limit or a start after empty lines may cut out of their group.
    tight_rows = (
        (F.col("_pos") >= max_lines) | (F.col("_bytes") > max_size + 1) | (F.col("_edge") & (F.col("_pos") > 0))
    )
    keys = ["file_key", "_group"]
    tight = group.where(tight_rows).select(*keys).distinct()
    loose = group.join(tight, keys, "left_anti").withColumn("_segment", F.lit(0).cast("long"))
    tight_lines = group.join(tight, keys, "left_semi")
    cuts = greedy_cut(
        tight_lines,
        keys,
        pos="_pos",
        size=F.octet_length("line") + 1,
        empty=F.col("line") == "",
        boundary=F.col("_edge"),
        max_rows=max_lines,
        max_bytes=max_size + 1,
        out="_segment",
        block_rows=block_rows,
    )
    cut = tight_lines.join(cuts, [*keys, "_pos"])
    # What a segment starts with before its first text is never part of a body,
    # and no limit cuts it: such rows go before any list is made.
    loose = loose.where(_has_text_since(F.col("_group")))
    begin = cut.groupBy(*keys, "_segment").agg(F.min("line_no").alias("_begin"))
    cut = cut.join(begin, [*keys, "_segment"]).where(_has_text_since(F.col("_begin"))).drop("_begin")
    return _merge(loose, first).unionByName(_merge(cut, first))


def _has_text_since(begin: Column) -> Column:
    return F.coalesce(F.col("_last_text"), F.lit(-2)) >= begin


def _line_groups(lines: DataFrame, start_pattern: str, max_size: int, block: Column | None) -> DataFrame:
    """Lines with the first line of their group, place and bytes within it.

    A group starts where a matching line follows a line with text: there the
    record before is complete for certain.  A matching line after an empty one
    stays inside as an edge, because empty lines alone are not a record.
    """
    kept = F.when(F.octet_length("line") > max_size, F.substring("line", 1, max_size)).otherwise(F.col("line"))
    source = lines.withColumn("line", kept)
    # The order is worked out on narrow rows; lines move once, to meet their place.
    part = block if block is not None else F.lit(0)
    narrow = source.select(
        "file_key", "line_no", part.alias("_part"), (F.octet_length("line").cast("long") + 1).alias("_used"),
        F.rlike("line", F.lit(java_pattern(start_pattern))).alias("_edge"), (F.col("line") != "").alias("_text"),
    )
    ahead = Window.partitionBy("file_key", "_part").orderBy("line_no")
    edged = narrow.withColumn("_after_text", F.coalesce(F.lag("_text").over(ahead), F.lit(False)))
    begins = F.col("_edge") & F.col("_after_text")
    within = F.col("_part") if block is not None else None
    counted = running(
        edged,
        ["file_key"],
        ["line_no"],
        sums={"_total": F.col("_used"), "_nth": F.lit(1).cast("long")},
        maxes={"_group": F.when(begins, F.col("line_no")), "_last_text": F.when(F.col("_text"), F.col("line_no"))},
        block=within,
    ).withColumn("_group", F.coalesce(F.col("_group"), F.lit(-1)).cast("long"))
    if block is not None:
        # Read twice below, for the blocks and for the rows.
        counted = staged(counted, "line-order")
    # Totals at the start of the group, carried along as a running maximum.
    carried = running(
        counted,
        ["file_key"],
        ["line_no"],
        maxes={"_before": F.when(begins, F.col("_total") - F.col("_used")), "_skip": F.when(begins, F.col("_nth") - 1)},
        block=within,
    )
    placed = carried.select(
        "file_key", "line_no", "_edge", "_group", "_last_text",
        (F.col("_total") - F.coalesce(F.col("_before"), F.lit(0))).alias("_bytes"),
        (F.col("_nth") - 1 - F.coalesce(F.col("_skip"), F.lit(0))).alias("_pos"),
    )
    return source.join(placed, ["file_key", "line_no"])


def _merge(rows: DataFrame, first: Sequence[str]) -> DataFrame:
    """Join the lines of each segment; bounded by the line and byte limits."""
    with_text = F.when(F.col("line") != "", F.col("line_no"))
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    joined = F.array_join(F.transform(ordered, lambda item: item["line"]), "\n")
    return (
        rows.groupBy("file_key", "_group", "_segment")
        .agg(
            F.min(with_text).alias("first_line"),
            F.max("line_no").alias("last_line"),
            F.ltrim(joined, F.lit("\n")).alias("body"),
            *[F.min_by(name, with_text).alias(name) for name in first],
        )
        .where(F.col("first_line").isNotNull())
        .select(
            "file_key", "first_line", "last_line",
            (F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"),
            "body", *first,
        )
    )
