"""Greedy cuts of an ordered sequence by count and bytes, exact and in parallel.

A new segment starts at the first row that would exceed the byte limit or that
finds the count used up.  Where a cut falls depends on all cuts before it, yet
every row knows where the segment that starts with it would end.  Following
these pointers, twice as far each time, marks all cuts of many sequences at
once.  A block of a long sequence depends on its past only through a small
state: how far into the block the open segment still reaches, or how many
empty rows it has so far.  So a long sequence is handled in three steps:

1. each block works out, for every state it may be entered with, the state it
   is left with (only for sequences longer than one block),
2. the states are followed block by block: one small row per block,
3. each block, now with its true state, marks its cuts.

Sequences of one block, nearly all of them, go straight to step 3.  Only keys,
places, sizes and flags pass through Python.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def next_cuts(size, empty, boundary, max_rows, max_bytes):
    """For each row as a segment start: first row with text, first row of the next segment."""
    n = len(size)
    index = np.arange(n)
    filled = np.where(empty, n, index)
    first_text = np.minimum.accumulate(filled[::-1])[::-1] if n else filled
    marks = np.where(boundary, index, n)
    next_mark = np.minimum.accumulate(np.append(marks, n)[::-1])[::-1]
    total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    inside = np.minimum(first_text, n - 1)
    by_bytes = np.searchsorted(total, total[inside] + max_bytes, side="right") - 1
    limit = np.minimum(np.minimum(index + max_rows, by_bytes), next_mark[inside + 1])
    return first_text, np.maximum(inside + 1, limit)


def _block_exits(rows: pd.DataFrame, length: int, max_rows: int, max_bytes: int):
    """Exit state and last cut for every entry state of one block.

    Entry ``d < max_rows``: the open segment reaches to row ``d``, where the
    next one starts.  Entry ``max_rows + k - 1``: the open segment has ``k``
    empty rows (``k`` stops at ``max_rows``) and no text.
    """
    empty = rows["empty"].to_numpy(dtype=bool)
    boundary = rows["boundary"].to_numpy(dtype=bool)
    size = rows["size"].to_numpy(dtype=np.int64)
    first_text, next_cut = next_cuts(size, empty, boundary, max_rows, max_bytes)
    start = np.arange(length)
    text_at, reach = first_text[:length], next_cut[:length]
    leaves = (text_at >= length) | (reach >= length)
    # The last cut in the block from each row on: pointers followed twice as far each time.
    last = np.where(leaves, start, np.minimum(reach, length - 1))
    while not leaves[last].all():
        last = last[last]
    state = np.where(text_at >= length, max_rows + np.minimum(length - start, max_rows) - 1, reach - length)

    def left(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and last cut where the first cut is at these rows; those beyond the block cut nothing in it."""
        inside = cuts < length
        at = last[np.where(inside, cuts, 0)]
        return np.where(inside, state[at], cuts - length), np.where(inside, at, -1)

    exits, cuts = left(np.arange(max_rows))
    head, k = int(first_text[0]), np.arange(1, max_rows + 1)
    if head >= length:
        more = (max_rows + np.minimum(k + length, max_rows) - 1, np.full(max_rows, -1))
    else:
        more = left(first_cuts(size, boundary, head, k, max_rows, max_bytes))
    return [np.concatenate(pair).tolist() for pair in ((exits, more[0]), (cuts, more[1]))]


def first_cuts(size, boundary, head, k, max_rows, max_bytes):
    """Where a segment ends that has ``k`` empty rows before these and its first text at ``head``."""
    total = np.cumsum(size[head : head + max_rows + 1])
    by_bytes = head + int(np.searchsorted(total, max_bytes, side="right"))
    later = np.flatnonzero(boundary[head + 1 : head + 1 + max_rows])
    by_mark = head + 1 + int(later[0]) if len(later) else len(size)
    return np.maximum(head + 1, np.minimum(max_rows - k, min(by_bytes, by_mark)))


def reached(begins: np.ndarray, next_cut: np.ndarray) -> np.ndarray:
    """Marks of all rows that the pointers lead to from some rows on, these included."""
    count = len(next_cut)
    jump = np.append(np.minimum(next_cut, count), count)
    marked = np.zeros(count + 1, bool)
    marked[begins] = marked[count] = True
    while True:
        found = jump[np.flatnonzero(marked)]
        if marked[found].all():
            return marked[:count]
        marked[found] = True
        jump = jump[jump]


def _segments(units: pa.Table, pos: str, block_rows: int, max_rows: int, max_bytes: int) -> np.ndarray:
    """First row of the segment of every row, for whole blocks one after the other."""
    at = units[pos].to_numpy()
    size = units["_size"].to_numpy()
    empty = units["_empty"].to_numpy()
    boundary = units["_boundary"].to_numpy().copy()
    first = np.flatnonzero(at % block_rows == 0)
    edges = np.append(first, len(at))
    ends = np.repeat(edges[1:], np.diff(edges))
    first_text, next_cut = next_cuts(size, empty, boundary, max_rows, max_bytes)
    # Blocks do not know of each other: where one ends, no pointer goes on.
    next_cut = np.where((first_text >= ends) | (next_cut >= ends), len(at), next_cut)
    entry, opened = units["entry"], units["open"]
    begins, starts = first.copy(), np.full(len(at), -1, np.int64)
    for nth in np.flatnonzero(entry.is_valid().to_numpy(zero_copy_only=False)[first]).tolist():
        low, high, state = int(first[nth]), int(ends[first[nth]]), entry[int(first[nth])].as_py()
        if state == 0:
            continue
        if state < max_rows:
            begins[nth] = low + state
        elif first_text[low] >= high:
            begins[nth] = high
        else:
            part = slice(low, high)
            k = np.array([state - max_rows + 1])
            cut = first_cuts(size[part], boundary[part], int(first_text[low]) - low, k, max_rows, max_bytes)
            begins[nth] = low + int(cut[0])
        begins[nth] = min(int(begins[nth]), high)
        starts[low : begins[nth]] = opened[low].as_py()
    # An open segment that fills its block cuts nothing there.
    marked = reached(begins[begins < edges[1:]], next_cut)
    rows = np.maximum.accumulate(np.where(marked, np.arange(len(at)), -1))
    return np.where(starts >= 0, starts, at[np.maximum(rows, 0)])


def greedy_cut(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    pos: str,
    size: Column,
    max_rows: int,
    max_bytes: int,
    empty: Column | None = None,
    boundary: Column | None = None,
    out: str = "segment",
    block_rows: int = 65536,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``keys``, ``pos``, ``carry`` and ``out``: the position of the first row of each row's segment.

    ``pos`` numbers the rows of a key from 0 without gaps.  A segment takes
    rows while it has less than ``max_rows`` and its sizes stay within
    ``max_bytes``; a row too large for any segment is one alone.  Only narrow
    columns should go along; join the others on keys and place.
    """
    block_rows = max(block_rows, max_rows)
    marked = rows.select(
        *keys,
        pos,
        *carry,
        F.floor(F.col(pos) / block_rows).cast("long").alias("_block"),
        size.cast("long").alias("_size"),
        (F.coalesce(empty, F.lit(False)) if empty is not None else F.lit(False)).alias("_empty"),
        (F.coalesce(boundary, F.lit(False)) if boundary is not None else F.lit(False)).alias("_boundary"),
    )
    long_keys = marked.where(F.col(pos) >= block_rows).select(*keys).distinct()
    narrow = marked.select(
        *keys, "_block", F.col(pos).alias("pos"), F.col("_size").alias("size"),
        F.col("_empty").alias("empty"), F.col("_boundary").alias("boundary"),
    ).join(long_keys, list(keys), "left_semi")
    # The last segment of a block may end within the first rows of the next.
    ahead = narrow.where((F.col("_block") > 0) & (F.col("pos") % block_rows < max_rows + 1)).withColumn(
        "_block", F.col("_block") - 1
    )
    entries = _entries(narrow.unionByName(ahead), keys, block_rows, max_rows, max_bytes)

    # Dealt by a hash of their own: a repartition by the columns of the join is
    # left out as done by it, and the join itself may turn into a broadcast
    # that reads each task's rows where they lie, or split a partition.
    placed = (
        marked.join(entries, [*keys, "_block"], "left")
        .repartition(F.xxhash64(*keys, "_block"))
        .sortWithinPartitions(*keys, "_block", pos)
    )
    schema = T.StructType([*[placed.schema[name] for name in (*keys, pos, *carry)], T.StructField(out, T.LongType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            found = _segments(whole, pos, block_rows, max_rows, max_bytes)
            yield from whole.select([*keys, pos, *carry]).append_column(out, pa.array(found, pa.int64())).to_batches()

        for batch in batches:
            # Blocks are cut at once when the next one begins, so at most one waits.
            begins = np.flatnonzero(batch.column(pos).to_numpy() % block_rows == 0)
            last = int(begins[-1]) if len(begins) else -1
            if last < 0 or (last == 0 and not held):
                held.append(batch)
                continue
            whole = [*held, batch.slice(0, last)] if last else held
            yield from done(pa.Table.from_batches(whole))
            held = [batch.slice(last)]
        if held:
            yield from done(pa.Table.from_batches(held))

    return placed.mapInArrow(mark, schema)


def _entries(
    rows: DataFrame, keys: Sequence[str], block_rows: int, max_rows: int, max_bytes: int
) -> DataFrame:
    """True entry state of every block of the long sequences."""
    key_fields = [rows.schema[name] for name in keys]
    summary = T.StructType(
        [
            *key_fields,
            T.StructField("_block", T.LongType()),
            T.StructField("exits", T.ArrayType(T.IntegerType())),
            T.StructField("cuts", T.ArrayType(T.IntegerType())),
        ]
    )

    def summarise(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        number = int(block["_block"].iloc[0])
        length = int((block["pos"] < (number + 1) * block_rows).sum())
        exits, cuts = _block_exits(block, length, max_rows, max_bytes)
        head = {name: [block[name].iloc[0]] for name in keys}
        return pd.DataFrame({**head, "_block": [number], "exits": [exits], "cuts": [cuts]})

    chained = T.StructType(
        [*key_fields, T.StructField("_block", T.LongType()),
         T.StructField("entry", T.IntegerType()), T.StructField("open", T.LongType())]
    )

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, opened = 0, 0
        for frame in frames:
            entry, start = [], []
            for number, exits, cuts in zip(frame["_block"], frame["exits"], frame["cuts"]):
                if number == 0:
                    state, opened = 0, 0
                entry.append(state)
                start.append(opened)
                if cuts[state] >= 0:
                    opened = number * block_rows + int(cuts[state])
                state = int(exits[state])
            yield frame[[*keys, "_block"]].assign(
                entry=np.array(entry, dtype="int32"), open=np.array(start, dtype="int64")
            )

    return (
        rows.groupBy(*keys, "_block")
        .applyInPandas(summarise, summary)
        .repartition(*keys)
        .sortWithinPartitions(*keys, "_block")
        .mapInPandas(chain, chained)
    )
