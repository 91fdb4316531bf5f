"""Rows in one total order, cut into ranges that tasks read back whole and in order.

Spark samples the bounds of the ranges, so they are even whatever the keys
are: a key that holds all rows is spread like any other.  What a pass over the
ranges learns about each, one small row per range, is put together on the
driver, and the next pass starts every range from what came before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.session import scratch_dir

PART, PLACE = "_part", "_place"

#: A file of one row group is read by one task, from its first row to its last.
_GROUP_BYTES = 1 << 30


def in_order(df: DataFrame, order: Sequence[str], *, parts: int | None = None) -> DataFrame:
    """The rows written in order, with their range and place in it; pass narrow ones.

    ``order`` must tell all rows apart.  There are as many ranges as shuffle
    partitions unless ``parts`` says otherwise.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns(
        {PART: F.spark_partition_id(), PLACE: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    )
    where = scratch_dir(spark, "ordered")
    writer = ranged.write.option("parquet.block.size", _GROUP_BYTES).option("maxRecordsPerFile", 0)
    writer.parquet(where)
    return spark.read.schema(ranged.schema).parquet(where)


class Run(NamedTuple):
    """Rows ``low`` to ``high`` of a batch: the next ones of a key in a range; ``begins`` where the range has none before."""

    part: int
    key: tuple
    begins: bool
    low: int
    high: int


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, list[Run]]]:
    """Each batch with its runs of equal range and key; a run goes on in the next batch where one ends inside it."""
    last, expected = None, 0
    for batch in batches:
        count = batch.num_rows
        if not count:
            continue
        part, place = batch.column(PART).to_numpy(), batch.column(PLACE).to_numpy()
        change = np.zeros(count, bool)
        change[1:] = part[1:] != part[:-1]
        for key in keys:
            codes = batch.column(key).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), count]
        found = []
        for low, high in zip(edges, edges[1:]):
            key = tuple(batch.column(name)[low].as_py() for name in keys)
            number = int(part[low])
            if int(place[low]) != (expected if last and last[0] == number else 0):
                raise RuntimeError("a range was read in pieces; raise spark.sql.shuffle.partitions")
            found.append(Run(number, key, (number, key) != last, low, high))
            last, expected = (number, key), int(place[high - 1]) + 1
        yield batch, found
