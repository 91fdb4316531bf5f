"""Packing documents into sequences of a fixed number of tokens.

Sum-of-squares packing: a piece goes where the squared counts of open
sequences per residual gap become smallest afterwards.  Pieces are dealt
evenly over groups of a fixed number of pieces; a task packs a group, longest
pieces first, and opens a sequence only where no open one has room.  Only
lengths travel to the packing tasks, never tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.llm.common import text_id, whole
from logweir.llm.tokens import ByteTokens
from logweir.session import staged


@dataclass(frozen=True)
class Settings:
    """``capacity`` tokens a sequence; ``group`` pieces are packed by a task; ``end`` closes a document."""

    capacity: int = 1024
    group: int = 8192
    end: int = 2
    tokenizer: str = "byte_bpe_50k"


def pieces(documents: DataFrame, settings: Settings = Settings(), *, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, when asked for, ``ids``: every row of the table in pieces.

    A document is the ids of its whole text and the end id; null and empty
    texts have the end id alone.  Only documents longer than a sequence are
    cut: all pieces but the first are full.  Repeated rows and ids each have
    pieces of their own.
    """
    size = settings.capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = ByteTokens(settings.tokenizer)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["_id"], batch["_text"], strict=True):
                doc_id = None if doc_id is None else int(doc_id)
                ids = np.array([*tokens.with_specials(text), settings.end], "<u4")
                starts = [0, *range(len(ids) % size or size, len(ids), size)]
                for nth, (start, stop) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    part = ids[start:stop]
                    row = (doc_id, nth, start, stop - start, zlib.crc32(part.tobytes()))
                    out.append((*row, part.astype(np.int32)) if with_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pd.DataFrame(out, columns=names[: 5 + with_ids]).astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return documents.select(text_id("doc_id").alias("_id"), whole("text").alias("_text")).mapInPandas(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and place in it for each length, longest first.

    Moving a sequence from gap ``g`` to ``g - s`` changes the sum of squared
    counts by ``2 (open[g - s] - open[g]) + 2``, filling it by ``1 - 2 open[g]``.
    Ties go to the smallest gap, within a gap to the sequence opened last.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    number, offset, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for at in np.argsort(-lengths, kind="stable"):
        size = int(lengths[at])
        fits = np.flatnonzero(counts[size:]) + size
        if len(fits):
            left = counts[fits - size]
            change = np.where(fits > size, 2 * left + 1, 0) - 2 * counts[fits] + 1
            gap = int(fits[np.argmin(change)])
            sequence = open_at[gap].pop()
            counts[gap] -= 1
        else:
            gap, sequence, opened = capacity, opened, opened + 1
        number[at], offset[at] = sequence, capacity - gap
        if gap > size:
            counts[gap - size] += 1
            open_at[gap - size].append(sequence)
    return number, offset


def pack(cut: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length``: places without gaps, from 0.

    A full piece is a sequence by itself and stays where it is.  The others
    are numbered where they were written and dealt over the groups by that
    number, so groups are even whatever the ids and lengths are, and a lost
    task packs the same rows again.  No pieces, no rows.
    """
    table = staged(cut, "pieces").withColumn("_nth", F.monotonically_increasing_id())
    full = F.col("length") >= settings.capacity
    alone = table.where(full).select(
        *cut.columns, (2 * F.col("_nth") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = table.where(~full)
    groups = max(1, -(-rest.count() // settings.group))
    group = F.pmod(F.xxhash64("_nth"), F.lit(groups))

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_nth")
        number, offset = sum_of_squares(rows["length"].to_numpy(), settings.capacity)
        sequence = 2 * ((rows["_group"][0].as_py() << 32) + number)
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    if "ids" in cut.columns:
        # Tokens stay where they are; places come back by number.
        places = rest.select("_nth", "length", group.alias("_group")).groupBy("_group").applyInArrow(
            packed, "_nth long, length long, _group long, sequence_id long, offset long"
        )
        placed = rest.join(places.select("_nth", "sequence_id", "offset"), "_nth")
    else:
        # Rows without tokens are as narrow as their numbers and travel whole.
        numbered = rest.withColumn("_group", group)
        places = [T.StructField(name, T.LongType()) for name in ("sequence_id", "offset")]
        placed = numbered.groupBy("_group").applyInArrow(packed, T.StructType([*numbered.schema.fields, *places]))
    return placed.select(*cut.columns, "sequence_id", "offset").unionByName(alone)


def sequences(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``sequence_id``, its ``ids`` and the ``doc_ids`` in it: the training rows, at most ``capacity`` ids each."""
    placed = pack(pieces(documents, settings, with_ids=True), settings)
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("_parts")).select(
        "sequence_id", F.flatten(F.col("_parts.ids")).alias("ids"), F.col("_parts.doc_id").alias("doc_ids")
    )


def report(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack(pieces(documents, settings), settings)
