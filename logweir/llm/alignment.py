"""Alignment of two tokenizers' tokens over one text, and what it tells about the whole corpus.

Interval coalescing: the byte ranges of all tokens of both tokenizers, sorted
by start, fall into groups where a start reaches the running maximum of the
ends before it, which is where tokens of both end; inside a group every
overlapping pair is a link.  Documents are aligned in blocks of bounded size.
A block keeps its links as places in its own list of distinct id pairs, so the
corpus-wide counts come back as one row per pair of a block, not per link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import text_id, whole
from logweir.llm.tokens import ByteTokens, PieceTokens
from logweir.session import staged

#: Bits of a pair's number that hold the id of the second tokenizer.
_SHIFT = 24


@dataclass(frozen=True)
class Settings:
    """``slice`` characters of text are aligned at a time, ``block`` share a list of pairs; a longer text is both by itself."""

    first: str = "byte_bpe_50k"
    second: str = "piece_bpe_32k"
    block: int = 4 << 20
    slice: int = 1 << 18


@dataclass(frozen=True)
class Aligned:
    """The group of every token of both sides, and links as places of tokens."""

    group: tuple[np.ndarray, np.ndarray]
    links: tuple[np.ndarray, np.ndarray]


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the intervals by start, and the group of each in that order."""
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks) - 1


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Aligned:
    """Groups and links of two tilings of the same bytes, each given by the ends of its tokens."""
    ends = (np.asarray(ends_a, np.int64), np.asarray(ends_b, np.int64))
    starts = tuple(np.concatenate(([0], end[:-1])).astype(np.int64)[: len(end)] for end in ends)
    side = np.repeat(np.array([0, 1], np.int8), [len(end) for end in ends])
    order, group = coalesce(np.concatenate(starts), np.concatenate(ends), side)
    groups = tuple(group[side[order] == which] for which in (0, 1))
    # Tokens of one side come in order, so those of the other that overlap one are a run.
    low = np.searchsorted(ends[1], starts[0], side="right")
    high = np.searchsorted(starts[1], ends[0], side="left")
    widths = high - low
    first = np.repeat(np.arange(len(ends[0])), widths)
    second = np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths) + np.repeat(low, widths)
    return Aligned(groups, (first, second))


class _Speller:
    """Groups as ``a1,a2|b1;a3|b2,b3``: decimal ids of both sides in order."""

    #: What follows an id: one of its side, the other side, the next group, the end of the text.
    AFTER = (b",", b"|", b";", b"")

    def __init__(self, ids: int):
        self.ids = ids
        self.parts = [b"%d%s" % (number, after) for after in self.AFTER for number in range(ids)]

    def spelled(self, ids: tuple[np.ndarray, np.ndarray], group: tuple[np.ndarray, np.ndarray], sizes: np.ndarray) -> list[bytes]:
        """The groups of each text; ``sizes`` has its tokens of both sides together."""
        place = (
            np.arange(len(ids[0])) + np.searchsorted(group[1], group[0], side="left"),
            np.arange(len(ids[1])) + np.searchsorted(group[0], group[1], side="right"),
        )
        total = len(ids[0]) + len(ids[1])
        number, of, side = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
        for which in (0, 1):
            number[place[which]], of[place[which]], side[place[which]] = ids[which], group[which], which
        after = np.full(total, 3)
        after[:-1] = np.where(of[1:] != of[:-1], 2, side[1:] != side[:-1])
        edges = np.concatenate(([0], np.cumsum(sizes)))
        after[edges[1:][sizes > 0] - 1] = 3
        parts = list(map(self.parts.__getitem__, (after * self.ids + number).tolist()))
        return [b"".join(parts[low:high]) for low, high in zip(edges.tolist(), edges[1:].tolist())]


class _Block:
    """Aligned texts of a block, taken up in slices so that few tokens are held at once."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], speller: _Speller):
        self.lengths, self.speller = lengths, speller
        self.docs: list[tuple] = []
        self.codes: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []

    def add(self, rows: list[tuple]) -> None:
        """Texts as ``(doc_id, ids a, ids b)``; no ids where the sides differ.

        Tokens of both sides end where a text ends, so the texts are aligned
        as one and no group holds tokens of two.
        """
        sizes = tuple(np.array([len(row[side]) for row in rows], np.int64) for side in (1, 2))
        ids = tuple(np.concatenate([np.array(row[side], np.int32) for row in rows]) for side in (1, 2))
        found = align(*(np.cumsum(length[part]) for length, part in zip(self.lengths, ids, strict=True)))
        first, second = found.links
        owner = np.repeat(np.arange(len(rows)), sizes[0])
        groups = np.bincount(owner[np.flatnonzero(np.diff(found.group[0], prepend=-1))], minlength=len(rows))
        owner = owner[first]
        links = np.bincount(owner, minlength=len(rows))
        spelled = self.speller.spelled(ids, found.group, sizes[0] + sizes[1])
        hashed = [hashlib.sha256(text).hexdigest() if text else "" for text in spelled]
        self.codes.append((ids[0][first].astype(np.int64) << _SHIFT) | ids[1][second])
        self.owners.append((owner + len(self.docs)).astype(np.int32))
        self.docs.extend(zip((row[0] for row in rows), *(values.tolist() for values in (*sizes, groups, links)), hashed, strict=True))

    def row(self, number: int) -> dict[str, object]:
        place, pairs = pd.factorize(np.concatenate(self.codes))
        # Links of one document and pair become one entry with a count.
        entries, times = np.unique(np.concatenate(self.owners) * np.int64(max(len(pairs), 1)) + place, return_counts=True)
        owner, place = np.divmod(entries, max(len(pairs), 1))
        return {
            "block": number,
            "docs": self.docs,
            "pairs": pairs,
            "holds": np.bincount(place, minlength=len(pairs)),
            "entries": np.bincount(owner, minlength=len(self.docs)).astype("<i4").tobytes(),
            "place": place.astype("<i4").tobytes(),
            "times": times.astype("<i4").tobytes(),
        }


_DOCS = "array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>>"
_BLOCK = f"block long, docs {_DOCS}, pairs array<long>, holds array<long>, entries binary, place binary, times binary"


def blocks(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Aligned documents in blocks; written once, because both passes over the counts read them."""

    def encoded(tokens_a: ByteTokens, tokens_b: PieceTokens, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides, or none where they do not spell the same bytes."""
        if not text:
            return [], []
        data, ids_a, ids_b = (" " + text).encode(), tokens_a.ordinary(" " + text), tokens_b.ordinary(text)
        for side, ids in ((tokens_b, ids_b), (tokens_a, ids_a)):
            if b"".join(map(side.bytes.__getitem__, ids)) != data:
                return [], []
        return ids_a, ids_b

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens_a, tokens_b = ByteTokens(settings.first), PieceTokens(settings.second)
        lengths = tuple(np.array([len(token) for token in side.bytes]) for side in (tokens_a, tokens_b))
        speller = _Speller(max(map(len, lengths)))
        number, block, rows, held, sliced = TaskContext.get().partitionId() << 32, _Block(lengths, speller), [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch["_id"], batch["_text"], strict=True):
                rows.append((None if doc_id is None else int(doc_id), *encoded(tokens_a, tokens_b, text)))
                held, sliced = held + len(text), sliced + len(text)
                if sliced >= settings.slice or held >= settings.block:
                    block.add(rows)
                    rows, sliced = [], 0
                if held >= settings.block:
                    yield pd.DataFrame([block.row(number)])
                    number, block, held = number + 1, _Block(lengths, speller), 0
        if rows:
            block.add(rows)
        if block.docs:
            yield pd.DataFrame([block.row(number)])

    read = documents.select(text_id("doc_id").alias("_id"), whole("text").alias("_text"))
    return staged(read.mapInPandas(aligned, _BLOCK), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, documents``: how many documents hold each linked id pair; ``highest`` where no pair of ``a`` has more."""
    held = aligned.select(F.explode(F.arrays_zip("pairs", "holds")).alias("_pair"))
    counts = held.groupBy(F.col("_pair.pairs").alias("pair")).agg(F.sum("_pair.holds").alias("documents"))
    # An id has at most as many pairs as the other vocabulary has ids.
    first = F.shiftright("pair", _SHIFT)
    top = F.max("documents").over(Window.partitionBy(first))
    return counts.select(
        "pair", first.alias("a"), F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)).alias("b"), "documents",
        (F.col("documents") == top).alias("highest"),
    )


def report(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row.

    A null or empty text, and one whose tokens do not spell a space and the
    text (normalised or unknown characters), has no tokens: zeros and an empty
    digest.  Repeated rows are documents of their own; an empty table has no
    rows.  Counts go back to the blocks by pair, one row per distinct pair of
    a block; a pair that every block holds has as many rows as there are
    blocks, not documents.
    """
    aligned = blocks(documents, settings)
    wanted = aligned.select("block", F.posexplode("pairs").alias("at", "pair"))
    known = wanted.join(pair_counts(aligned).select("pair", "documents", "highest"), "pair")
    answers = known.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("at", "documents", "highest"))).alias("_known")
    )
    # A block's answers are as many as its pairs, which its size bounds.
    joined = aligned.join(answers, "block", "left").select(
        "docs", "entries", "place", "times",
        F.coalesce("_known.documents", F.array().cast("array<long>")).alias("counts"),
        F.coalesce("_known.highest", F.array().cast("array<boolean>")).alias("best"),
    )

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for docs, entries, place, times, counts, best in batch.itertuples(index=False, name=None):
                out = pd.DataFrame(
                    [tuple(doc.values()) for doc in docs],
                    columns=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"],
                ).astype({"doc_id": "Int64"})
                entries, place, times = (np.frombuffer(data, "<i4").astype(np.int64) for data in (entries, place, times))
                owner = np.repeat(np.arange(len(docs)), entries)
                for name, value in (("n_best", best), ("count_sum", counts)):
                    total = np.zeros(len(docs), np.int64)
                    np.add.at(total, owner, np.asarray(value, np.int64)[place] * times)
                    out[name] = total
                yield out

    schema = (
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in summed(batches):
            yield out[names]

    return joined.mapInPandas(ordered, schema)
