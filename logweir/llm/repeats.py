"""Repeated passages by suffix arrays over anchored contexts.

Every string of ``length`` bytes holds one anchor: its smallest hashed n-gram.
Equal strings have equal anchors, so strings can be compared where their
anchors meet.  Where an anchor is frequent, strings meet by the anchor and the
bytes beside it instead: a string reaches further on one side of its anchor,
and has all bytes of that side.  Chunks of documents first exchange anchor hashes alone; only
anchors of several documents send their contexts on.  There the contexts,
aligned at the anchor, form an enhanced suffix array column by column.  A scan
of its common prefixes gives the interval tree, and nodes whose occurrences
differ on the left are the maximal repeats, each with all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import whole


@dataclass(frozen=True)
class Settings:
    """Repeats of at least ``length`` bytes; chunks and parts are sized in bytes of text.

    Contexts of an anchor that occurs ``frequent`` times are dealt by what is
    beside it.
    """

    length: int = 50
    gram: int = 16
    chunk: int = 6_000_000
    part: int = 16_000_000
    slice: int = 1_000_000
    frequent: int = 512

    @property
    def back(self) -> int:
        """How far before its anchor a string can start."""
        return self.length - self.gram

    @property
    def side(self) -> int:
        """Bytes beside its anchor that every string has, on the one side or the other."""
        return self.back // 2

    @property
    def width(self) -> int:
        """Bytes from the first start to the last end around an anchor."""
        return self.back + self.length


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on, by doubling; size is a power of two."""
    out = (data.astype(np.uint64) + np.uint64(1)) * _MIX[1]
    step = 1
    while step < size:
        joined = out[:-step] * _MIX[0] + out[step:]
        out = joined ^ (joined >> np.uint64(29))
        step *= 2
    return out * _MIX[1]


def _smallest(hashes: np.ndarray, size: int) -> np.ndarray:
    """Place of the first smallest hash among ``size`` places from each place on."""
    value, place, step = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while step < size:
        move = min(step, size - step)
        left, right = value[:-move], value[move:]
        first = left <= right
        value = np.where(first, left, right)
        place = np.where(first, place[:-move], place[move:])
        step += move
    return place


@dataclass
class Anchors:
    """Anchors of some documents: document, hash, place, and the first and last string start that it stands for."""

    document: np.ndarray
    hash: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def sided(self, data: bytes, settings: Settings) -> Anchors:
        """Anchors split by the side on which their strings have ``side`` bytes, the left one if both; hashes take these in."""
        gram, side, parts = settings.gram, settings.side, []
        turn = self.place - side  # the last string start of the left side
        for mark, before, after, first, last in (
            (1, side, gram, self.first, np.minimum(self.last, turn)), (2, 0, gram + side, np.maximum(self.first, turn + 1), self.last)
        ):
            rows = np.flatnonzero(first <= last)
            hashes = [xxhash.xxh3_64_intdigest(data[at - before : at + after], mark) for at in self.place[rows].tolist()]
            parts.append((self.document[rows], np.array(hashes, np.uint64), self.place[rows], first[rows], last[rows]))
        return Anchors(*[np.concatenate(column) for column in zip(*parts, strict=True)])

    def join(self, other: Anchors) -> Anchors:
        pairs = zip(
            (self.document, self.hash, self.place, self.first, self.last),
            (other.document, other.hash, other.place, other.first, other.last),
            strict=True,
        )
        return Anchors(*map(np.concatenate, pairs))

    def pick(self, rows: np.ndarray) -> Anchors:
        return Anchors(self.document[rows], self.hash[rows], self.place[rows], self.first[rows], self.last[rows])


def anchors(data: np.ndarray, ends: np.ndarray, settings: Settings) -> Anchors:
    """Anchors of documents laid end to end; a slice at a time, at document ends."""
    parts, low, start = [], 0, 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, start + settings.slice, side="right")))
        stop = int(ends[high - 1])
        piece = data[start:stop]
        if len(piece) >= settings.length:
            hashes = _gram_hashes(piece, settings.gram)
            place = _smallest(hashes, settings.back + 1)
            begin = np.arange(len(place), dtype=np.int64) + start
            document = np.searchsorted(ends, begin, side="right")
            inside = np.flatnonzero(begin + settings.length <= ends[document])
            place, document = place[inside].astype(np.int64), document[inside]
            if len(place):
                change = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (document[1:] != document[:-1])]))
                last = np.concatenate([change[1:], [len(place)]]) - 1
                parts.append(
                    (document[change], hashes[place[change]], place[change] + start, begin[inside[change]], begin[inside[last]])
                )
        low, start = high, stop
    if not parts:
        empty = np.empty(0, np.int64)
        return Anchors(empty, empty.astype(np.uint64), empty, empty, empty)
    return Anchors(*[np.concatenate(column) for column in zip(*parts, strict=True)])


_LAST_ID = np.iinfo(np.int64).max


class _Chunk:
    """The documents of a chunk in a fixed order, as bytes laid end to end."""

    def __init__(self, rows: pd.DataFrame, settings: Settings):
        # A null id comes after all others and hides nothing.
        ids = [_LAST_ID if value is None else int(value) for value in rows["doc_id"]]
        texts = [text.encode("utf-8", "replace") for text in rows["text"]]
        order = sorted(range(len(ids)), key=lambda at: (ids[at], texts[at]))
        self.rows = rows.iloc[order]
        self.ids = np.array(ids, np.int64)[order]
        self.data = np.frombuffer(b"".join(texts[at] for at in order), np.uint8)
        self.ends = np.cumsum([len(texts[at]) for at in order]).astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.found = anchors(self.data, self.ends, settings)

    def contexts(self, found: Anchors, settings: Settings) -> list[bytes]:
        data = self.data.tobytes()
        return [data[a : b + settings.length] for a, b in zip(found.first.tolist(), found.last.tolist(), strict=True)]

    def hidden(self, found: Anchors, settings: Settings) -> np.ndarray:
        """Whether a smaller id of this chunk has the same context at the same anchor."""
        order = np.argsort(found.hash, kind="stable")  # by hash, then by id as the documents lie
        ordered = found.pick(order)
        again = np.zeros(len(order), bool)
        again[1:] = ordered.hash[1:] == ordered.hash[:-1]
        out = np.zeros(len(order), bool)
        groups = np.flatnonzero(again | np.append(again[1:], False))
        picked = ordered.pick(groups)
        seen: dict[tuple[int, int, bytes], int] = {}
        rows = zip(picked.hash.tolist(), (picked.place - picked.first).tolist(), self.contexts(picked, settings), strict=True)
        for at, key in enumerate(rows):
            own = int(self.ids[picked.document[at]])
            if seen.setdefault(key, own) < own:
                out[order[groups[at]]] = True
        return out


def _parts(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each hash and the half of it that tells hashes apart within a part."""
    return (hashes % np.uint64(parts)).astype(np.int64), (hashes >> np.uint64(32)).astype(np.uint32)


def _known(found: Anchors, ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (part, key) of a chunk in order, its uses, and the entry of each anchor.

    Uses are the number of anchors, 127 at most, and 128 more where several ids have one.
    """
    part, key = _parts(found.hash, parts)
    joined = (part.astype(np.uint64) << np.uint64(32)) | key
    distinct, entry = np.unique(joined, return_inverse=True)
    own = ids[found.document]
    low, high = np.full(len(distinct), _LAST_ID), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(low, entry, own)
    np.maximum.at(high, entry, own)
    uses = np.minimum(np.bincount(entry, minlength=len(distinct)), 127) + 128 * (low < high)
    return (distinct >> np.uint64(32)).astype(np.int64), distinct.astype(np.uint32), uses.astype(np.uint8), entry


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Nodes (first, last, length) of the common-prefix interval tree with at least this length.

    ``common[i]`` is the common prefix of suffixes i and i + 1.  One scan with a
    stack of open intervals.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # start, length
    for at, length in enumerate([*common.tolist(), 0]):
        start = at
        while stack and stack[-1][1] > length:
            start, deeper = stack.pop()
            out.append((start, at, deeper))
        if length >= least and (not stack or stack[-1][1] < length):
            stack.append((start, length))
    return out


def cover(contexts: np.ndarray, first: np.ndarray, last: np.ndarray, ids: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Per context the columns that repeats from smaller ids cover, as start and end; end 0 for none.

    ``contexts`` has a row per context, aligned at the anchor; ``first`` and
    ``last`` are the columns of the string starts a row stands for.  Any two
    repeats of one context overlap, so what they cover is one stretch.
    """
    rows, width, length = len(contexts), settings.width, settings.length
    start, end = np.full(rows, width, np.int64), np.zeros(rows, np.int64)
    columns = np.ascontiguousarray(contexts.T)
    stop = last + length
    order = np.arange(rows)
    for column in range(width - 1, -1, -1):
        # Suffixes from this column: by its byte, then as those of the next column.
        order = order[np.argsort(columns[column][order], kind="stable")]
        if column > settings.back:
            continue
        here = order[(first[order] <= column) & (column <= last[order])]
        if len(here) < 2:
            continue
        a, b = here[:-1], here[1:]
        alike = columns[column][a] == columns[column][b]
        alike &= columns[column + length - 1][a] == columns[column + length - 1][b]
        near = np.flatnonzero(alike)
        common = np.zeros(len(a), np.int64)
        for low in range(0, len(near), 65536):
            part = near[low : low + 65536]
            same = contexts[a[part], column:] == contexts[b[part], column:]
            reach = np.where(same.all(axis=1), width - column, np.argmin(same, axis=1))
            common[part] = np.minimum(reach, np.minimum(stop[a[part]], stop[b[part]]) - column)
        joined = common >= length
        edges = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))
        lows, highs = edges[::2], edges[1::2]  # members low..high
        if not len(lows):
            continue
        # Left extension: occurrences that all continue alike belong to a longer repeat.
        left = np.where(first[here] == column, -1, columns[column - 1][here].astype(np.int64) if column else -1)
        diverse = np.zeros(len(here) - 1, bool)
        diverse[:] = (left[:-1] != left[1:]) | (left[:-1] < 0)
        counted = np.concatenate([[0], np.cumsum(diverse)])
        kept = counted[highs] > counted[lows]
        lows, highs = lows[kept], highs[kept]
        if not len(lows):
            continue
        bounds = np.column_stack([lows, highs]).ravel()
        padded = np.append(common, 0)
        flat = np.minimum.reduceat(padded, bounds)[::2] == np.maximum.reduceat(padded, bounds)[::2]
        nodes = [(int(low), int(high), int(common[low])) for low, high in zip(lows[flat], highs[flat], strict=True)]
        for low, high in zip(lows[~flat].tolist(), highs[~flat].tolist(), strict=True):
            for begin, finish, size in intervals(common[low:high], length):
                if counted[low + finish] > counted[low + begin]:
                    nodes.append((low + begin, low + finish, size))
        for low, high, size in nodes:
            members = here[low : high + 1]
            own = ids[members]
            members = members[own > own.min()]
            start[members] = np.minimum(start[members], column)
            end[members] = np.maximum(end[members], column + size)
    return start, end


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, in order, none touching the next."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    first = np.flatnonzero(fresh)
    return starts[first], reach[np.concatenate([first[1:], [len(starts)]]) - 1]


def _pack(*arrays: np.ndarray) -> bytes:
    header = np.array([len(arrays)] + [array.nbytes for array in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(header + b"".join(array.tobytes() for array in arrays))


def _unpack(data: bytes, *types: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(data))
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, count, 8)
    out, at = [], 8 * (count + 1)
    for kind, size in zip(types, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def remove(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends``.

    A byte goes when a string of ``length`` bytes over it also starts in a
    document with a smaller id; strings are judged on the input.  A null text
    is empty.  Rows with one id hide nothing from each other, a null id is
    larger than any other; repeated rows are documents of their own, and an
    empty table gives no rows.  ``starts`` and ``ends`` are the removed byte
    spans.
    """
    # As text, a null id and a large one reach the tasks unchanged.
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), whole("text").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, parts = -(-total // settings.chunk) + 1, -(-total // settings.part) + 1
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def hashes(chunk: pd.DataFrame) -> pd.DataFrame:
        at = int(chunk["chunk"].iloc[0])
        own = _Chunk(chunk, settings)
        part, key, uses, _ = _known(own.found, own.ids, parts)
        out = []
        for number in np.unique(part):
            low, high = np.searchsorted(part, [number, number + 1])
            out.append((int(number), at, key[low:high].tobytes(), zstandard.compress(uses[low:high].tobytes(), 1)))
        return pd.DataFrame(out, columns=["part", "chunk", "keys", "uses"])

    def shared(blobs: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(data, np.uint32) for data in blobs["keys"]]
        uses = np.concatenate([np.frombuffer(zstandard.decompress(data), np.uint8) for data in blobs["uses"]])
        distinct, entry, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        wanted = count > 1
        wanted[entry[uses >= 128]] = True
        frequent = np.bincount(entry, weights=uses & 127, minlength=len(distinct)) >= settings.frequent
        edges = np.cumsum([0, *map(len, keys)])
        masks = [
            [np.packbits(flags[entry[low:high]]).tobytes() for flags in (wanted, wanted & frequent)] for low, high in zip(edges, edges[1:])
        ]
        return pd.DataFrame(
            {"chunk": blobs["chunk"], "part": blobs["part"], "mask": [mask[0] for mask in masks], "frequent": [mask[1] for mask in masks]}
        )

    def contexts(chunk: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk) or not len(masks):
            return pd.DataFrame([], columns=["part", "chunk", "packed"])
        at, own = int(chunk["chunk"].iloc[0]), _Chunk(chunk, settings)
        part, key, _, entry = _known(own.found, own.ids, parts)
        wanted, frequent = np.zeros(len(key), bool), np.zeros(len(key), bool)
        for number, *packed in zip(masks["part"], masks["mask"], masks["frequent"], strict=True):
            low, high = np.searchsorted(part, [number, number + 1])
            for flags, mask in zip((wanted, frequent), packed, strict=True):
                flags[low:high] = np.unpackbits(np.frombuffer(mask, np.uint8), count=high - low).astype(bool)
        # Of equal contexts only the smallest id of the chunk goes on; the others are covered by it.
        picked = np.flatnonzero(wanted[entry] & ~own.hidden(own.found, settings))
        often = frequent[entry[picked]]
        split = own.found.pick(picked[often]).sided(own.data.tobytes(), settings)
        found = own.found.pick(picked[~often]).join(split)
        number = np.concatenate([part[entry[picked[~often]]], _parts(split.hash, parts)[0]])
        out = []
        order = np.lexsort((found.hash, number))
        found, number = found.pick(order), number[order]
        for value in np.unique(number):
            low, high = np.searchsorted(number, [value, value + 1])
            group = found.pick(np.arange(low, high))
            out.append(
                (
                    int(value),
                    at,
                    _pack(
                        np.frombuffer(b"".join(own.contexts(group, settings)), np.uint8),
                        (settings.back - (group.place - group.first)).astype(np.uint8),
                        (settings.back - (group.place - group.last)).astype(np.uint8),
                        own.ids[group.document],
                        group.place.astype(np.int32),
                    ),
                )
            )
        return pd.DataFrame(out, columns=["part", "chunk", "packed"])

    def covered(blobs: pd.DataFrame) -> pd.DataFrame:
        read = [_unpack(data, np.uint8, np.uint8, np.uint8, np.int64, np.int32) for data in blobs["packed"]]
        first, last = (np.concatenate([blob[at] for blob in read]).astype(np.int64) for at in (1, 2))
        ids, place = (np.concatenate([blob[at] for blob in read]) for at in (3, 4))
        owner = np.repeat(blobs["chunk"].to_numpy(np.int64), [len(blob[1]) for blob in read])
        text = np.concatenate([blob[0] for blob in read])
        del read
        size = last - first + settings.length
        matrix = np.zeros((len(first), settings.width), np.uint8)
        cells = np.arange(settings.width)[None, :]
        matrix[(cells >= first[:, None]) & (cells < (first + size)[:, None])] = text
        start, end = cover(matrix, first, last, ids, settings)
        hit = np.flatnonzero(end)
        begin = place[hit].astype(np.int64) - settings.back
        spans = pd.DataFrame({"chunk": owner[hit], "start": begin + start[hit], "end": begin + end[hit]})
        out = []
        for number, own in spans.groupby("chunk"):
            starts, ends = _merge(own["start"].to_numpy(), own["end"].to_numpy())
            out.append((int(number), _pack(starts.astype(np.int32), ends.astype(np.int32))))
        return pd.DataFrame(out, columns=["chunk", "packed"])

    def kept(chunk: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk):
            return pd.DataFrame([], columns=_RESULT_NAMES)
        own = _Chunk(chunk, settings)
        local = own.found.pick(np.flatnonzero(own.hidden(own.found, settings)))
        read = [_unpack(data, np.int32, np.int32) for data in spans["packed"]]
        starts, ends = _merge(
            np.concatenate([local.first, *[blob[0] for blob in read]]).astype(np.int64),
            np.concatenate([local.last + settings.length, *[blob[1] for blob in read]]).astype(np.int64),
        )
        return _kept(own, starts, ends)

    by_chunk = dealt.groupBy("chunk")
    keys = by_chunk.applyInPandas(hashes, "part long, chunk long, keys binary, uses binary")
    masks = keys.groupBy("part").applyInPandas(shared, "chunk long, part long, mask binary, frequent binary")
    sent = by_chunk.cogroup(masks.groupBy("chunk")).applyInPandas(contexts, "part long, chunk long, packed binary")
    spans = sent.groupBy("part").applyInPandas(covered, "chunk long, packed binary")
    found = by_chunk.cogroup(spans.toDF("chunk", "packed").groupBy("chunk")).applyInPandas(kept, _RESULT)
    return found.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))


_RESULT = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
_RESULT_NAMES = [part.split()[0] for part in _RESULT.split(", ")]


def _kept(own: _Chunk, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    """Results per document from merged spans, which may touch across document ends."""
    data, out, at = own.data.tobytes(), [], 0
    for (low, high), value in zip(zip(own.starts.tolist(), own.ends.tolist(), strict=True), own.rows["doc_id"], strict=True):
        while at < len(ends) and ends[at] <= low:
            at += 1
        digest, place, begins, finishes, scan = hashlib.sha256(), low, [], [], at
        while scan < len(starts) and starts[scan] < high:
            begin, finish = max(int(starts[scan]), low), min(int(ends[scan]), high)
            digest.update(data[place:begin])
            place = finish
            begins.append(begin - low)
            finishes.append(finish - low)
            scan += 1
        digest.update(data[place:high])
        removed = sum(finishes) - sum(begins)
        out.append((value, high - low, removed, len(begins), digest.hexdigest(), begins, finishes))
    return pd.DataFrame(out, columns=_RESULT_NAMES)
