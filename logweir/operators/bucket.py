"""The arithmetic of a token bucket over blocks of arrivals, in whole numbers.

One token is ``unit`` parts and the bucket gains ``gain`` parts per
microsecond, so a rate of 2.5 per second is exact.

Where records wait, a block of arrivals turns the moment at which the bucket
would be empty into the later of two, both known from the block alone.  Where
records are refused, three facts make a block one step:

* The *fluid* bucket, which takes what is there instead of refusing, is at
  most one token below the true one, and its blocks are shifts with a floor
  and a ceiling.
* While the true bucket does not overflow, its content modulo one token is
  known from the clock alone.  Together with the fluid bucket that gives the
  content itself.
* So only arrivals at which the fluid bucket is within a token of full need a
  look one by one.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np

#: Up to this many arrivals are followed one by one, which is faster there.
_FEW = 48


class Scale:
    """Whole-number units of a rate: parts per token and parts per microsecond."""

    def __init__(self, rate: float, burst: int):
        exact = Fraction(str(rate))
        self.gain = exact.numerator
        self.unit = 1_000_000 * exact.denominator
        self.full = burst * self.unit
        #: After so many microseconds without a record any bucket is full.
        self.refill_us = -(-self.full // self.gain)

    def kind(self, count: int, most: int = 0):
        """Type of whole numbers that so many arrivals and this largest one fit."""
        return np.int64 if max(4 * self.full, 4 * self.gain, most) + 2 * count * self.unit < 2**62 else object


class Bucket:
    """A token bucket in whole parts; full at first."""

    __slots__ = ("scale", "parts")

    def __init__(self, scale: Scale, parts: int | None = None):
        self.scale = scale
        self.parts = scale.full if parts is None else parts

    def take(self, waited_us: int) -> bool:
        parts = min(self.scale.full, self.parts + waited_us * self.scale.gain)
        admitted = parts >= self.scale.unit
        self.parts = parts - self.scale.unit if admitted else parts
        return admitted


@dataclass(frozen=True)
class Held:
    """A bucket after its last record: parts, below zero where records wait, and that record's time."""

    parts: int
    last: int

    def at(self, now: int, scale: Scale) -> int:
        """Parts when the next record comes."""
        return min(scale.full, self.parts + max(0, now - self.last) * scale.gain)


# ---------------------------------------------------------------- waiting


def waiting_block(times: np.ndarray, scale: Scale) -> tuple[int, int]:
    """A block as a step: the moment the bucket is empty, in parts, becomes ``max(moment + tokens, least)``."""
    count, start = len(times), int(times[0])
    kind = scale.kind(count, (int(times[-1]) - start) * scale.gain)
    late = (times - start).astype(kind) * scale.gain - np.arange(count).astype(kind) * scale.unit
    return count * scale.unit, int(late.max()) - scale.full + count * scale.unit + start * scale.gain


def wait(times: np.ndarray, entry: Held | None, scale: Scale) -> tuple[np.ndarray, Held]:
    """When each record may leave, and the bucket after them."""
    start, count = int(times[0]), len(times)
    empty = -scale.full if entry is None else entry.last * scale.gain - entry.parts - start * scale.gain
    kind = scale.kind(count, abs(empty) + (int(times[-1]) - start) * scale.gain)
    taken = np.arange(count).astype(kind) * scale.unit
    at = (times - start).astype(kind) * scale.gain
    moment = np.maximum(np.maximum.accumulate(at - scale.full - taken), empty) + taken + scale.unit
    leaves = np.maximum(times, start - (-moment // scale.gain).astype(np.int64))
    last = int(times[-1])
    return leaves, Held(last * scale.gain - int(moment[-1]) - start * scale.gain, last)


# ---------------------------------------------------------------- refusing


def steps_of(times: np.ndarray, before: int, scale: Scale) -> np.ndarray:
    """Parts gained before each record; a wait longer than a refill is as good as one."""
    waits = np.diff(times, prepend=before)
    return np.minimum(np.maximum(waits, 0), scale.refill_us).astype(scale.kind(len(times))) * scale.gain


def _square(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps as rows of equal length, and those left over."""
    width = math.isqrt(len(steps)) if len(steps) >= _FEW else 0
    if not width:
        return steps[:0].reshape(0, 1), steps
    count = len(steps) // width
    return steps[: count * width].reshape(count, width), steps[count * width :]


def _maps(rows: np.ndarray, scale: Scale) -> list[tuple[int, int, int]]:
    """Shift, floor and ceiling of the fluid bucket over each row."""
    shift, floor = np.zeros_like(rows[:, 0]), np.zeros_like(rows[:, 0])
    ceiling = floor + scale.full
    for step in rows.T:
        # Shifts beyond the size of the bucket all do the same.
        shift = np.minimum(np.maximum(shift + step - scale.unit, -scale.full), scale.full)
        floor = np.maximum(np.minimum(floor + step, scale.full) - scale.unit, 0)
        ceiling = np.maximum(np.minimum(ceiling + step, scale.full) - scale.unit, 0)
    return list(zip(shift.tolist(), floor.tolist(), ceiling.tolist()))


def fluid_block(steps: np.ndarray, scale: Scale) -> tuple[int, int, int]:
    """A block of the fluid bucket as one step: shift, floor and ceiling."""
    rows, rest = _square(steps)
    shift, floor, ceiling = 0, 0, scale.full
    maps = _maps(rows, scale) if len(rows) else []
    maps += [(step - scale.unit, max(0, min(scale.full, step) - scale.unit), scale.full - scale.unit) for step in rest.tolist()]
    for following in maps:
        shift, floor, ceiling = joined((shift, floor, ceiling), following, scale)
    return shift, floor, ceiling


def joined(first: tuple[int, int, int], then: tuple[int, int, int], scale: Scale) -> tuple[int, int, int]:
    """Two steps of the fluid bucket as one."""
    shift = max(-scale.full, min(scale.full, first[0] + then[0]))
    return shift, fluid_after(first[1], then), fluid_after(first[2], then)


def fluid_after(parts: int, block: tuple[int, int, int]) -> int:
    return max(block[1], min(block[2], parts + block[0]))


def _fluid_contents(steps: np.ndarray, parts: int, scale: Scale) -> tuple[np.ndarray, int]:
    """The fluid bucket when each record comes, and after the last one."""
    rows, rest = _square(steps)
    out = []
    if len(rows):
        entries = []
        for block in _maps(rows, scale):
            entries.append(parts)
            parts = fluid_after(parts, block)
        content, found = np.array(entries, rows.dtype), np.empty_like(rows)
        for at, step in enumerate(rows.T):
            found[:, at] = np.minimum(content + step, scale.full)
            content = np.maximum(found[:, at] - scale.unit, 0)
        out.append(found.ravel())
    tail = []
    for step in rest.tolist():
        tail.append(min(scale.full, parts + step))
        parts = max(0, tail[-1] - scale.unit)
    out.append(np.array(tail, steps.dtype))
    return np.concatenate(out), parts


def _clock(steps: np.ndarray, scale: Scale) -> np.ndarray:
    """Parts gained since the block began, up to whole tokens."""
    return np.cumsum(steps % scale.unit)


def refuse(times: np.ndarray, entry: Held | None, scale: Scale) -> tuple[np.ndarray, Held]:
    """Which records find a whole token, and the bucket after them."""
    last = int(times[-1])
    parts = scale.full if entry is None else entry.at(int(times[0]), scale)
    if len(times) < _FEW:
        bucket, before, flags = Bucket(scale, parts), int(times[0]), []
        for now in times.tolist():
            flags.append(bucket.take(max(0, now - before)))
            before = now
        return np.array(flags, bool), Held(bucket.parts, last)
    steps = steps_of(times, int(times[0]), scale)
    fluid, _ = _fluid_contents(steps, parts, scale)
    clock, index = _clock(steps, scale), np.arange(len(times))
    full = fluid >= scale.full
    near = np.flatnonzero((fluid + scale.unit > scale.full) & ~full)
    if len(near):
        sure = np.maximum.accumulate(np.where(full, index, -1))
        known = -1
        for at, latest, low, gained in zip(near.tolist(), sure[near].tolist(), fluid[near].tolist(), clock[near].tolist()):
            known = max(known, latest)
            base = parts if known < 0 else scale.full - int(clock[known])
            if low + (base + gained - low) % scale.unit >= scale.full:
                full[at], known = True, at
    known = np.maximum.accumulate(np.where(full, index, -1))
    base = np.where(known < 0, parts, scale.full - clock[np.maximum(known, 0)])
    content = np.where(full, scale.full, fluid + (base + clock - fluid) % scale.unit)
    admitted = content >= scale.unit
    return admitted, Held(int(content[-1]) - (scale.unit if admitted[-1] else 0), last)


def true_content(fluid: int, residue: int, unit: int) -> int:
    """The content at most one token above the fluid one, from its residue."""
    return fluid + (residue - fluid) % unit


class Residues:
    """What a run of arrivals does to the content modulo one token, taken up piece by piece."""

    def __init__(self, fluid: int, scale: Scale):
        self.fluid, self.scale = fluid, scale
        self.clock, self.reset = 0, False
        self.near: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, steps: np.ndarray) -> None:
        fluid, self.fluid = _fluid_contents(steps, self.fluid, self.scale)
        clock = _clock(steps, self.scale) + self.clock
        full = np.flatnonzero(fluid >= self.scale.full)
        later = np.arange(len(steps))
        if len(full):
            # Full for certain: what was before no longer counts.
            self.reset, self.near = True, []
            clock, later = clock - clock[full[-1]], later[full[-1] + 1 :]
        near = later[fluid[later] + self.scale.unit > self.scale.full]
        if len(near):
            self.near.append((clock[near] % self.scale.unit, fluid[near]))
        self.clock = int(clock[-1]) % self.scale.unit

    def step(self) -> dict[str, object]:
        """``after`` a moment when the bucket was full for certain the residue is known.

        Otherwise ``edges`` cut the residues at the start into stretches and
        ``ends`` has the residue after the run for each, null where only the
        clock counts.
        """
        clocks, fluids = ([int(value) for side in self.near for value in side[at].tolist()] for at in (0, 1))
        edges, ends = _paint(clocks, fluids, self.clock, self.scale)
        if self.reset:
            after = residue_after(self.scale.full % self.scale.unit, edges, ends, self.clock, self.scale)
            return {"after": after, "clock": self.clock, "edges": [], "ends": []}
        return {"after": None, "clock": self.clock, "edges": edges, "ends": ends}


def _paint(clocks: Sequence[int], fluids: Sequence[int], clock: int, scale: Scale) -> tuple[list[int], list[int | None]]:
    """The residues at a block's start in stretches that end alike.

    At each arrival where the bucket may overflow unseen, one arc of residues
    does; from there all go on as one.  Painted from the last arrival to the
    first, the first overflow of a residue stays on top, and stretches under
    it vanish, so the list does not grow with the arrivals once the arcs cover
    the circle.
    """
    edges, ends = [0], [None]

    def paint(low: int, high: int, end: int) -> None:
        first, last = bisect_left(edges, low), bisect_left(edges, high)
        rest = ends[bisect_right(edges, high) - 1]
        beyond = high < scale.unit and not (last < len(edges) and edges[last] == high)
        edges[first:last] = [low, high] if beyond else [low]
        ends[first:last] = [end, rest] if beyond else [end]

    for at, fluid in zip(reversed(clocks), reversed(fluids), strict=True):
        low = (scale.full - at) % scale.unit
        end = residue_after(low, edges, ends, clock, scale)
        high = low + scale.unit - (scale.full - fluid)
        if high > scale.unit:
            paint(0, high - scale.unit, end)
        paint(low, min(high, scale.unit), end)
    kept = [at for at in range(len(edges)) if not at or ends[at] != ends[at - 1]]
    return [edges[at] for at in kept], [ends[at] for at in kept]


def residue_after(residue: int, edges: Sequence[int], ends: Sequence[int | None], clock: int, scale: Scale) -> int:
    end = ends[bisect_right(edges, residue) - 1]
    return (residue + clock) % scale.unit if end is None else end
