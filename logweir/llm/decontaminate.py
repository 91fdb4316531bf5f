"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so that a question asked
again with other values has the same template.  A run of names is one
placeholder, and so is a number with its unit, however many words a value has.
Windows of template tokens are joined by hash; windows on one diagonal of a
document and an item form a run, and a run counts only as far as every slot
value of the item maps to one value of the document and back.  A window with
few plain words has no template to speak of: it is hashed as it is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import whole
from logweir.session import staged


@dataclass(frozen=True)
class Settings:
    """``window`` tokens are hashed; a run of ``least`` words, or of a whole shorter item, is a leak.

    Items of fewer than ``shortest`` words say too little and match nothing.
    Windows of fewer than ``literals`` plain words match only as written.  Up
    to ``filter_windows`` benchmark windows (16 bytes each) go to every task
    as a filter; a larger benchmark is joined without one.
    """

    window: int = 8
    least: int = 13
    shortest: int = 5
    literals: int = 3
    filter_windows: int = 1_000_000


#: Names of units.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz gram grams kilogram kilograms "
    "ton tons ml l litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month "
    "months year years hz khz mhz ghz w kw mw v kv mv ohm j kj cal kcal n pa kpa bar k c f degree degrees percent usd eur gbp "
    "dollar dollars euro euros cent cents pound pounds bit bits byte bytes kb mb gb tb kmh mph".split()
)
_PLAIN, _NUMBER, _NAME, _UNIT, _NONE = range(5)


class _Template(dict):
    """Written word to its place in the tables of hashes, kinds and plain forms."""

    def __init__(self):
        super().__init__()
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.hashes, self.written = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.kinds, self.forms = np.zeros(1024, np.uint8), []

    def __missing__(self, word: str) -> int:
        start, end = 0, len(word)
        while start < end and not word[start].isalnum():
            start += 1
        while end > start and not word[end - 1].isalnum():
            end -= 1
        form = word[start:end]
        if not form:
            kind = _NONE
        elif any(map(str.isdigit, form)):
            kind = _NUMBER
        elif form.lower() in UNITS:
            kind = _UNIT
        elif form[0].isupper() and not (len(form) > 1 and form.isupper()):
            kind = _NAME
        else:
            kind = _PLAIN
        form = form.lower()
        at = len(self)
        if at == len(self.hashes):
            self.hashes, self.written, self.kinds = (
                np.concatenate([table, np.zeros_like(table)]) for table in (self.hashes, self.written, self.kinds)
            )
        self.written[at] = xxhash.xxh3_64_intdigest(form.encode("utf-8", "replace"))
        self.hashes[at] = self.written[at] if kind == _PLAIN else xxhash.xxh3_64_intdigest(f"<{kind}>")
        self.kinds[at] = kind
        self.forms.append(form)
        self[word] = at
        return at

    def read(self, text: str) -> "_Read":
        """The tokens of a text; marks without letters and digits are left out."""
        if len(self) > 500_000:
            self._empty()
        at = np.array(list(map(self.__getitem__, text.split())), np.int64)
        at = at[self.kinds[at] != _NONE]
        kinds = self.kinds[at]
        goes_on = np.zeros(len(at), bool)
        goes_on[1:] = ((kinds[1:] == _NAME) & (kinds[:-1] == _NAME)) | ((kinds[1:] == _UNIT) & (kinds[:-1] == _NUMBER))
        return _Read(self, at, np.flatnonzero(~goes_on))


@dataclass(frozen=True)
class _Read:
    """Words of a text as places in the tables, and the word that each token starts with."""

    template: _Template
    words: np.ndarray
    starts: np.ndarray

    def hashes(self) -> np.ndarray:
        return self.template.hashes[self.words[self.starts]]

    def written(self) -> np.ndarray:
        """Hashes of the tokens as written."""
        return np.add.reduceat(self.template.written[self.words] * np.uint64(0xD6E8FEB86659FD93), self.starts)

    def plain(self) -> np.ndarray:
        return self.template.kinds[self.words[self.starts]] == _PLAIN

    def end(self, token: int) -> int:
        """The word after a token."""
        return int(self.starts[token + 1]) if token + 1 < len(self.starts) else len(self.words)

    def slots(self, first: int, last: int) -> list[str | None]:
        """Per token the kind and value of a slot, nothing for a plain word."""
        out = []
        for token in range(first, last):
            places = self.words[int(self.starts[token]) : self.end(token)]
            kind = self.template.kinds[places[0]]
            out.append(None if kind == _PLAIN else f"{kind}{''.join(self.template.forms[at] for at in places)}")
        return out


def _window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, size, np.uint64)
    for at in range(size):
        mixed = (out ^ hashes[at : at + count]) * np.uint64(0x9E3779B97F4A7C15)
        out = mixed ^ (mixed >> np.uint64(29))
    return out


def _windows(read: _Read, sizes: list[int], settings: Settings, wanted: np.ndarray | None) -> list[tuple]:
    """Hash, place, size, first word, word after, slots of each window, or of those with a wanted hash."""
    hashes, plain = read.hashes(), np.concatenate([[0], np.cumsum(read.plain())])
    out, written = [], None
    for size in sizes:
        found = _window_hashes(hashes, size)
        if not len(found):
            continue
        bare = np.flatnonzero(plain[size:] - plain[:-size] < min(settings.literals, size))
        if len(bare):
            written = read.written() if written is None else written
            found[bare] = ~_window_hashes(written, size)[bare]
        keep = np.arange(len(found))
        if wanted is not None:
            at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
            keep = np.flatnonzero(wanted[at] == found)
        out += [
            (
                int(found[at].astype(np.int64)), at, size, int(read.starts[at]), read.end(at + size - 1),
                read.slots(at, at + size),
            )
            for at in keep.tolist()
        ]
    return out


def benchmark_windows(benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Template windows of all items: item, its length in words and tokens, hash, place, slots."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = _Template()
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                read = template.read(text)
                length, tokens = len(read.words), len(read.starts)
                if length >= settings.shortest:
                    found = _windows(read, [min(settings.window, tokens)], settings, None)
                    rows += [(item, length, tokens, row[0], row[1], row[2], row[5]) for row in found]
            if rows:
                yield pd.DataFrame(rows, columns=["item_id", "length", "tokens", "hash", "item_place", "size", "item_slots"])

    texts = benchmark.where("item_id is not null").select("item_id", whole("text").alias("text")).distinct()
    return texts.mapInPandas(
        windows, "item_id long, length int, tokens int, hash long, item_place int, size int, item_slots array<string>"
    )


def _key() -> Column:
    """Rows with one id and one text are alike in every result."""
    return F.struct(F.col("doc_id"), F.xxhash64(whole("text")).alias("text_hash"))


def leaks(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``key`` (id and text hash), ``item_id``, ``start``, ``words``: runs of leaked benchmark text."""
    items = staged(benchmark_windows(benchmark, settings), "benchmark-windows")
    total, sizes = items.count(), [row.size_ for row in items.select(F.col("size").alias("size_")).distinct().collect()]
    # The count is the proof that the filter is small; beyond it the join does all the work.
    wanted = None
    if total <= settings.filter_windows:
        wanted = np.unique(np.array([row[0] for row in items.select("hash").distinct().collect()], np.int64).view(np.uint64))
    sizes = sorted(sizes)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = _Template()
        for batch in batches:
            rows = []
            if sizes and (wanted is None or len(wanted)):
                for at, text in enumerate(batch["text"]):
                    rows += [(at, *row) for row in _windows(template.read(text), sizes, settings, wanted)]
            if not rows:
                continue
            picked = [row[0] for row in rows]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].iloc[picked].to_numpy(),
                    "text_hash": batch["text_hash"].iloc[picked].to_numpy(),
                    "hash": [row[1] for row in rows],
                    "place": [row[2] for row in rows],
                    "size": [row[3] for row in rows],
                    "word": [row[4] for row in rows],
                    "after": [row[5] for row in rows],
                    "slots": [row[6] for row in rows],
                }
            )

    # An id may be null: as text it passes through the tasks unchanged.
    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), whole("text").alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )
    hits = texts.mapInPandas(
        windows, "doc_id string, text_hash long, hash long, place int, size int, word int, after int, slots array<string>"
    )
    matched = hits.join(items, ["hash", "size"]).where(
        F.forall(
            F.arrays_zip("slots", "item_slots"),
            lambda pair: F.left(pair["slots"], F.lit(1)).eqNullSafe(F.left(pair["item_slots"], F.lit(1))),
        )
    )
    runs = matched.groupBy("doc_id", "text_hash", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")).agg(
        F.first("length").alias("length"),
        F.first("tokens").alias("tokens"),
        # At most one window per word of the item.
        F.sort_array(F.collect_set(F.struct("place", "size", "word", "after", "slots", "item_slots"))).alias("windows"),
    )

    def longest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lists in batches:
            yield pd.DataFrame([_longest_run(list(windows)) for windows in lists], columns=["start", "words", "tokens"])

    longest.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    run = F.pandas_udf(longest, "start int, words int, tokens int")(F.col("windows"))
    id_type = documents.schema["doc_id"].dataType
    return (
        runs.withColumn("run", run)
        .where((F.col("run.words") >= F.least(F.lit(settings.least), F.col("length"))) | (F.col("run.tokens") >= F.col("tokens")))
        .select(
            F.struct(F.col("doc_id").cast(id_type).alias("doc_id"), "text_hash").alias("key"),
            "item_id",
            F.col("run.start").alias("start"),
            F.col("run.words").alias("words"),
        )
    )


def _longest_run(windows: list) -> tuple[int, int, int]:
    """First word, words and tokens of the longest stretch whose slots map one to one."""
    best, begin, end = (0, 0, 0), None, 0
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    for window in windows:
        pairs = [(a, b) for a, b in zip(window["item_slots"], window["slots"], strict=True) if a is not None]
        fits = all(there.get(a, b) == b and back.get(b, a) == a for a, b in pairs)
        own_there, own_back = dict(pairs), {b: a for a, b in pairs}
        own = len(set(pairs)) == len(own_there) == len(own_back)
        if begin is None or window["place"] > end or not fits or not own:
            if not own:
                begin = None
                continue
            begin, there, back = window, {}, {}
        there.update(own_there)
        back.update(own_back)
        end = window["place"] + window["size"]
        best = max(best, (end - begin["place"], window["after"] - begin["word"], -begin["word"]))
    return -best[2], best[1], best[0]


def report(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document row: ``n_leaks``, ``items`` (ids in order) and ``contaminated``.

    Null and empty texts have no leaks; null item ids and texts match nothing.
    Rows with one id and one text get equal results.
    """
    found = leaks(documents, benchmark, settings).groupBy("key").agg(
        F.count(F.lit(1)).alias("n_leaks"), F.sort_array(F.collect_set("item_id")).alias("items")
    )
    rows = documents.select("doc_id", _key().alias("key"))
    return rows.join(found, rows["key"].eqNullSafe(found["key"]), "left").select(
        "doc_id",
        F.coalesce("n_leaks", F.lit(0)).cast("long").alias("n_leaks"),
        F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"),
        F.when(F.col("n_leaks") > 0, 1).otherwise(0).alias("contaminated"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents without a leak, all columns as they are."""
    found = leaks(documents, benchmark, settings).select(F.col("key").alias("_leaked")).distinct()
    rows = documents.select(F.struct("*").alias("_row"), _key().alias("_key"))
    return rows.join(found, F.col("_key").eqNullSafe(F.col("_leaked")), "left_anti").select("_row.*")
