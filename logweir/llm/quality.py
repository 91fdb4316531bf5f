"""Text quality from weak labels.

Overlapping heuristics vote good, bad or nothing on every text.  An
expectation-maximisation over the counts of vote patterns estimates how
accurate each heuristic is and what each pattern implies, with no labelled
data.  The implied labels of a bounded sample train a linear scorer on hashed
word shapes, which then scores every whole text.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import smallest_by_hash, whole


@dataclass(frozen=True)
class Settings:
    """``sample`` texts at most train the scorer; the votes of all texts are counted."""

    sample: int = 4000
    buckets: int = 2048
    rounds: int = 100
    steps: int = 250
    threshold: float = 0.5


#: Each heuristic: its name, and from which value on it votes bad or, on the other side, good.
HEURISTICS = (
    ("symbols", 0.04, 0.01),
    ("capitals", 0.30, 0.10),
    ("stutter", 0.15, 0.03),
    ("repeats", 0.30, 0.08),
    ("bangs", 0.15, 0.03),
    ("separators", 0.10, 0.02),
    ("few_function_words", 0.97, 0.90),
    ("no_sentences", 0.995, 0.97),
)

#: Frequent function words of the supported languages.
FUNCTION_WORDS = frozenset(
    "a an and are as at be by for from he in is it of on that the this to was with "
    "au avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "auf das dem den der die ein eine für ich im in ist mit nicht sich und von zu "
    "al como con del el ella es la las lo los no para por que se su un una y".split()
)


#: Longest run of characters without blanks that is one token for the scorer.
_PIECE = 40


#: Marks that are no symbols.
_PLAIN = ".,;:!?'\"()-"


@cache
def _classes() -> np.ndarray:
    """For every code point: 1 blank, 2 letter, 4 capital, 8 symbol, added up."""
    marks = map(chr, range(sys.maxunicode + 1))
    return np.fromiter(
        (
            mark.isspace() + 2 * mark.isalpha() + 4 * mark.isupper() + 8 * (not (mark.isalnum() or mark.isspace() or mark in _PLAIN))
            for mark in marks
        ),
        np.uint8,
        sys.maxunicode + 1,
    )


def _marks(text: str) -> tuple[int, int, int, int]:
    """How many characters of a text are not blank, letters, capitals and symbols."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(_classes()[points], minlength=16)
    return tuple(int(sum(counts[at] for at in range(16) if bool(at & bit) == (bit > 1))) for bit in (1, 2, 4, 8))


class _Words(dict):
    """Words to numbers with a fact each; made on first sight, all forgotten when there are too many."""

    def __init__(self):
        super().__init__()
        self.facts: list[int] = []

    def fact(self, word: str) -> int:
        raise NotImplementedError

    def __missing__(self, word: str) -> int:
        at = len(self.facts)
        self.facts.append(self.fact(word))
        self[word] = at
        return at

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number and fact of each word."""
        if len(self) > 300_000:
            self.clear()
            self.facts.clear()
        numbers = list(map(self.__getitem__, words))
        return np.array(numbers, np.int64), np.array(list(map(self.facts.__getitem__, numbers)), np.int64)


class _Votes(_Words):
    """Facts of a word that votes need: 1 ends a sentence, 2 is a function word, 4 is symbols without a letter."""

    def fact(self, word: str) -> int:
        core = word.strip(".,;:!?")
        fact = (word[-1] in ".!?") + 2 * (core.lower() in FUNCTION_WORDS)
        if core and not core.isalnum() and not any(map(str.isalpha, core)):
            fact += 4 * any(not mark.isalnum() and mark not in _PLAIN for mark in core)
        return fact


class _Kinds(dict):
    """Code point to its kind: a capital, a letter, a digit, or itself."""

    def __missing__(self, point: int) -> str:
        mark = chr(point)
        self[point] = kind = "A" if mark.isupper() else "a" if mark.isalpha() else "9" if mark.isdigit() else mark
        return kind


_KINDS, _RUNS = _Kinds(), re.compile(r"(.)\1+", re.DOTALL)


class _Shapes(_Words):
    """The bucket of a word's shape: its kinds of characters, equal neighbours as one."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets
        self.known: dict[str, int] = {}

    def fact(self, word: str) -> int:
        if word.isascii() and word.isalpha() and word.islower():
            shape = "a"
        else:
            shape = _RUNS.sub(r"\1", word.translate(_KINDS))
        found = self.known.get(shape)
        if found is None:
            found = zlib.crc32(shape.encode("utf-8", "replace")) % self.buckets
            if len(self.known) < 300_000:
                self.known[shape] = found
        return found

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Number and shape of each token of a text: its words, long ones in pieces, so that no character is left out."""
        words = text.split()
        if max(map(len, words), default=0) > _PIECE:
            words = [word[at : at + _PIECE] for word in words for at in range(0, len(word), _PIECE)]
        return self.look_up(words)


def _repeats(words: np.ndarray) -> int:
    """How many runs of four words occurred before in the text."""
    count = len(words) - 3
    if count < 2:
        return 0
    joined = np.zeros(count, np.uint64)
    for place in range(4):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + words[place : count + place].astype(np.uint64)
    return count - len(np.unique(joined))


def _measures(text: str, words: np.ndarray, facts: np.ndarray) -> list[float]:
    """The value each heuristic looks at, in the order of ``HEURISTICS``."""
    count = len(words)
    marks, letters, capitals, symbols = _marks(text)
    same = (words[1:] == words[:-1]).mean() if count > 1 else 0.0
    repeated = _repeats(words) / (count - 3) if count >= 8 else 0.0
    ends, functions, separators = ((facts & bit > 0).mean() for bit in (1, 2, 4))
    return [
        symbols / max(marks, 1),
        capitals / max(letters, 1),
        same,
        repeated,
        (text.count("!") + text.count("?")) / count,
        separators,
        1 - functions if count >= 10 else 0.93,
        1 - ends if count >= 30 else 0.98,
    ]


def _votes(text: str, known: _Votes) -> str:
    """One character per heuristic: b, g, or - where it does not say."""
    words = text.split()
    if not words:
        return "b" * len(HEURISTICS)
    values = _measures(text, *known.look_up(words))
    return "".join(
        "b" if value >= bad else "g" if value <= good else "-"
        for value, (_, bad, good) in zip(values, HEURISTICS, strict=True)
    )


def _hashed(word: np.ndarray, shape: np.ndarray, buckets: int) -> np.ndarray:
    """Roots of the shares of hashed shapes, pairs of shapes, word echoes, and repeated runs of four words."""
    out = np.zeros(buckets)
    if len(word):
        pairs = (shape[:-1] * 31 + shape[1:] + 7) % buckets
        echo = [(1009 * gap) % buckets for gap in (1, 2, 3)]
        out += np.bincount(shape, minlength=buckets)
        out += np.bincount(pairs, minlength=buckets)
        for gap, place in zip((1, 2, 3), echo, strict=True):
            out[place] += 4 * (word[gap:] == word[:-gap]).sum()
        out[11 % buckets] += 4 * _repeats(word)
        out = np.sqrt(out / len(word))
    return out


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts and, per heuristic, the chance of a good and a bad vote for good and for bad texts."""

    good: float
    chances: tuple[tuple[tuple[float, float], tuple[float, float]], ...]

    def posterior(self, votes: str) -> float:
        logs = [np.log(self.good), np.log(1 - self.good)]
        for vote, pair in zip(votes, self.chances, strict=True):
            for side in (0, 1):
                # A heuristic that does not say tells nothing: a short text has few votes.
                logs[side] += np.log(pair[side]["gb".index(vote)]) if vote != "-" else 0.0
        top = max(logs)
        weights = [np.exp(value - top) for value in logs]
        return float(weights[0] / sum(weights))


def estimate(patterns: list[tuple[str, int]], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over counted vote patterns; starts from the majority of votes."""
    size = len(HEURISTICS)
    counts = np.array([count for _, count in patterns], float)
    seen = np.array([["gb-".index(vote) for vote in votes] for votes, _ in patterns]).reshape(-1, size)
    # One bad vote says more than one good vote: most heuristics see one kind of defect each.
    good = 1 / (1 + np.exp(-((seen == 0).sum(axis=1) - 4.0 * (seen == 1).sum(axis=1))))
    chances = np.full((size, 2, 3), 0.5)
    share = 0.5
    for _ in range(rounds):
        share = float(np.clip((counts * good).sum() / counts.sum(), 0.02, 0.98))
        for place in range(size):
            for side, weight in enumerate((good, 1 - good)):
                votes = np.bincount(seen[:, place], weights=counts * weight, minlength=3)[:2] + 0.5
                chances[place, side, :2] = votes / votes.sum()
                chances[place, side, 2] = 1.0
        logs = np.log([share, 1 - share])[:, None] + np.array(
            [sum(np.log(chances[place, side, seen[:, place]]) for place in range(size)) for side in (0, 1)]
        )
        good = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
    return LabelModel(share, tuple(tuple(tuple(map(float, side[:2])) for side in pair) for pair in chances))


@dataclass(frozen=True)
class Scorer:
    weights: tuple[float, ...]
    bias: float
    labels: LabelModel
    settings: Settings


def vote(text: Column, settings: Settings) -> Column:
    def votes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _Votes()
        for batch in batches:
            yield pd.Series([_votes(value, words) for value in batch], dtype=object)

    votes.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(votes, "string")(text)


def fit(documents: DataFrame, settings: Settings = Settings()) -> Scorer | None:
    """Votes over all texts, label model, then the scorer from a bounded sample; None without texts."""
    patterns = (
        documents.select(vote(whole("text"), settings).alias("votes")).groupBy("votes").count().orderBy("votes").collect()
    )  # at most 3 to the number of heuristics rows
    if not patterns:
        return None
    model = estimate([(row["votes"], row["count"]) for row in patterns], settings.rounds)
    chosen = smallest_by_hash(documents.select("doc_id").where("doc_id is not null"), "doc_id", settings.sample, "quality")
    sample = documents.select("doc_id", whole("text").alias("_text")).join(F.broadcast(chosen.distinct()), "doc_id")

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, shapes = _Votes(), _Shapes(settings.buckets)
        for batch in batches:
            vectors = [_hashed(*shapes.tokens(text), settings.buckets) for text in batch["_text"]]
            kept = [np.flatnonzero(vector) for vector in vectors]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "votes": [_votes(text, words) for text in batch["_text"]],
                    "places": [at.tolist() for at in kept],
                    "values": [vector[at].astype("float32").tolist() for vector, at in zip(vectors, kept, strict=True)],
                }
            )

    found = (
        sample.mapInPandas(examples, "doc_id long, votes string, places array<int>, values array<float>")
        .orderBy("doc_id", "votes")
        .limit(2 * settings.sample)
        .collect()
    )
    if not found:
        return Scorer((0.0,) * settings.buckets, 4.0, model, settings)
    matrix = np.zeros((len(found), settings.buckets), np.float32)
    for at, row in enumerate(found):
        matrix[at, row.places] = row["values"]
    truth = np.array([model.posterior(row.votes) for row in found])
    weights, bias = _descend(matrix, truth, settings.steps)
    return Scorer(tuple(weights.tolist()), bias, model, settings)


def _descend(matrix: np.ndarray, truth: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient steps with momentum; both classes weigh the same."""
    weights, bias = np.zeros(matrix.shape[1], np.float32), 0.0
    speed, speed_bias = np.zeros_like(weights), 0.0
    share = float(np.clip(truth.mean(), 0.02, 0.98))
    importance = truth / share + (1 - truth) / (1 - share)
    importance /= importance.sum()
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(matrix @ weights + np.float32(bias), -30, 30)))
        error = ((chance - truth) * importance).astype(np.float32)
        speed = (0.9 * speed - 2.0 * (error @ matrix + 1e-5 * weights)).astype(np.float32)
        speed_bias = 0.9 * speed_bias - 2.0 * error.sum()
        weights, bias = weights + speed, bias + speed_bias
    return weights, float(bias)


def score(documents: DataFrame, scorer: Scorer | None, *, column: str = "quality") -> DataFrame:
    """Add the chance that a text is good, from its whole text; an empty or null text scores 0.

    Without a scorer (no documents to fit on) nothing is scored and the column is null.
    """
    if scorer is None:
        return documents.withColumn(column, F.lit(None).cast("double"))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shapes = _Shapes(scorer.settings.buckets)
        weights = np.array(scorer.weights)
        for batch in batches:
            out = []
            for text in batch:
                word, shape = shapes.tokens(text)
                value = _hashed(word, shape, scorer.settings.buckets) @ weights + scorer.bias
                out.append(1 / (1 + np.exp(-np.clip(value, -30, 30))) if len(word) else 0.0)
            yield pd.Series(out, dtype=float)

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return documents.withColumn(column, F.pandas_udf(scored, "double")(whole("text")))


def classify(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``score`` and ``accepted`` (1 from the threshold on) for every row.

    Null and empty texts score 0 and are not accepted; equal texts score alike.
    An empty table gives no rows; other columns are left out.
    """
    scored = score(documents.select("doc_id", "text"), fit(documents, settings), column="score")
    accepted = F.when(F.col("score") >= settings.threshold, 1).otherwise(0)
    return scored.select("doc_id", "score", accepted.alias("accepted"))


def keep_good(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that the scorer accepts, all columns as they are.

    Null and empty texts are bad and go.  Repeated rows stay or go together; an
    empty table stays empty.
    """
    scorer = fit(documents, settings)
    rows = documents.select(F.struct("*").alias("_row"), F.col("text"))
    return score(rows, scorer, column="_quality").where(F.col("_quality") >= settings.threshold).select("_row.*")
