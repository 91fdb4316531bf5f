"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled texts: one on ordinary
windows, one on the fragments that toxic texts have and ordinary texts lack.
A text is cut into short overlapping windows; each is compressed with the
ordinary dictionary alone and with both dictionaries together.  How many bytes
the toxic dictionary saves tells how toxic a window is.  Log-likelihood ratios
for each saving, and the weights that turn a document's savings into a score,
are calibrated on labelled documents that trained no dictionary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import smallest_by_hash, whole


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and shape of the windows.

    ``per_class`` documents of each class train the dictionaries and as many
    calibrate; of a training text the dictionaries see one slice of ``slice_chars``
    characters.  The ordinary dictionary is trained on ``piece_bytes`` of every
    ``stride_bytes`` of a slice, on at most ``pieces`` of them, chosen by a hash.
    Scoring always sees whole texts.
    """

    window: int = 40
    step: int = 32
    level: int = 10
    per_class: int = 2500
    slice_chars: int = 20_000
    piece_bytes: int = 64
    stride_bytes: int = 512
    pieces: int = 60_000
    gram: int = 5
    ratio: float = 10.0
    least_documents: int = 4
    ordinary_bytes: int = 7000
    toxic_bytes: int = 5000


_BINS = 41
_MID = 20


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    both: bytes
    ratios: tuple[float, ...]
    weights: tuple[float, ...]
    settings: Settings


def _grams(text: bytes, size: int) -> np.ndarray:
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    count = len(data) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for place in range(size):
        out = (out << np.uint64(8)) | data[place : place + count]
    return out


def _document_counts(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    seen = [np.unique(_grams(text, size)) for text in texts]
    return np.unique(np.concatenate(seen or [np.empty(0, np.uint64)]), return_counts=True)


def _contrast(toxic: list[bytes], ordinary: list[bytes], settings: Settings) -> list[bytes]:
    """Fragments of toxic texts made of n-grams that ordinary texts hardly have."""
    grams, count = _document_counts(toxic, settings.gram)
    common, common_count = _document_counts(ordinary, settings.gram)
    other = np.zeros(len(grams))
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        other = np.where(common[at] == grams, common_count[at], 0)
    share = count / max(len(toxic), 1)
    marked = grams[
        (count >= settings.least_documents) & (share > settings.ratio * (other + 0.5) / max(len(ordinary), 1))
    ]
    fragments = []
    for text in toxic:
        hit = np.isin(_grams(text, settings.gram), marked)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        for start, end in zip(edges[::2], edges[1::2], strict=True):
            fragments.append(text[max(0, start - 1) : end + settings.gram - 1])
    return fragments


def _pieces(texts: list[bytes], settings: Settings) -> list[bytes]:
    """Short pieces at even distances; of too many those with the smallest hashes of text and place."""
    size, found = settings.piece_bytes, []
    for text in texts:
        whole_text = hashlib.blake2b(text, digest_size=8)
        for at in range(len(text) % size if len(text) > size else 0, len(text), settings.stride_bytes):
            mark = whole_text.copy()
            mark.update(b"at%d" % at)
            found.append((mark.digest(), text[at : at + size]))
    if len(found) > settings.pieces:
        bound = sorted(mark for mark, _ in found)[settings.pieces - 1]
        found = [row for row in found if row[0] <= bound][: settings.pieces]
    return [piece for _, piece in found]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """The content of a trained dictionary; too few samples are joined as they are."""
    samples = [sample.ljust(8) for sample in samples if len(sample) > 4]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:]


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        level=level, dict_data=data, write_content_size=False, write_dict_id=False, write_checksum=False
    )


def _savings(text: str, ordinary, both, settings: Settings) -> np.ndarray:
    """How often each saving occurs in the windows of a whole text."""
    data = text.lower().encode("utf-8", "replace")
    window, last = settings.window, max(1, len(data) - (settings.window - settings.step))
    alone, helped = ordinary.compress, both.compress
    saved = [len(alone(part)) - len(helped(part)) for part in (data[at : at + window] for at in range(0, last, settings.step))]
    return np.bincount(np.clip(np.array(saved) + _MID, 0, _BINS - 1), minlength=_BINS)


def _features(counts: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Of each row of savings: sum, mean and maximum of the ratios, strong windows, length."""
    total = counts.sum(axis=1)
    summed = counts @ ratios
    top = np.where(counts > 0, ratios, -np.inf).max(axis=1)
    strong = counts[:, ratios > 1.5].sum(axis=1)
    return np.column_stack(
        [
            np.sign(summed) * np.log1p(np.abs(summed)),
            np.maximum(summed, 0) / np.sqrt(total),
            summed / total,
            top,
            np.log1p(strong),
            strong / total,
            np.log(total),
            np.ones(len(counts)),
        ]
    )


def _logistic(features: np.ndarray, labels: np.ndarray, importance: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    weights = np.zeros(features.shape[1])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        gradient = features.T @ (importance * (labels - chance)) - ridge * weights
        curve = (features * (importance * chance * (1 - chance))[:, None]).T @ features + ridge * np.eye(len(weights))
        move = np.linalg.solve(curve, gradient)
        weights += move
        if np.abs(move).max() < 1e-6:
            break
    return weights


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Train on a bounded sample of labelled rows; rows of the held-out fold never take part.

    Null labels are skipped, a document with several labels counts as toxic if
    one says so; of ids that many rows share, no more than ``4 * per_class``
    rows in all are used.  None when either class has no rows to learn from.  In the
    calibration each class weighs as much as among all rows of the fold, however
    many of them the sample holds, so a score means the same at every size.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("_toxic"))
    )
    # Bounded by the settings: at most 4 * per_class short rows.
    picked = [
        smallest_by_hash(known.where(F.col("_toxic") == value), "doc_id", 2 * settings.per_class, "toxicity")
        for value in (1, 0)
    ]
    sample = picked[0].unionByName(picked[1])
    totals = {row["_toxic"]: row["count"] for row in known.groupBy("_toxic").count().collect()}
    rows = (
        documents.select("doc_id", whole("text").alias("_text"))
        .join(F.broadcast(sample), "doc_id")
        .withColumn("_half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)))
    )
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.char_length("_text") - settings.slice_chars + 1))
    slices = (
        rows.where("_half = 0")
        .select("doc_id", "_toxic", F.substring("_text", start.cast("int") + 1, F.lit(settings.slice_chars)).alias("_text"))
        .orderBy("doc_id", "_text")
        .limit(4 * settings.per_class)
        .collect()
    )
    texts = {value: [row._text.lower().encode() for row in slices if row._toxic == value] for value in (0, 1)}
    if not texts[0] or not texts[1]:
        return None
    general = _dictionary(_pieces(texts[0], settings), settings.ordinary_bytes)
    special = _dictionary(_contrast(texts[1], texts[0], settings), settings.toxic_bytes)
    both = special + general

    def savings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = _compressor(general or b" " * 8, settings.level), _compressor(both, settings.level)
        for batch in batches:
            counts = [_savings(text, first, second, settings).tolist() for text in batch["_text"]]
            yield pd.DataFrame({"_toxic": batch["_toxic"], "counts": counts})

    found = (
        rows.where("_half = 1")
        .select("_toxic", "_text")
        .mapInPandas(savings, "_toxic int, counts array<long>")
        .orderBy("_toxic", "counts")
        .limit(4 * settings.per_class)
        .collect()
    )
    if len({row._toxic for row in found}) < 2:
        return None
    counts = np.array([row.counts for row in found], float)
    truth = np.array([row._toxic for row in found], float)
    shares = [counts[truth == value].sum(axis=0) + 1.0 for value in (0, 1)]
    ratios = np.log(shares[1] / shares[1].sum()) - np.log(shares[0] / shares[0].sum())
    # One over the chance that a row of the class is in the sample; 1 for all where no bound is reached.
    stands_for = [max(1.0, totals[value] / (2 * settings.per_class)) for value in (0, 1)]
    importance = np.where(truth == 1, stands_for[1], stands_for[0])
    weights = _logistic(_features(counts, ratios), truth, importance / importance.mean())
    return Model(general or b" " * 8, both, tuple(ratios), tuple(weights), settings)


def score(documents: DataFrame, model: Model | None, *, column: str = "toxicity") -> DataFrame:
    """Add the chance that a text is toxic, from its whole text alone.

    A null text counts as empty; an empty text is one empty window.  Without a
    model every score is 0.
    """
    if model is None:
        return documents.withColumn(column, F.lit(0.0))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        first, second = _compressor(model.ordinary, model.settings.level), _compressor(model.both, model.settings.level)
        ratios, weights = np.array(model.ratios), np.array(model.weights)
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=float)
                continue
            counts = np.array([_savings(text, first, second, model.settings) for text in batch], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(_features(counts, ratios) @ weights, -30, 30))))

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return documents.withColumn(column, F.pandas_udf(scored, "double")(whole("text")))


def classify(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of documents.

    Null and empty texts get the score of one empty window, a null id is not
    held out, a score of exactly 0.5 is predicted toxic.  Repeated rows get
    equal scores; an empty table gives no rows.  Other columns are left out.
    """
    scored = score(documents.select("doc_id", "text"), fit(documents, labels, settings), column="score")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
