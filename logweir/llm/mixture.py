"""Mixing sources to target weights by exact block quotas.

Each source is laid out in hashed order and cut into blocks of a fixed number
of words.  A source's target becomes an exact number of block draws: whole
passes over the source, then a permuted subset.  The draws of all sources are
split among output shards by a tree: at each node the left half receives a
multivariate hypergeometric share of the node's draws.  Every shard walks its
own path of that tree, so no draw depends on another task, and shards get
disjoint ranges of each source's permuted blocks, shuffled locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import whole
from logweir.operators.ordered import running
from logweir.session import staged


@dataclass(frozen=True)
class Settings:
    """``weights`` repeat over the sources by code point; no source is taken more than ``most`` times.

    Blocks have ``block`` words at every size.
    """

    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    most: int = 3
    block: int = 512
    shard_words: int = 1 << 20
    seed: int = 20


WORD = r"[^\x20\x09-\x0D]+"


def words(column: str = "text") -> Column:
    return F.regexp_count(whole(column), F.lit(WORD)).cast("long")


def targets(sizes: list[int], settings: Settings = Settings()) -> list[float]:
    """Words to take per source: weighted shares of all words, none above ``most`` times its size."""
    weights = [settings.weights[at % len(settings.weights)] for at in range(len(sizes))]
    caps = [float(settings.most * size) for size in sizes]
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        share = left / sum(weights[at] for at in open_)
        full = {at for at in open_ if share * weights[at] > caps[at]}
        if not full:
            for at in open_:
                out[at] = share * weights[at]
            break
        for at in full:
            out[at] = caps[at]
            left -= caps[at]
        open_ -= full
    return out


@dataclass(frozen=True)
class Source:
    """Draws of one source: whole passes over ``blocks`` blocks, then ``draws`` in all."""

    size: int
    block: int
    blocks: int  # with a shorter one at the end, if any
    full: int  # of the full length
    draws: int
    last: int  # words that the last draw takes

    @staticmethod
    def plan(size: int, target: float, block: int) -> Source:
        blocks, full, wanted = -(-size // block), size // block, round(target)
        if not size or not wanted:
            return Source(size, block, blocks, full, 0, 0)
        passes, rest = divmod(wanted, size)
        draws = passes * blocks + -(-rest // block)
        # Whole passes end with the short block; a partial pass ends where its words are used up.
        last = rest - (-(-rest // block) - 1) * block if rest else size - (blocks - 1) * block
        return Source(size, block, blocks, full, draws, last)


def _permute(places: np.ndarray, size: int, key: int) -> np.ndarray:
    """A bijection on 0..size-1: a small Feistel network, walked until it lands inside."""
    if size <= 1:
        return places
    half = max(1, -(-(int(size - 1).bit_length()) // 2))
    mask, out = np.uint64((1 << half) - 1), places.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for turn in range(4):
            mixed = (right + np.uint64((key + 1) * 0x9E3779B97F4A7C15 + turn * 0xBF58476D1CE4E5B9 & (2**64 - 1))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(27)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= np.uint64(size)
    return out.astype(np.int64)


def _log_factorials(x: int, y: int) -> float:
    """``log(x! / y!)``, precise for large neighbours too."""
    if min(x, y) < 1000:
        return math.lgamma(x + 1) - math.lgamma(y + 1)
    step = x - y
    return (y + 0.5) * math.log1p(step / y) + step * (math.log(x) - 1) + (1 / x - 1 / y) / 12


def hypergeometric(random: np.random.Generator, good: int, bad: int, wanted: int) -> int:
    """How many of ``wanted`` draws without replacement are good, for populations of any size.

    The generator counts up to a thousand million; beyond, candidates from a
    ratio of uniforms around the mean are accepted by their exact chance.
    """
    if good + bad < 1_000_000_000:
        return int(random.hypergeometric(good, bad, wanted))
    low, high = max(0, wanted - bad), min(wanted, good)
    if low == high:
        return low
    total = good + bad
    spread = math.sqrt(wanted * (good / total) * (bad / total) * ((total - wanted) / (total - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    top = (wanted + 1) * (good + 1) // (total + 2)
    # From the mode, so that numbers beyond the precision of a double stay whole.
    middle = wanted * good / total - top + 0.5
    while True:
        u, v = 1.0 - random.random(), random.random()
        found = top + math.floor(middle + width * (v - 0.5) / u)
        if low <= found <= high:
            chance = -(
                _log_factorials(found, top) + _log_factorials(good - found, good - top)
                + _log_factorials(wanted - found, wanted - top) + _log_factorials(bad - wanted + found, bad - wanted + top)
            )
            if 2 * math.log(u) <= chance:
                return found


def _quotas(shard: int, shards: int, draws: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First draw and number of draws of each source for one shard, along its path of the tree."""
    total = int(draws.sum())
    low, high, first, own = 0, shards, np.zeros(len(draws), np.int64), draws.copy()
    while high - low > 1:
        middle = (low + high) // 2
        wanted = total * middle // shards - total * low // shards
        random = np.random.default_rng([seed, low, high])
        left, rest = np.zeros(len(draws), np.int64), int(own.sum())
        for at, count in enumerate(own):
            rest -= int(count)
            left[at] = hypergeometric(random, int(count), rest, wanted) if wanted and count else 0
            wanted -= int(left[at])
        if shard < middle:
            own, high = left, middle
        else:
            first, own, low = first + left, own - left, middle
    return first, own


def _draws(shard: int, shards: int, sources: list[Source], seed: int) -> pd.DataFrame:
    """The blocks of one shard in their local order: source, block, words taken of it."""
    first, own = _quotas(shard, shards, np.array([source.draws for source in sources], np.int64), seed)
    parts = []
    for at, source in enumerate(sources):
        slots = np.arange(first[at], first[at] + own[at])
        if not len(slots):
            continue
        turns, places = slots // source.blocks, slots % source.blocks
        blocks = places.copy()
        for turn in np.unique(turns):
            inside = (turns == turn) & (places < source.full)
            blocks[inside] = _permute(places[inside], source.full, seed * 1_000_003 + at * 1009 + int(turn))
        length = np.minimum(source.block, source.size - blocks * source.block)
        length[slots == source.draws - 1] = np.minimum(length[slots == source.draws - 1], source.last)
        parts.append(pd.DataFrame({"source_at": np.int32(at), "block": blocks, "length": length}))
    if not parts:
        return pd.DataFrame({"source_at": [], "block": [], "length": [], "shard": [], "place": []}).astype("int64")
    out = pd.concat(parts, ignore_index=True)
    out = out.iloc[np.random.default_rng([seed, shards, shard]).permutation(len(out))].reset_index(drop=True)
    return out.assign(shard=np.int64(shard), place=np.arange(len(out)))


@dataclass(frozen=True)
class Mix:
    """``laid``: documents with size, source figures and place; ``parts``: what each shard holds."""

    laid: DataFrame
    parts: DataFrame


def mix(documents: DataFrame, settings: Settings = Settings()) -> Mix:
    """Lay the documents out and draw the mix.

    ``laid`` has a row per row of documents: ``doc_id, source, size,
    source_size, target, source_at, start`` with ``start`` the words before it
    in its source.  ``parts`` has ``shard, place, block_at`` and the words
    ``from_word`` to ``to_word`` of a document, with its ``source_at, start,
    size``.  A null source is a source of its own, the last; null and empty
    texts have size 0 and are never drawn.  Rows with one id are told apart by
    their start.
    """
    spark = documents.sparkSession
    sized = staged(
        documents.select(
            F.col("doc_id"),
            "source",
            words().alias("size"),
            F.xxhash64(F.lit(settings.seed), F.col("doc_id").cast("string"), whole("text")).alias("_order"),
        ),
        "mixture-sizes",
    )
    # One row per source, as many as the mixture has weights for.
    sums = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    sums.sort(key=lambda row: (row["source"] is None, row["source"] or ""))
    wanted = targets([row["size"] for row in sums], settings)
    rows = sum(row["rows"] for row in sums)
    block = settings.block
    sources = [Source.plan(row["size"], target, block) for row, target in zip(sums, wanted, strict=True)]
    table = spark.createDataFrame(
        [(row["source"], at, row["size"], target) for at, (row, target) in enumerate(zip(sums, wanted, strict=True))],
        "_source string, source_at int, source_size long, target double",
    )
    bits = max(0, min(16, (max(rows, 1) // 2048).bit_length()))
    placed = sized.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    laid = staged(
        running(
            placed,
            ["source_at"],
            ["_order", "doc_id", "size"],
            sums={"_end": F.col("size")},
            block=F.shiftright("_order", 64 - bits) if bits else F.lit(0),
        ).select("doc_id", "source", "size", "source_size", "target", "source_at", (F.col("_end") - F.col("size")).alias("start")),
        "mixture-places",
    )
    shards = max(1, -(-sum(source.draws for source in sources) * block // settings.shard_words))
    seed = settings.seed

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                yield _draws(int(shard), shards, sources, seed)

    draws = spark.range(shards).mapInPandas(draw, "source_at int, block long, length long, shard long, place long")
    pieces = (
        laid.where("size > 0")
        .select("doc_id", "source_at", "start", "size")
        .withColumn(
            "block",
            F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))),
        )
    )
    begin = F.col("block") * block
    parts = (
        # Spark takes the draws for as small as the shards they come from.
        draws.hint("merge").join(pieces, ["source_at", "block"])
        .withColumn("from_word", F.greatest(begin - F.col("start"), F.lit(0).cast("long")))
        .withColumn("to_word", F.least(begin + F.col("length") - F.col("start"), F.col("size")))
        .where("to_word > from_word")
        .select("shard", "place", "doc_id", "source_at", "start", "size", "from_word", "to_word")
    )
    return Mix(laid, parts)


def taken(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of documents: ``doc_id, size, source_size, target, taken``.

    Null and empty texts have size 0 and nothing taken; a null source is the
    last source.  Repeated rows are documents of their own; an empty table
    gives no rows.
    """
    mixed = mix(documents, settings)
    sums = mixed.parts.groupBy("source_at", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("_taken"))
    # Documents with words have starts of their own.
    return mixed.laid.join(sums, ["source_at", "start"], "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(0).cast("long").alias("taken"),
    )
