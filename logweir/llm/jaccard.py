"""Near-duplicate join on word n-grams by a MinHash forest with exact verification.

A text is the set of its five-word shingles.  Texts with one set are one
class.  Classes get a signature per tree; the sorted signatures of a tree are a
prefix trie, and two classes are candidates where they share a node.  The
matched prefixes start at the longest length that finds every pair at the
threshold with the wanted chance, and are shortened while the links found so
far show that too many are missed.  Candidates are verified on their whole
shingle sets, each pair in the first tree that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import whole
from logweir.llm.components import components
from logweir.session import staged


@dataclass(frozen=True)
class Settings:
    """``trees`` signatures of ``depth`` hashes; nodes are worked on in blocks of ``block`` classes."""

    words: int = 5
    threshold: float = 0.8
    trees: int = 16
    depth: int = 8
    recall: float = 0.99
    block: int = 384

    def chance(self, similarity: float, depth: int) -> float:
        """That a pair shares a prefix of this length in some tree."""
        return 1 - (1 - similarity**depth) ** self.trees

    def first_depth(self) -> int:
        return next((d for d in range(self.depth, 1, -1) if self.chance(self.threshold, d) >= self.recall), 1)


class _Hashes(dict):
    """Word to its 64-bit hash; emptied when it grows too large."""

    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return value


def shingles(text: str, hashes: _Hashes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of lower-case words; a shorter text is one n-gram."""
    if len(hashes) > 500_000:
        hashes.clear()
    found = np.array(list(map(hashes.__getitem__, text.lower().split())), np.uint64)
    if not len(found):
        return found
    size = min(words, len(found))
    out = np.full(len(found) - size + 1, size, np.uint64)
    for at in range(size):
        out = (out ^ found[at : at + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def _multipliers(settings: Settings) -> np.ndarray:
    random = np.random.default_rng(5)
    return random.integers(1, 2**63, settings.trees * settings.depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signature(found: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    out = np.full(len(multipliers), np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1024):
        part = found[at : at + 1024]
        out = np.minimum(out, (part[None, :] * multipliers[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sign(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``text_hash``, the digest of the shingle set and its signature, per row."""
    multipliers = _multipliers(settings)

    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for batch in batches:
            rows = []
            for text in batch:
                found = shingles(text, hashes, settings.words)
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest()
                rows.append((digest, _signature(found, multipliers).tolist() if len(found) else None))
            yield pd.DataFrame(rows, columns=["digest", "signature"])

    signed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    marks = F.pandas_udf(signed, "digest string, signature array<int>")
    return (
        documents.select("doc_id", whole("text").alias("text"))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), marks("text").alias("_marks"))
        .select("doc_id", "text_hash", "_marks.*")
    )


def _prefix(tree: int, depth: int, settings: Settings):
    return F.xxhash64(F.lit(tree), F.slice("signature", tree * settings.depth + 1, depth))


def _nodes(classes: DataFrame, depth: int, before: int | None, settings: Settings) -> DataFrame:
    """``tree``, ``node``, ``digest``, ``size``: trie nodes with pairs that no earlier tree or longer prefix has."""
    paths = classes.where("signature is not null").select(
        "digest", F.posexplode(F.array(*[_prefix(tree, depth, settings) for tree in range(settings.trees)])).alias("tree", "node")
    )
    shared = paths.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    members = staged(paths.join(shared, ["tree", "node"]), "forest-nodes")
    # A node whose members all share an earlier tree's node, or a longer prefix, brings nothing new.
    known = [_prefix(tree, depth, settings) for tree in range(settings.trees)]
    if before:
        known += [_prefix(tree, before, settings) for tree in range(settings.trees)]
    numbered = members.select("digest").distinct().join(classes, "digest").select("digest", *[k.alias(f"_p{at}") for at, k in enumerate(known)])
    same = [
        ((F.min(f"_p{at}") == F.max(f"_p{at}")) & ((F.lit(at) < F.col("tree")) if at < settings.trees else F.lit(True))).alias(f"_s{at}")
        for at in range(len(known))
    ]
    nodes = members.join(numbered, "digest").groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size"), *same)
    fresh = nodes.where(~F.greatest(*[F.col(f"_s{at}").cast("int") for at in range(len(known))]).cast("boolean")) if known else nodes
    return members.join(fresh.select("tree", "node", "size"), ["tree", "node"])


_VERIFIED = "digest string, linked long, root string, found double, expected double"


def _verify(members: pd.DataFrame, depth: int, before: int | None, settings: Settings) -> pd.DataFrame:
    """Links of one block pair of a node: per member the copies linked and the smallest digest of its group."""
    members = members.sort_values("digest").reset_index(drop=True)
    tree, one, two = int(members["tree"].iloc[0]), int(members["one"].iloc[0]), int(members["two"].iloc[0])
    count = len(members)
    signatures = np.array(members["signature"].tolist(), np.int32).reshape(count, settings.trees, settings.depth)
    open_ = np.triu(np.ones((count, count), bool), 1)
    if one != two:
        block = members["block"].to_numpy()
        open_ &= block[:, None] != block[None, :]
    checks = [(at, depth) for at in range(tree)] + [(at, before) for at in range(settings.trees) if before]
    for at, length in checks:
        _, label = np.unique(signatures[:, at, :length], axis=0, return_inverse=True)
        open_ &= label.reshape(-1)[:, None] != label.reshape(-1)[None, :]
    if not open_.any():
        return pd.DataFrame([], columns=["digest", "linked", "root", "found", "expected"])
    hashes, unpack = _Hashes(), zstandard.ZstdDecompressor()
    used = open_.any(axis=0) | open_.any(axis=1)
    sets = [
        shingles(unpack.decompress(data).decode("utf-8"), hashes, settings.words) if use else np.empty(0, np.uint64)
        for data, use in zip(members["packed"], used, strict=True)
    ]
    sizes = np.array([len(found) for found in sets])
    if count <= 12:
        common = np.zeros((count, count))
        for a, b in zip(*np.nonzero(open_), strict=True):
            if min(sizes[a], sizes[b]) >= settings.threshold * max(sizes[a], sizes[b]):
                common[a, b] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:
        # Shingles of several members, a slice at a time, as a membership matrix.
        values, places = np.unique(np.concatenate(sets), return_inverse=True)
        owners = np.repeat(np.arange(count), sizes)
        often = np.bincount(places, minlength=len(values)) > 1
        renumbered = np.cumsum(often) - 1
        owners, places = owners[often[places]], renumbered[places[often[places]]]
        order = np.argsort(places, kind="stable")
        owners, places = owners[order], places[order]
        common, width = np.zeros((count, count), np.float32), 4096
        for low in range(0, int(often.sum()), width):
            a, b = np.searchsorted(places, [low, low + width])
            matrix = np.zeros((count, width), np.float32)
            matrix[owners[a:b], places[a:b] - low] = 1
            common += matrix @ matrix.T
    together = sizes[:, None] + sizes[None, :] - common
    likeness = np.where(together > 0, common / np.maximum(together, 1), 0)
    links = open_ & (likeness >= settings.threshold - 1e-9)
    pairs = np.argwhere(links)
    if not len(pairs):
        return pd.DataFrame([], columns=["digest", "linked", "root", "found", "expected"])
    copies = members["copies"].to_numpy(np.int64)
    both = links | links.T
    linked = both @ copies
    root = np.arange(count)
    while True:  # smallest neighbour's root, then roots of roots
        lower = np.minimum(root, np.where(both, root[None, :], count).min(axis=1))
        lower = lower[lower]
        if (lower == root).all():
            break
        root = lower
    expected = np.zeros(count)
    np.add.at(expected, pairs[:, 0], 1 / np.maximum([settings.chance(likeness[a, b], depth) for a, b in pairs], 1e-9))
    found = links.sum(axis=1).astype(float)
    at = np.flatnonzero(both.any(axis=1))
    digests = members["digest"].to_numpy()
    return pd.DataFrame(
        {"digest": digests[at], "linked": linked[at], "root": digests[root[at]], "found": found[at], "expected": expected[at]}
    )


@dataclass(frozen=True)
class Joined:
    """``signed``: rows with their class digest; ``classes``: digest, copies, links and group root."""

    signed: DataFrame
    classes: DataFrame


def join(documents: DataFrame, settings: Settings = Settings()) -> Joined:
    """Verified links between classes of texts, and the groups they form."""
    signed = staged(sign(documents, settings), "signed")
    # Rows with one id and one text are one place to fetch the text from.
    place = F.struct(F.col("doc_id"), F.col("text_hash"))
    classes = staged(
        signed.groupBy("digest").agg(
            F.min(place).alias("place"), F.count(F.lit(1)).alias("copies"), F.max("signature").alias("signature")
        ),
        "classes",
    )

    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pd.Series([pack.compress(text.encode("utf-8", "replace")) for text in batch], dtype=object)

    packed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    pack = F.pandas_udf(packed, "binary")
    texts = documents.select("doc_id", whole("text").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    depth, before, verified = settings.first_depth(), None, []
    while True:
        nodes = staged(_nodes(classes, depth, before, settings), "forest-fresh")
        wanted = nodes.select("digest").distinct().join(classes, "digest").select(
            "digest", "copies", "signature", F.col("place.doc_id").alias("_id"), F.col("place.text_hash").alias("_hash")
        )
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
        # Equal rows give their text once each; the members of a node are told apart by digest.
        fetched = texts.join(wanted, same).select("digest", "copies", "signature", pack("text").alias("packed")).dropDuplicates(["digest"])
        blocks = F.ceil(F.col("size") / settings.block).cast("int")
        own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
        spread = (
            nodes.withColumn("blocks", blocks)
            .withColumn("block", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(
                "tree", "node", "digest", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")
            )
        )

        def verify(members: pd.DataFrame, depth: int = depth, before: int | None = before) -> pd.DataFrame:
            return _verify(members, depth, before, settings)

        found = staged(
            spread.join(fetched, "digest").groupBy("tree", "node", "one", "two").applyInPandas(lambda part: verify(part), _VERIFIED),
            "verified",
        )
        verified.append(found)
        figures = found.agg(F.sum("found").alias("found"), F.sum("expected").alias("expected")).first()
        # Each link stands for as many as have its likeness and were missed.
        missed = 1 - figures["found"] / figures["expected"] if figures["expected"] else 0.0
        if missed <= 1 - settings.recall or depth <= 2:
            break
        before, depth = depth, depth - 1
    links = verified[0]
    for more in verified[1:]:
        links = links.union(more)
    roots = components(links.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("digest").agg(F.sum("linked").alias("linked"))
    grouped = (
        classes.select("digest", "place", "copies")
        .join(counts, "digest", "left")
        .join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left")
        .select("digest", "place", "copies", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "digest").alias("root"))
    )
    kept = grouped.groupBy("root").agg(F.min("place").alias("first"), F.sum("copies").alias("group_size"))
    return Joined(signed, staged(grouped.join(kept, "root"), "groups"))


def groups(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``class_id``, ``n_links`` and ``group_size`` for every row.

    ``class_id`` is the smallest id of the group (null for a group that has a
    null id), ``n_links`` counts the other rows whose similarity with this one
    reaches the threshold.  Texts without words are alike, a null text is empty.
    """
    joined = join(documents, settings)
    return joined.signed.select("doc_id", "digest").join(joined.classes, "digest").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        (F.col("linked") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.col("group_size").cast("long").alias("group_size"),
    )


def keep_one(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents with one row of each group left, that with the smallest id; all columns as they are.

    Texts without words (null, empty, blank) are one group; a null id comes
    last.  Of repeated rows one stays; an empty table stays empty.
    """
    joined = join(documents, settings)
    # One key for join and window, so that the texts move once; a null id is written as such.
    def key(place: str, text: Column) -> Column:
        return F.concat_ws(":", F.coalesce(F.col(place).cast("string"), F.lit("null")), text.cast("string")).alias("_key")

    firsts = joined.classes.select(key("first.doc_id", F.col("first.text_hash"))).distinct()
    rows = documents.select(F.struct("*").alias("_row"), key("doc_id", F.xxhash64(whole("text"))))
    kept = rows.join(firsts, "_key", "left_semi")
    # Rows that repeat an id and its text: one of them stays.
    order = Window.partitionBy("_key").orderBy(F.lit(0))
    return kept.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("_row.*")
