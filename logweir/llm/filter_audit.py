"""Audit of filters that run one after the other: what each removes in every order.

A row of the table fails some of k filters.  In an order of the filters it is
removed at the first one it fails: the min-plus product of its mask (0 where
it fails, infinite elsewhere) and the positions of the filters in that order.
Rows with one mask behave alike, so Spark counts rows per part and mask, at
most 2**k rows a part, and each part's audit is one small product and scatter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.llm.common import whole

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of UTF-8 that go on with a code point.
_INSIDE = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"

#: The five text filters, in the bits of a mask; E compares with the rest of the table.
FILTERS = "ABCDE"
_COPY = 1 << FILTERS.index("E")


def failing(text: bytes) -> int:
    """Mask of the filters A to D that a text fails.

    A: under 200 words.  B: fewer than half of the words are distinct.
    C: more than 3 capitals A-Z per 100 code points.  D: one of ``#$%&*|``.
    ``bytes.split`` splits at exactly the blanks 0x20 and 0x09 to 0x0D.
    """
    words = text.split()
    capitals = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _INSIDE))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 3 * points) << 2
        | (len(text.translate(None, _MARKS)) < len(text)) << 3
    )


def _facts(text: Column) -> Column:
    def facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [bytes(text) for text in batch]
            yield pd.DataFrame(
                {"mask": [failing(text) for text in texts], "digest": [hashlib.sha256(text).digest() for text in texts]}
            )

    facts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(facts, "mask int, digest binary")(F.encode(text, "UTF-8"))


def text_masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, rows, good, toxic``: rows per part and mask, how many of them are labelled good and toxic.

    ``part`` is the language.  Null and empty texts are one text; a null
    language counts as the empty one.  Filter E fails where a smaller
    ``doc_id`` of the table has the same text (compared by SHA-256); a null id
    is neither smaller nor larger than any.  Repeated rows each count; of
    repeated labels of one id any 1 counts.  Texts never move: digests, masks
    and counts do, summed before each shuffle, so that a text that a third of
    all rows share is a few rows.
    """
    read = documents.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), _facts(whole("text")).alias("_found")
    ).select("doc_id", "part", "_found.mask", "_found.digest")
    each = read.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    labelled = each.join(marks, "doc_id", "left").withColumns(
        {name: F.coalesce(name, F.lit(0)) for name in ("good", "toxic")}
    )
    copies = labelled.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    lowest = copies.groupBy("digest").agg(F.min("first.doc_id").alias("lowest"))
    # Not a copy: the rows of the smallest id that has the text, and rows without an id.
    own = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.n")).otherwise(0)
    split = copies.join(lowest, "digest").select(
        "part", "good", "toxic",
        F.explode(
            F.array(
                F.struct(F.col("mask"), own.alias("n")),
                F.struct((F.col("mask") + _COPY).alias("mask"), (F.col("n") - own).alias("n")),
            )
        ).alias("_cell"),
    )
    n = F.col("_cell.n")
    return split.groupBy("part", F.col("_cell.mask").alias("mask")).agg(
        F.sum(n).alias("rows"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


def column_masks(rows: DataFrame, part: Column, filters: Mapping[str, Column], weights: Mapping[str, Column]) -> DataFrame:
    """The same for filters and weights that are columns; a null condition does not fail."""
    mask = F.lit(0)
    for place, condition in enumerate(filters.values()):
        mask = mask + F.when(condition, 1 << place).otherwise(0)
    named = rows.select(
        F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"),
        *[F.coalesce(value.cast("long"), F.lit(0)).alias(name) for name, value in weights.items()],
    )
    return named.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(name).alias(name) for name in weights])


def orders(count: int) -> np.ndarray:
    """All orders of the filters, a row each: the filter at every step."""
    return np.array(list(permutations(range(count))), np.int64).reshape(-1, count)


def removal_steps(masks: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Step, from 0, at which a mask is removed in an order: a row per mask; the number of filters where it never is.

    The min-plus product of masks x filters and filters x orders.
    """
    count = order.shape[1]
    # The inverse of an order says at which step each filter stands.
    position = np.argsort(order, axis=1).T
    fails = (masks[:, None] >> np.arange(count)) & 1
    steps = np.full((len(masks), len(order)), count, np.int64)
    for place in range(count):
        np.minimum(steps, np.where(fails[:, place, None] == 1, position[place], count), out=steps)
    return steps


def _scattered(steps: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """Weight removed in each order at each step; the last column is what no filter removes."""
    out = np.zeros((steps.shape[1], count + 1), np.int64)
    np.add.at(out, (np.arange(steps.shape[1])[None, :], steps), weights[:, None])
    return out


def audit(cells: DataFrame, names: Sequence[str], weights: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """One row per part, order of the filters and step, from rows per part and mask.

    ``kept`` rows after the step, ``removed`` by it, ``redundant`` ones that
    fail its filter and were removed before, ``unique_fails`` of its filter
    alone, ``<weight>_lost`` the weight removed, and ``shapley``, what the
    filter removes summed over all orders.  A part has at most one row per
    mask, so a part is never more than 2**filters rows; no cells, no rows.
    """
    names, weights = list(names), list(weights)
    count = len(names)
    numbers = ["kept", "removed", "redundant", "unique_fails", *[f"{name}_lost" for name in weights], "shapley"]
    schema = T.StructType(
        [
            T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()),
            T.StructField("step", T.IntegerType()), *[T.StructField(name, T.LongType()) for name in numbers],
        ]
    )

    def audited(part: pd.DataFrame) -> pd.DataFrame:
        masks, rows = part["mask"].to_numpy(np.int64), part["rows"].to_numpy(np.int64)
        order = orders(count)
        steps = removal_steps(masks, order)
        removed = _scattered(steps, rows, count)[:, :count]
        fails = np.array([rows[(masks >> place) & 1 == 1].sum() for place in range(count)], np.int64)
        alone = np.array([rows[masks == 1 << place].sum() for place in range(count)], np.int64)
        shapley = np.zeros(count, np.int64)
        np.add.at(shapley, order, removed)
        found = {
            "kept": rows.sum() - removed.cumsum(axis=1),
            "removed": removed,
            "redundant": fails[order] - removed,
            "unique_fails": alone[order],
            **{
                f"{name}_lost": _scattered(steps, part[name].to_numpy(np.int64), count)[:, :count] for name in weights
            },
            "shapley": shapley[order],
        }
        return pd.DataFrame(
            {
                "part": part["part"].iloc[0],
                "filter_order": np.repeat(["".join(names[place] for place in row) for row in order], count),
                "step": np.tile(np.arange(1, count + 1, dtype=np.int32), len(order)),
                **{name: found[name].ravel() for name in numbers},
            }
        )

    return cells.groupBy("part").applyInPandas(audited, schema)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters for every language of the table."""
    return audit(text_masks(documents, labels), FILTERS)
