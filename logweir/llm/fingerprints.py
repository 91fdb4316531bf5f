"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text is a set of paragraphs: lines, long ones cut into parts.  Each paragraph
digest goes to one cell of each of three tables; a cell keeps a count, the xor
of its digests and the xor of their checks.  Sketches of two versions subtract
cell by cell, so what both have cancels, and peeling recovers the digests that
differ: a cell with one digest gives it away, and taking it out of its other
cells leaves more such cells.  Pairs that do not peel are sketched again with
more cells and another hash, until all are done.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.common import whole
from logweir.session import staged

_TABLES = 3
_FOUND = 3  # table number of what was peeled
_ROW = ("_bucket", "_nth")


@dataclass(frozen=True)
class Settings:
    """``cells`` per table of the stored sketch; parts of at most ``part`` characters.

    A retry has ``spare`` times as many cells per table as two texts have
    paragraphs, doubled at each further retry.  ``rounds`` passes over a table
    each peel.
    """

    cells: int = 8
    part: int = 120
    spare: float = 0.6
    rounds: int = 12
    bucket_rows: int = 256
    ranges: int = 64


def paragraphs(text: Column, settings: Settings = Settings()) -> Column:
    """Distinct 64-bit digests of the lines of a text, long lines in parts."""
    pieces = F.regexp_extract_all(text, F.lit(f"([^\\n]{{1,{settings.part}}})"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda piece: F.xxhash64(piece)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(77)).bitwiseAND(F.lit(0xFFFFFFFF))


def _cell(key: Column, table: Column, cells: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(key, table, F.lit(salt)), cells.cast("long"))


def with_next(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``text`` and ``next_text``, the text of the document after it by id.

    The last document is followed by the first, a single one by itself.  Null
    ids come first; equal ids are ordered by a hash of the text.  Rows keep a bucket of ids
    and a place in it, so that equal rows can be told apart.
    """
    figures = documents.agg(
        F.count(F.lit(1)).alias("rows"),
        F.percentile_approx("doc_id", [at / settings.ranges for at in range(settings.ranges + 1)], 10_000).alias("bounds"),
    ).first()
    bounds = sorted(set(figures["bounds"] or [0]))
    lows, highs = bounds, [*bounds[1:], bounds[-1] + 1]
    each = max(1, figures["rows"] // settings.ranges // settings.bucket_rows + 1)
    widths = [max(1, -(-(high - low) // each)) for low, high in zip(lows, highs, strict=True)]

    def pick(values: list[int], place: Column) -> Column:
        return F.element_at(F.array(*[F.lit(value).cast("long") for value in values]), place)

    # Each range of ids has its own bucket width, so that dense and sparse ids spread alike.
    known = F.array(*[F.lit(low).cast("long") for low in lows])
    place = F.greatest(F.size(F.filter(known, lambda low: low <= F.col("doc_id"))), F.lit(1))
    offset = (F.col("doc_id").cast("decimal(20,0)") - pick(lows, F.col("_range"))) / pick(widths, F.col("_range"))
    rows = (
        documents.select("doc_id", whole("text").alias("text"))
        .withColumn("_range", place)
        .withColumn(
            "_bucket",
            F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(
                F.col("_range") * (2 * each + 2) + F.least(F.floor(offset).cast("long"), F.lit(2 * each))
            ),
        )
        .select("_bucket", "doc_id", "text")
    )
    ordered = Window.partitionBy("_bucket").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    placed = rows.withColumns({"_nth": F.row_number().over(ordered), "next_text": F.lead("text").over(ordered)})
    # The first text of each bucket follows the last one of the bucket before.
    firsts = rows.withColumn("_nth", F.row_number().over(ordered)).where("_nth = 1")
    buckets = staged(rows.select("_bucket").distinct().withColumn("_group", F.floor(F.col("_bucket") / 4096)), "buckets")
    inside = Window.partitionBy("_group").orderBy("_bucket")
    # One row per 4096 buckets.
    groups = buckets.groupBy("_group").agg(F.min("_bucket").alias("_head"))
    heads = groups.select("_group", F.lead("_head").over(Window.partitionBy(F.lit(0)).orderBy("_group")).alias("_next_head"))
    start = buckets.agg(F.min("_bucket")).first()[0]
    links = (
        buckets.withColumn("_next", F.lead("_bucket").over(inside))
        .join(heads, "_group")
        .select("_bucket", F.coalesce("_next", "_next_head", F.lit(start).cast("long")).alias("_next"))
    )
    edges = firsts.select(F.col("_bucket").alias("_next"), F.col("text").alias("_edge")).join(links, "_next").select("_bucket", "_edge")
    return placed.join(edges, "_bucket").select(
        "_bucket", "_nth", "doc_id", "text", F.coalesce("next_text", "_edge").alias("next_text")
    )


def _sketch(rows: DataFrame, sides: tuple[str, ...], cells: Column, salt: int, keep: tuple[str, ...]) -> DataFrame:
    """Cells of the digest lists named in ``sides``: per cell and side count, xor of digests, xor of checks."""

    def entry(at: int):
        return lambda key: F.struct(F.lit(at).alias("side"), key.alias("key"))

    entries = F.concat(*[F.transform(side, entry(at)) for at, side in enumerate(sides)])
    keys = rows.select(*keep, cells.cast("long").alias("_cells"), F.explode(entries).alias("_entry"))
    hashed = keys.select(
        *keep, "_cells", F.col("_entry.side").alias("_side"), F.col("_entry.key").alias("_key"), _check(F.col("_entry.key")).alias("_sum"),
        F.explode(F.array(*[F.lit(table) for table in range(_TABLES)])).alias("t"),
    )
    zero = F.lit(0).cast("long")
    aggregates = []
    for at, side in enumerate(sides):
        own = F.col("_side") == at
        aggregates += [
            F.sum(F.when(own, 1).otherwise(0)).alias(f"n_{side}"),
            F.bit_xor(F.when(own, F.col("_key")).otherwise(zero)).alias(f"k_{side}"),
            F.bit_xor(F.when(own, F.col("_sum")).otherwise(zero)).alias(f"c_{side}"),
        ]
    cell = _cell(F.col("_key"), F.col("t"), F.col("_cells"), salt)
    return hashed.withColumn("cell", cell).groupBy(*keep, "_cells", "t", "cell").agg(*aggregates)


def subtract(sketch: DataFrame, first: str, second: str, keep: tuple[str, ...], name: str) -> DataFrame:
    """Cells of ``first`` minus those of ``second``, empty ones left out."""
    return sketch.select(
        *keep, F.lit(name).alias("pair"), "_cells", "t", "cell",
        (F.col(f"n_{first}") - F.col(f"n_{second}")).alias("n"),
        F.col(f"k_{first}").bitwiseXOR(F.col(f"k_{second}")).alias("k"),
        F.col(f"c_{first}").bitwiseXOR(F.col(f"c_{second}")).alias("c"),
    ).where("n <> 0 or k <> 0 or c <> 0")


def peel(cells: DataFrame, keep: tuple[str, ...], salt: int, rounds: int, *, digests: bool = False) -> DataFrame:
    """Per pair ``found``, how many digests were recovered, and ``failed`` when cells are left over.

    With ``digests`` also the lists ``removed`` and ``added``.  One table is
    looked at per round: a digest has one cell there, so none is taken twice.
    """
    keys = (*keep, "pair", "_cells", "t", "cell")
    zero = F.lit(0).cast("long")

    def row(t: Column, cell: Column, n: Column, k: Column, c: Column) -> Column:
        return F.struct(
            t.cast("int").alias("t"), cell.cast("long").alias("cell"), n.cast("long").alias("n"), k.alias("k"), c.alias("c")
        )

    for turn in range(rounds):
        table = turn % _TABLES
        n, k, c = F.col("n"), F.col("k"), F.col("c")
        pure = (F.col("t") == table) & (F.abs("n") == 1) & (_check(k) == c)
        taken = [
            row(F.lit(other), _cell(k, F.lit(other), F.col("_cells"), salt), -n, k, c) for other in range(_TABLES) if other != table
        ]
        found = row(F.lit(_FOUND), k if digests else zero, F.lit(1), n if digests else zero, zero)
        same = row(F.col("t"), F.col("cell"), n, k, c)
        cells = (
            cells.select(*keep, "pair", "_cells", F.explode(F.when(pure, F.array(found, *taken)).otherwise(F.array(same))).alias("_r"))
            .select(*keep, "pair", "_cells", "_r.*")
            .groupBy(*keys)
            .agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
            .where(f"t = {_FOUND} or n <> 0 or k <> 0 or c <> 0")
        )
    done = F.col("t") == _FOUND
    more = []
    if digests:
        more = [
            F.sort_array(F.collect_list(F.when(done & (F.col("k") == sign), F.col("cell")))).alias(name)
            for sign, name in ((1, "removed"), (-1, "added"))
        ]
    return cells.groupBy(*keep, "pair").agg(
        F.sum(F.when(done, F.col("n")).otherwise(0)).alias("found"), F.max(~done).alias("failed"), *more
    )


def differences(
    rows: DataFrame, keep: tuple[str, ...], pairs: dict[str, tuple[str, str]], settings: Settings = Settings(), *, digests: bool = False
) -> DataFrame:
    """How many paragraphs differ per row and pair of digest lists, by peeling subtracted sketches.

    ``rows`` is a stored table, with ``keep`` naming one row.  Pairs without a
    difference have no row in the result.
    """
    lists = tuple(dict.fromkeys(side for pair in pairs.values() for side in pair))
    together = rows.select(*keep, *lists).repartition(keep[0])
    first = _sketch(together, lists, F.lit(settings.cells), 0, keep)
    cells = reduce(DataFrame.unionByName, [subtract(first, *pair, keep, name) for name, pair in pairs.items()])
    done, attempt = [], 0
    while True:
        tried = staged(peel(cells, keep, attempt, settings.rounds, digests=digests), "peeled")
        done.append(tried.where(~F.col("failed")))
        failed = tried.where("failed").select(*keep, "pair")
        if failed.isEmpty():
            return reduce(DataFrame.unionByName, done)
        attempt += 1
        parts = []
        for name, (one, two) in pairs.items():
            # The stored table of failed pairs is far smaller than its rows, so its size says little.
            again = together.join(failed.where(F.col("pair") == name).select(*keep).hint("merge"), list(keep), "left_semi")
            size = F.ceil((F.size(one) + F.size(two)) * settings.spare * 2 ** (attempt - 1)) + 2 * settings.cells
            parts.append(subtract(_sketch(again, (one, two), size, attempt, keep), one, two, keep, name))
        cells = reduce(DataFrame.unionByName, parts)


def written(sketch: DataFrame, side: str, keep: tuple[str, ...]) -> DataFrame:
    """The cells of one side as text, in order, one row per document that has a paragraph."""
    cell = F.struct((F.col("t") * F.lit(1_000_000) + F.col("cell")).alias("at"), f"n_{side}", f"k_{side}", f"c_{side}")
    cells = F.sort_array(F.collect_list(F.when(F.col(f"n_{side}") > 0, cell)))
    one = F.transform(
        cells, lambda x: F.concat_ws(":", x["at"].cast("string"), x[f"n_{side}"].cast("string"), F.hex(x[f"k_{side}"]), F.hex(x[f"c_{side}"]))
    )
    return sketch.groupBy(*keep).agg(F.array_join(one, ",").alias(f"cells_{side}"))


def fingerprints(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are.

    The edited text has the last half of the characters, rounded down, replaced
    by as many first characters of the next document.  Likeness is the share of
    paragraphs two texts have in common, 1 for two texts without any.  A null
    text is empty.  Repeated rows are documents of their own with equal
    fingerprints; an empty table gives no rows.  Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_paragraphs, changed``.
    """
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half)
    )
    rows = staged(
        with_next(documents, settings)
        .withColumn("_edited", edited)
        .select(
            *_ROW,
            "doc_id",
            F.char_length("text").cast("long").alias("n_chars"),
            F.sha2("_edited", 256).alias("edited_sha256"),
            F.xxhash64("text").alias("_own_hash"),
            F.xxhash64("_edited").alias("_edited_hash"),
            paragraphs(F.col("text"), settings).alias("own"),
            paragraphs(F.col("_edited"), settings).alias("edited"),
            paragraphs(F.col("next_text"), settings).alias("next"),
        ),
        "fingerprint-rows",
    )
    changes = differences(rows, _ROW, {"edited": ("own", "edited"), "next": ("own", "next")}, settings)
    together = rows.select(*_ROW, "own", "edited").repartition(_ROW[0])
    sketch = _sketch(together, ("own", "edited"), F.lit(settings.cells), 0, _ROW)
    out = [written(sketch, side, _ROW) for side in ("own", "edited")]
    counted = changes.groupBy(*_ROW).agg(
        *[F.sum(F.when(F.col("pair") == name, F.col("found"))).alias(f"_d_{name}") for name in ("edited", "next")]
    )
    base = rows.select(
        *_ROW, "doc_id", "n_chars", "edited_sha256", "_own_hash", "_edited_hash", *[F.size(side).alias(f"_n_{side}") for side in ("own", "edited", "next")]
    )
    joined = reduce(lambda left, right: left.join(right, list(_ROW), "left"), [*out, counted], base)

    def near(name: str) -> Column:
        total = F.col("_n_own") + F.col(f"_n_{name}")
        return F.when(total == 0, 1.0).otherwise(1 - F.coalesce(f"_d_{name}", F.lit(0)) / total)

    def mark(name: str) -> Column:
        return F.concat_ws("|", F.hex(f"_{name}_hash"), F.col(f"_n_{name}").cast("string"), F.coalesce(f"cells_{name}", F.lit("")))

    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        mark("own").alias("fingerprint"),
        mark("edited").alias("edited_fingerprint"),
        near("edited").alias("near_edited"),
        near("next").alias("near_next"),
        F.col("_n_own").cast("long").alias("n_paragraphs"),
        F.coalesce("_d_edited", F.lit(0)).cast("long").alias("changed"),
    )
