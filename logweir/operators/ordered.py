"""Running totals over an order, without one task per hot key.

A plain window puts a whole key into one task.  When a ``block`` expression is
given, the window covers one (key, block) at a time; the totals of the blocks,
one small row each, get their own running window, and are joined back as the
base of the block.  Blocks must follow the order: every row of a lower block
sorts before every row of a higher one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "_block"


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    *,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    block: Column | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Add running sums and maxima per key, in the given order.

    ``exclusive`` leaves the row itself out; a sum then starts at 0 and a
    maximum at null.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    last = -1 if exclusive else Window.currentRow
    if block is None:
        rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumns(
            {
                **{out: F.coalesce(F.sum(value).over(rows), F.lit(0)) for out, value in sums.items()},
                **{out: F.max(value).over(rows) for out, value in maxes.items()},
            }
        )

    source = df.withColumn(_BLOCK, block)
    totals = source.groupBy(*keys, _BLOCK).agg(
        *[F.sum(value).alias(f"_base_{out}") for out, value in sums.items()],
        *[F.max(value).alias(f"_base_{out}") for out, value in maxes.items()],
    )
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *keys,
        _BLOCK,
        *[F.coalesce(F.sum(f"_base_{out}").over(before), F.lit(0)).alias(f"_base_{out}") for out in sums],
        *[F.max(f"_base_{out}").over(before).alias(f"_base_{out}") for out in maxes],
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    joined = source.join(bases, [*keys, _BLOCK])
    # greatest() skips nulls, so a block without a value keeps its base.
    return joined.withColumns(
        {
            **{
                out: F.col(f"_base_{out}") + F.coalesce(F.sum(value).over(inside), F.lit(0))
                for out, value in sums.items()
            },
            **{out: F.greatest(F.col(f"_base_{out}"), F.max(value).over(inside)) for out, value in maxes.items()},
        }
    ).drop(_BLOCK, *[f"_base_{out}" for out in [*sums, *maxes]])
