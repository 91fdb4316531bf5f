"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.session import staged


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of a link.

    ``links`` has columns ``a`` and ``b``.  Each round points nodes at the
    smallest node they know, first larger neighbours, then smaller ones, until
    nothing moves; a hot node costs an aggregate and a join, never a list.
    """
    stars = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), "stars"
    )
    while True:
        both = stars.union(stars.select("root", "node")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = staged(
            both.where("other > node").join(least, "node").select(F.col("other").alias("node"), F.col("least").alias("root")).distinct(),
            "stars",
        )
        lowest = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(lowest, "node").select(
            F.explode(
                F.array(
                    F.struct(F.col("node"), F.col("least").alias("root")),
                    F.struct(F.col("root").alias("node"), F.col("least").alias("root")),
                )
            ).alias("_star")
        )
        following = staged(small.select("_star.*").where("node <> root").distinct(), "stars")
        moved = following.join(stars, ["node", "root"], "left_anti").union(stars.join(following, ["node", "root"], "left_anti"))
        stable, stars = moved.isEmpty(), following
        if stable:
            return stars.union(stars.select("root", "root")).distinct().toDF("node", "root")
