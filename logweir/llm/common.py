"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def whole(column: str) -> Column:
    """The text of a column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_id(column: str) -> Column:
    """A long id as text: Python workers get long columns with nulls as doubles, which round large ids."""
    return F.col(column).cast("long").cast("string")


def smallest_by_hash(df: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """At most ``most`` rows, chosen by a hash of the key: the same rows on every run.

    Of many rows only those below a hash bound, about twice as many as wanted,
    are ordered, so that the last step does not grow with the number of tasks.
    """
    mark, rows = F.xxhash64(F.lit(seed), F.col(key).cast("string")), df.count()
    wanted = 2 * most + 1000
    if rows > wanted:
        df = df.where(mark <= F.lit(-(2**63) + 2**64 * wanted // rows))
    return df.orderBy(mark, key).limit(most)
