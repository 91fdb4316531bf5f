"""Plan shaping shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A filter on a computed column is normally moved below the projection that
    computes it, with the whole expression copied into it.  For parsed lines
    that would run every regular expression again and make the generated code
    too large to compile.  A generator over one struct keeps the filter above;
    filters on other columns still move down to the scan.
    """
    kept = [name for name in df.columns if name not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
