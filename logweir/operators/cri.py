"""Container-runtime framing of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions import text
from logweir.operators.steps import settle

_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})\z"


def parse_cri(lines: DataFrame, *, line: str = "line") -> DataFrame:
    """Split ``<time> <stdout|stderr> <P|F> <body>``; other lines stay raw.

    Adds ``cri_ok``, ``ts`` (microseconds), ``time_unix_nano`` (all digits),
    ``utc_offset`` (seconds, as written), ``stream``, ``flag`` and ``body``.
    The steps are separate projections so that each line is split once, and
    one pattern checks the time; its parts are then at known places.
    """
    pieces = lines.withColumn("_part", F.split(F.col(line), " ", 4))
    first = F.get("_part", F.lit(0))
    framed = (
        (F.size("_part") == 4)
        & F.get("_part", F.lit(1)).isin("stdout", "stderr")
        & F.get("_part", F.lit(2)).isin("P", "F")
    )
    stamped = pieces.withColumn("_stamp", F.when(framed & F.rlike(first, F.lit(_STAMP)), first))
    # An hour of one digit is allowed; with two, every part has its place.
    short = F.substring("_stamp", 13, 1) == ":"
    full = F.concat(F.substring("_stamp", 1, 11), F.lit("0"), F.expr("substring(_stamp, 12)"))
    even = stamped.withColumn("_stamp", F.when(short, full).otherwise(F.col("_stamp")))
    zone = F.when(F.endswith("_stamp", F.lit("Z")), F.lit("Z")).otherwise(F.right("_stamp", F.lit(6)))
    timed = even.withColumns(
        {
            "_local": F.try_to_timestamp(F.concat(F.substring("_stamp", 1, 19), F.lit("Z"))),
            "_digits": F.when(
                F.substring("_stamp", 20, 1).isin(".", ","),
                F.split_part(F.translate(F.expr("substring(_stamp, 21)"), "Z+", "--"), F.lit("-"), F.lit(1)),
            ),
            "_zone": zone,
        }
    )
    hours = F.substring("_zone", 2, 2).try_cast("int")
    minutes = F.substring("_zone", 5, 2).try_cast("int")
    sign = F.when(F.startswith("_zone", F.lit("-")), F.lit(-1)).otherwise(1)
    offset = F.when(F.col("_zone") == "Z", F.lit(0)).when(
        (hours <= 24) & (minutes <= 60), sign * (hours * 3600 + minutes * 60)
    )
    placed = timed.withColumns(
        {
            "utc_offset": F.when(F.col("_local").isNotNull(), offset),
            "_nanos": F.coalesce(
                F.rpad(F.substring("_digits", 1, 9), 9, "0").try_cast("long"), F.lit(0).cast("long")
            ),
        }
    )
    ok = F.col("utc_offset").isNotNull()
    seconds = F.unix_seconds("_local") - F.col("utc_offset")
    micros = seconds * F.lit(1_000_000) + F.floor(F.col("_nanos") / 1000)
    nanos = F.try_add(F.try_multiply(seconds, F.lit(1_000_000_000)), F.col("_nanos"))
    return settle(
        placed,
        cri_ok=ok,
        utc_offset=F.col("utc_offset"),
        ts=F.when(ok, F.timestamp_micros(micros)),
        time_unix_nano=F.when(ok, nanos),
        stream=F.when(ok, F.get("_part", F.lit(1))),
        flag=F.when(ok, F.get("_part", F.lit(2))),
        body=F.when(ok, F.get("_part", F.lit(3))).otherwise(F.col(line)),
    ).drop("_part", "_stamp", "_local", "_digits", "_zone", "_nanos")


def with_cri_attributes(parsed: DataFrame) -> DataFrame:
    """``attributes`` of framed lines: stream and flag; empty for raw lines."""
    return parsed.withColumn("attributes", text.cri_attributes(F.col("stream"), F.col("flag")))
