"""Log-shaped views over the given tables.

Each view has a Spark form here and a SQL twin in ``plans.checks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.operators.ordered import running


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds of a zoneless timestamp, whatever the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Container log lines, one per event."""
    return table(spark, folder, "events").selectExpr(
        "event_id as line_no",
        """concat('/var/log/containers/pod', cast(user_id % 7 as string), '_ns', cast(user_id % 3 as string),
                  '_svc', cast(user_id % 5 as string), '-c', cast(user_id as string), '.log') as path""",
        """concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), ' ',
                  case when event_type = 'error' then 'stderr' else 'stdout' end, ' F svc L:34 - ',
                  case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' when 'signup' then 'INFO'
                                  when 'click' then 'DEBUG' else 'TRACE' end,
                  ' - req', cast(event_id as string), ' - ', event_type,
                  ' trace_id=', lower(lpad(hex(event_id), 16, '0'))) as line""",
    )


def mixed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same with every tenth line lacking its time, so not framed."""
    short = F.substring("line", F.lit(29), F.length("line"))
    return event_lines(spark, folder).withColumn(
        "line", F.when(F.col("line_no") % 10 == 0, short).otherwise(F.col("line"))
    )


def varied_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Container lines as other runtimes write them: offsets, a comma, nine digits, partial lines, ids of several widths."""
    return table(spark, folder, "events").selectExpr(
        "event_id as line_no",
        """concat(
             case event_id % 5
               when 0 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
               when 1 then date_format(ts + interval 8 hours, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+08:00'")
               when 2 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss,SSSSSS'Z'")
               when 3 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'123Z'")
               else date_format(ts - make_dt_interval(0, 5, 30), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'-05:30'") end,
             case when event_id % 2 = 0 then ' stdout ' else ' stderr ' end, case when event_id % 7 = 3 then 'P ' else 'F ' end,
             'id=', case event_id % 4 when 0 then lower(lpad(hex(event_id + 1), 16, '0')) when 1 then lower(lpad(hex(event_id), 32, 'a'))
                                     when 2 then lower(lpad(hex(event_id), 15, 'b')) else repeat('0', 32) end, '.') as line""",
    )


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each document, as if it were a file; the last piece has no newline."""
    docs = table(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("file_key"),
        F.octet_length("text").cast("long").alias("file_size"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    ).withColumn("line_no", F.col("line_no").cast("long"))


def conv_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each conversation; a turn starts with its role."""
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("file_key"),
        "turn",
        F.posexplode(F.split(F.concat(F.col("role"), F.lit("> "), F.col("text")), "\n")).alias("part", "line"),
    )
    # Turn and part give the order, whatever the length of a turn.
    numbered = running(
        turns, ["file_key"], ["turn", "part"], sums={"line_no": F.lit(1).cast("long")}, block=F.col("turn"), exclusive=True
    )
    return numbered.select("file_key", "line_no", "line")


def _host(number: Column) -> Column:
    """Three hosts whose processes have the same numbers."""
    return F.concat(F.lit("node"), (number % 3).cast("string"))


def _pid(number: Column) -> Column:
    return F.floor(number / 3).cast("long")


def processes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        _host(F.col("c_custkey")).alias("host"),
        _pid(F.col("c_custkey")).alias("pid"),
        F.lower("c_mktsegment").alias("comm"),
        F.concat(F.lit("java -jar "), F.col("c_name"), F.lit(".jar --nation="), F.col("c_nationkey").cast("string")).alias("cmdline"),
    )


def open_files(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("o_orderkey")
    folder_name = F.when(number % 11 == 0, F.lit("pipe:[")).otherwise(F.concat(F.lit("/data/"), F.lower("o_orderstatus"), F.lit("/")))
    ending = F.when(number % 13 == 0, F.lit(".log (deleted)")).when(number % 5 == 0, F.lit(".tmp")).otherwise(F.lit(".log"))
    return table(spark, folder, "orders").select(
        _host(F.col("o_custkey")).alias("host"),
        _pid(F.col("o_custkey")).alias("pid"),
        number.alias("fd_order"),
        F.concat(folder_name, (number % 4000).cast("string"), ending).alias("path"),
    )


def doc_path(key: str = "doc_id") -> Column:
    return F.concat(F.lit("/data/docs/"), F.col(key).cast("string"), F.lit(".log"))


# Fixed moments of the position views.
DAY = "2024-01-01 00:00:00"


def live_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that exist: all documents but every seventh; some were replaced."""
    docs = table(spark, folder, "documents")
    return docs.where("doc_id % 7 <> 0").select(
        F.when(F.col("doc_id") % 10 == 3, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id")).alias("file_key"),
        doc_path().alias("path"),
        F.octet_length("text").cast("long").alias("size"),
    )


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """Stored offsets: half of each document, some beyond its end, some missing."""
    docs = table(spark, folder, "documents")
    size = F.octet_length("text").cast("long")
    return docs.where("doc_id % 5 <> 4").select(
        F.col("doc_id").alias("file_key"),
        doc_path().alias("path"),
        F.when(F.col("doc_id") % 5 == 3, size + 10).otherwise(F.floor(size / 2).cast("long")).alias("offset"),
        F.expr(f"timestamp_ntz'{DAY}' + make_dt_interval(0, cast(doc_id % 48 as int))").alias("updated_at"),
    )


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.timestamp_micros(micros("ts")).alias("ts"),
    )


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Delivery attempts: sixteen events in a row are the attempts of one batch."""
    status = F.expr(
        "case event_type when 'error' then 503 when 'click' then 429 when 'view' then 500 "
        "when 'signup' then (case when event_id % 3 = 0 then 401 end) "
        "else (case when event_id % 4 = 0 then 200 else 408 end) end"
    )
    asked = F.when(F.col("event_id") % 6 == 0, (F.col("event_id") % 50) * 60_000).otherwise(0)
    return table(spark, folder, "events").select(
        F.floor(F.col("event_id") / 16).cast("long").alias("batch_id"),
        (F.col("event_id") % 16 + 1).cast("int").alias("attempt"),
        F.timestamp_micros(micros("ts")).alias("at"),
        status.cast("int").alias("status"),
        asked.cast("long").alias("retry_after_ms"),
    )
