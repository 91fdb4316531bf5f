"""Small state of micro-batches as a table: a snapshot and the batches after it.

Every micro-batch adds its rows under its own number, so a replayed batch
replaces them, and reads what the batches before it left.  Now and then the
rows up to the batch before are merged into one snapshot and their folders go,
so the table keeps a bounded number of files however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Micro-batch that added a row.
ADDED = "added_by"


@dataclass(frozen=True)
class StateTable:
    """``merge`` makes the rows of a snapshot from all rows so far; ``every`` so many batches one is written.

    Rows have the columns of ``schema`` and ``added_by``, the batch they are
    from; a merge keeps that column.  One writer at a time, as a streaming
    query is.
    """

    folder: str
    schema: str
    merge: Callable[[DataFrame], DataFrame] = lambda rows: rows
    every: int = 20

    @property
    def _full(self) -> str:
        return f"{self.schema}, {ADDED} long"

    def _entries(self, spark: SparkSession) -> tuple[int, dict[int, str], list[int]]:
        """Newest whole snapshot (-1 for none), the batches after it, and numbers of older folders."""
        jvm = spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(self.folder)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return -1, {}, []
        batches, snapshots = {}, []
        for status in files.listStatus(root):
            kind, _, number = status.getPath().getName().partition("-")
            # A folder without the mark of a finished write is not there yet.
            if kind in ("batch", "snapshot") and files.exists(jvm.Path(status.getPath(), "_SUCCESS")):
                if kind == "batch":
                    batches[int(number)] = f"{self.folder}/batch-{number}"
                else:
                    snapshots.append(int(number))
        return max(snapshots, default=-1), batches, snapshots

    def before(self, spark: SparkSession, batch_id: int | None = None) -> DataFrame:
        """Rows of all batches, or of those before one."""
        newest, batches, snapshots = self._entries(spark)
        if batch_id is not None and newest >= batch_id:
            # A replay of an older batch than the snapshot was made for.
            newest = max((number for number in snapshots if number < batch_id), default=-1)
        paths = [path for number, path in sorted(batches.items()) if number > newest and (batch_id is None or number < batch_id)]
        if newest >= 0:
            paths.insert(0, f"{self.folder}/snapshot-{newest}")
        if not paths:
            return spark.createDataFrame([], self._full)
        return self.merge(spark.read.schema(self._full).parquet(*paths))

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """Add the rows of a batch; a second time replaces the first."""
        names = [part.split()[0] for part in self.schema.split(", ")]
        added = rows.select(*names, F.lit(batch_id).cast("long").alias(ADDED))
        added.write.mode("overwrite").parquet(f"{self.folder}/batch-{batch_id}")
        newest, batches, _ = self._entries(rows.sparkSession)
        if sum(newest < number < batch_id for number in batches) >= self.every:
            self._compact(rows.sparkSession, batch_id)

    def _compact(self, spark: SparkSession, batch_id: int) -> None:
        """Merge what is before a batch; the batch itself may be replayed and stays apart."""
        self.before(spark, batch_id).write.mode("overwrite").parquet(f"{self.folder}/snapshot-{batch_id - 1}")
        _, batches, snapshots = self._entries(spark)
        gone = [f"batch-{number}" for number in batches if number < batch_id]
        gone += [f"snapshot-{number}" for number in snapshots if number < batch_id - 1]
        jvm = spark._jvm.org.apache.hadoop.fs
        files = jvm.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in gone:
            files.delete(jvm.Path(f"{self.folder}/{name}"), True)


def table_step(batch_id: int | str) -> int:
    """Place of a batch in its tables: micro-batches are the even steps, what is drained after one follows it."""
    return 2 * batch_id if isinstance(batch_id, int) else 2 * int(batch_id.split("-")[0]) + 1


def batch_name(step: int) -> int | str:
    """The batch that has a place in the tables."""
    return f"{step // 2}-drain" if step % 2 else step // 2


def newest_per(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps the row of the latest batch for each key."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [name for name in rows.columns if name not in keys]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), ADDED).alias("_row"))
        return best.select(*[F.col(name) if name in keys else F.col(f"_row.{name}") for name in rows.columns])

    return merge
