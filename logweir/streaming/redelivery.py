"""Batches whose export failed: kept, scheduled and sent again."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.operators import outbox
from logweir.rules import Retry, duration_ms
from logweir.streaming.sinks import Sink
from logweir.streaming.state_table import ADDED, StateTable, batch_name, table_step

_ATTEMPTS = "batch_id long, attempt int, at timestamp, status int, retry_after_ms long"


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


@dataclass(frozen=True)
class Outbox:
    """``kept`` has the records of failed batches, ``attempts`` a row per attempt, in one shared folder.

    A merge of the attempts forgets batches that have come to an end and, of
    the others, attempts that no longer bear on the next wait.  Records of a
    batch that went out are removed; those of one given up stay for a look.
    """

    folder: str
    retry: Retry = Retry()
    clock: Callable[[], dt.datetime] = _now
    every: int = 20

    @property
    def _table(self) -> StateTable:
        return StateTable(f"{self.folder}/attempts", _ATTEMPTS, self._open, self.every)

    def _open(self, rows: DataFrame) -> DataFrame:
        waiting = outbox.schedule(rows, self.retry).where("next_at is not null").select("batch_id")
        initial, longest = (int(duration_ms(text)) or least for text, least in ((self.retry.initial_interval, 1_000), (self.retry.max_interval, 30_000)))
        needed = max(1, math.ceil(math.log2(max(longest / initial, 1))) + 1) + 1
        late = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("attempt")))
        kept = rows.join(waiting, "batch_id", "left_semi").withColumn("_late", late)
        return kept.where((F.col("attempt") == 1) | (F.col("_late") <= needed)).drop("_late")

    def _kept(self, step: int) -> str:
        return f"{self.folder}/kept/batch={batch_name(step)}"

    def attempts(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Attempts of the batches that wait; ``batch_id`` is the step of a batch in the tables."""
        return self._table.before(spark, before).drop(ADDED)

    def guard(self, sink: Sink) -> Sink:
        """Send what is due, then the batch; a batch that fails is kept and its error goes on."""

        def send(batch: DataFrame, batch_id: int | str) -> None:
            spark, step = batch.sparkSession, table_step(batch_id)
            notes = self._redeliver(spark, sink, step)
            try:
                sink(batch, batch_id)
            except Exception:
                batch.write.mode("overwrite").parquet(self._kept(step))
                notes.append((step, 1, self.clock(), None, 0))
                raise
            finally:
                if notes:
                    self._table.put(spark.createDataFrame(notes, _ATTEMPTS).coalesce(1), step)

        return send

    def redeliver(self, spark: SparkSession, sink: Sink, batch_id: int) -> list[tuple[int, bool]]:
        """Send the kept batches whose wait is over, as micro-batch ``batch_id``; which went out."""
        step = table_step(batch_id)
        notes = self._redeliver(spark, sink, step)
        if notes:
            self._table.put(spark.createDataFrame(notes, _ATTEMPTS).coalesce(1), step)
        return [(batch_name(note[0]), note[3] == 200) for note in notes]

    def _redeliver(self, spark: SparkSession, sink: Sink, step: int) -> list[tuple]:
        """All that is due goes out in one call; only when that fails is each batch tried alone.

        The schedule has one small row per waiting batch.
        """
        now = self.clock()
        due = outbox.schedule(self.attempts(spark, step), self.retry).where(F.col("next_at") <= F.lit(now))
        waiting = {row.batch_id: row.attempts + 1 for row in due.select("batch_id", "attempts").collect()}
        if not waiting:
            return []
        sent = self._sent(spark, sink, sorted(waiting), step)
        if not sent and len(waiting) > 1:
            sent = [number for number in sorted(waiting) if self._sent(spark, sink, [number], step)]
        self._remove(spark, sent)
        return [(number, attempt, now, 200 if number in sent else None, 0) for number, attempt in sorted(waiting.items())]

    def _sent(self, spark: SparkSession, sink: Sink, numbers: list[int], step: int) -> list[int]:
        """These kept batches in one call under a name of their own; a replay has the same name."""
        records = spark.read.parquet(*map(self._kept, numbers))
        try:
            sink(records, f"{batch_name(step)}-again-{batch_name(numbers[0])}")
        except Exception:  # noqa: BLE001 - any failure is another attempt
            return []
        return numbers

    def _remove(self, spark: SparkSession, numbers: list[int]) -> None:
        jvm = spark._jvm.org.apache.hadoop.fs
        for number in numbers:
            path = jvm.Path(self._kept(number))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
