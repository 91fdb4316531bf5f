"""Micro-batch sinks: fan-out to alerts and export, alert policy refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweir.operators import alerts, enrich, otlp
from logweir.rules import AlertPolicy, ExportOptions
from logweir.streaming.state_table import ADDED, StateTable, table_step

#: Takes the rows of a micro-batch and the name its output goes under: the number of the batch, or a text for a redelivery.
Sink = Callable[[DataFrame, int | str], None]

_OUTCOME = "batch string, sink string, outcome string, error string"


def _outcomes(folder: str) -> StateTable:
    return StateTable(folder, _OUTCOME)


class PolicyTable:
    """The alert policy in force: re-read for each micro-batch, swapped whole.

    A missing or invalid table leaves the last valid policy in force.
    """

    def __init__(self, path: str, initial: AlertPolicy):
        self.path, self.current = path, initial
        self.rejected: str | None = None

    def refresh(self, spark: SparkSession) -> AlertPolicy:
        try:
            # Two rows are enough to see that the table is not a single policy.
            self.current = alerts.policy_from_rows(spark.read.parquet(self.path).limit(2).collect())
            self.rejected = None
        except Exception as error:  # noqa: BLE001 - any bad table keeps the old policy
            self.rejected = str(error)
        return self.current


def alert_sink(path: str, policy: AlertPolicy | PolicyTable) -> Sink:
    """Write the alert messages of a batch under its own folder, so a replay replaces them.

    Alerts that an ignored keyword holds back become a table beside them, with
    the keyword.
    """

    def send(batch: DataFrame, batch_id: int | str) -> None:
        active = policy.refresh(batch.sparkSession) if isinstance(policy, PolicyTable) else policy
        if active.enabled:
            sent, ignored = alerts.split_ignored(alerts.select_alerts(batch, active))
            found = alerts.rendered(sent, active).select("payload")
            found.write.mode("overwrite").text(f"{path}/batch={batch_id}")
            if active.ignore_keywords:
                ignored.write.mode("overwrite").parquet(f"{path}-ignored/batch={batch_id}")

    return send


def export_sink(path: str, options: ExportOptions, keys: list[str], order: list[str]) -> Sink:
    """Write the request documents of a batch; oversize records go to a side table."""

    def send(batch: DataFrame, batch_id: int | str) -> None:
        fits, rejected = enrich.split_oversize(batch, max_bytes=options.max_queue_bytes)
        held = []

        def hold(places: DataFrame) -> DataFrame:
            held.append(places.persist())
            return held[-1]

        try:
            documents = otlp.requests(otlp.pack_batches(fits, keys, order, options, hold=hold), keys)
            writer = documents.select("request").write.mode("overwrite")
            writer.option("compression", options.compression or "none").text(f"{path}/batch={batch_id}")
        finally:
            for places in held:
                places.unpersist()
        rejected.select("size", *keys).write.mode("overwrite").parquet(f"{path}-rejected/batch={batch_id}")

    return send


def fan_out(sinks: dict[str, Sink], outcomes: str) -> Sink:
    """One batch to all sinks in order; a failing sink never stops the others.

    Each outcome is a row of the ``outcomes`` table.
    """

    def send(batch: DataFrame, batch_id: int | str) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            rows = []
            for name, sink in sinks.items():
                try:
                    sink(batch, batch_id)
                    rows.append((str(batch_id), name, "ok", None))
                except Exception as error:  # noqa: BLE001 - best effort by design
                    said = str(error).splitlines() or [type(error).__name__]
                    rows.append((str(batch_id), name, "failed", said[0]))
            _outcomes(outcomes).put(spark.createDataFrame(rows, _OUTCOME).coalesce(1), table_step(batch_id))
        finally:
            batch.unpersist()

    return send


def read_outcomes(spark: SparkSession, outcomes: str) -> DataFrame:
    """``batch, sink, outcome, error`` of every micro-batch and drain."""
    return _outcomes(outcomes).before(spark).drop(ADDED)
