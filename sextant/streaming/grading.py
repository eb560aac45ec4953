"""Answers graded as they arrive; an addition of ours, batch and stream give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sextant.operators import grounding as G
from sextant.operators import orphans as O


def graded_stream(answers: DataFrame, requests: DataFrame, out: str, checkpoint: str, delay: str = "30 days") -> StreamingQuery:
    """Each new answer once: duplicates within ``delay`` are dropped by key, each batch is graded against the requests and appended.

    A batch is written under its number, so one that is repeated after a failure replaces itself.
    """
    once = answers.withWatermark("collected_at", delay).dropDuplicatesWithinWatermark(["custom_id"])

    def write(batch: DataFrame, number: int) -> None:
        G.answer_grading(G.unit_verdicts(batch, requests)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def orphan_stream(deltas: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Signed reference and existence counts kept under ``folder`` from a stream of (key, n_references, n_existing) deltas.

    The state after batch n is the folder ``state=n``; a repeated batch starts from the state before it.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.createDataFrame([], batch.schema) if number == 0 else spark.read.parquet(f"{folder}/state={number - 1}")
        O.apply_deltas(state, batch).write.mode("overwrite").parquet(f"{folder}/state={number}")

    return deltas.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
