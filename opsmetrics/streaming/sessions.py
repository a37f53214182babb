"""Streaming sessionization with a watermark, written batch by batch.

State per user is bounded by the gap plus the allowed lateness: a session is
emitted (append mode) once the watermark passes its end + gap, and later events
are dropped. The watermark needs a TIMESTAMP (LTZ) event time, so the NTZ event
time is cast in the session time zone and cast back for the sink.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opsmetrics.functions.expr import MICROS_PER_MINUTE
from opsmetrics.sources.sinks import write_dead_letter


def sessionize_stream(
    events: DataFrame,
    gap: str = "6 hours",
    watermark: str = "1 hour",
    user_col: str = "username",
    ts_col: str = "ts",
    page_col: str = "event_type",
) -> DataFrame:
    """Streaming gap sessions; same columns as the batch ``sessionize``."""
    ts = F.col("_event_time")
    sessions = (
        events.where(F.col(user_col).isNotNull() & F.col(ts_col).isNotNull())
        .withColumn("_event_time", F.col(ts_col).cast("timestamp"))
        .withWatermark("_event_time", watermark)
        .groupBy(F.col(user_col).alias("username"), F.session_window(ts, gap).alias("_w"))
        .agg(
            F.min(ts).alias("_start"),
            F.max(ts).alias("_end"),
            F.array_sort(F.collect_set(page_col)).alias("pages_visited"),
        )
    )
    minutes = F.floor(F.timestamp_diff("MICROSECOND", F.col("_start"), F.col("_end")) / F.lit(MICROS_PER_MINUTE))
    return sessions.select(
        "username",
        F.col("_start").cast("timestamp_ntz").alias("session_start"),
        F.col("_end").cast("timestamp_ntz").alias("session_end"),
        minutes.cast("bigint").alias("duration_minutes"),
        "pages_visited",
    )


def start_sessions_sink(
    sessions: DataFrame,
    path: str,
    dead_letter_path: str,
    checkpoint_location: str,
    trigger: dict | None = None,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Append streamed sessions through ``foreachBatch``.

    Each micro-batch is written to its own ``run=<query id>/batch_id=N`` folder with
    overwrite: a batch replayed after a failure replaces its earlier attempt, and
    a new stream, whose batches count from 0 again, has a folder of its own.

    The batch is computed first, so an error upstream ends the stream. Only a
    failed write goes to the dead-letter sink, with the whole error text; the
    query's ``dead_letters`` list names those batches. ``trigger`` takes the
    arguments of ``DataStreamWriter.trigger`` (default: all available, then end);
    the size of a micro-batch is set where the stream is read
    (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
    """
    dead_letters: list[str] = []

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        place = f"run={run}/batch_id={batch_id}"
        rows = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            rows.count()
            try:
                rows.write.format(fmt).mode("overwrite").save(f"{path.rstrip('/')}/{place}")
            except Exception as exc:  # the failure is the payload of the fallback sink
                write_dead_letter(rows, exc, f"{dead_letter_path.rstrip('/')}/{place}", "overwrite")
                dead_letters.append(place)
        finally:
            rows.unpersist()

    query = (
        sessions.writeStream.outputMode("append")
        .foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint_location)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    query.dead_letters = dead_letters
    return query
