"""Streaming sessions in two levels of state, and a side sink for what no session takes.

Level 1 aggregates the events of a user in cells of one gap. Events combine
before the shuffle and cells of one user lie in different tasks, so a user with
most of the events is spread over the cluster. Level 2 joins the closed cells of
a user to sessions: it sees a row for each cell, and its state holds the sessions
that may still go on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from opsmetrics.operators.sessions import duration_micros

#: The setting that state with timers needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
# Why an event is in the side sink.
LATE, NO_USER, NO_TIME = "fuera de plazo", "sin usuario", "sin fecha"

_SESSION = (
    "username string, session_start timestamp, session_end timestamp, duration_minutes bigint, pages_visited array<string>, events bigint"
)


def _micros(column: pd.Series) -> list[int]:
    return column.astype("datetime64[us]").astype("int64").tolist()


class _JoinCells(StatefulProcessor):
    """Per user: open sessions and newly closed cells to sessions; those that nothing can reach any more come out."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions string")

    def close(self) -> None:
        pass

    def _settled(self, end: int) -> int:
        """When the cell that holds the last moment of the gap after ``end`` has closed."""
        return ((end + self.gap) // self.gap + 1) * self.gap

    def _step(self, key: tuple, parts: list, timers) -> Iterator[pd.DataFrame]:
        kept = self.open.get()
        parts += json.loads(kept[0]) if kept is not None else []
        joined: list[list] = []
        for start, end, pages, events in sorted(parts, key=lambda p: (p[0], p[1])):
            if joined and start - joined[-1][1] <= self.gap:
                last = joined[-1]
                last[1], last[2], last[3] = max(last[1], end), sorted({*last[2], *pages}), last[3] + events
            else:
                joined.append([start, end, sorted(pages), events])
        now = timers.getCurrentWatermarkInMs() * 1000
        done = [s for s in joined if self._settled(s[1]) <= now]
        still = [s for s in joined if self._settled(s[1]) > now]
        if still:
            self.open.update((json.dumps(still),))
            self.handle.registerTimer(min(self._settled(s[1]) for s in still) // 1000)
        else:
            self.open.clear()
        if done:
            yield pd.DataFrame(
                {
                    "username": key[0],
                    "session_start": pd.to_datetime([s[0] for s in done], unit="us"),
                    "session_end": pd.to_datetime([s[1] for s in done], unit="us"),
                    "duration_minutes": [(s[1] - s[0]) // 60_000_000 for s in done],
                    "pages_visited": [s[2] for s in done],
                    "events": [s[3] for s in done],
                }
            )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for frame in rows:
            parts += zip(_micros(frame["first"]), _micros(frame["last"]), map(list, frame["pages"]), frame["events"].tolist())
        yield from self._step(key, parts, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key, [], timerValues)


def sessionize_cells_stream(
    events: DataFrame,
    gap: str = "6 hours",
    watermark: str = "1 hour",
    user_col: str = "username",
    ts_col: str = "ts",
    page_col: str = "event_type",
) -> DataFrame:
    """Streaming gap sessions with the columns of the batch ``sessionize``, plus the number of ``events``.

    A session comes out once the watermark has passed the end of the cell in
    which its gap ends, so up to one gap later than with one level. Rows without
    user or time, and events behind the watermark, are left out: route them with
    ``start_event_split`` first. The session must have the state store ``STATE_STORE``.
    """
    gap_us = duration_micros(gap)
    if gap_us % 1000:
        raise ValueError("the gap must be whole milliseconds")
    if not events.sparkSession.conf.get(STATE_STORE[0]).endswith(".RocksDBStateStoreProvider"):
        raise ValueError(f"set {STATE_STORE[0]} to {STATE_STORE[1]} before the stream is made")
    ts = F.col("_event_time")
    cells = (
        events.where(F.col(user_col).isNotNull() & F.col(ts_col).isNotNull())
        .withColumn("_event_time", F.col(ts_col).cast("timestamp"))
        .withWatermark("_event_time", watermark)
        .groupBy(F.col(user_col).alias("username"), F.window(ts, f"{gap_us} microseconds").alias("window"))
        .agg(
            F.min(ts).alias("first"),
            F.max(ts).alias("last"),
            F.collect_set(page_col).alias("pages"),
            F.count(F.lit(1)).alias("events"),
        )
        .select("username", F.window_time("window").alias("cell_time"), "first", "last", "pages", "events")
    )
    sessions = cells.groupBy("username").transformWithStateInPandas(_JoinCells(gap_us), _SESSION, "append", "EventTime")
    return sessions.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _publish(spark: SparkSession, staged: str, path: str) -> None:
    """Put a written folder in its place, whole at once."""
    jvm = spark._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise RuntimeError(f"cannot put {staged} in its place {path}")


def start_event_split(
    events: DataFrame,
    accepted_path: str,
    late_path: str,
    checkpoint_location: str,
    watermark: str = "1 hour",
    trigger: dict | None = None,
    user_col: str = "username",
    ts_col: str = "ts",
) -> StreamingQuery:
    """Split a stream by its watermark: every event is in ``accepted_path`` or, with its reason, in ``late_path``.

    The watermark of a micro-batch is the newest event of all earlier ones less
    ``watermark``, as in Spark's own operators. Events behind it, and rows without
    user or time, get the column ``motivo`` and the watermark they missed.

    A batch's newest event is noted next to the checkpoint before its accepted rows are
    put in place, in one step; a batch that is replayed after that is left as it
    is, and one replayed before it gives the same rows. So a stream over
    ``accepted_path`` reads each event once. It drops none of them, provided it takes
    the files of a batch together (no ``maxFilesPerTrigger``).
    """
    lateness = duration_micros(watermark)
    progress = f"{checkpoint_location.rstrip('/')}-split"

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = f"{accepted_path.rstrip('/')}/batch_id={batch_id}"
        if _exists(spark, place):
            return
        newest = None
        if batch_id > 0:
            newest = spark.read.schema("newest timestamp_ntz").json(f"{progress}/batch_id={batch_id - 1}").first()["newest"]
        rows = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            ts = F.col(ts_col).cast("timestamp_ntz")
            limit = F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL '{lateness}' MICROSECOND") if newest else F.lit(None).cast("timestamp_ntz")
            reason = (
                F.when(F.col(user_col).isNull(), NO_USER).when(ts.isNull(), NO_TIME).when(F.coalesce(ts < limit, F.lit(False)), LATE)
            )
            marked = rows.select("*", reason.alias("motivo"), limit.alias("limite"))
            marked.where("motivo is not null").write.mode("overwrite").parquet(f"{late_path.rstrip('/')}/batch_id={batch_id}")
            seen = rows.where(F.col(user_col).isNotNull()).agg(F.greatest(F.max(ts), F.lit(newest).cast("timestamp_ntz")).alias("newest"))
            seen.coalesce(1).write.mode("overwrite").json(f"{progress}/batch_id={batch_id}")
            staged = f"{progress}/accepted-{batch_id}"
            marked.where("motivo is null").drop("motivo", "limite").write.mode("overwrite").parquet(staged)
            _publish(spark, staged, place)
        finally:
            rows.unpersist()

    return (
        events.writeStream.foreachBatch(split)
        .option("checkpointLocation", checkpoint_location)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
