"""User sessions from an event log and the usage metrics built on them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics import rules
from opsmetrics.functions import ts_literal
from opsmetrics.functions.expr import MICROS_PER_MINUTE


_UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}


def duration_micros(gap: str | dt.timedelta) -> int:
    """'6 hours', '1 hour 30 minutes' or a timedelta, in microseconds."""
    if isinstance(gap, dt.timedelta):
        return int(gap / dt.timedelta(microseconds=1))
    parts = gap.lower().replace("interval", "").split()
    if len(parts) % 2:
        raise ValueError(f"cannot read duration {gap!r}")
    total = 0
    for amount, unit in zip(parts[::2], parts[1::2]):
        unit = unit.rstrip("s") if unit.rstrip("s") in _UNIT_MICROS else unit
        if unit not in _UNIT_MICROS:
            raise ValueError(f"unknown unit in duration {gap!r}")
        total += int(float(amount) * _UNIT_MICROS[unit])
    if total <= 0:
        raise ValueError("gap must be positive")
    return total


def _epoch_micros(ts):
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def sessionize(
    events: DataFrame,
    gap: str | dt.timedelta = "6 hours",
    user_col: str = "username",
    ts_col: str = "ts",
    page_col: str = "event_type",
) -> DataFrame:
    """Gap sessions per user: a new session starts when the next event comes more
    than ``gap`` after the previous one (exactly ``gap`` stays in the session).

    1. Time is cut into cells of one gap. Events of a user in one cell are always
       in one session, so a plain aggregate with map-side combine leaves a row
       per user and cell, however many events a user has.
    2. The cells of a user in order: a cell starts a session when it begins more
       than the gap after the end of the one before.
    3. Cells are gathered per session. Pages are exploded first, so the set holds
       the distinct pages of a session, not a list for each cell.

    The end is the last event; duration is whole minutes, truncated; pages are
    the sorted distinct page names.
    """
    gap_us = duration_micros(gap)
    ts = F.col(ts_col)
    ev = events.where(F.col(user_col).isNotNull() & ts.isNotNull()).select(
        F.col(user_col).alias("username"),
        ts.alias("_ts"),
        F.col(page_col).alias("_page"),
        F.floor(_epoch_micros(ts) / F.lit(gap_us)).alias("_cell"),
    )
    cells = ev.groupBy("username", "_cell").agg(
        F.min("_ts").alias("_s"), F.max("_ts").alias("_e"), F.collect_set("_page").alias("_p")
    )
    order = Window.partitionBy("username").orderBy("_cell")
    pause = F.timestamp_diff("MICROSECOND", F.lag("_e").over(order), F.col("_s"))
    numbered = cells.withColumn("_new", F.when(pause <= gap_us, 0).otherwise(1)).withColumn(
        "_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    sessions = (
        numbered.select("username", "_session", "_s", "_e", F.explode_outer("_p").alias("_page"))
        .groupBy("username", "_session")
        .agg(
            F.min("_s").alias("session_start"),
            F.max("_e").alias("session_end"),
            F.array_sort(F.collect_set("_page")).alias("pages_visited"),
        )
    )
    minutes = F.floor(F.timestamp_diff("MICROSECOND", F.col("session_start"), F.col("session_end")) / F.lit(MICROS_PER_MINUTE))
    return sessions.select(
        "username", "session_start", "session_end", minutes.cast("bigint").alias("duration_minutes"), "pages_visited"
    )


def _window(sessions: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    return sessions.where(F.col("session_start") >= ts_literal(as_of - dt.timedelta(days=days)))


def session_summary(sessions: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Sessions, distinct users, mean minutes and total hours since as_of - days.

    No row when there is no session in the period.
    """
    return (
        _window(sessions, as_of, days)
        .agg(
            F.count(F.lit(1)).alias("total_sessions"),
            F.count_distinct("username").alias("unique_users"),
            F.avg("duration_minutes").alias("avg_duration_minutes"),
            (F.sum("duration_minutes") / F.lit(60.0)).alias("total_hours"),
        )
        .where(F.col("total_sessions") > 0)
    )


def session_summaries(sessions: DataFrame, as_of: dt.datetime, periods: tuple[int, ...] = rules.USAGE_PERIODS) -> DataFrame:
    """``session_summary`` of several periods at once, a row for each (``days``) that has a session.

    A session belongs to the shortest period that reaches back to it, and to all
    longer ones; a user to the shortest period of any of their sessions. So one
    aggregate by user, and one over the users, hold the figures of each period
    by itself; those of a period are the sums up to it.
    """
    periods = sorted(set(periods))
    shortest = F.coalesce(
        *[F.when(F.col("session_start") >= ts_literal(as_of - dt.timedelta(days=d)), F.lit(i)) for i, d in enumerate(periods)]
    )
    placed = _window(sessions, as_of, periods[-1]).select("username", "duration_minutes", shortest.alias("_p"))
    own = range(len(periods))
    per_user = placed.groupBy("username").agg(
        F.min("_p").alias("_first"),
        F.array(*[F.count_if(F.col("_p") == i) for i in own]).alias("_n"),
        F.array(*[F.count(F.when(F.col("_p") == i, F.col("duration_minutes"))) for i in own]).alias("_timed"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("_p") == i, F.col("duration_minutes"))), F.lit(0)) for i in own]).alias("_minutes"),
    )
    known = F.col("username").isNotNull()
    up_to = lambda what, i: sum((F.sum(F.get(what, F.lit(j))) for j in range(i + 1)), F.lit(0))
    rows = [
        F.struct(
            F.lit(d).alias("days"),
            up_to("_n", i).cast("bigint").alias("total_sessions"),
            F.count_if(known & (F.col("_first") <= i)).alias("unique_users"),
            F.try_divide(up_to("_minutes", i).cast("double"), up_to("_timed", i)).alias("avg_duration_minutes"),
            F.when(up_to("_timed", i) > 0, up_to("_minutes", i) / F.lit(60.0)).alias("total_hours"),
        )
        for i, d in enumerate(periods)
    ]
    return per_user.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows")).where(F.col("total_sessions") > 0)


def sessions_by_user(sessions: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Sessions per user in the period."""
    return (
        _window(sessions, as_of, days)
        .where(F.col("username").isNotNull())
        .groupBy("username")
        .agg(F.count(F.lit(1)).alias("sesiones"))
    )


def sessions_by_day(sessions: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Sessions per start day in the period (days without sessions are absent)."""
    return (
        _window(sessions, as_of, days)
        .groupBy(F.to_date("session_start").alias("fecha"))
        .agg(F.count(F.lit(1)).alias("sesiones"))
    )


def minute_text(c: str):
    """'yyyy-MM-dd HH:mm' of a timestamp_ntz, time-zone free."""
    return F.substring(F.col(c).cast("string"), 1, 16)


def recent_sessions(sessions: DataFrame, n: int = rules.RECENT_SESSIONS) -> DataFrame:
    """The n newest sessions (ties by user name) for display."""
    return (
        sessions.orderBy(F.desc("session_start"), F.asc("username"))
        .limit(n)
        .select("username", minute_text("session_start").alias("session_start"), minute_text("session_end").alias("session_end"), "duration_minutes")
    )
