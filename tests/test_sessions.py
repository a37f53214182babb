import datetime as dt
import os

from opsmetrics.operators import sessions as S
from opsmetrics.streaming import sessionize_stream, start_sessions_sink
from tests.conftest import rows

D = dt.datetime
T0 = D(2024, 1, 10, 8)
EV_SCHEMA = "username string, ts timestamp_ntz, event_type string"


def h(x):
    return T0 + dt.timedelta(hours=x)


EVENTS = [
    ("u1", h(0), "view"), ("u1", h(1), "click"), ("u1", h(1.5), "view"),
    ("u1", h(7.5), "buy"),  # exactly 6 h after the previous event: same session
    ("u1", h(13.6), "view"),  # more than 6 h later: new session
    ("u2", h(2), "error"), ("u2", h(2) + dt.timedelta(seconds=119), None),
    (None, h(3), "view"),
]


def test_sessionize_gap_duration_pages(spark):
    out = S.sessionize(spark.createDataFrame(EVENTS, EV_SCHEMA))
    got = rows(out, "username", "session_start", "session_end", "duration_minutes", "pages_visited")
    assert got == [
        ("u1", h(0), h(7.5), 450, ["buy", "click", "view"]),
        ("u1", h(13.6), h(13.6), 0, ["view"]),
        ("u2", h(2), h(2) + dt.timedelta(seconds=119), 1, ["error"]),
    ]


def test_usage_metrics(spark):
    sess = S.sessionize(spark.createDataFrame(EVENTS, EV_SCHEMA))
    as_of = D(2024, 1, 12)
    summary = S.session_summary(sess, as_of, days=7).collect()[0]
    assert (summary.total_sessions, summary.unique_users) == (3, 2)
    assert summary.avg_duration_minutes == 451 / 3 and summary.total_hours == 451 / 60
    assert S.session_summary(sess, D(2030, 1, 1), days=7).count() == 0
    assert rows(S.sessions_by_user(sess, as_of, 7)) == [("u1", 2), ("u2", 1)]
    assert rows(S.sessions_by_day(sess, as_of, 7)) == [(dt.date(2024, 1, 10), 3)]
    recent = S.recent_sessions(sess, n=2).collect()
    assert [(r.username, r.session_start, r.session_end) for r in recent] == [
        ("u1", "2024-01-10 21:36", "2024-01-10 21:36"), ("u2", "2024-01-10 10:00", "2024-01-10 10:01")
    ]


def test_all_periods_at_once_equal_each_by_itself(spark):
    as_of = D(2024, 1, 31)
    data = [("a", 1, 5), ("a", 6.9, 7), ("a", 80, 1), ("b", 15, 2), ("b", 15.01, 3), ("c", 91, 4), (None, 20, 6), ("d", 59, None), ("e", -2, 9)]
    sess = spark.createDataFrame(
        [(u, as_of - dt.timedelta(days=d), m) for u, d, m in data], "username string, session_start timestamp_ntz, duration_minutes bigint"
    )
    for given in (sess, sess.where("username = 'd'"), sess.where("username is null"), sess.where("false")):
        want = [(d, *r) for d in (7, 15, 30, 60, 90) for r in S.session_summary(given, as_of, d).collect()]
        out = S.session_summaries(given, as_of)
        assert sorted(map(tuple, out.collect())) == [tuple(r) for r in want]
    plan = S.session_summaries(sess, as_of)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_streaming_sessions_match_batch_and_drop_late_events(spark, tmpdir_path):
    src, out, dead, ckpt = (os.path.join(tmpdir_path, p) for p in ("src", "out", "dead", "ckpt"))
    first = EVENTS[:-1] + [("u3", h(48), "view")]  # u3 advances the watermark
    spark.createDataFrame(first, EV_SCHEMA).coalesce(1).write.parquet(f"{src}/part=1")

    def run():
        stream = spark.readStream.schema(EV_SCHEMA).parquet(src)
        q = start_sessions_sink(sessionize_stream(stream, gap="6 hours", watermark="1 hour"), out, dead, ckpt)
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    batch = S.sessionize(spark.createDataFrame(first, EV_SCHEMA))
    closed = batch.where(f"session_end < TIMESTAMP_NTZ '{h(48 - 1 - 6)}'")  # end + gap <= max - lateness
    cols = ("username", "session_start", "session_end", "duration_minutes", "pages_visited")
    streamed = spark.read.parquet(out)
    assert rows(streamed, *cols) == rows(closed, *cols)

    # a late event for u1 (inside its first session) arrives after the watermark passed
    spark.createDataFrame([("u1", h(0.5), "late")], EV_SCHEMA).coalesce(1).write.parquet(f"{src}/part=2")
    run()
    again = spark.read.parquet(out)
    assert rows(again, *cols) == rows(closed, *cols)
    assert not any("late" in r.pages_visited for r in again.collect())


def test_duration_micros():
    import pytest

    assert S.duration_micros("6 hours") == 6 * 3_600_000_000
    assert S.duration_micros("1 hour 30 minutes") == 5_400_000_000
    assert S.duration_micros(dt.timedelta(minutes=2)) == 120_000_000
    with pytest.raises(ValueError):
        S.duration_micros("6 fortnights")


def test_sessions_equal_python_brute_force(spark):
    import random

    rng = random.Random(11)
    data = []
    for user in ("a", "b", "c", "d"):
        t = T0
        for _ in range(rng.randrange(20, 120)):
            t += dt.timedelta(seconds=rng.choice([30, 600, 3600 * 5, 3600 * 6, 3600 * 6 + 1, 3600 * 30]))
            data.append((user, t, rng.choice(["x", "y", "z", None])))
    expected = []
    for user in ("a", "b", "c", "d"):
        evs = sorted((t, p) for u, t, p in data if u == user)
        cur = [evs[0]]
        for ev in evs[1:]:
            if ev[0] - cur[-1][0] > dt.timedelta(hours=6):
                expected.append((user, cur))
                cur = [ev]
            else:
                cur.append(ev)
        expected.append((user, cur))
    want = sorted(
        (u, s[0][0], s[-1][0], int((s[-1][0] - s[0][0]).total_seconds() // 60), sorted({p for _, p in s if p is not None}))
        for u, s in expected
    )
    ev = spark.createDataFrame(data, EV_SCHEMA)
    got = sorted(
        (r.username, r.session_start, r.session_end, r.duration_minutes, list(r.pages_visited)) for r in S.sessionize(ev).collect()
    )
    assert got == want


def test_hot_user_is_combined_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    ev = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id"))).alias("username"),
        F.timestamp_add("SECOND", F.col("id") % 80_000, F.lit(T0).cast("timestamp_ntz")).alias("ts"),
        F.lit("view").alias("event_type"),
    )
    out = S.sessionize(ev)
    assert out.where("username = 'hot'").count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    first_exchange = plan.rindex("Exchange hashpartitioning(username")
    assert "partial_" in plan[first_exchange:]  # below the first shuffle


def _stream(spark, folder, name, **options):
    stream = spark.readStream.schema(EV_SCHEMA).options(**options).parquet(f"{folder}/{name}")
    return sessionize_stream(stream, gap="6 hours", watermark="1 hour")


def test_second_stream_keeps_the_sessions_of_the_first(spark, tmpdir_path):
    for user in ("x", "y"):
        data = [(user, h(0), "view"), ("end", h(48), "view")]
        spark.createDataFrame(data, EV_SCHEMA).coalesce(1).write.parquet(f"{tmpdir_path}/{user}")
        q = start_sessions_sink(_stream(spark, tmpdir_path, user), f"{tmpdir_path}/out", f"{tmpdir_path}/dead", f"{tmpdir_path}/ckpt-{user}")
        q.awaitTermination(120)
        assert q.dead_letters == []
    assert {r.username for r in spark.read.parquet(f"{tmpdir_path}/out").collect()} == {"x", "y"}


def test_failed_write_is_reported_and_kept_whole(spark, tmpdir_path):
    data = [("x", h(0), "view"), ("end", h(48), "view")]
    spark.createDataFrame(data, EV_SCHEMA).coalesce(1).write.parquet(f"{tmpdir_path}/in")
    q = start_sessions_sink(
        _stream(spark, tmpdir_path, "in"), f"{tmpdir_path}/out", f"{tmpdir_path}/dead", f"{tmpdir_path}/ckpt", fmt="no_such_format"
    )
    q.awaitTermination(120)
    assert q.dead_letters
    dead = spark.read.json(f"{tmpdir_path}/dead").collect()
    assert [r.username for r in dead if r.username] == ["x"] and "no_such_format" in dead[0].error


def test_upstream_error_ends_the_stream(spark, tmpdir_path):
    import pytest
    from pyspark.sql import functions as F

    data = [("x", h(0), "view"), ("end", h(48), "view")]
    spark.createDataFrame(data, EV_SCHEMA).coalesce(1).write.parquet(f"{tmpdir_path}/in")
    broken = _stream(spark, tmpdir_path, "in").withColumn("username", F.raise_error(F.lit("broken upstream")).cast("string"))
    q = start_sessions_sink(broken, f"{tmpdir_path}/out", f"{tmpdir_path}/dead", f"{tmpdir_path}/ckpt")
    with pytest.raises(Exception, match="broken upstream"):
        q.awaitTermination(120)
    assert q.dead_letters == []


def test_several_micro_batches_equal_one(spark, tmpdir_path):
    for i, data in enumerate([[("x", h(0), "a")], [("x", h(1), "b")], [("end", h(48), "view")]]):
        spark.createDataFrame(data, EV_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmpdir_path}/in")
    q = start_sessions_sink(
        _stream(spark, tmpdir_path, "in", maxFilesPerTrigger=1), f"{tmpdir_path}/out", f"{tmpdir_path}/dead", f"{tmpdir_path}/ckpt"
    )
    q.awaitTermination(120)
    got = [(r.username, r.session_start, r.session_end) for r in spark.read.parquet(f"{tmpdir_path}/out").collect()]
    assert got == [("x", h(0), h(1))]
