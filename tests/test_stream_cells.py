"""Two-level streaming sessions and the split of late events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opsmetrics.operators import sessions as S
from opsmetrics.streaming import sessionize_cells_stream, start_event_split, start_sessions_sink
from opsmetrics.streaming.cells import STATE_STORE
from tests.conftest import rows

SCHEMA = "username string, ts timestamp_ntz, event_type string"
T0 = dt.datetime(2024, 1, 10)
GAP = dt.timedelta(hours=6)
COLS = ("username", "session_start", "session_end", "duration_minutes", "pages_visited")


@pytest.fixture(autouse=True)
def state_store(spark):
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    yield
    spark.conf.set(STATE_STORE[0], before)


def settled(end, gap=GAP):
    """When the cell that holds the end of the gap after a session has closed."""
    epoch = dt.datetime(1970, 1, 1)
    return epoch + ((end + gap - epoch) // gap + 1) * gap


def visits(seed, users=4, n=60):
    rng, out = random.Random(seed), []
    for u in range(users):
        t = T0 + dt.timedelta(minutes=rng.randrange(600))
        for _ in range(n):
            t += dt.timedelta(seconds=rng.choice([20, 900, 3600 * 2, 3600 * 6, 3600 * 6 + 1, 3600 * 7, 3600 * 20]))
            out.append((f"u{u}", t, rng.choice(["a", "b", "c", None])))
    return sorted(out, key=lambda e: e[1])


def put(spark, data, folder, i):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={i}")


def run(spark, folder, base):
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    query = start_sessions_sink(sessionize_cells_stream(stream), f"{base}/out", f"{base}/dead", f"{base}/ckpt")
    query.awaitTermination(300)
    assert query.exception() is None and query.dead_letters == []
    return spark.read.parquet(f"{base}/out")


def test_closed_sessions_equal_batch_also_after_restarts(spark, tmpdir_path):
    events = visits(3)
    third = len(events) // 3
    for i in range(3):
        put(spark, events[i * third : (i + 1) * third if i < 2 else None], f"{tmpdir_path}/in", i)
        out = run(spark, f"{tmpdir_path}/in", tmpdir_path)  # the same checkpoint, a new query each time
        seen = events[: (i + 1) * third] if i < 2 else events
        limit = max(t for _, t, _ in seen) - dt.timedelta(hours=1)
        batch = S.sessionize(spark.createDataFrame(seen, SCHEMA)).collect()
        want = sorted(tuple(r[c] for c in COLS) for r in batch if settled(r.session_end) <= limit)
        assert sorted(tuple(r[c] for c in COLS) for r in out.collect()) == want, i
    assert len(want) > 40


def test_hot_user_is_spread_by_cells(spark, tmpdir_path):
    hot = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 500)).alias("username"),
        F.timestamp_add("SECOND", F.col("id") * 20, F.lit(T0).cast("timestamp_ntz")).alias("ts"),
        F.lit("view").alias("event_type"),
    )
    hot.coalesce(2).write.parquet(f"{tmpdir_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmpdir_path}/in")
    query = start_sessions_sink(sessionize_cells_stream(stream), f"{tmpdir_path}/out", f"{tmpdir_path}/dead", f"{tmpdir_path}/ckpt")
    query.awaitTermination(300)
    first = next(p for p in query.recentProgress if p["numInputRows"])
    cells, joined = first["stateOperators"][-1], first["stateOperators"][0]
    if "window" not in str(cells.get("operatorName")) and cells["operatorName"] != "stateStoreSave":
        cells, joined = joined, cells
    span = 60_000 * 20 // (6 * 3600) + 2
    assert cells["operatorName"] == "stateStoreSave" and 0 < cells["numRowsTotal"] <= 501 * span < 60_000
    plan = query._jsq.explainInternal(False)
    assert "partial_" in plan[plan.index("StateStoreRestore") :]  # events combine before the shuffle of cells


def test_every_event_is_in_a_session_or_in_the_side_sink(spark, tmpdir_path):
    events = visits(5, n=40)
    cut = events[len(events) // 2][1]
    early = [e for e in events if e[1] < cut]
    held, sent = early[::7], [e for i, e in enumerate(early) if i % 7]
    last = max(t for _, t, _ in events)
    put(spark, [*sent, (None, T0, "a"), ("u0", None, "a")], f"{tmpdir_path}/in", 0)
    put(spark, [*held, *(e for e in events if e[1] >= cut), (None, None, "a")], f"{tmpdir_path}/in", 1)
    put(spark, [("end", last + dt.timedelta(days=3), "end")], f"{tmpdir_path}/in", 2)
    base = tmpdir_path

    def split():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        query = start_event_split(stream, f"{base}/accepted", f"{base}/late", f"{base}/ckpt-a")
        query.awaitTermination(300)
        assert query.exception() is None

    split()
    put(spark, [("u0", T0, "too late"), ("end", last + dt.timedelta(days=4), "end")], f"{base}/in", 3)
    split()  # goes on from its checkpoint
    late, accepted = spark.read.parquet(f"{base}/late"), spark.read.parquet(f"{base}/accepted")
    total = len(events) + 3 + 1 + 2
    assert late.count() + accepted.count() == total
    limit = max(t for _, t, _ in sent) - dt.timedelta(hours=1)
    want = [(e[0], e[1]) for e in held if e[1] < limit] + [("u0", T0)]
    assert rows(late.where("motivo = 'fuera de plazo'"), "username", "ts") == sorted(want)
    assert rows(late.where("motivo <> 'fuera de plazo'"), "motivo") == [("sin fecha",), ("sin usuario",), ("sin usuario",)]

    stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/accepted")
    query = start_sessions_sink(sessionize_cells_stream(stream), f"{base}/out", f"{base}/dead", f"{base}/ckpt-b")
    query.awaitTermination(300)
    in_sessions = spark.read.parquet(f"{base}/out").agg(F.sum("events")).first()[0]
    open_events = 1  # the newest one, which moved the watermark
    assert in_sessions + open_events + late.count() == total
