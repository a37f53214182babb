"""Properties of SURVEY section 5.3 on the generated sf0.001 tables, and
generated-value checks of the numeric rules against NumPy/pandas."""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsmetrics.functions import floor_days, round_half_even
from opsmetrics.operators import cycle, filters, ingest, volume, workload
from opsmetrics.plans import fixtures as fx
from tests.conftest import SF_SMALL


def test_volume_totals_agree(spark):
    ops = fx.operations(spark, SF_SMALL)
    files = ops.where(F.col("file").isNotNull()).count()
    assert volume.monthly_volume(ops).agg(F.sum("operaciones")).first()[0] == files
    assert volume.owner_type_summary(ops).agg(F.sum("total_operaciones")).first()[0] == files
    assert volume.type_distribution(ops).agg(F.sum("proporcion")).first()[0] == __import__("pytest").approx(1.0)


def test_capacity_and_levels(spark):
    ops = fx.operations(spark, SF_SMALL)
    cap = workload.available_capacity(ops)
    assert cap.where(F.col("cargas_posibles_adicionales") < 0).count() == 0
    owners = ops.select("operativo").distinct().count()
    types = ops.select("tipo").distinct().count()
    assert cap.count() == owners * types
    narrow = fx.operations(spark, SF_SMALL, narrow=True)
    flow = volume.flow_classification(narrow)
    assert volume.level_counts(flow).agg(F.sum("cantidad")).first()[0] == flow.count()


def test_slow_share_at_most_a_fifth_plus_ties(spark):
    closed = filters.closed_durations(fx.operations(spark, SF_SMALL))
    slow = cycle.slow_operations(closed).count()
    n = closed.count()
    threshold = cycle.bottleneck_insight(closed).first().umbral
    at_threshold = closed.where(F.col("duracion_real_dias") == threshold).count()
    assert slow <= 0.2 * n + at_threshold + 1


def test_upload_split_is_a_partition(spark):
    raw = fx.raw_upload(spark, SF_SMALL)
    result = ingest.analyze_upload(raw, fx.existing_ops(spark, SF_SMALL))
    deduped = ingest.upload_dedupe(ingest.valid_rows(ingest.clean_text(ingest.normalize_headers(raw))))
    new_keys = result.new.select("file")
    old_keys = result.existing.select("file")
    assert new_keys.intersect(old_keys).count() == 0
    assert new_keys.union(old_keys).exceptAll(deduped.select("file")).count() == 0
    assert new_keys.count() + old_keys.count() == deduped.count()
    counts = result.counts.first()
    assert (counts.nuevos, counts.existentes) == (new_keys.count(), old_keys.count())
    assert counts.duplicados == result.duplicates.count()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_subnormal=False), min_size=1, max_size=30),
       st.integers(min_value=0, max_value=6))
def test_round_half_even_matches_numpy(spark, values, k):
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(round_half_even("v", k)).collect()]
    assert got == [float(np.round(v, k)) for v in values]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.datetimes(min_value=dt.datetime(1990, 1, 1), max_value=dt.datetime(2030, 1, 1)),
                          st.timedeltas(min_value=dt.timedelta(days=-400), max_value=dt.timedelta(days=400))),
                min_size=1, max_size=30))
def test_floor_days_matches_pandas(spark, pairs):
    data = [(a, a + d) for a, d in pairs]
    got = [r[0] for r in spark.createDataFrame(data, "a timestamp_ntz, b timestamp_ntz").select(floor_days("a", "b")).collect()]
    want = [int((pd.Timestamp(b) - pd.Timestamp(a)).days) for a, b in data]
    assert got == want


@settings(max_examples=15, deadline=None)
@given(
    st.one_of(st.none(), st.lists(st.integers(min_value=1995, max_value=2002), max_size=4)),
    st.one_of(st.none(), st.lists(st.tuples(st.integers(1995, 2002), st.integers(1, 12)), max_size=5)),
    st.one_of(st.none(), st.lists(st.sampled_from(["A", "M", "Z", "Q"]), max_size=3)),
)
def test_apply_filters_matches_python(spark, years, months, tipos):
    rng = np.random.default_rng(3)
    base = dt.datetime(1995, 1, 1)
    rows = [
        (f"f{i}", ["A", "M", "Z", None][i % 4], base + dt.timedelta(hours=int(h)))
        for i, h in enumerate(rng.integers(0, 24 * 365 * 8, 400))
    ]
    df = spark.createDataFrame(rows, "file string, tipo string, fecha_file timestamp_ntz")
    month_keys = None if months is None else [f"{y:04d}-{m:02d}" for y, m in months]
    got = sorted(r.file for r in filters.apply_filters(df, years=years, months=month_keys, tipos=tipos).collect())

    def keep(tipo, ts):
        if years is not None and ts.year not in years:
            return False
        if months is not None and (ts.year, ts.month) not in set(months):
            return False
        return tipos is None or tipo in tipos

    assert got == sorted(f for f, t, ts in rows if keep(t, ts))
