import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsmetrics.operators import forecast as M
from tests.conftest import rows

START = dt.date(2022, 1, 1)


def synthetic(spark, days=420):
    data = []
    for i in range(days):
        d = START + dt.timedelta(days=i)
        y = 20 + 0.02 * i + 6 * math.sin(2 * math.pi * (d.toordinal() % 7) / 7)
        data.append(("X", d, int(round(y))))
    data += [("short", START, 5), ("short", START + dt.timedelta(days=1), 4)]  # 9 rows: not eligible
    data += [("one_day", START, 50)]  # one day: not eligible
    return spark.createDataFrame(data, "serie string, ds date, y bigint")


def test_daily_series_and_eligibility(spark):
    ops = spark.createDataFrame(
        [("A", dt.datetime(2024, 1, 1, 9)), ("A", dt.datetime(2024, 1, 1, 17)), ("M", dt.datetime(2024, 1, 2)), (None, dt.datetime(2024, 1, 2))],
        "tipo string, fecha_file timestamp_ntz",
    )
    got = rows(M.daily_series(ops))
    assert got == [("A", dt.date(2024, 1, 1), 2), ("M", dt.date(2024, 1, 2), 1), ("TODOS", dt.date(2024, 1, 1), 2), ("TODOS", dt.date(2024, 1, 2), 2)]
    assert rows(M.forecast_eligible(synthetic(spark))) == [("X", sum(r.y for r in synthetic(spark).where("serie = 'X'").collect()), 420)]


def test_forecast_shape_bounds_and_recovery(spark):
    daily = synthetic(spark)
    out = M.forecast(daily, horizon=30)
    pdf = out.toPandas().sort_values("ds")
    assert set(pdf["serie"]) == {"X"}
    assert len(pdf) == 420 + 30
    assert pdf["ds"].iloc[-1] == START + dt.timedelta(days=449)
    assert (pdf["yhat_lower"] <= pdf["yhat"]).all() and (pdf["yhat"] <= pdf["yhat_upper"]).all()
    assert np.allclose(pdf["yhat"], pdf["trend"] + pdf["weekly"] + pdf["yearly"])
    hist = pdf.iloc[:420]
    truth = daily.where("serie = 'X'").toPandas().sort_values("ds")["y"].to_numpy()
    assert np.mean(np.abs(hist["yhat"].to_numpy() - truth)) < 1.0
    weekly_true = np.array([6 * math.sin(2 * math.pi * (d.toordinal() % 7) / 7) for d in hist["ds"]])
    assert np.corrcoef(hist["weekly"], weekly_true)[0, 1] > 0.95
    future = pdf.iloc[420:]
    assert abs(future["trend"].mean() - (20 + 0.02 * 435)) < 1.5


def test_trend_follows_a_break(spark):
    data = []
    for i in range(500):
        level = 20 + 0.05 * i if i < 300 else 35 - 0.04 * (i - 300)
        data.append(("X", START + dt.timedelta(days=i), int(round(level))))
    daily = spark.createDataFrame(data, "serie string, ds date, y bigint")
    pdf = M.forecast(daily, horizon=60).toPandas().sort_values("ds")
    future = pdf.iloc[500:]
    slope = (future["trend"].iloc[-1] - future["trend"].iloc[0]) / 59
    assert -0.06 < slope < -0.02  # the post-break decline, not the earlier rise


def whole_fit(pdf, horizon):
    """The fit of one series in one piece: residuals instead of normal equations."""
    pdf = pdf.sort_values("ds")
    serie = pdf["serie"].iloc[0]
    ds = pd.to_datetime(pdf["ds"]).to_numpy().astype("datetime64[D]")
    y = pdf["y"].to_numpy(dtype=float)
    n = len(ds)
    future = ds[-1] + np.arange(1, horizon + 1).astype("timedelta64[D]")
    all_ds = np.concatenate([ds, future])
    span = max(float((ds[-1] - ds[0]).astype(int)), 1.0)
    t = (all_ds - ds[0]).astype(int).astype(float) / span
    y_scale = max(float(np.abs(y).max()), 1.0)
    ys = y / y_scale

    n_window = int(np.floor(n * M.CHANGEPOINT_RANGE))
    n_cp = min(M.N_CHANGEPOINTS, max(n_window - 1, 0))
    cps = t[np.linspace(0, n_window - 1, n_cp + 1).round().astype(int)[1:]] if n_cp > 0 else np.empty(0)
    hinges = np.maximum(t[:, None] - cps[None, :], 0.0)
    trend_x = np.hstack([np.ones((len(t), 1)), t[:, None], hinges])
    epoch_days = (all_ds - np.datetime64("1970-01-01")).astype(int).astype(float)
    weekly_x = M._fourier(epoch_days, M.WEEKLY_PERIOD, M.WEEKLY_ORDER)
    yearly_x = M._fourier(epoch_days, M.YEARLY_PERIOD, M.YEARLY_ORDER)
    x = np.hstack([trend_x, weekly_x, yearly_x])
    prior_sd = np.concatenate(
        [
            [M.TREND_PRIOR_SCALE, M.TREND_PRIOR_SCALE],
            np.full(n_cp, M.CHANGEPOINT_PRIOR_SCALE),
            np.full(weekly_x.shape[1] + yearly_x.shape[1], M.SEASONALITY_PRIOR_SCALE),
        ]
    )
    xh = x[:n]
    gram, rhs = xh.T @ xh, xh.T @ ys
    sigma2 = max(float(np.var(ys)), 1e-4)
    penalty = sigma2 / prior_sd**2
    cp = slice(2, 2 + n_cp)
    for _ in range(M.IRLS_ITERATIONS):
        # MAP by iteratively reweighted ridge: Gaussian priors on level, slope
        # and seasonality; the Laplace prior on changepoint rates as a ridge
        # weight sigma^2 / (scale * |delta|) from the previous solve
        beta = np.linalg.solve(gram + np.diag(penalty), rhs)
        sigma2 = max(float(np.mean((ys - xh @ beta) ** 2)), 1e-8)
        penalty = sigma2 / prior_sd**2
        penalty[cp] = sigma2 / (M.CHANGEPOINT_PRIOR_SCALE * np.maximum(np.abs(beta[cp]), 1e-6))
    k_t, k_w = trend_x.shape[1], weekly_x.shape[1]
    trend = trend_x @ beta[:k_t]
    weekly = weekly_x @ beta[k_t : k_t + k_w]
    yearly = yearly_x @ beta[k_t + k_w :]
    yhat = trend + weekly + yearly
    z = 1.2815515655446004  # two-sided 80 % normal quantile
    # past the end the trend may go on changing as often (n_cp a unit of time)
    # and as much (mean absolute change) as in the history: the variance of such
    # a trend grows with the cube of the time past the end
    change = float(np.mean(np.abs(beta[cp]))) if n_cp else 0.0
    past = np.maximum(t - 1.0, 0.0)
    half = z * np.sqrt(sigma2 + 2.0 * change**2 * n_cp * past**3 / 3.0)
    return pd.DataFrame(
        {
            "serie": serie,
            "ds": pd.to_datetime(all_ds).date,
            "yhat": yhat * y_scale,
            "yhat_lower": (yhat - half) * y_scale,
            "yhat_upper": (yhat + half) * y_scale,
            "trend": trend * y_scale,
            "weekly": weekly * y_scale,
            "yearly": yearly * y_scale,
        }
    )


@pytest.mark.parametrize("partitions", [1, 7])
def test_normal_equations_give_the_fit_of_the_whole_series(spark, partitions):
    rng = np.random.default_rng(4)
    data = []
    for serie, days, keep in (("long", 900, 0.8), ("mid", 60, 1.0), ("tiny", 2, 1.0), ("some", 12, 0.7)):
        for i in range(days):
            if i in (0, days - 1) or rng.random() < keep:
                data.append((serie, START + dt.timedelta(days=i), int(30 + 0.05 * i + 8 * math.sin(i / 3) + rng.integers(0, 9))))
    daily = spark.createDataFrame(data, "serie string, ds date, y bigint").repartition(partitions)
    got = M.forecast(daily, horizon=40).toPandas().sort_values(["serie", "ds"]).reset_index(drop=True)
    plain = pd.DataFrame(data, columns=["serie", "ds", "y"])
    want = pd.concat([whole_fit(own, 40) for _, own in plain.groupby("serie")]).sort_values(["serie", "ds"]).reset_index(drop=True)
    assert got[["serie", "ds"]].equals(want[["serie", "ds"]])
    few = got["serie"].isin(["tiny", "some"])  # fewer days than coefficients: their prior settles the fit, and rounding shows
    for c in ("yhat", "yhat_lower", "yhat_upper", "trend", "weekly", "yearly"):
        assert np.allclose(got[c][~few], want[c][~few], atol=1e-6, rtol=1e-6), c
        assert np.allclose(got[c][few], want[c][few], atol=1e-2, rtol=1e-3), c


def test_error_on_a_known_signal(spark):
    signal = lambda i: 50 + 0.1 * i + 9 * math.sin(2 * math.pi * (i % 7) / 7) + 12 * math.sin(2 * math.pi * i / 365.25)
    data = [("X", START + dt.timedelta(days=i), int(round(1000 * signal(i)))) for i in range(800)]
    pdf = M.forecast(spark.createDataFrame(data, "serie string, ds date, y bigint"), horizon=60).toPandas().sort_values("ds")
    truth = np.array([1000 * signal(i) for i in range(860)])
    error = np.abs(pdf["yhat"].to_numpy() - truth) / truth
    assert error[:800].max() < 0.02 and error[800:].max() < 0.06
