"""Daily volume series and a many-series additive forecast.

The model family follows Taylor & Letham, "Forecasting at Scale" (2018):
piecewise-linear trend with changepoints (Laplace prior on the rate changes),
Fourier weekly and yearly seasonality, no daily term. Each series is fitted
independently by a MAP solve (iteratively reweighted ridge) of its normal
equations, which are a distributed aggregate over the days.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics import rules

FORECAST_SCHEMA = (
    "serie string, ds date, yhat double, yhat_lower double, yhat_upper double, "
    "trend double, weekly double, yearly double"
)

# Fixed model settings.
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
CHANGEPOINT_PRIOR_SCALE = 0.05
SEASONALITY_PRIOR_SCALE = 10.0
TREND_PRIOR_SCALE = 5.0
WEEKLY_ORDER, WEEKLY_PERIOD = 3, 7.0
YEARLY_ORDER, YEARLY_PERIOD = 10, 365.25
INTERVAL_WIDTH = 0.80
IRLS_ITERATIONS = 15


def daily_series(
    df: DataFrame, date_col: str = "fecha_file", type_col: str = "tipo", all_label: str = rules.ALL_SERIES
) -> DataFrame:
    """Rows per (series, day): one series per type plus one over all rows.

    A type named like the all-rows series has no series of its own, so the name
    stays unique; its rows count in the total.

    Counted once per (type, day); the all-rows series is summed from those
    counts, so the fact rows are aggregated once, not twice.
    """
    per_type = (
        df.where(F.col(date_col).isNotNull())
        .groupBy(F.col(type_col).alias("_t"), F.to_date(date_col).alias("ds"))
        .agg(F.count(F.lit(1)).alias("y"))
    )
    typed = per_type.where(F.col("_t") != F.lit(all_label)).select(F.col("_t").cast("string").alias("serie"), "ds", "y")
    everything = per_type.groupBy("ds").agg(F.sum("y").alias("y")).select(F.lit(all_label).alias("serie"), "ds", "y")
    return typed.unionByName(everything)


def forecast_eligible(
    daily: DataFrame, min_rows: int = rules.FORECAST_MIN_ROWS, min_days: int = rules.FORECAST_MIN_DAYS
) -> DataFrame:
    """Series with enough rows and days to be fitted."""
    return (
        daily.groupBy("serie")
        .agg(F.sum("y").cast("bigint").alias("filas"), F.count(F.lit(1)).alias("dias"))
        .where((F.col("filas") >= min_rows) & (F.col("dias") >= min_days))
    )


def _fourier(days: np.ndarray, period: float, order: int) -> np.ndarray:
    angles = 2.0 * np.pi * np.outer(days, np.arange(1, order + 1)) / period
    return np.hstack([np.sin(angles), np.cos(angles)])


def _design(t: np.ndarray, epoch_days: np.ndarray, changepoints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend (level, slope, a hinge for each changepoint), weekly and yearly columns of the given days."""
    hinges = np.maximum(t[:, None] - changepoints[None, :], 0.0)
    trend = np.hstack([np.ones((len(t), 1)), t[:, None], hinges])
    return trend, _fourier(epoch_days, WEEKLY_PERIOD, WEEKLY_ORDER), _fourier(epoch_days, YEARLY_PERIOD, YEARLY_ORDER)


def _of_series(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row = pdf.iloc[0]
    epoch = pdf["epoch"].to_numpy(dtype=float)
    return _design((epoch - row["first_epoch"]) / row["span"], epoch, np.asarray(row["changepoints"], dtype=float))


def series_frame(
    daily: DataFrame, min_rows: int = rules.FORECAST_MIN_ROWS, min_days: int = rules.FORECAST_MIN_DAYS
) -> DataFrame:
    """What the fit needs to know of each eligible series: days, span, scale and changepoints.

    Time runs from 0 to 1 over the observed span. Changepoints are at up to 25
    evenly spaced of the first 80 % of the observed days.
    """
    order = Window.partitionBy("serie").orderBy("ds")
    days = daily.select("serie", F.unix_date("ds").alias("epoch"), "y", (F.row_number().over(order) - 1).alias("rank"))
    stats = days.groupBy("serie").agg(
        F.sum("y").alias("filas"),
        F.count(F.lit(1)).alias("days"),
        F.min("epoch").alias("first_epoch"),
        F.max("epoch").alias("last_epoch"),
        F.greatest(F.max(F.abs("y")).cast("double"), F.lit(1.0)).alias("scale"),
        F.collect_list(F.struct("rank", "epoch")).alias("at"),  # of one series: bounded by the calendar
    )
    window = F.floor(F.col("days") * F.lit(CHANGEPOINT_RANGE)).cast("int")
    n_cp = F.greatest(F.least(F.lit(N_CHANGEPOINTS), window - 1), F.lit(0))
    span = F.greatest(F.col("last_epoch") - F.col("first_epoch"), F.lit(1)).cast("double")
    step = (F.col("window") - 1) / F.col("n_cp")
    ranks = F.when(F.col("n_cp") > 0, F.transform(F.sequence(F.lit(1), F.col("n_cp")), lambda k: F.rint(k * step).cast("int")))
    chosen = F.filter("at", lambda p: F.array_contains(F.col("ranks"), p["rank"]))
    return (
        stats.where((F.col("filas") >= min_rows) & (F.col("days") >= min_days))
        .withColumns({"window": window, "n_cp": n_cp, "span": span})
        .withColumn("ranks", F.coalesce(ranks, F.array().cast("array<int>")))
        .select(
            "serie", "days", "first_epoch", "last_epoch", "scale", "span",
            F.transform(F.array_sort(chosen), lambda p: (p["epoch"] - F.col("first_epoch")) / F.col("span")).alias("changepoints"),
        )
    )


def normal_equations(daily: DataFrame, series: DataFrame) -> DataFrame:
    """The normal equations of each series as rows ``(serie, i, j, valor)``, i <= j.

    They are the products of the design's columns and, as the last column, of the
    scaled counts, summed over the days. Each batch of days adds up its own part;
    an aggregate adds up the parts, so their number and the number of days do not
    matter to what solves them.
    """
    days = daily.select("serie", F.unix_date("ds").alias("epoch"), "y").join(series, "serie")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for serie, own in frame.groupby("serie", sort=False):
                x = np.hstack([*_of_series(own), (own["y"].to_numpy(dtype=float) / own["scale"].iloc[0])[:, None]])
                i, j = np.triu_indices(x.shape[1])
                yield pd.DataFrame({"serie": serie, "i": i, "j": j, "valor": (x.T @ x)[i, j]})

    parts = days.mapInPandas(partial, "serie string, i int, j int, valor double")
    return parts.groupBy("serie", "i", "j").agg(F.sum("valor").alias("valor"))


def solve(products: np.ndarray, n: int, n_cp: int) -> tuple[np.ndarray, float]:
    """Coefficients and residual variance from the products of columns and counts over ``n`` days.

    MAP by iteratively reweighted ridge: Gaussian priors on level, slope and
    seasonality; the Laplace prior on changepoint rates as a ridge weight
    sigma^2 / (scale * |delta|) from the previous solve.
    """
    gram, rhs, squares = products[:-1, :-1], products[:-1, -1], products[-1, -1]
    prior_sd = np.concatenate(
        [
            [TREND_PRIOR_SCALE, TREND_PRIOR_SCALE],
            np.full(n_cp, CHANGEPOINT_PRIOR_SCALE),
            np.full(2 * (WEEKLY_ORDER + YEARLY_ORDER), SEASONALITY_PRIOR_SCALE),
        ]
    )
    sigma2 = max(squares / n - (rhs[0] / n) ** 2, 1e-4)
    penalty = sigma2 / prior_sd**2
    cp = slice(2, 2 + n_cp)
    for _ in range(IRLS_ITERATIONS):
        beta = np.linalg.solve(gram + np.diag(penalty), rhs)
        sigma2 = max((squares - 2.0 * beta @ rhs + beta @ gram @ beta) / n, 1e-8)
        penalty = sigma2 / prior_sd**2
        penalty[cp] = sigma2 / (CHANGEPOINT_PRIOR_SCALE * np.maximum(np.abs(beta[cp]), 1e-6))
    return beta, float(sigma2)


def _solutions(equations: DataFrame, series: DataFrame) -> DataFrame:
    """Per series the coefficients: one small matrix for each, however many days it has."""
    matrices = equations.groupBy("serie").agg(F.array_sort(F.collect_list(F.struct("i", "j", "valor"))).alias("products"))

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for serie, days, n_cp, entries in zip(frame["serie"], frame["days"], frame["n_cp"], frame["products"]):
                p = entries[-1]["i"] + 1
                products = np.zeros((p, p))
                for e in entries:
                    products[e["i"], e["j"]] = products[e["j"], e["i"]] = e["valor"]
                out.append((serie, *solve(products, days, n_cp)))
            yield pd.DataFrame(out, columns=["serie", "beta", "sigma2"])

    given = matrices.join(series.select("serie", "days", F.size("changepoints").alias("n_cp")), "serie")
    return given.mapInPandas(solved, "serie string, beta array<double>, sigma2 double")


def _predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    z = 1.2815515655446004  # two-sided 80 % normal quantile
    for frame in frames:
        for serie, own in frame.groupby("serie", sort=False):
            trend_x, weekly_x, yearly_x = _of_series(own)
            row = own.iloc[0]
            beta, scale = np.asarray(row["beta"], dtype=float), float(row["scale"])
            n_cp, k_t, k_w = trend_x.shape[1] - 2, trend_x.shape[1], weekly_x.shape[1]
            trend, weekly = trend_x @ beta[:k_t], weekly_x @ beta[k_t : k_t + k_w]
            yearly = yearly_x @ beta[k_t + k_w :]
            yhat = trend + weekly + yearly
            # past the end the trend may go on changing as often (n_cp a unit of time)
            # and as much (mean absolute change) as in the history: the variance of
            # such a trend grows with the cube of the time past the end
            change = float(np.mean(np.abs(beta[2 : 2 + n_cp]))) if n_cp else 0.0
            past = np.maximum(trend_x[:, 1] - 1.0, 0.0)
            half = z * np.sqrt(row["sigma2"] + 2.0 * change**2 * n_cp * past**3 / 3.0)
            yield pd.DataFrame(
                {
                    "serie": serie,
                    "ds": own["ds"],
                    "yhat": yhat * scale,
                    "yhat_lower": (yhat - half) * scale,
                    "yhat_upper": (yhat + half) * scale,
                    "trend": trend * scale,
                    "weekly": weekly * scale,
                    "yearly": yearly * scale,
                }
            )


def forecast(
    daily: DataFrame,
    horizon: int = rules.FORECAST_HORIZON_DAYS,
    min_rows: int = rules.FORECAST_MIN_ROWS,
    min_days: int = rules.FORECAST_MIN_DAYS,
) -> DataFrame:
    """History days plus ``horizon`` future days for every eligible series.

    The days are read in batches, by any number of tasks; only the normal
    equations of a series, some fifty rows and columns, are in one place.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least one day")
    series = series_frame(daily, min_rows, min_days)
    fitted = series.join(_solutions(normal_equations(daily, series), series), "serie")
    ahead = F.explode(F.sequence(F.col("last_epoch") + 1, F.col("last_epoch") + horizon)).alias("epoch")
    epochs = daily.select("serie", F.unix_date("ds").alias("epoch")).unionByName(series.select("serie", ahead))
    rows = epochs.join(fitted, "serie").withColumn("ds", F.date_from_unix_date("epoch"))
    wanted = ["serie", "epoch", "ds", "first_epoch", "span", "scale", "changepoints", "beta", "sigma2"]
    return rows.select(*wanted).mapInPandas(_predict, FORECAST_SCHEMA)
