"""Global filters, filter facets, open and closed operations."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmetrics import rules
from opsmetrics.functions import floor_days, is_open, month_key, month_label, ts_literal
from opsmetrics.sources.readers import coerce_dates


def _ranges(starts: list[dt.date], step) -> list[tuple[dt.date, dt.date]]:
    """Merge sorted period starts into [start, end) ranges of consecutive periods."""
    out: list[tuple[dt.date, dt.date]] = []
    for s in starts:
        e = step(s)
        if out and out[-1][1] == s:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _next_month(d: dt.date) -> dt.date:
    return dt.date(d.year + (d.month == 12), d.month % 12 + 1, 1)


def _in_ranges(ts: Column, ranges: list[tuple[dt.date, dt.date]]) -> Column:
    pred = F.lit(False)
    for lo, hi in ranges:
        pred = pred | ((ts >= ts_literal(lo)) & (ts < ts_literal(hi)))
    return pred


def year_predicate(ts: Column, years: Iterable[int]) -> Column:
    """``year(ts) IN years`` as range predicates, which reach the parquet scan."""
    starts = [dt.date(int(y), 1, 1) for y in sorted(set(years))]
    return _in_ranges(ts, _ranges(starts, lambda d: dt.date(d.year + 1, 1, 1)))


def month_start(month: str) -> dt.date:
    """First day of a month given as ``yyyy-MM`` or as a display label ('Marzo 1996')."""
    text = month.strip()
    if len(text) >= 7 and text[:4].isdigit() and text[4] == "-":
        return dt.date(int(text[:4]), int(text[5:7]), 1)
    name, _, year = text.lower().rpartition(" ")
    if name in rules.MONTH_NAMES_ES and year.isdigit():
        return dt.date(int(year), rules.MONTH_NAMES_ES.index(name) + 1, 1)
    raise ValueError(f"cannot read month {month!r}")


def month_predicate(ts: Column, months: Iterable[str]) -> Column:
    """Months (``yyyy-MM`` keys or display labels) as range predicates."""
    starts = sorted({month_start(m) for m in months})
    return _in_ranges(ts, _ranges(starts, _next_month))


def apply_filters(
    df: DataFrame,
    years: Iterable[int] | None = None,
    months: Iterable[str] | None = None,
    tipos: Iterable[str] | None = None,
    operativos: Iterable[str] | None = None,
    date_col: str = "fecha_file",
    type_col: str = "tipo",
    owner_col: str = "operativo",
) -> DataFrame:
    """Conjunction of the global filters.

    ``None`` means "all" for that dimension; an empty list selects nothing, as an
    empty selection does in the dashboard. Membership never matches NULL.
    """
    preds: list[Column] = []
    ts = F.col(date_col)
    if years is not None:
        years = list(years)
        preds.append(year_predicate(ts, years) if years else F.lit(False))
    if months is not None:
        months = list(months)
        preds.append(month_predicate(ts, months) if months else F.lit(False))
    for values, col in ((tipos, type_col), (operativos, owner_col)):
        if values is not None:
            values = list(values)
            preds.append(F.col(col).isin(values) if values else F.lit(False))
    if not preds:
        return df
    cond = preds[0]
    for p in preds[1:]:
        cond = cond & p
    return df.where(cond)


def filter_facets(
    df: DataFrame,
    years: Iterable[int] | None = None,
    date_col: str = "fecha_file",
    type_col: str = "tipo",
    owner_col: str = "operativo",
) -> DataFrame:
    """Distinct values offered by the filters: years, months (of the chosen
    years), types and owners, as (facet, value) rows without NULLs.

    One scan, unpivoted and made distinct in a single aggregation.
    """
    ts = F.col(date_col)
    month = month_key(ts)
    if years is not None:
        month = F.when(year_predicate(ts, list(years)), month)
    stacked = df.select(
        F.year(ts).cast("string").alias("_y"),
        month.alias("_m"),
        F.col(type_col).cast("string").alias("_t"),
        F.col(owner_col).cast("string").alias("_o"),
    ).select(F.expr("stack(4, 'anio', _y, 'mes', _m, 'tipo', _t, 'operativo', _o) AS (facet, value)"))
    return stacked.where(F.col("value").isNotNull()).distinct()


def labelled_facets(facets: DataFrame) -> DataFrame:
    """``filter_facets`` in display order, months with their display label."""
    shown = F.when(F.col("facet") == "mes", month_label(F.to_date(F.concat("value", F.lit("-01"))))).otherwise(F.col("value"))
    return facets.select("facet", "value", shown.alias("etiqueta")).orderBy("facet", "value")


def open_operations(df: DataFrame, state_col: str = "estado") -> DataFrame:
    """Operations not in the closed state; a NULL state counts as open."""
    return df.where(is_open(state_col))


def closed_durations(
    df: DataFrame,
    start_col: str = "fecha_file",
    end_col: str = "fecha_cierre",
    out_col: str = "duracion_real_dias",
) -> DataFrame:
    """Operations with both dates and a non-negative floored duration in days.

    "Closed" means having a closing date, whatever the state says. All input
    columns are kept. Empty (with the duration column) when a date column is absent.
    """
    if start_col not in df.columns or end_col not in df.columns:
        return df.where(F.lit(False)).withColumn(out_col, F.lit(None).cast("bigint"))
    df = coerce_dates(df, [start_col, end_col])
    start, end = F.col(start_col), F.col(end_col)
    return (
        df.where(start.isNotNull() & end.isNotNull())
        .withColumn(out_col, floor_days(start, end))
        .where(F.col(out_col) >= 0)
    )
