import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsmetrics import rules
from opsmetrics.functions.expr import normalize_text, placeholder_if_missing
from opsmetrics.sources.readers import coerce_dates, unreadable_dates
from opsmetrics.functions import (
    floor_days,
    is_open,
    level_of,
    month_key,
    month_label,
    parse_timestamp,
    round_half_even,
    rule_lookup,
    strip_all,
)

D = dt.datetime


def one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr.alias("x")).collect()]


def test_floor_days_floors_negative_spans(spark):
    data = [(D(2024, 1, 2), D(2024, 1, 1, 18)), (D(2024, 1, 1), D(2024, 1, 1, 2)), (D(2024, 1, 1), D(2024, 1, 2, 1)), (D(2024, 1, 1), None)]
    got = one(spark, floor_days("a", "b"), data, "a timestamp_ntz, b timestamp_ntz")
    assert got == [-1, 0, 1, None]


def test_round_half_even_matches_numpy(spark):
    values = [0.25, 0.35, 2.675, 12.25, 1.005, -0.25, 123.456789]
    for k in (1, 2, 6):
        got = one(spark, round_half_even("v", k), [(v,) for v in values], "v double")
        assert got == [float(np.round(v, k)) for v in values]


def test_parse_timestamp_coerces_and_nulls(spark):
    data = [("1996-03-04",), ("1996-03-04 05:06:07",), ("1996-03-04T05:06:07",), ("3/4/1996",), (" 1996-03-04 ",), ("bad-date",), (None,), ("",)]
    got = one(spark, parse_timestamp("s"), data, "s string")
    assert got == [D(1996, 3, 4), D(1996, 3, 4, 5, 6, 7), D(1996, 3, 4, 5, 6, 7), D(1996, 3, 4), D(1996, 3, 4), None, None, None]


def test_parse_timestamp_layouts_in_both_orders(spark):
    texts = ["25/12/2023", "25-12-2023", "2023/12/25", "12-25-2023", "Jan 2, 2024", "2 January 2024", "02/01/24", "1/2/2024 3:04 PM", "03/04/2024", "25.12.2023", "1/2/99"]
    data = [(t,) for t in texts]
    xmas = D(2023, 12, 25)
    month_first = [xmas, xmas, xmas, xmas, D(2024, 1, 2), D(2024, 1, 2), D(2024, 2, 1), D(2024, 1, 2, 15, 4), D(2024, 3, 4), xmas, D(1999, 1, 2)]
    assert one(spark, parse_timestamp("s"), data, "s string") == month_first
    day_first = [xmas, xmas, xmas, xmas, D(2024, 1, 2), D(2024, 1, 2), D(2024, 1, 2), D(2024, 2, 1, 15, 4), D(2024, 4, 3), xmas, D(1999, 2, 1)]
    assert one(spark, parse_timestamp("s", day_first=True), data, "s string") == day_first


#: Text, what it is month first, and day first where that differs; None is no date.
PROBES = [
    ("45000", None), ("202403", None), ("12345-01-01", None), ("0000-01-01", None), ("2024-13-01", None), ("2024-02-30", None),
    ("15/10/2017", D(2017, 10, 15)), ("2017-10-15", D(2017, 10, 15)), ("31/03/2024 02:30", D(2024, 3, 31, 2, 30)),
    ("1/2/24 10:30", D(2024, 1, 2, 10, 30), D(2024, 2, 1, 10, 30)), ("01-02-24", D(2024, 1, 2), D(2024, 2, 1)),
    ("1.2.24", D(2024, 1, 2), D(2024, 2, 1)), ("4-Mar-24", D(2024, 3, 4)), ("March 3, 2024 10:00", D(2024, 3, 3, 10)),
    ("2024/03/04 05:06", D(2024, 3, 4, 5, 6)), ("2024.03.04", D(2024, 3, 4)), ("2024", D(2024, 1, 1)), ("2024-03", D(2024, 3, 1)),
    ("20240304T050607", D(2024, 3, 4, 5, 6, 7)), ("20240304050607", D(2024, 3, 4, 5, 6, 7)), ("4Mar2024", D(2024, 3, 4)),
    ("Mon, 4 Mar 2024", D(2024, 3, 4)), ("March 4th, 2024 at 3 p.m.", D(2024, 3, 4, 15)), ("1/2/2024 13:00 PM", None),
    ("1/2/2024 0:30 AM", D(2024, 1, 2, 0, 30), D(2024, 2, 1, 0, 30)), ("2024-03-04 24:00", None), ("2024-03-04 05:06:60", None),
    ("1/2/2024 5:06:07.1234567", D(2024, 1, 2, 5, 6, 7, 123456), D(2024, 2, 1, 5, 6, 7, 123456)), ("marzo 4 2024", None), ("1/2/024", None),
    ("00/00/2024", None), ("2024-03-04T05:06:07Z", D(2024, 3, 4, 5, 6, 7)), ("2024-03-04 05:06:07+02:00", D(2024, 3, 4, 5, 6, 7)),
    ("1/2/69", D(1969, 1, 2), D(1969, 2, 1)), ("1/2/68", D(2068, 1, 2), D(2068, 2, 1)), ("x\x012024\x013", None), ("9999-12-31", D(9999, 12, 31)),
]


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Kolkata"])
def test_dates_by_shape_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(p[0],) for p in PROBES], "s string")
        whole = coerce_dates(df, ["s"]).collect()
        assert [r["s"] for r in whole] == [p[1] for p in PROBES]
        assert [r["s"] for r in coerce_dates(df, ["s"], day_first=True).collect()] == [p[-1] for p in PROBES]
        assert [r[0] for r in df.select(parse_timestamp("s")).collect()] == [p[1] for p in PROBES]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_serial_numbers_on_request(spark):
    df = spark.createDataFrame([("45000",), ("45000.75",), ("1/2/2024",), ("4500",), ("x",), (None,)], "s string")
    got = [r["s"] for r in coerce_dates(df, ["s"], serials=True).collect()]
    assert got == [D(2023, 3, 15), D(2023, 3, 15, 18), D(2024, 1, 2), D(4500, 1, 1), None, None]
    bad = unreadable_dates(df.withColumnRenamed("s", "fecha_file"))
    assert [tuple(r) for r in bad.collect()] == [("fecha_file", 3)]


@pytest.mark.filterwarnings("ignore:Parsing dates")
def test_random_dates_equal_pandas(spark):
    """One value at a time, as pandas settles a layout by the first value of a column."""
    rng = np.random.default_rng(8)
    dates = ["%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d.%m.%Y", "%d-%b-%Y", "%d %B %Y", "%b %d, %Y", "%B %d %Y", "%Y%m%d", "%d%b%Y"]
    times = ["", " %H:%M", " %H:%M:%S", " %I:%M %p", "T%H:%M:%S", " %H:%M:%S.%f", ", %H:%M"]
    texts = []
    for _ in range(400):
        moment = D(1980, 1, 1) + dt.timedelta(seconds=int(rng.integers(0, 2_000_000_000)))
        text = moment.strftime(str(rng.choice(dates)) + str(rng.choice(times)))
        if rng.random() < 0.3:  # a changed digit: another date, or none
            at = int(rng.choice([i for i, c in enumerate(text) if c.isdigit()]))
            text = text[:at] + str(rng.integers(0, 10)) + text[at + 1 :]
        texts.append(text)
    got = one(spark, parse_timestamp("s"), [(t,) for t in texts], "s string")
    for text, here in zip(texts, got):
        there = pd.to_datetime(pd.Series([text]), errors="coerce")[0]
        if there is not pd.NaT:
            assert here == there.to_pydatetime().replace(tzinfo=None), text
        elif here is not None:  # pandas ends at 1677 and 2262
            assert not 1678 <= here.year <= 2261, text


def test_strip_all_unicode_whitespace(spark):
    data = [("\u00a0 ab\u3000",), ("\t\nx y\r",), (" ",), (None,)]
    assert one(spark, strip_all("s"), data, "s string") == ["ab", "x y", "", None]


def test_clean_text_value_tokens(spark):
    data = [(" nan ",), ("None",), ("na",), ("",), (None,), (" abc ",), (" NA ",), ("n/a",)]
    got = one(spark, placeholder_if_missing(normalize_text("s")), data, "s string")
    p = rules.PLACEHOLDER
    assert got == [p, p, p, p, p, "ABC", p, "N/A"]


def test_is_open_null_state_is_open(spark):
    data = [("CERRADO",), ("Cerrado",), ("ABIERTO",), (None,), ("cerrado ",)]
    assert one(spark, is_open("e"), data, "e string") == [False, False, True, True, True]


def test_month_key_and_label(spark):
    data = [(D(1996, 3, 4, 23, 59),), (D(2001, 12, 31),)]
    assert one(spark, month_key("t"), data, "t timestamp_ntz") == ["1996-03", "2001-12"]
    assert one(spark, month_label("t"), data, "t timestamp_ntz") == ["Marzo 1996", "Diciembre 2001"]


def test_levels(spark):
    data = [(None,), (0.0,), (69.99,), (70.0,), (99.9,), (100.0,), (250.0,)]
    assert one(spark, level_of("i"), data, "i double") == ["BAJO", "BAJO", "BAJO", "MEDIO", "MEDIO", "ALTO", "ALTO"]


def test_rule_lookup_defaults(spark):
    data = [("A",), ("Z",), (None,)]
    assert one(spark, rule_lookup("t", rules.IDEAL_PER_MONTH, 0), data, "t string") == [15, 0, 0]
    assert one(spark, rule_lookup("t", rules.STANDARD_DAYS), data, "t string") == [30, None, None]
    assert one(spark, rule_lookup("t", rules.EFFORT_POINTS, 1), data, "t string") == [3, 1, 1]
