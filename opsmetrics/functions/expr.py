"""Scalar column expressions that reproduce pandas semantics on Spark.

Each helper returns a ``Column`` built from built-in functions only, so it
stays inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsmetrics import rules

ColumnOrName = Column | str

# The characters Python's str.strip() removes (str.isspace()).
# Spark's trim() only removes the ASCII space.
PY_WHITESPACE_CODEPOINTS = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
PY_WHITESPACE = "".join(chr(cp) for cp in PY_WHITESPACE_CODEPOINTS)

MICROS_PER_DAY = 86_400_000_000
MICROS_PER_MINUTE = 60_000_000


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_all(c: ColumnOrName) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def normalize_text(c: ColumnOrName) -> Column:
    """First step of text cleaning: cast to string, strip, upper case."""
    return F.upper(strip_all(_col(c).cast("string")))


def placeholder_if_missing(c: ColumnOrName, placeholder: str = rules.PLACEHOLDER) -> Column:
    """Second step: '', NAN, NONE, NA and NULL become the placeholder.

    Null counts as missing (pandas turns it into 'nan'/'None' first).
    """
    x = _col(c)
    # NOT (NULL IN ...) is NULL, so NULL and the tokens both fall to the
    # placeholder. Written with coalesce so a filter on the result stays small
    # after Catalyst inlines it (the text expression appears twice, not six times).
    return F.coalesce(F.when(~x.isin(*rules.MISSING_TOKENS), x), F.lit(placeholder))


def to_timestamp_ntz(c: ColumnOrName) -> Column:
    """Cast any date-like column to timestamp_ntz (no time zone shift for NTZ/date)."""
    return _col(c).cast("timestamp_ntz")


def floor_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``(end - start).dt.days``: whole days, floored (-6 hours is -1)."""
    micros = F.timestamp_diff("MICROSECOND", _col(start), _col(end))
    return F.floor(micros / F.lit(float(MICROS_PER_DAY))).cast("bigint")


def round_half_even(c: ColumnOrName, digits: int) -> Column:
    """``Series.round(k)`` (NumPy): rint(x * 10^k) / 10^k. F.round is half-up."""
    scale = float(10**digits)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def month_key(ts: ColumnOrName) -> Column:
    """Calendar month ``yyyy-MM`` (time-zone free on timestamp_ntz)."""
    return F.format_string("%04d-%02d", F.year(_col(ts)), F.month(_col(ts)))


def month_label(ts: ColumnOrName) -> Column:
    """Display month, capitalised Spanish name and year, e.g. 'Marzo 1996'."""
    names = F.array(*[F.lit(n.capitalize()) for n in rules.MONTH_NAMES_ES])
    return F.concat_ws(" ", F.element_at(names, F.month(_col(ts))), F.year(_col(ts)).cast("string"))


def rule_lookup(c: ColumnOrName, table: Mapping[str, float | int], default: float | int | None = None) -> Column:
    """Per-type rule value as a literal map lookup, with a default for unknown types.

    The map is a literal inside the expression: no join, no broadcast.
    """
    pairs = []
    for key, value in table.items():
        pairs += [F.lit(key), F.lit(value)]
    looked_up = F.try_element_at(F.create_map(*pairs), _col(c))
    return looked_up if default is None else F.coalesce(looked_up, F.lit(default))


def within_standard(duration: ColumnOrName, type_col: ColumnOrName, standard: Mapping[str, int] | None = None) -> Column:
    """Success: closed within the type's standard; an unknown type or no duration is none."""
    return F.coalesce(_col(duration) <= rule_lookup(type_col, standard or rules.STANDARD_DAYS), F.lit(False))


def is_open(estado: ColumnOrName, closed_state: str = rules.CLOSED_STATE) -> Column:
    """Open = upper(estado) is not the closed state; NULL estado counts as open."""
    return ~F.upper(_col(estado)).eqNullSafe(F.lit(closed_state))


def level_of(index: ColumnOrName) -> Column:
    """Flow level: null or < 70 low, [70, 100) medium, >= 100 high."""
    i = _col(index)
    return (
        F.when(i.isNull() | (i < rules.LEVEL_MID_FROM), F.lit(rules.LEVEL_LOW))
        .when(i < rules.LEVEL_HIGH_FROM, F.lit(rules.LEVEL_MID))
        .otherwise(F.lit(rules.LEVEL_HIGH))
    )


def ts_literal(value: dt.datetime | dt.date) -> Column:
    """A timestamp_ntz literal, so comparisons against NTZ columns push down to the scan."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")


def quality_label(field: str) -> str:
    """A field as the quality summary names it."""
    return field.replace("_", " ").title()
