"""Dates as sheets hold them: one shape per text, one reading per shape.

A text is matched once against the shapes below. The match names its fields
(year, month, day, hour, ...), whichever order they are written in, and the
timestamp is made from these fields. There is no chain of parse attempts, no
exception for a text that is no date, and no time zone in between.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsmetrics.functions.expr import ColumnOrName, _col, rule_lookup, strip_all

# English month names as dates write them, short or whole.
_MONTH = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    "sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
_MONTH_NUMBERS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

# What a shape is made of. A name in braces is a field; ``year`` has four or two digits.
_PIECES = {
    "year4": "(?<year>[0-9]{4})",
    "year": "(?<year>[0-9]{4}|[0-9]{2})(?![0-9])",
    "month": "(?<month>[0-9]{1,2})",
    "month2": "(?<month>[0-9]{2})",
    "day": "(?<day>[0-9]{1,2})",
    "day2": "(?<day>[0-9]{2})",
    "nth": "(?<day>[0-9]{1,2})(?:st|nd|rd|th)?",
    "first": "(?<first>[0-9]{1,2})",
    "second": "(?<second>[0-9]{1,2})",
    "name": f"(?<name>{_MONTH})",
    "clock": "(?:t?(?<hour>[0-9]{2})(?<minute>[0-9]{2})(?<sec>[0-9]{2})?)?",
    "sep": r"(?:\s*[-/.,]\s*|\s+)",
    "gap": r"[-/.,\s]*",
}
#: The shapes of the date itself. Which of ``first`` and ``second`` is the month is settled by their values.
DATE_SHAPES = [
    "{year4}{sep}{month}(?:{sep}{day})?",
    "{first}{sep}{second}{sep}{year}",
    "{nth}{gap}{name}{gap}{year}",
    "{name}{gap}{nth}{sep}{year}",
    "{name}{sep}{year4}",
    "{year4}{sep}{name}{sep}{day}",
    "{year4}{month2}{day2}{clock}",
    "{year4}",
]
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.]?\s+)?"
_TIME = (
    r"(?:(?:\s*t\s*|\s*,\s*|\s+at\s+|\s+)(?<hour>[0-9]{1,2})(?::(?<minute>[0-9]{1,2})(?::(?<sec>[0-9]{1,2})(?:\.(?<frac>[0-9]+))?)?)?"
    r"(?:\s*(?<half>[ap])\.?m\.?)?)?"
)
_ZONE = r"(?:\s*(?:z|utc|gmt|[+-][0-9]{2}:?[0-9]{2}))?"
_FIELDS = ["year", "month", "day", "first", "second", "name", "hour", "minute", "sec", "frac", "half"]
_MARK = "\x01"


def _numbered(pattern: str, i: int) -> str:
    """The pattern with group names of its own."""
    return pattern.replace("(?<", f"(?<s{i}").replace(f"(?<s{i}!", "(?<!")


def _shape_pattern() -> tuple[str, str]:
    """One pattern for all shapes, and the replacement that lists the fields in the order of ``_FIELDS``."""
    shapes = [_numbered(shape.format(**_PIECES), i) for i, shape in enumerate(DATE_SHAPES)]
    pattern = f"(?i)^{_WEEKDAY}(?:{'|'.join(shapes)}){_numbered(_TIME, len(shapes))}{_ZONE}$"
    # by number, as a lookup of each name in each match takes most of the time
    names = re.findall(r"\(\?<(\w+)>", pattern)
    groups = [[f"${i}" for i, name in enumerate(names, 1) if re.fullmatch(rf"s\d+{f}", name)] for f in _FIELDS]
    return re.sub(r"\(\?<\w+>", "(", pattern), "".join(_MARK + "".join(g) for g in groups)


_PATTERN, _LISTED = _shape_pattern()


def date_fields(c: ColumnOrName) -> Column:
    """The fields of a date text, as an array; an array of one element if it has none of the shapes."""
    text = F.replace(strip_all(_col(c).cast("string")), F.lit(_MARK), F.lit("?"))
    return F.split(F.regexp_replace(text, _PATTERN, _LISTED), _MARK)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parts(fields: Column, day_first: bool) -> Column:
    """Year, month, day, hour, minute and second that the fields name; NULL for those they cannot mean."""
    # a field that the shape lacks is empty: NULL here, as a cast that fails costs an exception
    text = {f: F.nullif(F.get(fields, F.lit(i + 1)), F.lit("")) for i, f in enumerate(_FIELDS)}
    number = {f: text[f].try_cast("int") for f in _FIELDS if f not in ("name", "frac", "half")}
    # two-digit years from 69 on are 19xx, the others 20xx
    short = F.length(text["year"]) == 2
    year = F.when(short, F.pmod(number["year"] - 69, F.lit(100)) + 1969).otherwise(number["year"])
    first, second = number["first"], number["second"]
    swapped = second <= 12 if day_first else first > 12
    named = F.when(text["name"].isNotNull(), rule_lookup(F.lower(F.substring(text["name"], 1, 3)), _MONTH_NUMBERS))
    month = F.coalesce(number["month"], F.when(swapped, second).otherwise(first), named, F.lit(1))
    day = F.coalesce(number["day"], F.when(swapped, first).otherwise(second), F.lit(1))
    hour = F.coalesce(number["hour"], F.lit(0))
    in_half = _once(hour, lambda h: F.when(h <= 12, F.pmod(h, F.lit(12))))
    hour = F.when(text["half"].isNull(), hour).otherwise(in_half + F.when(F.lower(text["half"]) == "p", 12).otherwise(0))
    exact = F.concat_ws(".", text["sec"], F.substring(text["frac"], 1, 6)).try_cast("decimal(16,6)")
    second_ = F.when(text["sec"].isNull(), F.lit(0).cast("decimal(16,6)")).otherwise(exact)
    minute = F.coalesce(number["minute"], F.lit(0))
    return F.struct(
        year.alias("year"), month.alias("month"), day.alias("day"), hour.alias("hour"), minute.alias("minute"), second_.alias("second")
    )


def fields_timestamp(fields: Column, day_first: bool = False) -> Column:
    """The timestamp_ntz that the fields make, NULL if they make none.

    Of two numbers before a year the first is the month (the day with
    ``day_first``), unless only the other way round can be a date.

    Each step is computed once and in small functions: written as one expression,
    the code of a few columns is too large to be compiled as a whole.
    """

    def made(p: Column) -> Column:
        possible = (p["year"] >= 1) & p["month"].between(1, 12) & p["day"].between(1, 31)
        in_time = (p["hour"] < 24) & (p["minute"] < 60) & (p["second"] < 60)
        stamp = F.try_make_timestamp_ntz(p["year"], p["month"], p["day"], p["hour"], p["minute"], p["second"])
        return F.when(possible & in_time, stamp)

    return _once(fields, lambda f: _once(_parts(f, day_first), made))


#: Serial numbers that a sheet shows when a date cell has no date format: days since this one.
SERIAL_ORIGIN = "TIMESTAMP_NTZ '1899-12-30 00:00:00'"


def serial_timestamp(c: ColumnOrName) -> Column:
    """A five-digit serial number, with a fraction for the time, as timestamp_ntz (to the second); other text is NULL."""
    text = strip_all(_col(c).cast("string"))
    seconds = F.rint(F.when(text.rlike(r"^[0-9]{5}(\.[0-9]+)?$"), text).try_cast("double") * 86_400).cast("bigint")
    return F.timestamp_add("SECOND", seconds, F.expr(SERIAL_ORIGIN))


def parse_timestamp(c: ColumnOrName, day_first: bool = False, serials: bool = False) -> Column:
    """``pd.to_datetime(errors='coerce')`` for text, each value by its own shape: unreadable -> NULL.

    Whole columns are cheaper through ``sources.coerce_dates``, which computes
    the fields in a projection of their own.
    """
    parsed = fields_timestamp(date_fields(c), day_first)
    return F.coalesce(parsed, serial_timestamp(c)) if serials else parsed
