"""Sources. All readers return lazy DataFrames; filters and projections applied
afterwards are pushed into the scan by Catalyst (parquet, ORC, JDBC)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmetrics import rules, schema
from opsmetrics.functions import date_fields, fields_timestamp, serial_timestamp, strip_all, to_timestamp_ntz, ts_literal
from opsmetrics.sources import sheets


def _load(spark: SparkSession, path: str | None, fmt: str, options: dict | None) -> DataFrame:
    reader = spark.read.format(fmt).options(**(options or {}))
    return reader.load(path) if path is not None else reader.load()


def _text_dates(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]


def _fields_column(i: int) -> str:
    return f"_date_fields_{i}"


def coerce_dates(
    df: DataFrame, columns: list[str] | None = None, day_first: bool = False, serials: bool = False
) -> DataFrame:
    """Coerce the date columns that exist: text is read by its shape (bad -> NULL),
    dates and timestamps are cast to timestamp_ntz. Absent columns are left absent.
    ``day_first`` settles text such as 03/04/2024; text that is a date in one
    order only is read in that order either way. With ``serials`` five-digit
    numbers are a sheet's days since 1899-12-30; they are no dates otherwise.

    Two projections: the fields of each text are found once, and then read.
    """
    wanted = columns or schema.DATE_COLUMNS
    text = _text_dates(df, wanted)
    other = [c for c in wanted if c in df.columns and c not in text and not isinstance(df.schema[c].dataType, T.TimestampNTZType)]
    if not text and not other:
        return df
    df = df.withColumns({_fields_column(i): date_fields(c) for i, c in enumerate(text)} | {c: to_timestamp_ntz(c) for c in other})
    read = {}
    for i, c in enumerate(text):
        read[c] = fields_timestamp(F.col(_fields_column(i)), day_first)
        if serials:
            read[c] = F.coalesce(read[c], serial_timestamp(c))
    return df.withColumns(read).drop(*(_fields_column(i) for i in range(len(text)))) if read else df


def unreadable_dates(
    df: DataFrame, columns: list[str] | None = None, day_first: bool = False, serials: bool = False
) -> DataFrame:
    """Per text date column: how many non-blank values cannot be read as a date (one row per column)."""
    present = _text_dates(df, columns or schema.DATE_COLUMNS)
    if not present:
        return df.sparkSession.createDataFrame([], "campo string, fechas_ilegibles bigint")
    filled = {f"_filled_{c}": F.upper(strip_all(c)).isin(*rules.MISSING_TOKENS) == F.lit(False) for c in present}
    read = coerce_dates(df.select(*present, *(f.alias(n) for n, f in filled.items())), present, day_first, serials)
    counts = read.agg(*[F.count_if(F.col(f"_filled_{c}") & F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(present)])
    stacked = ", ".join(f"'{c}', _m{i}" for i, c in enumerate(present))
    return counts.select(F.expr(f"stack({len(present)}, {stacked}) AS (campo, fechas_ilegibles)"))


def prepare_operations(df: DataFrame, date_columns: list[str] | None = None, day_first: bool = False) -> DataFrame:
    """Operations as the analyses expect them: dates coerced, rows without a
    ``fecha_file`` dropped."""
    return coerce_dates(df, date_columns, day_first).dropna(subset=["fecha_file"])


def read_operations(
    spark: SparkSession,
    path: str | None = None,
    fmt: str = "parquet",
    options: dict | None = None,
    day_first: bool = False,
) -> DataFrame:
    """Read the whole operations table (parquet / csv / json / jdbc ...).

    For JDBC pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` in ``options`` so the read is split across executors.
    """
    return prepare_operations(_load(spark, path, fmt, options), day_first=day_first)


def read_upload(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    options: dict | None = None,
    ordinal_column: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read an uploaded sheet with every column as text, plus ``_ordinal``.

    CSV is read as spreadsheets write it: quotes are doubled inside quotes, blanks
    count, and a quoted value may hold line breaks. All the same a file is read by
    many tasks (``sheets.read_quoted_csv``). Spark's own reader takes over with
    ``multi_line=True`` (one task for each file), ``multi_line=False`` (no line breaks
    in values) and options that change how records are found.

    ``_ordinal`` defines which copy of a duplicated key is "first". It comes from
    ``ordinal_column`` when the source carries one (row number of the sheet);
    otherwise it counts the rows from 0, by file name and position in the file.
    """
    given = {k.lower() for k in options or {}}
    if fmt == "csv" and multi_line is None and ordinal_column is None and not given & sheets.OWN_PARSING:
        return sheets.read_quoted_csv(spark, path, options)
    opts = {}
    if fmt == "csv":
        opts = {"header": "true", "inferSchema": "false", "escape": '"', "multiLine": str(multi_line is not False).lower()}
    opts.update(options or {})
    df = _load(spark, path, fmt, opts)
    numbered = sheets.number_rows(df) if ordinal_column is None else df
    text = [F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if c != ordinal_column]
    return numbered.select(*text, F.col(f"`{ordinal_column or sheets.ORDINAL}`").cast("bigint").alias(sheets.ORDINAL))


def stored_key_values(ops: DataFrame, key: str = "file") -> DataFrame:
    """Stored business keys normalised for matching (non-null, non-empty,
    stripped, upper-cased), one row per stored row. Only the key column is read."""
    raw = F.col(key).cast("string")
    return (
        ops.select(raw.alias(key))
        .where(F.col(key).isNotNull() & (F.col(key) != ""))
        .select(F.upper(strip_all(key)).alias(key))
    )


def existing_keys(ops: DataFrame, key: str = "file") -> DataFrame:
    """Distinct stored business keys, normalised for matching."""
    return stored_key_values(ops, key).distinct()


def read_load_log(spark: SparkSession, path: str, fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    """The load log, newest load first."""
    return _load(spark, path, fmt, options).orderBy(F.desc("fecha_carga"))


def read_sessions(
    spark: SparkSession,
    path: str,
    since: dt.datetime | None = None,
    fmt: str = "parquet",
    options: dict | None = None,
) -> DataFrame:
    """Stored sessions; ``since`` becomes a ``session_start >=`` predicate that is
    pushed to the source."""
    df = _load(spark, path, fmt, options)
    return df if since is None else df.where(F.col("session_start") >= ts_literal(since))
