"""Upload ingestion: header and text cleaning, duplicate detection, first-copy
dedupe, new-versus-existing split, quality summary.

Shuffles, all on the cleaned key: the duplicate count is a grouped count
(partial aggregation on the map side) followed by a left-semi join that AQE
can split for a hot key; the first-copy dedupe is a ``row_number() = 1``
window planned as a partial window group limit, so every map partition keeps
one row per key before the exchange; the new-versus-existing split is a
semi/anti join against the stored keys that occur in the upload. Placeholder
keys are filtered before any of these, so they never form a hot key.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics import rules, schema
from opsmetrics.functions.expr import normalize_text, placeholder_if_missing, quality_label
from opsmetrics.session import checkpoint_dir
from opsmetrics.sources.readers import coerce_dates, stored_key_values, unreadable_dates
from opsmetrics.sources.store import OperationsStore

ORDINAL = "_ordinal"
# Alternative headers seen in uploads, in normalised form, and their contract name.
HEADER_ALIASES = {"fchprimerafactprov": "fecha_primera_factura"}


def normalize_header(name: str) -> str:
    """NFKD, drop non-ASCII, lower case, keep only [a-z0-9]."""
    ascii_name = unicodedata.normalize("NFKD", str(name)).encode("ascii", "ignore").decode("ascii")
    return re.sub(r"[^a-z0-9]", "", ascii_name.lower())


def _contract_by_normal_form() -> dict[str, str]:
    mapping = {normalize_header(c): c for c in schema.CONTRACT_COLUMNS}
    mapping.update(HEADER_ALIASES)
    return mapping


def normalize_headers(df: DataFrame) -> DataFrame:
    """Rename uploaded headers onto contract names (metadata only, no data pass).

    Columns whose header starts with 'unnamed' (any case) and Spark's names for
    blank CSV headers (``_c<N>``) are dropped. A header matching a contract
    column in normalised form gets the contract name; any other header keeps its
    normalised form. Two headers mapping to one name raise ``ValueError``.
    """
    contract = _contract_by_normal_form()
    keep, names = [], []
    for c in df.columns:
        if c == ORDINAL:
            keep.append(c)
            names.append(c)
            continue
        if re.match(r"(?i)^unnamed", c) or re.fullmatch(r"_c\d+", c):
            continue
        norm = normalize_header(c)
        keep.append(c)
        names.append(contract.get(norm, norm))
    dupes = sorted({n for n in names if names.count(n) > 1})
    if dupes:
        raise ValueError(f"uploaded headers collide after normalisation: {dupes}")
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)])


def clean_text(df: DataFrame, columns: list[str] | None = None, placeholder: str = rules.PLACEHOLDER) -> DataFrame:
    """Clean the text columns: strip, upper; '', NAN, NONE, NA and NULL become the
    placeholder. A missing column is added holding the placeholder.

    Two projections: the stripped upper-case text is computed once per column
    and then tested (Catalyst does not merge projections that would repeat it).
    """
    cols = columns or schema.TEXT_COLUMNS
    present = [c for c in cols if c in df.columns]
    normalized = df.withColumns({c: normalize_text(c) for c in present})
    return normalized.withColumns(
        {c: (placeholder_if_missing(c, placeholder) if c in present else F.lit(placeholder)) for c in cols}
    )


def valid_rows(df: DataFrame, key: str = "file", placeholder: str = rules.PLACEHOLDER) -> DataFrame:
    """Drop rows whose cleaned key is the placeholder (before any keyed shuffle,
    so the placeholder never forms a hot key)."""
    return df.where(F.col(key) != F.lit(placeholder))


def upload_duplicates(df: DataFrame, key: str = "file", sort: bool = False) -> DataFrame:
    """Every row whose key occurs more than once (all copies).

    Counts are pre-aggregated per map partition; the rows are then matched to the
    duplicated keys with a left-semi join (AQE splits a skewed key's partition).
    """
    dup_keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(key)
    out = df.join(dup_keys, on=key, how="left_semi")
    return out.orderBy(key) if sort else out


def upload_dedupe(df: DataFrame, key: str = "file", order: list[str] | None = None) -> DataFrame:
    """Keep the first row of each key by the explicit order columns.

    ``row_number() = 1`` is planned as a window group limit: each map partition
    keeps its own first row per key before the shuffle.
    """
    order_cols = order or [ORDINAL]
    w = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in order_cols])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def split_existing(deduped: DataFrame, existing: DataFrame, key: str = "file") -> DataFrame:
    """Deduplicated rows whose key is already stored."""
    return deduped.join(existing.select(key), on=key, how="left_semi")


def split_new(deduped: DataFrame, existing: DataFrame, key: str = "file") -> DataFrame:
    """Deduplicated rows whose key is not stored yet (the complement)."""
    return deduped.join(existing.select(key), on=key, how="left_anti")


def quality_summary(
    new_df: DataFrame, fields: list[str] | None = None, placeholder: str = rules.PLACEHOLDER
) -> DataFrame:
    """Share of placeholder values in each checked field of the new rows.

    One global aggregate of conditional counts, unpivoted to one row per field;
    no rows when there are no new rows.
    """
    fields = fields or rules.QUALITY_FIELDS
    aggs = [F.count(F.lit(1)).alias("_total")]
    aggs += [F.count_if(F.col(f) == F.lit(placeholder)).alias(f"_m{i}") for i, f in enumerate(fields)]
    stacked = ", ".join(f"'{quality_label(f)}', _m{i}" for i, f in enumerate(fields))
    return (
        new_df.agg(*aggs)
        .where(F.col("_total") > 0)
        .select("_total", F.expr(f"stack({len(fields)}, {stacked}) AS (campo, registros_faltantes)"))
        .select(
            "campo",
            F.col("registros_faltantes").cast("bigint").alias("registros_faltantes"),
            (F.col("registros_faltantes") / F.col("_total") * F.lit(100.0)).alias("porcentaje"),
        )
    )


def project_contract(df: DataFrame) -> DataFrame:
    """Keep the contract columns that exist, in stored order."""
    return df.select(*[c for c in schema.CONTRACT_COLUMNS if c in df.columns])


def upload_summary(
    valid: DataFrame,
    existing: DataFrame,
    key: str = "file",
    order: list[str] | None = None,
    fields: list[str] | None = None,
    placeholder: str = rules.PLACEHOLDER,
) -> DataFrame:
    """All figures of the load log in one pass over the upload, one row:
    ``nuevos`` (new keys), ``existentes`` (keys already stored), ``duplicados`` (rows of
    keys that occur more than once, every copy) and ``faltantes``: for each of the
    checked fields, how many new rows hold the placeholder.

    Upload rows and stored keys are aggregated per key together, with map-side
    partial aggregation: one shuffle, no join and no ``distinct``. Of a key's copies
    the first one by ``order`` counts for the fields, as in ``upload_dedupe``.
    """
    fields = fields or rules.QUALITY_FIELDS
    flags = F.array(*[(F.col(f) == F.lit(placeholder)).alias(f) for f in fields])
    # nulls last, as the copies are ordered there
    places = [F.struct(F.col(c).isNull(), F.col(c)).alias(f"o{i}") for i, c in enumerate(order or [ORDINAL])]
    first = F.struct(*places, flags.alias("missing"))
    rows = valid.select(key, first.alias("_first"))
    stored = existing.select(key, F.lit(None).cast(rows.schema["_first"].dataType).alias("_first"))
    per_key = (
        rows.unionAll(stored)
        .groupBy(key)
        .agg(
            F.count("_first").alias("_n"),  # of an upload row the struct is not null, whatever it holds
            F.count_if(F.col("_first").isNull()).alias("_stored"),
            F.min("_first").alias("_first"),
        )
        .where(F.col("_n") > 0)
        .select("_n", "_stored", F.col("_first.missing").alias("_missing"))
    )
    new = F.col("_stored") == 0
    return per_key.agg(
        F.count_if(new).alias("nuevos"),
        F.count_if(~new).alias("existentes"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).cast("bigint").alias("duplicados"),
        F.array(*[F.count_if(new & F.get("_missing", F.lit(i))) for i in range(len(fields))]).alias("faltantes"),
    )


def upload_counts(valid: DataFrame, existing: DataFrame, key: str = "file") -> DataFrame:
    """The three counts of ``upload_summary``, without the fields."""
    rows = valid.select(key, F.lit("").alias("_any"))
    return upload_summary(rows, existing, key, ["_any"], ["_any"], "").select("nuevos", "existentes", "duplicados")


def summary_quality(summary: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``quality_summary`` from the figures of ``upload_summary``."""
    labels = F.array(*[F.lit(quality_label(f)) for f in fields or rules.QUALITY_FIELDS])
    return (
        summary.where(F.col("nuevos") > 0)
        .select("nuevos", F.inline(F.arrays_zip(labels.alias("campo"), F.col("faltantes").alias("registros_faltantes"))))
        .select(
            "campo", "registros_faltantes", (F.col("registros_faltantes") / F.col("nuevos") * F.lit(100.0)).alias("porcentaje")
        )
    )


class UploadAnalysis(NamedTuple):
    new: DataFrame
    existing: DataFrame
    duplicates: DataFrame
    quality: DataFrame
    summary: DataFrame
    counts: DataFrame
    bad_dates: DataFrame


def analyze_upload(
    raw: DataFrame,
    stored_ops: DataFrame | OperationsStore,
    key: str = "file",
    checkpoint: bool = False,
    day_first: bool = False,
    serials: bool = False,
    sort_duplicates: bool = False,
) -> UploadAnalysis:
    """The whole upload analysis as lazy frames (new, existing, duplicates,
    quality summary, load-log figures, unreadable dates per column).

    ``stored_ops`` is the stored table, or a store with a key index. A table's keys
    go straight into the semi and anti joins with the deduplicated rows: repeated
    stored keys need no ``distinct`` there. A store is asked for the upload's
    keys only, which reads the upload's buckets of its index.

    The cleaned frame feeds three outputs. With ``checkpoint=True`` it is written
    once to the reliable checkpoint folder (``spark.checkpoint.dir``), which cuts
    the lineage and survives executor loss; otherwise it is recomputed per output.
    """
    cleaned = valid_rows(clean_text(normalize_headers(raw)), key)
    if checkpoint:
        checkpoint_dir(cleaned.sparkSession)
        cleaned = cleaned.checkpoint(eager=True)
    # without a sheet order (``read_upload`` adds one) the kept copy is the
    # smallest row by all columns: deterministic, so a retried task agrees
    order = [ORDINAL] if ORDINAL in cleaned.columns else sorted(c for c in cleaned.columns if c != key)
    duplicates = upload_duplicates(cleaned, key, sort=sort_duplicates)
    deduped = upload_dedupe(cleaned, key, order)
    if isinstance(stored_ops, OperationsStore):
        stored = stored_ops.stored_keys(cleaned.select(key))
    else:
        stored = stored_key_values(stored_ops, key)
    new = split_new(deduped, stored, key)
    existing = split_existing(deduped, stored, key)
    summary = upload_summary(cleaned, stored, key, order)
    return UploadAnalysis(
        new=project_contract(coerce_dates(new, day_first=day_first, serials=serials)),
        existing=existing,
        duplicates=duplicates,
        quality=summary_quality(summary),
        summary=summary,
        counts=summary.select("nuevos", "existentes", "duplicados"),
        bad_dates=unreadable_dates(cleaned, day_first=day_first, serials=serials),
    )
