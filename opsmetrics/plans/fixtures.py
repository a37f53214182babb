"""Fixtures of FIXTURES.md, derived by Spark from the generated tables.

Every fixture is a lazy DataFrame over the given parquet tables, so the work
of each registered query grows with the input scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmetrics.functions import round_half_even
from opsmetrics.operators.sessions import sessionize
from opsmetrics.sources.readers import prepare_operations
from opsmetrics.sources.sinks import to_contract

# Fixture type letters by o_orderkey % 8; Z is a type without rules.
TYPE_CODES = "AMFBSTCZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A generated table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def type_code(orderkey: Column) -> Column:
    letters = F.array(*[F.lit(c) for c in TYPE_CODES])
    return F.element_at(letters, (F.pmod(orderkey, F.lit(len(TYPE_CODES))) + 1).cast("int"))


def _owner(custkey: Column, narrow: bool) -> Column:
    if narrow:
        return F.concat(F.lit("TEAM"), F.pmod(custkey, F.lit(3)).cast("string"))
    return F.concat(F.lit("OP"), F.lpad(F.floor(custkey / F.lit(4)).cast("string"), 5, "0"))


def operations(spark: SparkSession, sf_dir: str, narrow: bool = False) -> DataFrame:
    """`ops` (or `ops_narrow`): one operation per order, client name from customer."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    # one name per customer key: with the key unique on this side, Catalyst drops
    # the outer join from every plan that does not read the client name
    c = table(spark, sf_dir, "customer").groupBy("c_custkey").agg(F.min("c_name").alias("c_name"))
    k = F.col("o_orderkey")
    hours = F.lit(24) * (F.pmod(k * F.lit(37), F.lit(140)) - F.lit(10)) + F.pmod(k, F.lit(24)) - F.lit(12)
    status = F.col("o_orderstatus")
    closed_state = F.when(F.pmod(k, F.lit(2)) == 0, F.lit("CERRADO")).otherwise(F.lit("Cerrado"))
    ops = o.join(c, o["o_custkey"] == c["c_custkey"], "left").select(
        F.concat(F.lit("F"), F.lpad(k.cast("string"), 9, "0")).alias("file"),
        F.col("o_custkey").cast("string").alias("nit_cliente"),
        F.col("c_name").alias("cliente"),
        type_code(k).alias("tipo"),
        _owner(F.col("o_custkey"), narrow).alias("operativo"),
        F.concat(F.lit("COM"), F.pmod(F.col("o_custkey"), F.lit(20)).cast("string")).alias("comercial"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("fecha_file"),
        F.when(status == "F", F.timestamp_add("HOUR", hours, F.col("o_orderdate").cast("timestamp_ntz"))).alias("fecha_cierre"),
        F.when(status == "F", closed_state).when(status == "O", F.lit("ABIERTO")).alias("estado"),
    )
    return prepare_operations(to_contract(ops))


def upload_file_text(orderkey: Column, linenumber: Column) -> Column:
    return F.concat(F.lit(" l"), orderkey.cast("string"), F.lit("-"), linenumber.cast("string"), F.lit(" "))


#: How the fixture writes the date of a line, as Spark and as DuckDB patterns.
DATE_LAYOUTS = [
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm", "%Y-%m-%dT%H:%M"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("yyyy/MM/dd HH:mm", "%Y/%m/%d %H:%M"),
    ("yyyyMMdd", "%Y%m%d"),
    ("yyyyMMddHHmmss", "%Y%m%d%H%M%S"),
    ("dd/MM/yyyy", "%d/%m/%Y"),
    ("dd-MM-yyyy", "%d-%m-%Y"),
    ("dd.MM.yyyy HH:mm", "%d.%m.%Y %H:%M"),
    ("MM/dd/yyyy hh:mm a", "%m/%d/%Y %I:%M %p"),
    ("MM/dd/yy", "%m/%d/%y"),
    ("M/d/yy HH:mm", "%-m/%-d/%y %H:%M"),
    ("MM-dd-yy", "%m-%d-%y"),
    ("M.d.yy", "%-m.%-d.%y"),
    ("d-MMM-yy", "%-d-%b-%y"),
    ("dd MMM yyyy", "%d %b %Y"),
    ("d MMMM yyyy", "%-d %B %Y"),
    ("MMMM d, yyyy HH:mm", "%B %-d, %Y %H:%M"),
    ("MMM d, yyyy hh:mm:ss a", "%b %-d, %Y %I:%M:%S %p"),
]


def upload_date_text(day: Column, orderkey: Column, linenumber: Column) -> Column:
    """The order date with a time of day, in one of the layouts; line 7 has no date, or a sheet's serial number."""
    minutes = F.pmod(orderkey, F.lit(24)) * 60 + linenumber * 7
    moment = F.timestamp_add("MINUTE", minutes, day.cast("timestamp_ntz"))
    serial = F.date_diff(day, F.lit("1899-12-30").cast("date")).cast("string")
    none = F.when(F.pmod(orderkey, F.lit(2)) == 0, serial).otherwise(F.lit("bad-date"))
    pick = F.pmod(orderkey * 7 + linenumber, F.lit(len(DATE_LAYOUTS)))
    # one call for all layouts: a branch for each would be too much code for one compiled method
    layout = F.get(F.array(*[F.lit(layout) for layout, _ in DATE_LAYOUTS]), pick.cast("int"))
    return F.when(linenumber == 7, none).otherwise(F.call_function("date_format", moment, layout))


def raw_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`raw_upload`: an uploaded sheet, every column text, headers as uploaded,
    plus ``_ordinal`` (the sheet order within a key)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    # one row per order key: Catalyst then drops the join from branches that
    # only need the upload key (the stored-key filter, the key counts)
    o = (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderkey")
        .agg(F.min("o_custkey").alias("o_custkey"), F.min("o_orderdate").alias("o_orderdate"))
    )
    ln = F.col("l_linenumber")
    bad_file = (
        F.when(F.pmod(ln, F.lit(4)) == 0, F.lit(""))
        .when(F.pmod(ln, F.lit(4)) == 1, F.lit("nan"))
        .when(F.pmod(ln, F.lit(4)) == 2, F.lit(" None "))
    )
    ship_text = F.to_date("l_shipdate").cast("string")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"], "left").select(
        F.lit("0").alias("Unnamed: 0"),
        F.when(F.col("l_quantity") == 1, bad_file).otherwise(upload_file_text(F.col("l_orderkey"), ln)).alias("File"),
        F.col("o_custkey").cast("string").alias("NIT_Cliente"),
        F.concat(F.lit(" cliente "), F.col("o_custkey").cast("string")).alias("Cliente"),
        F.lower(type_code(F.col("l_orderkey"))).alias("Tipo"),
        F.when(F.col("l_tax") == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" op"), F.col("l_suppkey").cast("string")))
        .alias("Operativo"),
        F.when(F.col("l_returnflag") == "N", F.lit("na"))
        .otherwise(F.concat(F.lit("com"), F.pmod(F.col("l_suppkey"), F.lit(20)).cast("string")))
        .alias("Comercial"),
        F.col("l_linestatus").alias("Estado"),
        upload_date_text(F.to_date("o_orderdate"), F.col("l_orderkey"), ln).alias("Fecha File"),
        ship_text.alias("Fecha Cierre"),
        ship_text.alias("Fch Primera Fact Prov"),
        F.col("l_returnflag").alias("Envío Facturar"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("_ordinal"),
    )


def awkward_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`awkward_upload`: text with quotes, commas, line breaks and outer blanks."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return li.select(
        key.alias("clave"),
        F.concat(F.lit('  say "'), F.col("l_returnflag"), F.lit('", x ')).alias("cita"),
        F.concat(F.lit("a,"), key, F.lit("\nline two\r\nthree ")).alias("lineas"),
        F.when(F.pmod("l_linenumber", F.lit(2)) == 0, F.col("l_linestatus")).alias("nulo"),
    )


def existing_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`existing_ops`: keys already stored (raw form), those of orders with key % 3 = 0."""
    li = table(spark, sf_dir, "lineitem")
    return (
        li.where((F.col("l_quantity") != 1) & (F.pmod(F.col("l_orderkey"), F.lit(3)) == 0))
        .select(upload_file_text(F.col("l_orderkey"), F.col("l_linenumber")).alias("file"))
        .distinct()
    )


def load_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`load_log`: one load per order month; one quality record per order status."""
    o = table(spark, sf_dir, "orders")
    month = F.trunc(F.to_date("o_orderdate"), "month").cast("timestamp_ntz")
    per_status = o.groupBy(month.alias("fecha_carga"), F.col("o_orderstatus").alias("campo")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per_month = per_status.groupBy("fecha_carga").agg(
        F.sum("n").cast("bigint").alias("registros_limpios"),
        F.coalesce(F.sum(F.when(F.col("campo") == "P", F.col("n"))), F.lit(0)).cast("bigint").alias("registros_duplicados"),
        F.array_sort(F.collect_list(F.struct("campo", "n"))).alias("_q"),
    )
    pct = lambda r: F.format_string(
        "%.1f%%", round_half_even(r["n"] / F.col("registros_limpios") * F.lit(100.0), 1)
    )
    calidad = F.transform(
        "_q",
        lambda r: F.struct(
            r["campo"].alias("campo"), r["n"].cast("bigint").alias("registros_faltantes"), pct(r).alias("porcentaje")
        ),
    )
    return per_month.select("registros_limpios", "registros_duplicados", calidad.alias("calidad_json"), "fecha_carga")


def events_with_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"), "ts", "event_type"
    )


def sessions(spark: SparkSession, sf_dir: str, gap: str = "6 hours") -> DataFrame:
    """`sessions`: gap sessions of the events, 6 hours per user."""
    return sessionize(events_with_user(spark, sf_dir), gap=gap)
