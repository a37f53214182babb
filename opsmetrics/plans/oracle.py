"""DuckDB SQL for the fixtures and helpers to write oracle queries.

The oracle states each fixture and query independently of the Spark plan
(windows where Spark aggregates, CROSS JOIN where Spark explodes, ...), over
the same pre-registered parquet views.
"""

from __future__ import annotations

from collections.abc import Mapping

from opsmetrics import rules
from opsmetrics.functions.expr import PY_WHITESPACE_CODEPOINTS
from opsmetrics.plans.fixtures import DATE_LAYOUTS, TYPE_CODES

WS = " || ".join(f"chr({cp})" for cp in PY_WHITESPACE_CODEPOINTS)


def case_map(col: str, mapping: Mapping[str, float | int], default: float | int | None = None) -> str:
    """SQL CASE lookup generated from a rule dictionary."""
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    tail = f" ELSE {default}" if default is not None else ""
    return f"(CASE {col} {whens}{tail} END)"


def values_table(rows: list[tuple], names: list[str]) -> str:
    def lit(v):
        return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v))

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(names)}))"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def clean(x: str) -> str:
    tokens = ", ".join(f"'{t}'" for t in rules.MISSING_TOKENS)
    return (
        f"(CASE WHEN {x} IS NULL OR upper({strip(x)}) IN ({tokens}) "
        f"THEN '{rules.PLACEHOLDER}' ELSE upper({strip(x)}) END)"
    )


def parse_ts(x: str) -> str:
    """A date text by layouts: DuckDB tries each of a kind, month first before day first."""
    t = strip(x)
    numeric = f"regexp_replace({t}, '^([0-9]+)[-/.]([0-9]+)[-/.]([0-9]+)', '\\1/\\2/\\3')"
    named = f"replace(replace({t}, '-', ' '), ',', '')"
    times = ["", " %H:%M", " %I:%M %p"]

    def first_of(text: str, layouts: list[str]) -> str:
        return "coalesce(" + ", ".join(f"try_strptime({text}, '{f}')" for f in layouts) + ")"

    short = first_of(numeric, [d + t for d in ("%m/%d/%y", "%d/%m/%y") for t in times])
    long = first_of(numeric, [d + t for d in ("%m/%d/%Y", "%d/%m/%Y") for t in times])
    days = ["%d %b %y", "%d %b %Y", "%d %B %Y", "%B %d %Y %H:%M", "%b %d %Y %I:%M:%S %p"]
    return (
        f"(CASE WHEN regexp_matches({t}, '^[0-9]{{4}}-') THEN try_cast(replace({t}, 'T', ' ') AS TIMESTAMP) "
        f"WHEN regexp_matches({t}, '^[0-9]{{14}}$') THEN try_strptime({t}, '%Y%m%d%H%M%S') "
        f"WHEN regexp_matches({t}, '^[0-9]{{8}}$') THEN try_strptime({t}, '%Y%m%d') "
        f"WHEN regexp_matches({t}, '^[0-9]{{4}}/') THEN {first_of(t, ['%Y/%m/%d %H:%M', '%Y/%m/%d'])} "
        f"WHEN regexp_matches({t}, '^[0-9]+[-/.][0-9]+[-/.][0-9]{{2}}( |$)') THEN {short} "
        f"WHEN regexp_matches({t}, '^[0-9]+[-/.][0-9]+[-/.][0-9]{{4}}') THEN {long} "
        f"WHEN regexp_matches({t}, '[A-Z][a-z]+') THEN {first_of(named, days)} END)"
    )


def r6(x: str) -> str:
    return f"round_even({x}, 6)"


def floor_days(a: str, b: str) -> str:
    return f"CAST(floor(date_diff('microsecond', {a}, {b}) / 86400000000.0) AS BIGINT)"


OPEN = "upper(estado) IS DISTINCT FROM 'CERRADO'"


def _type_code(k: str) -> str:
    return f"substr('{TYPE_CODES}', CAST({k} % {len(TYPE_CODES)} AS INTEGER) + 1, 1)"


def ops_cte(narrow: bool = False) -> str:
    owner = (
        "'TEAM' || CAST(o.o_custkey % 3 AS VARCHAR)"
        if narrow
        else "'OP' || lpad(CAST(o.o_custkey // 4 AS VARCHAR), 5, '0')"
    )
    hours = "CAST(24 * ((o.o_orderkey * 37) % 140 - 10) + o.o_orderkey % 24 - 12 AS BIGINT)"
    return f"""ops AS (
  SELECT 'F' || lpad(CAST(o.o_orderkey AS VARCHAR), 9, '0') AS file,
         CAST(o.o_custkey AS VARCHAR) AS nit_cliente,
         c.c_name AS cliente,
         {_type_code('o.o_orderkey')} AS tipo,
         {owner} AS operativo,
         'COM' || CAST(o.o_custkey % 20 AS VARCHAR) AS comercial,
         o.o_orderdate AS fecha_file,
         CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderdate + to_hours({hours}) END AS fecha_cierre,
         CASE WHEN o.o_orderstatus = 'F' THEN (CASE WHEN o.o_orderkey % 2 = 0 THEN 'CERRADO' ELSE 'Cerrado' END)
              WHEN o.o_orderstatus = 'O' THEN 'ABIERTO' END AS estado
  FROM orders o LEFT JOIN (SELECT c_custkey, min(c_name) AS c_name FROM customer GROUP BY c_custkey) c
    ON o.o_custkey = c.c_custkey
  WHERE o.o_orderdate IS NOT NULL
)"""


CLOSED_CTE = f"""closed AS (
  SELECT * FROM (
    SELECT *, {floor_days('fecha_file', 'fecha_cierre')} AS duracion_real_dias
    FROM ops WHERE fecha_file IS NOT NULL AND fecha_cierre IS NOT NULL
  ) WHERE duracion_real_dias >= 0
)"""


def _file_text(k: str, ln: str) -> str:
    return f"' l' || CAST({k} AS VARCHAR) || '-' || CAST({ln} AS VARCHAR) || ' '"


def _layouts() -> str:
    moment = "CAST(CAST(o.o_orderdate AS DATE) AS TIMESTAMP) + to_minutes(CAST((l.l_orderkey % 24) * 60 + l.l_linenumber * 7 AS BIGINT))"
    pick = f"(l.l_orderkey * 7 + l.l_linenumber) % {len(DATE_LAYOUTS)}"
    return " ".join(f"WHEN {pick} = {i} THEN strftime({moment}, '{layout}')" for i, (_, layout) in enumerate(DATE_LAYOUTS))


RAW_UPLOAD_CTE = f"""raw_upload AS (
  SELECT
    CASE WHEN l.l_quantity = 1 THEN (CASE l.l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN ' None ' END)
         ELSE {_file_text('l.l_orderkey', 'l.l_linenumber')} END AS "File",
    CAST(o.o_custkey AS VARCHAR) AS "NIT_Cliente",
    ' cliente ' || CAST(o.o_custkey AS VARCHAR) AS "Cliente",
    lower({_type_code('l.l_orderkey')}) AS "Tipo",
    CASE WHEN l.l_tax = 0 THEN NULL ELSE ' op' || CAST(l.l_suppkey AS VARCHAR) END AS "Operativo",
    CASE WHEN l.l_returnflag = 'N' THEN 'na' ELSE 'com' || CAST(l.l_suppkey % 20 AS VARCHAR) END AS "Comercial",
    l.l_linestatus AS "Estado",
    CASE WHEN l.l_linenumber = 7 THEN (CASE WHEN l.l_orderkey % 2 = 0
           THEN CAST(date_diff('day', DATE '1899-12-30', CAST(o.o_orderdate AS DATE)) AS VARCHAR) ELSE 'bad-date' END)
         {_layouts()} END AS "Fecha File",
    CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR) AS "Fecha Cierre",
    CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR) AS "Fch Primera Fact Prov",
    l.l_returnflag AS "Envío Facturar",
    l.l_shipdate AS o1, l.l_partkey AS o2, l.l_suppkey AS o3, l.l_extendedprice AS o4
  FROM lineitem l
  LEFT JOIN (SELECT o_orderkey, min(o_custkey) AS o_custkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY o_orderkey) o
    ON l.l_orderkey = o.o_orderkey
)"""

UPLOAD_CLEAN_CTE = f"""upload_clean AS (
  SELECT {clean('"File"')} AS file, {clean('"NIT_Cliente"')} AS nit_cliente, {clean('"Cliente"')} AS cliente,
         {clean('"Tipo"')} AS tipo, {clean('"Operativo"')} AS operativo, {clean('"Comercial"')} AS comercial,
         {clean('"Envío Facturar"')} AS envio_facturar, {clean('"Estado"')} AS estado,
         {parse_ts('"Fecha File"')} AS fecha_file, {parse_ts('"Fecha Cierre"')} AS fecha_cierre,
         {parse_ts('"Fch Primera Fact Prov"')} AS fecha_primera_factura,
         o1, o2, o3, o4
  FROM raw_upload
),
upload_valid AS (SELECT * FROM upload_clean WHERE file <> '{rules.PLACEHOLDER}'),
upload_dedupe AS (
  SELECT * FROM upload_valid
  QUALIFY row_number() OVER (PARTITION BY file ORDER BY o1, o2, o3, o4) = 1
),
upload_duplicates AS (
  SELECT * FROM upload_valid WHERE file IN (SELECT file FROM upload_valid GROUP BY file HAVING count(*) > 1)
),
existing_ops AS (
  SELECT DISTINCT {_file_text('l_orderkey', 'l_linenumber')} AS file
  FROM lineitem WHERE l_quantity <> 1 AND l_orderkey % 3 = 0
),
existing_keys AS (
  SELECT DISTINCT upper({strip('file')}) AS file FROM existing_ops WHERE file IS NOT NULL AND file <> ''
),
upload_new AS (SELECT * FROM upload_dedupe WHERE file NOT IN (SELECT file FROM existing_keys)),
upload_existing AS (SELECT * FROM upload_dedupe WHERE file IN (SELECT file FROM existing_keys))"""

SESSIONS_CTE = """sessions AS (
  WITH e AS (
    SELECT 'user' || CAST(user_id AS VARCHAR) AS username, ts, event_type
    FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
  ),
  m AS (
    SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY username ORDER BY ts) IS NULL
                     OR ts - lag(ts) OVER (PARTITION BY username ORDER BY ts) > INTERVAL 6 HOUR
                   THEN 1 ELSE 0 END AS brk
    FROM e
  ),
  g AS (SELECT *, sum(brk) OVER (PARTITION BY username ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM m)
  SELECT username, min(ts) AS session_start, max(ts) AS session_end,
         CAST(floor(date_diff('microsecond', min(ts), max(ts)) / 60000000.0) AS BIGINT) AS duration_minutes,
         list_sort(list(DISTINCT event_type)) AS pages_visited
  FROM g GROUP BY username, sid
)"""

LOAD_LOG_CTE = """load_log AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS fecha_carga,
         count(*) AS registros_limpios,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS registros_duplicados
  FROM orders GROUP BY 1
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
