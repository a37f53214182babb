"""Column contracts of the operations fact, the load log and the sessions table."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and order of the stored columns.
# Text columns cleaned on ingest, in the order the upload step treats them.
TEXT_COLUMNS = [
    "file", "nit_cliente", "cliente", "tipo",
    "operativo", "comercial", "envio_facturar", "estado",
]

# Date columns coerced to timestamp_ntz wherever they are present.
DATE_COLUMNS = [
    "fecha_file", "fecha_cierre", "fecha_primera_factura", "fecha_arribo",
    "fecha_zarpe", "fecha_de_factura", "fecha_envio_cierre",
]

# Stored column order of the operations table.
CONTRACT_COLUMNS = [
    "file", "nit_cliente", "cliente", "fecha_file", "tipo", "operativo",
    "comercial", "fecha_primera_factura", "fecha_arribo", "fecha_zarpe",
    "envio_facturar", "fecha_de_factura", "fecha_envio_cierre", "fecha_cierre",
    "estado",
]

OPERATIONS = T.StructType(
    [
        T.StructField(name, T.TimestampNTZType() if name in DATE_COLUMNS else T.StringType())
        for name in CONTRACT_COLUMNS
    ]
)

QUALITY_RECORD = T.StructType(
    [
        T.StructField("campo", T.StringType()),
        T.StructField("registros_faltantes", T.LongType()),
        T.StructField("porcentaje", T.StringType()),
    ]
)

SESSIONS = T.StructType(
    [
        T.StructField("username", T.StringType()),
        T.StructField("session_start", T.TimestampNTZType()),
        T.StructField("session_end", T.TimestampNTZType()),
        T.StructField("duration_minutes", T.LongType()),
        T.StructField("pages_visited", T.ArrayType(T.StringType())),
    ]
)
