"""Business rules per operation type and the stored placeholder values.

Users may pass their own dictionaries to the operators; these are defaults.
"""

from __future__ import annotations

# Fixed values (must equal the reference for equal results).
# Ideal operations per owner and month, by type.
IDEAL_PER_MONTH = {"A": 15, "M": 10, "F": 8, "B": 8, "S": 10, "T": 12, "C": 5}
# Standard and improvement-target cycle time in days, by type.
STANDARD_DAYS = {"A": 30, "M": 90, "F": 90, "B": 90, "S": 90, "T": 30, "C": 30}
TARGET_DAYS = {"A": 20, "M": 70, "F": 70, "B": 70, "S": 70, "T": 15, "C": 15}
# Effort points of one open operation, by type.
EFFORT_POINTS = {"A": 3, "M": 9, "F": 9, "B": 9, "S": 9, "T": 3, "C": 3}
# Defaults for a type missing from a rule table.
DEFAULT_IDEAL = 0
DEFAULT_EFFORT = 1
# Stored values.
PLACEHOLDER = "NO ESPECIFICADO"
MISSING_TOKENS = ["", "NAN", "NONE", "NA"]
CLOSED_STATE = "CERRADO"
ALL_SERIES = "TODOS"
LEVEL_LOW, LEVEL_MID, LEVEL_HIGH = "BAJO", "MEDIO", "ALTO"
LEVEL_MID_FROM, LEVEL_HIGH_FROM = 70, 100
DEFAULT_SPEED_DAYS = 90.0
DEFAULT_EFFICACY = 50.0
# Minimum sizes and defaults of the analyses.
BOTTLENECK_MIN_ROWS = 20
SLOW_QUANTILE = 0.80
FORECAST_MIN_ROWS = 10
FORECAST_MIN_DAYS = 2
FORECAST_HORIZON_DAYS = 90
RECENT_SESSIONS = 50
USAGE_PERIODS = (7, 15, 30, 60, 90)
TOP_OWNERS = 15
QUALITY_FIELDS = ["operativo", "comercial", "estado"]
# Spanish month names used by the month label (the reference formats months
# under the es_ES locale).
MONTH_NAMES_ES = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]
