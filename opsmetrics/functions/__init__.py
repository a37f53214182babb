"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from opsmetrics.functions.dates import (  # noqa: F401
    date_fields,
    fields_timestamp,
    parse_timestamp,
    serial_timestamp,
)
from opsmetrics.functions.expr import (  # noqa: F401
    floor_days,
    is_open,
    level_of,
    month_key,
    month_label,
    quality_label,
    round_half_even,
    rule_lookup,
    strip_all,
    to_timestamp_ntz,
    ts_literal,
    within_standard,
)
