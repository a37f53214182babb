"""Readers and writers of the operations, upload, load-log and sessions tables."""

from opsmetrics.sources.readers import (  # noqa: F401
    existing_keys,
    prepare_operations,
    read_load_log,
    read_operations,
    read_sessions,
    read_upload,
)
from opsmetrics.sources.sinks import (  # noqa: F401
    append_load_log,
    append_operations,
    append_sessions,
    export_csv,
    load_log_row,
)
from opsmetrics.sources.store import OperationsStore  # noqa: F401
