"""Structured Streaming versions of the session operators."""

from opsmetrics.streaming.sessions import sessionize_stream, start_sessions_sink  # noqa: F401
from opsmetrics.streaming.cells import sessionize_cells_stream, start_event_split  # noqa: F401
