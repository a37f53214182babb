"""Test fixtures derived from the generated tables, and the registered queries."""
