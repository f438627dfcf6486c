"""Registered queries over the driver tables, with their DuckDB counterparts."""
