"""Joins whose sides grow with the tables.

Spark sizes a side by its compressed files, which repeat themselves in tables of nodes, templates and edits, and may
send it whole through the driver to all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame) -> DataFrame:
    """`rows` as a side of a join that is dealt out by its key and merged, never broadcast."""
    return rows.hint("merge")
