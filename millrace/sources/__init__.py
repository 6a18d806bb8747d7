"""Readers and writers of the tables that the queries use."""

from millrace.sources.tables import read_table, write_partitioned

__all__ = ["read_table", "write_partitioned"]
