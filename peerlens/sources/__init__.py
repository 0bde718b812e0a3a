"""Readers and writers."""

from peerlens.sources.tables import table

__all__ = ["table"]
