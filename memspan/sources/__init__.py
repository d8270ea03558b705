"""Readers and writers: Parquet tables, JSON events and exports, text parsers."""
