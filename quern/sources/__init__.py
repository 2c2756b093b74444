"""Readers, table creation and sinks."""
