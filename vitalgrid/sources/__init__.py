"""Schemas, readers, writers and the table catalog."""
