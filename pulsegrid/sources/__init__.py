"""Readers, writers, schemas and the table catalog."""
