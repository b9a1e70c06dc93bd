"""Queries: each pairs a Spark plan over the test tables with its reference SQL."""
