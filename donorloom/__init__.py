"""Spark jobs for large tables of contribution filings."""
