"""Spark operators for market bar research: tables in, tables out."""
