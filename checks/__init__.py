"""Registered queries (Spark) and their SQL oracles (DuckDB) over the test tables."""
