"""Registered queries (Spark) with their DuckDB oracles, plus Spark ML plans."""
