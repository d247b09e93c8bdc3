"""Registered queries, their DuckDB equivalents, and pipeline wiring."""
