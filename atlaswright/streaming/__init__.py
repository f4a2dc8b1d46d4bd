"""Incremental versions of corpus statistics for tables that keep arriving."""
