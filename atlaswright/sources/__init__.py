"""Readers of dumps, tables and service replies, and writers of results."""
