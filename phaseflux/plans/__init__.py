"""Queries: operators applied to the tables, and their SQL."""
