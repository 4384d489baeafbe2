"""Stored tables: versions, transactions and resident columns."""
