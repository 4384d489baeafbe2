"""Operators on keyed tables: lookups, overlays, writes, checks and aggregates."""
