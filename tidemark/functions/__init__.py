"""Columns and checks of keyed tables."""
