"""Streams of operations, applied batch by batch."""
