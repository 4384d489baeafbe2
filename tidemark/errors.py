"""What a write can be refused for.  Each error carries the first keys that are at fault."""

from __future__ import annotations


class KeyedError(Exception):
    def __init__(self, message: str, keys: list[int] = ()):
        super().__init__(message + (f": {', '.join(map(str, keys))}" if keys else ""))
        self.keys = list(keys)


class UniqueViolation(KeyedError):
    """A key would be there twice."""


class UnsupportedRename(KeyedError):
    """A statement renames to keys that it renames from."""


class WriteConflict(KeyedError):
    """Another transaction has published a version since this one began."""


class RepeatedKeys(KeyedError):
    """Keys of the table may repeat, so a key names no row of it."""


class NullValue(KeyedError, ValueError):
    """A key or value is null."""
