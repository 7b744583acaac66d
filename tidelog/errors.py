"""Errors of the store."""


class StoreError(Exception):
    """Any failure of the store."""


class CorruptionError(StoreError):
    """Stored bytes that don't match their checksum, length, magic number or version."""


class SerializationError(StoreError):
    """A value that can't be turned into the store's types."""


class InvalidDataError(StoreError):
    """Rows that don't fit the store's schema."""
