"""The errors that the library raises; each is also the built-in error a Python user would expect."""

from __future__ import annotations


class Error(Exception):
    """Base of all errors of this library."""


class InvalidArgumentError(Error, ValueError):
    """An argument does not fit: sizes, names, ranges of numbers, headers of files."""


class OutOfRangeError(Error, IndexError):
    """An index or a block that a vector does not have."""


class BadCastError(Error, TypeError):
    """An operation that values of this kind do not have."""


class NotSettledError(Error, RuntimeError):
    """An iteration that did not end within its bound."""
