"""Errors raised before a job starts."""


class ArgumentError(ValueError):
    """A parameter is outside the range the operator accepts."""


class LeakageError(ValueError):
    """A feature list contains a column that must never be a feature."""
