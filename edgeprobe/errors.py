"""Errors of the engine, each with the exit code that a command line gives it."""


class EdgeprobeError(Exception):
    code = 1


class ConfigError(EdgeprobeError):
    """The configuration can't be used."""

    code = 2


class DataUnavailableError(EdgeprobeError):
    """A table or column that is needed isn't there."""

    code = 3


class InsufficientDataError(EdgeprobeError):
    """There are too few rows to measure anything."""

    code = 4
