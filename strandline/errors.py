"""Errors by kind; each has the exit code that the command line gives."""


class StrandlineError(Exception):
    exit_code = 1


class UsageError(StrandlineError):
    exit_code = 2


class InputError(StrandlineError):
    exit_code = 3


class UnsupportedError(StrandlineError):
    exit_code = 4


class IndexError_(StrandlineError):
    """A reference index that is missing, damaged, or of another reference."""

    exit_code = 5


class OutputError(StrandlineError):
    exit_code = 7
