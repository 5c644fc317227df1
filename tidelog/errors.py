"""Errors and their status names."""

from __future__ import annotations


class TidelogError(Exception):
    """Base class; `status` is the service status it maps to, `exit_code` that of the command line."""

    status = "internal"
    exit_code = 1


class InvalidIdentifier(TidelogError, ValueError):
    status = "invalid_argument"
    exit_code = 2


class InvalidState(TidelogError, ValueError):
    status = "failed_precondition"
    exit_code = 3


class NotFound(TidelogError, LookupError):
    status = "not_found"
    exit_code = 4


class Unauthenticated(TidelogError, PermissionError):
    status = "unauthenticated"
    exit_code = 5


class PermissionDenied(TidelogError, PermissionError):
    status = "permission_denied"
    exit_code = 6


class SqlRejected(TidelogError, ValueError):
    status = "invalid_argument"
    exit_code = 2


class NotOwner(TidelogError, PermissionError):
    """A shard's log may be written by its owner only; the refused call has no effect."""

    status = "failed_precondition"
    exit_code = 7


class StorageCorrupt(TidelogError, OSError):
    status = "data_loss"
    exit_code = 8
