"""Failures with a public code. What is missing and what isn't allowed look the same from outside."""

from __future__ import annotations

from typing import Any


class LoomtraceError(Exception):
    """code and message are public; detail stays inside."""

    code = "INTERNAL"

    def __init__(self, message: str, detail: str | None = None) -> None:
        super().__init__(message)
        self.message, self.detail = message, detail


class InvalidQuery(LoomtraceError):
    code = "INVALID_QUERY"


class InvalidArgument(LoomtraceError):
    code = "INVALID_ARGUMENT"


class NotFound(LoomtraceError):
    code = "NOT_FOUND"

    def __init__(self, detail: str | None = None) -> None:
        super().__init__("no such session, entry or fragment", detail)


class SourceError(LoomtraceError):
    code = "SOURCE_ERROR"

    def __init__(self, message: str, line: int | None = None) -> None:
        super().__init__(message)
        self.line = line


def failure(error: BaseException) -> dict[str, Any]:
    """The envelope of a failure, without inner detail."""
    if isinstance(error, LoomtraceError) and not isinstance(error, SourceError):
        return {"ok": False, "code": error.code, "message": error.message}
    return {"ok": False, "code": "INTERNAL", "message": "the operation failed"}
