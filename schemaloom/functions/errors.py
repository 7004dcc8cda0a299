"""Errors of the engine: a message, named details and the cause."""

from __future__ import annotations


class EngineError(ValueError):
    """Any error that the engine raises on purpose."""

    def __init__(self, message: str, *, cause: BaseException | None = None, **details):
        super().__init__(message)
        self.message, self.cause = message, cause
        self.details = {k: v for k, v in details.items() if v is not None}

    def __str__(self) -> str:
        shown = ", ".join(f"{k}={v}" for k, v in self.details.items())
        return f"{self.message} ({shown})" if shown else self.message


class SchemaError(EngineError):
    """A schema text that cannot be read."""


class SettingError(EngineError):
    """An option, a format or a reference that makes no sense."""


class StoreError(EngineError):
    """A file or an object that cannot be reached."""


class WarehouseError(EngineError):
    """A table, project or connector of a warehouse that cannot be reached."""


class RenderError(EngineError):
    """A schema that a format cannot hold."""


def wrapped(error: BaseException, message: str | None = None, kind: type[EngineError] = EngineError, **details) -> EngineError:
    """An error of the engine for any other; its own are given back as they are."""
    return error if isinstance(error, EngineError) else kind(message or str(error), cause=error, **details)
