"""Errors that callers can tell apart."""


class LogEngineError(Exception):
    """Base of all errors raised here."""

    def __init__(self, message: str, **details) -> None:
        super().__init__(message)
        self.details = details


class SourceError(LogEngineError):
    """A log, configuration or rules file is missing or can't be read."""


class ConfigError(LogEngineError):
    """A configuration that can't be used."""


class FilterError(LogEngineError):
    """A filter that can't be built, such as an unreadable time."""


class ExportError(LogEngineError):
    """A view that can't be written."""


class ValidationError(LogEngineError, ValueError):
    """An argument outside what is allowed, such as an unknown layout."""


class ConnectionFailed(LogEngineError):
    """The firewall can't be reached for its rules; details has the reason: timeout, authentication or other."""
