"""Errors of the engine. Problems of single rows are columns (reject_reason, status, issues), not errors."""


class EngineError(Exception):
    """Root of all errors raised here."""


class ConfigError(EngineError):
    """A setting that cannot be used."""


class SourceError(EngineError):
    """An input that cannot be read: a golden set, a policy, an audit log."""


class IngestionError(EngineError):
    """Documents that cannot be taken in."""


class StoreError(EngineError):
    """A chunk table that is missing or cannot be written."""


class ModelError(EngineError):
    """A model that is missing or failed for good."""


class PromptError(EngineError):
    """A prompt with a missing or unknown placeholder."""


class EngineWarning(UserWarning):
    """Something that is left out or replaced, while the work goes on."""
