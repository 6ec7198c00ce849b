"""Errors of the engine."""


class CorpuscleError(Exception):
    """Base of all errors raised here."""


class ConfigError(CorpuscleError):
    """A setting is missing or contradicts another."""


class ChunkingError(CorpuscleError):
    """A window is impossible."""


class SchemaError(CorpuscleError):
    """A schema or DDL text can't be made."""


class DagError(CorpuscleError):
    """Tasks depend on missing ones or on each other."""


class QueryError(CorpuscleError):
    """A search can't be carried out."""


class BusyError(CorpuscleError):
    """Another writer is at work."""
