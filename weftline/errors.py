"""Errors that callers may want to tell apart."""


class WeftlineError(Exception):
    """Base of all errors of this package."""


class FetchError(WeftlineError):
    """A page couldn't be had."""


class ExtractionError(WeftlineError):
    """A page couldn't be turned into text."""


class ConfigurationError(WeftlineError, ValueError):
    """Options that contradict each other or are out of range."""


class DependencyError(WeftlineError):
    """An optional part was asked for that isn't there."""
