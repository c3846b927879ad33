"""Errors by kind."""


class LamellaError(Exception):
    """Any error of the engine."""


class OutOfSpec(LamellaError):
    """A file or schema breaks the format's rules."""


class FeatureNotActive(LamellaError):
    """A codec or source needs a library that is absent."""


class FeatureNotSupported(LamellaError):
    """The format allows it, the engine does not."""


class InvalidParameter(LamellaError):
    """A caller's argument is wrong."""


class WouldOverAllocate(LamellaError):
    """A declared size exceeds the caller's limit."""
