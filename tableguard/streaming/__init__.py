"""Validation of streams."""

from .batches import stateful_checks, validate_stream

__all__ = ["stateful_checks", "validate_stream"]
