"""Registered queries over the test tables and their SQL twins."""

from . import checks, more, runs  # noqa: F401
from .queries import REGISTRY

__all__ = ["REGISTRY"]
