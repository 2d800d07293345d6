"""All queries of the core and their SQL."""

from __future__ import annotations

from . import corruptions, curation, files, running, scores, shapes, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
