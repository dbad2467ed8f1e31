"""All registered queries."""

from . import chat, judging, rollouts, scoring  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
