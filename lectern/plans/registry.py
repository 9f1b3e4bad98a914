"""All queries of the analytics operators."""

from __future__ import annotations

from lectern.plans import books, chats, evaluation, layout, scalars, search, terms  # noqa: F401
from lectern.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
