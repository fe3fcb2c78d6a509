"""The registered queries, by subject."""

from textguard.plans.catalog import (  # noqa: F401
    guard_queries,
    language_queries,
    obfuscation_queries,
    pii_queries,
    training_queries,
)
from textguard.plans.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
