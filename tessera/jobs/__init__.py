"""The registered queries, by subject."""

from tessera.jobs import backfill, contents, drafting, paragraphs, profiles, queries, records, sourcing, store  # noqa: F401
from tessera.jobs.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
