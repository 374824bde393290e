"""Where the modules of queries put what they register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that it is held against."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def fold_sql(parts: str, fits: str, glue: str, closes: str) -> str:
    """DuckDB SQL for gathering a list of texts in order: {o} is what is open, {x} the next part, {g} the two together or the part alone."""
    more = f"(s.open <> '' AND ({fits.format(o='s.open', x='e.open')}))"
    grown = f"(CASE WHEN {more} THEN s.open || {glue} || e.open ELSE e.open END)"
    kept = f"(CASE WHEN {more} OR s.open = '' THEN s.done ELSE list_append(s.done, s.open) END)"
    full = closes.format(g=grown)
    step = f"{{'done': CASE WHEN {full} THEN list_append({kept}, {grown}) ELSE {kept} END, 'open': CASE WHEN {full} THEN '' ELSE {grown} END}}"
    return f"list_reduce(list_transform({parts}, lambda p: {{'done': []::VARCHAR[], 'open': p}}), lambda s, e: {step}, {{'done': []::VARCHAR[], 'open': ''}})"


def closed_sql(folded: str) -> str:
    return f"CASE WHEN {folded}.open = '' THEN {folded}.done ELSE list_append({folded}.done, {folded}.open) END"
