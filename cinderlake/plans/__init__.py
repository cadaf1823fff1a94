"""Registered queries over the supplied tables, each with its SQL."""

from __future__ import annotations

from . import chunks, index, retrieval, state, tasks

MODULES = (retrieval, chunks, index, tasks, state)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
