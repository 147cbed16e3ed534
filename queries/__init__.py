"""Every operator bound to the given tables, with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("stage1", "features", "labels", "evaluation", "reports", "selection", "tables", "training")


def _load() -> None:
    for family in FAMILIES:
        import_module(f"queries.{family}")


def all_queries() -> dict:
    _load()
    from queries.registry import QUERIES

    return dict(QUERIES)


def all_sql() -> dict:
    _load()
    from queries.registry import SQL

    return dict(SQL)
