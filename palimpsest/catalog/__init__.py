"""Every operator as a named query over the given tables, with the SQL it must agree with."""

from __future__ import annotations

import importlib

MODULES = ["texts", "prints", "outline", "trees", "matching", "wording", "tables", "media", "report", "jobs",
           "intake"]

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"palimpsest.catalog.{m}")
