"""Registry of queries and of their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import SQL_TABLES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under a name, with SQL over the same tables if it can be said in SQL."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return build

    return add


def with_tables(sql: str) -> str:
    """Put the definitions of the domain tables a statement uses in front of it."""
    body = sql.strip().rstrip(";")
    own = ""
    if re.match(r"(?i)with\b", body):
        recursive = re.match(r"(?i)with\s+recursive\b", body)
        body = re.sub(r"(?i)^with(\s+recursive)?\s+", "", body)
        own, lead = body, "WITH RECURSIVE " if recursive else "WITH "
    else:
        lead = "WITH "
    used: list[str] = []

    def need(text: str) -> None:
        for t in SQL_TABLES:
            if t not in used and re.search(rf"\b{t}\b", text):
                need(SQL_TABLES[t])
                if t not in used:
                    used.append(t)

    need(body)
    parts = [f"{t} AS (\n{SQL_TABLES[t]}\n)" for t in used]
    if own:
        return lead + ",\n".join(parts + [own])
    return (lead + ",\n".join(parts) + "\n" if parts else "") + body
