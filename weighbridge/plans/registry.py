"""Named queries over the given tables, each with the DuckDB SQL that checks it where SQL can say the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weighbridge.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}  # name -> SQL, in dependency order


def view(name: str, sql: str) -> None:
    """A shared sub-select of the checking SQL."""
    VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Prepend the views that sql uses, directly or through other views."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(VIEWS[name])
    if not needed:
        return sql
    parts = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


def query(name: str, oracle: str | None = None):
    """Register fn(spark, sf_dir) under name; oracle is its checking SQL."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return wrap
