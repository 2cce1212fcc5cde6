"""Named queries over the shared tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    from paritas.queries import extras, inference, models, selection, simulation, texts

    out: dict[str, Query] = {}
    for module in (selection, inference, texts, simulation, models, extras):
        out.update(module.QUERIES)
    return out


def all_sql() -> dict[str, str]:
    from paritas.queries import extras, inference, models, selection, simulation, texts

    out: dict[str, str] = {}
    for module in (selection, inference, texts, simulation, models, extras):
        out.update(module.SQL)
    return out
