"""Registry of the queries: one key for each operator, with the SQL that another engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlume.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None, *needs: str, recursive: bool = False):
    """Register f(Tables) under key; sql may start with further CTEs ("WITH ...") and reads the views named in needs."""

    def add(f: Callable[[views.Tables], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: f(views.Tables(spark, sf_dir))
        if sql is not None:
            SQL[key] = with_views(sql, needs, recursive)
        return f

    return add


def with_views(sql: str, needs: tuple[str, ...], recursive: bool = False) -> str:
    body = sql.strip()
    more = body[:5].upper() == "WITH "
    ctes = [f"{name} AS ({views.duck(name)})" for name in views.closure(needs)] + ([body[5:]] if more else [])
    return (f"WITH {'RECURSIVE ' if recursive else ''}" if ctes else "") + ",\n".join(ctes) + ("" if more else f"\n{body}")
