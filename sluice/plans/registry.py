"""Registry of named queries and their DuckDB oracle texts.

A query is ``(spark, sf_dir) -> DataFrame``. Its oracle is one SQL text over the
driver's base tables; the fixture views it needs are put in front as a CTE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..views import Tables, view_cte

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def with_views(views: tuple[str, ...], body: str) -> str:
    """Prefix ``body`` with the CTEs of ``views`` (merging a leading WITH)."""
    head = view_cte(*views)
    body = body.strip()
    if not head:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + head[5:].rstrip() + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return head.rstrip() + ",\n" + body[5:]
    return head + body


def query(key: str, views: tuple[str, ...] = (), oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``.

    ``views`` names the fixture views the oracle reads; ``oracle`` is its SQL
    body (omitted for operators without an SQL equivalent).
    """

    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = with_views(views, oracle)
        return fn

    return deco


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def _load() -> None:
    # Importing the plan modules fills the registry.
    from . import cache, chat, code, history, prompts, streams, tasks  # noqa: F401
