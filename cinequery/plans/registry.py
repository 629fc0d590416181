"""All registered queries of the container engine, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can express it, its counterpart."""

    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


from cinequery.plans import container_queries, demux_queries, frame_queries, media_queries, scan_queries  # noqa: E402, F401
