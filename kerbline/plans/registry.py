"""Named queries over the derived road-survey views, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame."""

    def put(fn):
        assert name not in _QUERIES, name
        _QUERIES[name] = fn
        if oracle:
            _ORACLES[name] = oracle
        return fn

    return put


def whole(name: str, *cuts: tuple[str, str]) -> str:
    """The counterpart of a registered query without its subset filters: each (cut, instead) is replaced."""
    sql = _ORACLES[name]
    for cut, instead in cuts:
        assert cut in sql, (name, cut)
        sql = sql.replace(cut, instead)
    return sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES
