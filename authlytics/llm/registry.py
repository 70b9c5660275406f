"""Registered queries of this subpackage; filled by the modules ``queries`` imports."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def query(spark, sf_dir):
            from .common import prepare
            prepare(spark)
            return fn(spark, sf_dir)
        query.__name__, query.__doc__ = name, fn.__doc__
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
