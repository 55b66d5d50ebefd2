"""Query and oracle registry behind the driver entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nightgrid.plans.adapters import oracle_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    """Register a Spark query; the oracle of the same name is added apart."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        return fn

    return wrap


def oracle(name: str, views: str, body: str, recursive: bool = False) -> None:
    """Register DuckDB SQL: `views` are adapter names, `body` continues the
    WITH list or is a plain SELECT."""
    names = views.split()
    body = body.strip()
    head = "with recursive " if recursive else "with "
    ctes = oracle_ctes(*names)
    if body.lower().startswith(("select", "(")):
        ORACLES[name] = f"{head}{ctes}\n{body}" if names else body
    else:
        ORACLES[name] = head + (f"{ctes},\n{body}" if names else body)


def q6(expr: str, digits: int = 6) -> str:
    """SQL twin of `angles.r6`."""
    p = f"1e{digits}"
    return f"floor(({expr})*{p}+0.5e0)/{p}"


def c6(expr: str, alias: str, digits: int = 6) -> str:
    return f"{q6(expr, digits)} as {alias}"
