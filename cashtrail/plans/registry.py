"""Named queries over the domain tables, each with its comparison SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure
from ..sources.fixtures import Domain, duckdb_ctes

QUERIES: dict[str, Callable[[Domain], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None, ctes: str = "", recursive: bool = False, steps_once: bool = False):
    """Register a query; ``views`` are the domain views its SQL starts from, ``ctes`` shared steps, each computed once if asked."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            heads = [p for p in (duckdb_ctes(*views.split()) if views else "", ctes) if p]
            word = "with recursive " if recursive else "with "
            steps = ", ".join(heads)
            if steps_once:
                steps = re.sub(r"(^|,)(\s*\w+) as \((?=\s*select)", r"\1\2 as materialized (", steps)
            ORACLES[name] = (word + steps + " " if heads else "") + sql.strip()
        return fn

    return add


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double on the way out so results compare by value."""
    return df.select(*[F.round(c, digits).alias(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c) for c in df.columns])


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: QUERIES[name](Domain(configure(spark), folder))


def hav(a: str, b: str, c: str, d: str) -> str:
    return (f"2*6371.0*asin(sqrt(least(1.0,greatest(0.0,pow(sin(radians(({c})-({a}))/2),2)"
            f"+cos(radians({a}))*cos(radians({c}))*pow(sin(radians(({d})-({b}))/2),2)))))")
