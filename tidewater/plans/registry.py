"""Registry of named jobs: a Spark callable and, where exact, its DuckDB oracle.

Plans are thin: they read the tables, call the library's operators, and
round floating results to 4 decimals so that two engines summing in a
different order still agree.  Output columns carry the same names in the
Spark job and its oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r4(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, 4)
    return out.alias(name or (c if isinstance(c, str) else None)) if (name or isinstance(c, str)) else out


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column (top level) for cross-engine comparison."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
