"""Exploration summaries (L1-L4): single aggregate passes, results unpivoted with ``stack``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.quantiles import quantiles


def _stack(df: DataFrame, pairs: list[tuple[str, str]], key: str, value: str) -> DataFrame:
    args = ", ".join(f"'{k}', `{v}`" for k, v in pairs)
    return df.selectExpr(f"stack({len(pairs)}, {args}) AS (`{key}`, `{value}`)")


def date_range(df: DataFrame, date_col: str = "order_date") -> DataFrame:
    """L1: row count, column count, first and last date."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).alias("n_columns"),
                  F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """L2: (column, value, count) for non-null values of each column."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("kv")).select("kv.*")
    return stacked.where(F.col("value").isNotNull()).groupBy("col_name", "value").count()


def null_counts(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """L3: null count per column in one pass; by default only columns with nulls."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    out = _stack(agg, [(c, c) for c in df.columns], "col_name", "nulls")
    return out.where(F.col("nulls") > 0) if only_positive else out


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """L4: count, mean, sample std, min, quartiles (linear interpolation, exact), max per column."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col_name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*")
    stats = stacked.groupBy("col_name").agg(F.count("x").alias("count"), F.avg("x").alias("mean"),
                                            F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    q = quantiles(stacked, "col_name", "x", [0.25, 0.5, 0.75])
    return stats.join(F.broadcast(q), "col_name", "left").select(   # a row a column
        "col_name", "count", "mean", "std", "min", F.get("q", 0).alias("p25"), F.get("q", 1).alias("p50"),
        F.get("q", 2).alias("p75"), "max")
