"""Supplier scorecard statistics.

The grouping key is a parameter: ``department`` (the reference's proxy) or
``supplier``.  All statistics are algebraic aggregates, so a hot group is
combined map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.constants import PRICE_DEVIATION_EPS, REQUEST_DEFAULTS, SUPPLIER_FEATURES


def stats(orders: DataFrame, by: str = "department") -> DataFrame:
    """Mean real shipping days, coefficient of variation of value, 1 - late share, late count.

    A single-row group has a null sample std; like the reference, nulls become 0.
    """
    agg = orders.groupBy(by).agg(
        F.avg("actual_days").alias("avg_delivery_time"),
        (F.stddev_samp("order_value") / (F.avg("order_value") + F.lit(PRICE_DEVIATION_EPS)))
        .alias("price_deviation"),
        (1 - F.avg("late_risk")).alias("fulfillment_rate"),
        F.sum("late_risk").cast("double").alias("complaint_freq"),
    )
    return agg.fillna(0.0, subset=SUPPLIER_FEATURES)


def stats_of_sums(sums: DataFrame, by: str = "department") -> DataFrame:
    """``stats`` from partial sums: n, days, late, value and value2 (sum of squares) per ``by`` and anything finer."""
    n, v, v2 = F.sum("n"), F.sum("value"), F.sum("value2")
    spread = F.when(n > 1, F.sqrt(F.greatest(v2 - v * v / n, F.lit(0.0)) / (n - 1)))
    return sums.groupBy(by).agg(
        (F.sum("days") / n).alias("avg_delivery_time"),
        (spread / (v / n + F.lit(PRICE_DEVIATION_EPS))).alias("price_deviation"),
        (1 - F.sum("late") / n).alias("fulfillment_rate"),
        F.sum("late").cast("double").alias("complaint_freq")).fillna(0.0, subset=SUPPLIER_FEATURES)


def scorecard(stats_df: DataFrame, scores: DataFrame, by: str = "department") -> DataFrame:
    """The listed scorecard: statistics rounded 2/4/3/int, score rounded 4, flag."""
    s = stats_df.join(scores.select(by, "anomaly_score", "is_anomaly"), on=by, how="left")
    return s.select(
        by,
        F.round("avg_delivery_time", 2).alias("avg_delivery_time"),
        F.round("price_deviation", 4).alias("price_deviation"),
        F.round("fulfillment_rate", 3).alias("fulfillment_rate"),
        F.col("complaint_freq").cast("long").alias("complaint_freq"),
        F.round("anomaly_score", 4).alias("anomaly_score"),
        F.col("is_anomaly"),
    )


def anomaly_summary(flags: DataFrame) -> DataFrame:
    """Total, anomaly count, rate in percent to 1 decimal (0 when there are no rows)."""
    return flags.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_anomaly")).alias("anomaly_count"),
    ).withColumn("anomaly_rate",
                 F.when(F.col("total") > 0,
                        F.round(F.col("anomaly_count") * 100.0 / F.col("total"), 1)).otherwise(0.0))


def order_supplier_metrics(orders: DataFrame, stats_df: DataFrame, by: str = "department") -> DataFrame:
    """Each order's group metrics; a group without statistics gets the request defaults."""
    from tidewater.functions.joins import small_side
    s = small_side(stats_df)
    j = orders.join(s, on=by, how="left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(float(REQUEST_DEFAULTS[c])))
                          for c in SUPPLIER_FEATURES})


def avg_unit_value(orders: DataFrame) -> DataFrame:
    """E5: mean order value / max(mean quantity, 1) — one row."""
    return orders.agg(
        (F.avg("order_value") / F.greatest(F.avg("quantity"), F.lit(1.0))).alias("avg_unit_value"))


def zscore_outliers(stats_df: DataFrame, by: str, z: float = 2.0) -> DataFrame:
    """Deterministic outlier rule: score = largest |x - mean| / population std over the statistics.

    Means and deviations are one aggregate row, read as one scalar struct;
    a statistic with zero spread contributes 0.  Flag when the score exceeds ``z``.
    """
    from tidewater.functions.constants import SUPPLIER_FEATURES as FEATS
    row = stats_df.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in FEATS for n, f in (("m", F.avg), ("s", F.stddev_pop))])).scalar()
    parts = []
    for c in FEATS:
        mean, std = row[f"m_{c}"], row[f"s_{c}"]
        parts.append(F.when(std > 0, F.abs(F.col(c) - mean) / std).otherwise(F.lit(0.0)))
    score = F.greatest(*parts)
    return stats_df.select(by, score.alias("anomaly_score"), (score > z).alias("is_anomaly"))
