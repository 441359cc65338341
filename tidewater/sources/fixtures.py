"""Fixture tables derived from the driver tables (FIXTURES.md §3).

These only render the given tables in the schemas the jobs expect: the
lane network from order-line volumes between supplier and customer nations,
the route requests, and department-day inventory states.  Each is a small
grouped aggregate of ``order_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import haversine_km, round_half_up
from tidewater.operators import demand as D
from tidewater.sources.tables import order_lines, read_table

NODE_TYPES = ["warehouse", "supplier", "hub"]


def net_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node per nation: id, ``Type-NATION`` name, lat/lon on a fixed rule, type."""
    n = read_table(spark, sf_dir, "nation")
    typ = (F.when(F.pmod("n_nationkey", F.lit(3)) == 0, "warehouse")
           .when(F.pmod("n_nationkey", F.lit(3)) == 1, "supplier").otherwise("hub"))
    return n.select(
        F.col("n_nationkey").cast("int").alias("node_id"),
        F.concat(F.initcap(typ), F.lit("-"), F.col("n_name")).alias("name"),
        (F.lit(-40.0) + F.lit(3.3) * F.col("n_nationkey")).alias("lat"),
        (F.pmod(F.col("n_nationkey") * 47, F.lit(360)) - 180).cast("double").alias("lon"),
        typ.alias("type"))


def tax_cents() -> Column:
    """Tax in whole hundredths, so that its sum is exact in any order."""
    return F.round(F.col("tax") * 100).cast("long")


def lane_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nation -> customer nation lanes with quantity and mean tax (self lanes dropped)."""
    ol = order_lines(spark, sf_dir, ["supplier_nation", "customer_nation", "quantity", "tax"])
    return (ol.where(F.col("supplier_nation") != F.col("customer_nation"))
            .groupBy(F.col("supplier_nation").cast("int").alias("source"),
                     F.col("customer_nation").cast("int").alias("target"))
            .agg(F.sum("quantity").alias("volume"), (F.sum(tax_cents()) / (F.count(F.lit(1)) * 100)).alias("avg_tax")))


def net_edges(spark: SparkSession, sf_dir: str, lanes: DataFrame | None = None) -> DataFrame:
    """Every observed lane (at most nations x nations), with distance and mode.

    ``lanes`` (source, target, volume, avg_tax), when at hand, saves the pass over the order lines.

    Distance and traffic are kept to 6 decimals so that every engine starts
    the weight arithmetic from the same doubles.
    """
    lanes = lane_volumes(spark, sf_dir) if lanes is None else lanes
    nodes = net_nodes(spark, sf_dir)
    a = nodes.select(F.col("node_id").alias("source"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = nodes.select(F.col("node_id").alias("target"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    e = lanes.join(F.broadcast(a), "source").join(F.broadcast(b), "target")
    mode = F.when(F.pmod(F.col("source") + F.col("target"), F.lit(7)) == 0, "air").otherwise("ground")
    return e.select(
        "source", "target",
        F.round(haversine_km("lat1", "lon1", "lat2", "lon2"), 6).alias("distance"),
        F.when(mode == "air", F.lit(0.1)).otherwise(round_half_up(1 + F.col("avg_tax"), 6)).alias("traffic"),
        F.col("volume").cast("long").alias("capacity"),
        mode.alias("mode"))


def net_edges_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large network: a lane per supplier and customer with orders between them; customers' numbers start at 1,000,000.

    The weight is the mean line value in hundredths of the value, at least one.
    """
    lines = order_lines(spark, sf_dir, ["order_value", "supplier_id", "customer_id"])
    return lines.groupBy(F.col("supplier_id").cast("int").alias("source"), (F.col("customer_id") + 1_000_000).cast("int").alias("target")).agg(
        F.greatest(F.round(F.avg("order_value") / 100, 2), F.lit(0.01)).alias("weight"))


def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (supplier nation, customer nation) pairs of the order lines as (start, goal)."""
    ol = order_lines(spark, sf_dir, ["supplier_nation", "customer_nation"])
    return ol.select(F.col("supplier_nation").cast("int").alias("start"),
                     F.col("customer_nation").cast("int").alias("goal")).distinct()


def series_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Department-day states: trailing 7-day demand, inventory rule, late share, anomaly, days.

    inventory = 50 + pmod(31 * day_of_year + 17 * brand number, 750);
    risk = late lines / lines over the trailing 7 days (0 without lines);
    anomaly = 1 when that share is at least 0.6;
    days = rounded mean real shipping days over the trailing 7 days (0 without lines).
    """
    ol = order_lines(spark, sf_dir, ["department", "order_date", "quantity", "late_risk", "actual_days"])
    return states_of_days(ol.groupBy("department", "order_date").agg(
        F.sum("quantity").alias("demand"), F.count(F.lit(1)).alias("lines"),
        F.sum("late_risk").alias("late"), F.sum("actual_days").alias("days_sum")))


def states_of_days(daily: DataFrame) -> DataFrame:
    """``series_states`` from the daily sums of each department."""
    sp = D.spine(daily.select("department", "order_date", "demand"), ["department"])
    s = sp.join(daily.drop("demand"), ["department", "order_date"], "left").fillna(
        0, subset=["lines", "late", "days_sum"])
    w = Window.partitionBy("department").orderBy("order_date").rowsBetween(-6, 0)
    lines7 = F.sum("lines").over(w)
    risk = F.when(lines7 > 0, F.sum("late").over(w) / lines7).otherwise(0.0)
    days = F.when(lines7 > 0, F.round(F.sum("days_sum").over(w) / lines7)).otherwise(0.0)
    brand = F.expr("try_cast(regexp_extract(department, '([0-9]+)$', 1) AS INT)")
    s = s.select("department", "order_date",
                 F.sum("demand").over(w).alias("demand7"),
                 (F.lit(50) + F.pmod(F.dayofyear("order_date") * 31 + F.coalesce(brand, F.lit(0)) * 17,
                                     F.lit(750))).cast("double").alias("inventory"),
                 risk.alias("risk"), days.alias("days"))
    return s.withColumn("anomaly", (F.col("risk") >= 0.6).cast("int"))
