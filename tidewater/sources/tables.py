"""Driver tables and the ``order_lines`` view (order-line grain).

``order_lines`` maps the TPC-H-like tables onto the logical order-line schema
the jobs consume.  The fact side is ``lineitem``; every other table is a
key look-up.  Because dimension keys are unique and every foreign key
resolves (checked by ``tests/test_sources.py``), a dimension that supplies
none of the requested columns can be left out without changing a single
row.  Asking only for the columns a job needs therefore saves whole shuffles
of the fact table at scale: ``lineitem`` ⋈ ``orders`` is the one large-by-
large join (sort-merge on the order key); part/supplier/customer joins are
left to AQE, which broadcasts them only when their runtime size is under
``spark.sql.autoBroadcastJoinThreshold``; nation and region (25 and 5 rows by
definition of the schema) are broadcast explicitly.  Customer, nation and
region are joined to ``orders`` before the lines, so they shuffle no line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _shipping_mode(priority: Column) -> Column:
    # fixture choice (FIXTURES §2): order priority stands in for the shipping mode
    return (F.when(priority == "1-URGENT", "Same Day")
            .when(priority == "2-HIGH", "First Class")
            .when(priority == "3-MEDIUM", "Second Class")
            .otherwise("Standard Class"))


def scheduled_days_for(mode: Column) -> Column:
    return (F.when(mode == "Same Day", 0).when(mode == "First Class", 1)
            .when(mode == "Second Class", 2).otherwise(4))


# column -> (expression builder, tables it needs besides lineitem)
def _column_specs():
    mode = _shipping_mode(F.col("o_orderpriority"))
    actual = F.pmod(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")), F.lit(7))
    sched = scheduled_days_for(mode)
    return {
        "order_id": (F.col("l_orderkey"), ()),
        "line_no": (F.col("l_linenumber"), ()),
        "product_id": (F.col("l_partkey"), ()),
        "supplier_id": (F.col("l_suppkey"), ()),
        "quantity": (F.col("l_quantity"), ()),
        "discount_rate": (F.col("l_discount"), ()),
        "order_value": (F.col("l_extendedprice") * (1 - F.col("l_discount")), ()),
        "tax": (F.col("l_tax"), ()),
        "order_type": (F.col("l_returnflag"), ()),
        "shipping_date": (F.col("l_shipdate"), ()),
        "inventory": (F.lit(50) + F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17,
                                         F.lit(750)), ()),
        "order_date": (F.to_date("o_orderdate"), ("orders",)),
        "customer_id": (F.col("o_custkey"), ("orders",)),
        "shipping_mode": (mode, ("orders",)),
        "scheduled_days": (sched, ("orders",)),
        "actual_days": (actual, ("orders",)),
        "late_risk": (F.when(actual > sched, 1).otherwise(0), ("orders",)),
        "days_to_delivery": (sched, ("orders",)),
        "product_name": (F.col("p_name"), ("part",)),
        "category": (F.col("p_type"), ("part",)),
        "department": (F.col("p_brand"), ("part",)),
        "supplier": (F.col("s_name"), ("supplier",)),
        "supplier_nation": (F.col("s_nationkey"), ("supplier",)),
        "customer_segment": (F.col("c_mktsegment"), ("orders", "customer")),
        "customer_nation": (F.col("c_nationkey"), ("orders", "customer")),
        "country": (F.col("n_name"), ("orders", "customer", "nation")),
        "order_region": (F.col("n_name"), ("orders", "customer", "nation")),
        "city": (F.col("n_name"), ("orders", "customer", "nation")),
        "market": (F.col("r_name"), ("orders", "customer", "nation", "region")),
    }


ORDER_LINE_COLUMNS = [
    "order_id", "line_no", "product_id", "supplier_id", "quantity", "discount_rate", "order_value",
    "tax", "order_type", "shipping_date", "inventory", "order_date", "customer_id", "shipping_mode",
    "scheduled_days", "actual_days", "late_risk", "days_to_delivery", "product_name", "category",
    "department", "supplier", "supplier_nation", "customer_segment", "customer_nation", "country",
    "order_region", "city", "market",
]


def order_lines(spark: SparkSession, sf_dir: str, columns: list[str] | None = None,
                lineitem: DataFrame | None = None, task_lines: int | None = None) -> DataFrame:
    """The logical order-line table, joining only the dimensions ``columns`` need.

    ``lineitem`` replaces the table of that name, for example by a stream of it.  ``task_lines``: about so many lines
    a partition come out of the join with the orders, if the session's shuffle partitions would hold more.
    """
    specs = _column_specs()
    columns = list(columns) if columns else list(specs)
    unknown = [c for c in columns if c not in specs]
    if unknown:
        raise ValueError(f"unknown order_lines columns: {unknown}")
    need = set()
    for c in columns:
        need.update(specs[c][1])

    df = read_table(spark, sf_dir, "lineitem") if lineitem is None else lineitem
    if "part" in need:
        names = {"product_name": "p_name", "category": "p_type", "department": "p_brand"}
        p = read_table(spark, sf_dir, "part").select("p_partkey", *[names[c] for c in columns if c in names])
        df = df.join(p, df.l_partkey == p.p_partkey)
    if "supplier" in need:
        s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        df = df.join(s, df.l_suppkey == s.s_suppkey)
    if "orders" in need:
        # what hangs on an order is joined to the orders, which are fewer than the lines, and to the lines last
        o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                                       "o_orderpriority")
        if "customer" in need:
            c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
            o = o.join(c, o.o_custkey == c.c_custkey)
        if "nation" in need:
            n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
            o = o.join(F.broadcast(n), o.c_nationkey == n.n_nationkey)
        if "region" in need:
            r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
            o = o.join(F.broadcast(r), o.n_regionkey == r.r_regionkey)
        if task_lines:
            tasks = -(-(read_table(spark, sf_dir, "lineitem") if lineitem is None else lineitem).count() // task_lines)
            if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
                df = df.repartition(tasks, "l_orderkey")  # the exchange that the join needs anyhow
        df = df.join(o, df.l_orderkey == o.o_orderkey)
    return df.select(*[specs[c][0].alias(c) for c in columns])
