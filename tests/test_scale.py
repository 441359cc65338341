"""Steps that must not move or hold more than they need, with the same rows."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tidewater.operators import clean as C
from tidewater.operators import demand as D
from tidewater.operators import models as ML
from tidewater.plans import decision_plans as DP
from tidewater.session import scratch_path
from tidewater.sources import raw as RAW
from tidewater.sources.tables import order_lines
from tidewater.streaming import live as LV

from sfdirs import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_customers_are_joined_to_the_orders_not_the_lines(spark):
    plan = _plan(order_lines(spark, SF_SMALL, ["order_id", "department", "market"])).splitlines()
    depth = {t: next(len(p) - len(p.lstrip(" :+-")) for p in plan if k in p and "Relation" in p)
             for t, k in (("lines", "l_orderkey"), ("customer", "c_custkey"), ("orders", "o_orderkey"))}
    joins = [len(p) - len(p.lstrip(" :+-")) for p in plan if "Join" in p]
    assert joins.count(min(joins)) == 1 and depth["customer"] > min(joins) and len(joins) == 5
    top = next(i for i, p in enumerate(plan) if "Join" in p)
    assert "l_orderkey" in plan[top] and "o_orderkey" in plan[top]  # the orders come last, with all that hangs on them


def test_decisions_read_the_written_lines(spark):
    x = DP.decision_inputs(spark, SF_SMALL)
    assert all("order-lines" in f for f in x["orders"].inputFiles())
    assert not set(DP.LEARNED_IN) & set(x["orders"].columns)
    assert sorted(DP.RULE_IN + DP.LEARNED_IN) == sorted(DP.DECISION_IN)
    want = order_lines(spark, SF_SMALL, DP.RULE_IN)
    got = x["orders"].select(*DP.RULE_IN)
    assert got.dtypes == want.dtypes and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_export_is_compressed(spark):
    path = RAW.write_raw_csv(RAW.raw_orders_frame(order_lines(spark, SF_SMALL, RAW.RAW_SOURCE_COLUMNS)), scratch_path(spark, "gz"))
    parts = [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]
    assert parts and all(f.endswith(".csv.gz") for f in parts)


def test_columns_nobody_reads_are_no_keys(spark):
    raw = RAW.raw_orders_frame(order_lines(spark, SF_SMALL, RAW.RAW_SOURCE_COLUMNS))
    plan = _plan(C.clean_orders(raw).select("quantity", "order_date"))
    keys = next(p for p in plan.splitlines() if "Aggregate [" in p).split("], [")[0]
    assert "Customer Password" not in keys


def test_copies_differ_in_any_column(spark):
    rows = [("1/5/2018 0:00", 2.0, 10, "x", 0.0), ("1/5/2018 0:00", 2.0, 10, "x", -0.0), ("1/5/2018 0:00", 2.0, 10, "y", 0.0),
            ("1/5/2018 0:00", 2.0, 10, None, 0.0), ("1/5/2018 0:00", 2.0, 10, None, 0.0), ("1/5/2018 0:00", 2.0, 10, "", 0.0),
            ("1/5/2018 0:00", 2.0, 10, "x", None)]
    raw = spark.createDataFrame(rows, "`order date (DateOrders)` string, `Order Item Quantity` double, `Product Card Id` long, note string, extra double")
    got = sorted(((r.note, r.extra) for r in C.clean_orders(raw).collect()), key=str)
    assert got == sorted([("x", 0.0), ("y", 0.0), (None, 0.0), ("", 0.0), ("x", None)], key=str)


def test_history_without_laying_out_the_series(spark):
    day = dt.date(2020, 1, 1)
    rows = [(k, day + dt.timedelta(days=d), q) for k, days in ((1, (0, 900, 905, 929)), (2, (5,)), (3, (0, 10)), (None, (0, 29, 30)), (4, (0, 40)))
            for d, q in zip(days, (1.0, 2.0, None, 4.0))]
    daily = spark.createDataFrame(rows, "product_id long, order_date date, demand double")
    want = ML.history_state(D.spine(daily, ["product_id"]), ["product_id"])
    got = ML.history_of_days(daily, ["product_id"])
    key = lambda r: str(r.product_id)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert [len(r.hist) for r in sorted(got.collect(), key=key)] == [30, 1, 11, 30, 30]
    assert "posexplode" not in _plan(got)


def test_batches_go_by_bytes(spark, tmp_path):
    for i in range(9):
        spark.range(10).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    sink = scratch_path(spark, "bytes")
    LV.run_to_end(LV.arriving(spark, str(tmp_path / "t"), spark.range(1).schema, bytes_per_trigger=LV.BATCH_BYTES), sink, sink + "-ck")
    out = spark.read.parquet(sink)
    assert out.count() == 90 and out.agg(F.count_distinct("batch_id")).first()[0] == 1


def test_partitions_of_the_join_follow_the_lines(spark):
    lines = order_lines(spark, SF_SMALL, ["order_id", "line_no", "order_date"])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = order_lines(spark, SF_SMALL, ["order_id", "line_no", "order_date"], task_lines=100)
    assert lines.count() > 100 * n and few.rdd.getNumPartitions() == -(-lines.count() // 100)
    assert few.exceptAll(lines).count() == lines.exceptAll(few).count() == 0
