"""The order_lines view: referential integrity and join pruning give the same rows."""

from pyspark.sql import functions as F

from tidewater.sources.tables import order_lines, read_table

from sfdirs import SF_SMALL


def test_foreign_keys_resolve(spark):
    li = read_table(spark, SF_SMALL, "lineitem")
    o = read_table(spark, SF_SMALL, "orders")
    assert li.join(o, li.l_orderkey == o.o_orderkey, "left_anti").count() == 0
    assert li.join(read_table(spark, SF_SMALL, "part"), li.l_partkey == F.col("p_partkey"), "left_anti").count() == 0
    assert li.join(read_table(spark, SF_SMALL, "supplier"), li.l_suppkey == F.col("s_suppkey"),
                   "left_anti").count() == 0
    assert o.join(read_table(spark, SF_SMALL, "customer"), o.o_custkey == F.col("c_custkey"), "left_anti").count() == 0
    for t, k in [("orders", "o_orderkey"), ("part", "p_partkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey")]:
        d = read_table(spark, SF_SMALL, t)
        assert d.count() == d.select(k).distinct().count()


def test_pruned_view_equals_full_view(spark):
    cols = ["order_id", "line_no", "quantity", "order_date", "late_risk"]
    narrow = order_lines(spark, SF_SMALL, cols)
    full = order_lines(spark, SF_SMALL).select(*cols)
    assert narrow.exceptAll(full).count() == 0 and full.exceptAll(narrow).count() == 0
    assert narrow.count() == read_table(spark, SF_SMALL, "lineitem").count()


def test_pruning_skips_unneeded_joins(spark, capsys):
    order_lines(spark, SF_SMALL, ["order_id", "quantity"]).explain()
    assert "Join" not in capsys.readouterr().out
    order_lines(spark, SF_SMALL, ["order_id", "market"]).explain()
    assert "Join" in capsys.readouterr().out
