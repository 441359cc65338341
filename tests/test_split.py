"""Exact stratified split: quotas per class, repeated rows, null keys and classes."""

from pyspark.sql import functions as F

from tidewater.operators import risk as R


def counts(df):
    return {(r.risk_class, r.is_test): r["count"] for r in df.groupBy("risk_class", "is_test").count().collect()}


def test_every_class_gives_exactly_its_share(spark):
    df = spark.range(1003).select("id", (F.col("id") % 7 % 3).cast("int").alias("risk_class"), F.lit("x").alias("_other"))
    out = R.exact_stratified_split(df.repartition(5), ["id"])
    got = counts(out)
    for c, n in {r.risk_class: r["count"] for r in df.groupBy("risk_class").count().collect()}.items():
        assert got[(c, True)] == int(n * 0.2 + 0.5) and got[(c, True)] + got[(c, False)] == n
    assert out.select("id").distinct().count() == 1003 and out.columns == ["id", "risk_class", "_other", "is_test"]
    # the deal of rows to tasks does not matter
    again = R.exact_stratified_split(df.repartition(2, "risk_class"), ["id"])
    assert out.where("is_test").select("id").exceptAll(again.where("is_test").select("id")).count() == 0


def test_repeated_rows_and_nulls(spark):
    rows = [(7, 1)] * 400 + [(i, 1) for i in range(100)] + [(None, 2)] * 10 + [(i, None) for i in range(20)] + [(1, 0)]
    out = counts(R.exact_stratified_split(spark.createDataFrame(rows, "id long, risk_class int").repartition(6), ["id"]))
    assert out[(1, True)] == 100 and out[(1, False)] == 400
    assert out[(2, True)] == 2 and out[(2, False)] == 8
    assert out[(None, False)] == 20 and (None, True) not in out
    assert out[(0, False)] == 1


def test_empty_table(spark):
    assert R.exact_stratified_split(spark.createDataFrame([], "id long, risk_class int"), ["id"]).count() == 0
