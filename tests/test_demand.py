"""Demand series: gap-free spine, guarded rolling features, lags, naive forecast."""

import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import demand as D


def _orders(spark):
    d0 = dt.date(2020, 1, 1)
    rows = []
    for i in range(45):
        if i % 3 == 1:            # every third day has no orders
            continue
        rows.append(("A", d0 + dt.timedelta(days=i), float(i)))
        rows.append(("A", d0 + dt.timedelta(days=i), 1.0))
    rows.append(("B", d0, 5.0))
    rows.append(("B", d0 + dt.timedelta(days=3), 7.0))
    return spark.createDataFrame(rows, "product_id string, order_date date, quantity double")


def test_spine_has_no_gaps_and_zero_fill(spark):
    s = D.spine(D.daily_demand(_orders(spark), ["product_id"]), ["product_id"]).orderBy("product_id", "order_date")
    rows = s.collect()
    a = [r for r in rows if r.product_id == "A"]
    b = [r for r in rows if r.product_id == "B"]
    assert len(b) == 4 and [r.demand for r in b] == [5.0, 0.0, 0.0, 7.0]
    days = [r.order_date for r in a]
    assert all((y - x).days == 1 for x, y in zip(days, days[1:]))
    assert a[1].demand == 0.0 and a[2].demand == 3.0


def test_rolling_guard_and_values(spark):
    s = D.spine(D.daily_demand(_orders(spark), ["product_id"]), ["product_id"])
    f = D.lags(D.rolling(s, ["product_id"]), ["product_id"]).where(F.col("product_id") == "A") \
        .orderBy("order_date").collect()
    vals = [r.demand for r in f]
    assert f[6].rolling_7d_mean is None and f[7].rolling_7d_mean is not None
    assert abs(f[7].rolling_7d_mean - sum(vals[0:7]) / 7) < 1e-12
    assert abs(f[40].rolling_30d_mean - sum(vals[10:40]) / 30) < 1e-12
    import statistics
    assert abs(f[20].rolling_7d_std - statistics.stdev(vals[13:20])) < 1e-9
    assert f[20].lag_7 == vals[13] and f[5].lag_7 is None


def test_features_drop_first_30_days(spark):
    f = D.features(_orders(spark), ["product_id"])
    assert f.where(F.col("product_id") == "A").count() == 45 - 30
    assert f.where(F.col("product_id") == "B").count() == 0


def test_naive_forecast_repeats_last_week(spark):
    s = D.spine(D.daily_demand(_orders(spark), ["product_id"]), ["product_id"]).where(F.col("product_id") == "A")
    fc = D.naive_forecast(s, ["product_id"], horizon=9).orderBy("step").collect()
    hist = [r.demand for r in s.orderBy("order_date").collect()]
    assert [r.forecast for r in fc[:7]] == hist[-7:]
    assert fc[7].forecast == hist[-7]                       # the week repeats


def _sparse_orders(spark):
    """Series of every shape: long gaps, one day only, just 30, 31 and 32 days, daily, a hot one."""
    import random
    rng = random.Random(5)
    d0 = dt.date(1969, 11, 20)                                  # days before 1970 too
    days = {"gaps": sorted(rng.sample(range(900), 14)), "one": [3], "d30": [0, 30], "d31": [0, 31], "d32": [0, 32],
            "flat": list(range(60)), "long": [0, 1, 2, 700], "mixed": sorted(rng.sample(range(200), 90))}
    rows = [(k, d0 + dt.timedelta(days=d), float(rng.randint(1, 50)) if k != "flat" else 4.0) for k, v in days.items() for d in v]
    rows += [("gaps", d0 + dt.timedelta(days=days["gaps"][5]), 1.0)] * 500
    rows += [("mixed", None, 9.0)]
    return spark.createDataFrame(rows, "product_id string, order_date date, quantity double")


def test_runs_laid_out_equal_the_dense_features(spark):
    o = _sparse_orders(spark)
    for by in (["product_id"], []):
        key = lambda r: (r["product_id"] if by else "", r["order_date"])
        dense = sorted((r.asDict() for r in D.features(o, by).collect()), key=key)
        laid = sorted((r.asDict() for r in D.run_days(D.feature_runs(o, by), by).collect()), key=key)
        assert len(dense) == len(laid) > 0
        for a, b in zip(dense, laid):
            assert a.keys() == b.keys()
            for c in a:
                assert (abs(a[c] - b[c]) < 1e-7) if isinstance(a[c], float) else a[c] == b[c], (c, a, b)


def test_runs_stay_few_and_weekends_are_counted(spark):
    o = _sparse_orders(spark)
    r = D.feature_runs(o, ["product_id"])
    sales = {x.product_id: x.n for x in D.daily_demand(o, ["product_id"]).groupBy("product_id").agg(F.count("*").alias("n")).collect()}
    for x in r.groupBy("product_id").agg(F.count("*").alias("n")).collect():
        assert x.n <= 9 * sales[x.product_id]
    for x in r.select("first_day", "days", D.weekend_days(F.col("first_day"), F.col("days")).alias("w")).collect():
        assert x.w == sum((x.first_day + dt.timedelta(days=i)).weekday() >= 5 for i in range(x.days))


def test_metrics_of_runs_equal_the_dense_metrics(spark):
    from tidewater.operators import metrics as M
    o, by = _sparse_orders(spark), ["product_id"]
    f = D.features(o, by).withColumn("y_pred", F.lead("lag_7", 1).over(D._window(by)))
    t = D.split(D.target(f, by, horizon=1), by).where(~F.col("is_train"))
    dense = {r.product_id: r.asDict() for r in M.forecast_metrics(
        t.select(*by, "order_date", F.col("y_abs").alias("y_true"), "y_pred"), by).collect()}
    got = {r.product_id: r.asDict() for r in M.forecast_metrics_of_runs(D.naive_window_runs(o, by), D.tested_series(o, by), by).collect()}
    assert dense.keys() == got.keys() and "d31" in got and "d30" not in got
    for k in dense:
        for c in dense[k]:
            assert dense[k][c] == got[k][c] if c in ("product_id", "n_windows") else abs(dense[k][c] - got[k][c]) < 1e-7, (k, c)
