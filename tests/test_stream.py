"""Streams equal their batch twins; a row later than the watermark is dropped."""

import datetime as dt

from pyspark.sql import functions as F

from tidewater.session import scratch_path
from tidewater.streaming import live as LV

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_and_drops_late_rows(spark):
    path = scratch_path(spark, "test-events")
    t0 = dt.datetime(2024, 1, 1, 12)
    day = dt.timedelta(days=1)
    _write(spark, path, [(1, t0, 1, "purchase", 5.0, "{}"), (2, t0, 1, "view", 9.0, "{}")])
    _write(spark, path, [(3, t0 + day, 1, "purchase", 2.0, "{}")])
    _write(spark, path, [(4, t0 + 5 * day, 1, "purchase", 1.0, "{}")])
    _write(spark, path, [(6, t0 + 5 * day, 1, "view", 3.0, "{}")])
    # 5 days late; Spark judges late input against the previous batch's watermark (Jan 4, 12:00)
    _write(spark, path, [(5, t0, 1, "purchase", 100.0, "{}")])
    schema = spark.read.parquet(path).schema
    got = {str(r.day): r.demand for r in LV.daily_demand_stream(spark, path, schema, files_per_trigger=1).collect()}
    assert got == {"2024-01-01": 5.0, "2024-01-02": 2.0, "2024-01-06": 1.0}
    batch = {str(r.day): r.demand for r in LV.daily_demand_batch(spark.read.parquet(path)).collect()}
    assert batch["2024-01-01"] == 105.0                                  # the batch twin sees the late row


def test_redelivered_rows_dropped(spark):
    path = scratch_path(spark, "test-redeliver")
    t0 = dt.datetime(2024, 1, 1, 12)
    rows = [(i, t0 + dt.timedelta(hours=i), 1, "purchase", 1.0, "{}") for i in range(10)]
    _write(spark, path, rows)
    _write(spark, path, rows[:5])                                       # redelivery
    schema = spark.read.parquet(path).schema
    d = LV.dedup_stream(spark, path, schema)
    assert d.count() == 10 and d.select(F.count_distinct("event_id")).first()[0] == 10


def test_replayed_batch_leaves_no_copies(spark):
    sink = scratch_path(spark, "test-replay")
    write = LV.write_batch(sink)
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    for batch_id in (0, 1, 1, 0):
        write(batch, batch_id)
    assert spark.read.parquet(sink).count() == 4


def test_live_features_equal_the_batch_features(spark):
    """Several batches: late input within the watermark is in its day, days without input come by timer, later input is dropped."""
    from tidewater.operators import demand as D
    from tidewater.streaming import rings as RG
    path = scratch_path(spark, "test-live-features")
    t0 = dt.datetime(2024, 1, 1, 12)
    day = dt.timedelta(days=1)
    at = lambda u, d, v: (0, t0 + d * day, u, "purchase", v, "{}")
    _write(spark, path, [at(1, 0, 5.0), at(2, 0, 3.0), at(2, 1, 4.0), at(None, 0, 9.0)])
    _write(spark, path, [at(2, 3, 1.0), at(2, 2, 7.0), at(3, 3, None)])          # a day late: still open
    _write(spark, path, [at(2, d, float(d % 5)) for d in range(4, 20)])
    _write(spark, path, [at(1, 19, 2.0), at(2, 18, 6.0)])                        # user 1 sleeps for 19 days
    _write(spark, path, [at(1, 2, 100.0)])                                       # closed long ago: dropped
    _write(spark, path, [at(2, 45, 8.0)])
    schema = spark.read.parquet(path).schema
    e = LV.arriving(spark, path, schema, files_per_trigger=1)
    rows = RG.live_demand_features(spark, e.select("user_id", LV.event_time(e).alias("ts"), "value"), ["user_id"])
    got = {(r.user_id, r.day): r.asDict() for r in rows.collect()}
    assert rows.count() == len(got)
    closed = dt.date(2024, 1, 1) + 42 * day                                      # watermark: day 43, 12:00
    orders = [(r.user_id, r.ts.date(), r.value or 0.0) for r in spark.read.parquet(path).collect()
              if r.user_id is not None and r.value != 100.0 and r.ts.date() <= closed]
    orders += [(u, closed, 0.0) for u in (1, 2, 3)]                              # the batch series end with the last closed day
    o = spark.createDataFrame(orders, "user_id long, order_date date, quantity double")
    by = ["user_id"]
    want = D.lags(D.rolling(D.spine(D.daily_demand(o, by), by), by), by).collect()
    assert len(want) == len(got)
    for r in want:
        g = got[(r.user_id, r.order_date)]
        for c in ["demand", *RG.FEATURES]:
            assert (g[c] is None) == (r[c] is None) and (g[c] is None or abs(g[c] - r[c]) < 1e-9), (c, r, g)
