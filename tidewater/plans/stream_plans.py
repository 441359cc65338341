"""Streaming jobs (K1-K4).  Each stream's final result equals its batch twin, so it shares its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import risk as R
from tidewater.plans import decision_plans as DP
from tidewater.plans.registry import query, round_doubles
from tidewater.session import scratch_path
from tidewater.sources.tables import order_lines, read_table
from tidewater.functions.constants import DEMAND_LAGS
from tidewater.streaming import live as LV
from tidewater.streaming import rings as RG

_DAILY_SQL = """SELECT CAST(ts AS DATE) AS day, ROUND(SUM(value), 4) AS demand FROM events
WHERE event_type = 'purchase' GROUP BY 1"""


def _events(spark, sf_dir):
    """Place and schema of the events table, read in place by the streams."""
    return f"{sf_dir}/events.parquet", read_table(spark, sf_dir, "events").schema


@query("event_daily_demand", _DAILY_SQL)
def event_daily_demand(spark, sf_dir):
    """K2 batch twin: purchase value per day."""
    return round_doubles(LV.daily_demand_batch(read_table(spark, sf_dir, "events")))


@query("event_daily_demand_stream", _DAILY_SQL)
def event_daily_demand_stream(spark, sf_dir):
    """K2: the same totals from a watermarked one-day window over the arriving event files."""
    path, schema = _events(spark, sf_dir)
    return round_doubles(LV.daily_demand_stream(spark, path, schema))


_LIVE_FEATURES_SQL = """WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, SUM(value) AS demand FROM events
  WHERE event_type = 'purchase' GROUP BY 1, 2),
c AS (SELECT CAST(MAX(ts) - INTERVAL 2 DAY AS DATE) - 1 AS closed FROM events WHERE event_type = 'purchase'),
b AS (SELECT user_id, MIN(day) AS lo, MIN(closed) AS hi FROM p, c GROUP BY 1 HAVING MIN(day) <= MIN(closed)),
d AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
s AS (SELECT d.user_id, d.day, COALESCE(p.demand, 0.0) AS demand FROM d LEFT JOIN p ON p.user_id = d.user_id AND p.day = d.day)
SELECT user_id, day, ROUND(demand, 4) AS demand,
  ROUND(CASE WHEN COUNT(*) OVER w7 = 7 THEN AVG(demand) OVER w7 END, 4) AS rolling_7d_mean,
  ROUND(CASE WHEN COUNT(*) OVER w30 = 30 THEN AVG(demand) OVER w30 END, 4) AS rolling_30d_mean,
  ROUND(CASE WHEN COUNT(*) OVER w7 = 7 THEN STDDEV_SAMP(demand) OVER w7 END, 4) AS rolling_7d_std,
  """ + ", ".join(f"ROUND(LAG(demand, {n}) OVER w, 4) AS lag_{n}" for n in DEMAND_LAGS) + """ FROM s
WINDOW w AS (PARTITION BY user_id ORDER BY day),
  w7 AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
  w30 AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"""


@query("live_demand_features", _LIVE_FEATURES_SQL)
def live_demand_features(spark, sf_dir):
    """K2 with C2-C7: each user's purchases as a live series, a row per closed day, empty days by timers."""
    path, schema = _events(spark, sf_dir)
    e = LV.arriving(spark, path, schema)
    amounts = e.where(F.col("event_type") == "purchase").select("user_id", LV.event_time(e).alias("ts"), "value")
    return round_doubles(RG.live_demand_features(spark, amounts, ["user_id"]))


@query("stream_dedup_events", """SELECT event_type, COUNT(*) AS n_events, ROUND(SUM(value), 4) AS total_value
FROM events GROUP BY 1""")
def stream_dedup_events(spark, sf_dir):
    """K4: every event is delivered twice; dropping redeliveries leaves each event once."""
    path, schema = _events(spark, sf_dir)
    d = LV.dedup_stream(spark, path, schema, deliveries=2)
    return round_doubles(d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"),
                                                     F.sum("value").alias("total_value")))


def _live(spark, sf_dir):
    store = scratch_path(spark, "decision-tables")
    DP.publish_inputs(spark, DP.decision_inputs(spark, sf_dir), store)
    place = f"{sf_dir}/lineitem.parquet"
    # every batch joins the arriving lines with whole tables, so batches go by bytes, not by four files
    lines = order_lines(spark, sf_dir, DP.RULE_IN, lineitem=LV.arriving(
        spark, place, read_table(spark, sf_dir, "lineitem").schema, bytes_per_trigger=LV.BATCH_BYTES))

    def decide(batch, version):
        return DP.decisions(spark, sf_dir, DP.published_inputs(spark, version) | {"orders": R.delay_columns(batch)})

    return LV.live_decisions(spark, lines, store, decide)


@query("live_order_decisions", DP.DECISIONS_SQL + """SELECT order_id, line_no, department, demand_forecast_7d,
  demand_7d_avg, risk_level, risk_score, is_anomaly, anomaly_score, state, trained, action_id, action,
  FLOOR(q_value * 1000.0 + 0.5) / 1000.0 AS q_value, ROUND(confidence, 4) AS confidence, route_cost, path_names, is_emergency,
  route_type, trigger FROM decf""")
def live_order_decisions(spark, sf_dir):
    """K1: order lines arriving as files, each batch decided by the look-ups committed last; equals the batch decisions."""
    return DP._decision_out(_live(spark, sf_dir))


@query("stream_history_latest", DP.DECISIONS_SQL + """,
h AS (SELECT order_id, line_no, order_date, product_id, quantity, order_value, department, action, route_type FROM decf
      ORDER BY order_date DESC, order_id DESC, line_no DESC, product_id DESC, quantity DESC, order_value DESC LIMIT 50)
SELECT *, CAST(COUNT(*) OVER () - ROW_NUMBER() OVER (ORDER BY order_date DESC, order_id DESC, line_no DESC,
  product_id DESC, quantity DESC, order_value DESC) + 1 AS BIGINT) AS row_no FROM h""")
def stream_history_latest(spark, sf_dir):
    """K3: the newest 50 decisions of the stream's sink table."""
    rows = _live(spark, sf_dir).select("order_id", "line_no", "order_date", "product_id", "quantity", "order_value",
                                       "department", "action", "route_type")
    return LV.newest(rows, ["order_date", "order_id", "line_no", "product_id", "quantity", "order_value"])
