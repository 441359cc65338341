"""Cleaning, delay-risk, supplier, metric and exploration jobs with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.constants import RISK_FEATURES, SUPPLIER_FEATURES
from tidewater.functions.exprs import arith_hash
from tidewater.operators import clean as C
from tidewater.operators import demand as D
from tidewater.operators import eda as E
from tidewater.operators import metrics as M
from tidewater.operators import risk as R
from tidewater.operators import supplier as S
from tidewater.plans.demand_plans import NOT_NULL_SQL, sql_features, sql_spine
from tidewater.plans.oracle_base import with_order_lines
from tidewater.plans.registry import query, round_doubles
from tidewater.session import written
from tidewater.sources import raw as RAW
from tidewater.sources.tables import ORDER_LINE_COLUMNS, order_lines

CLEAN_COLS = ["order_id", "line_no", "order_date", "shipping_date", "quantity", "product_id",
              "product_name", "late_risk", "actual_days", "scheduled_days", "shipping_mode",
              "discount_rate", "category", "customer_segment", "order_value", "department",
              "country", "city"]
_CLEAN_SQL = with_order_lines() + """SELECT DISTINCT order_id, line_no, order_date,
  date_trunc('minute', shipping_date) AS shipping_date, quantity, product_id, product_name, late_risk,
  actual_days, scheduled_days, shipping_mode, discount_rate, category, customer_segment,
  ROUND(order_value, 4) AS order_value, department, country, city
FROM order_lines WHERE quantity IS NOT NULL AND order_date IS NOT NULL"""


DEDUP_LINES = 200_000  # whole lines that a task of the duplicate search holds


def _raw(spark, sf_dir, task_lines=None):
    return RAW.raw_orders_frame(order_lines(spark, sf_dir, RAW.RAW_SOURCE_COLUMNS, task_lines=task_lines))


def _clean_out(df):
    df = df.withColumnsRenamed({"Order Id": "order_id", "Order Item Id": "line_no"})
    return round_doubles(df.select(*CLEAN_COLS).withColumn(
        "shipping_date", F.col("shipping_date").cast("timestamp_ntz")))


# ------------------------------------------------------------- A1, B1-B4, B7
@query("scan_orders_csv", _CLEAN_SQL)
def scan_orders_csv(spark, sf_dir):
    """A1: the raw export written as latin-1 CSV, scanned back with its schema, then cleaned."""
    path = RAW.write_raw_csv(_raw(spark, sf_dir))
    return _clean_out(C.clean_orders(RAW.scan_orders_csv(spark, path)))


@query("clean_orders", _CLEAN_SQL)
def clean_orders(spark, sf_dir):
    return _clean_out(C.clean_orders(_raw(spark, sf_dir, task_lines=DEDUP_LINES)))


@query("parse_dates", with_order_lines() + """SELECT order_id, line_no, order_date,
  date_trunc('minute', shipping_date) AS shipping_date FROM order_lines""")
def parse_dates(spark, sf_dir):
    p = C.parse_dates(_raw(spark, sf_dir))
    return p.select(F.col("Order Id").alias("order_id"), F.col("Order Item Id").alias("line_no"),
                    "order_date", F.col("shipping_date").cast("timestamp_ntz").alias("shipping_date"))


@query("dedup_orders", with_order_lines()
       + "SELECT DISTINCT order_id, line_no, order_date FROM order_lines")
def dedup_orders(spark, sf_dir):
    """B3 on the order-key projection, where (order, line) pairs repeat."""
    return order_lines(spark, sf_dir, ["order_id", "line_no", "order_date"]).dropDuplicates()


@query("product_orders", with_order_lines("""
top AS (SELECT product_id FROM order_lines GROUP BY product_id ORDER BY COUNT(*) DESC, product_id LIMIT 1)""")
       + """SELECT order_id, line_no, o.product_id, order_date, quantity FROM order_lines o
JOIN top t ON o.product_id = t.product_id""")
def product_orders(spark, sf_dir):
    """Lines of one product (here the busiest product; a top-1 report picks it)."""
    ol = order_lines(spark, sf_dir, ["order_id", "line_no", "product_id", "order_date", "quantity"])
    top = ol.groupBy("product_id").count().orderBy(F.desc("count"), "product_id").first()
    return C.product_rows(ol, str(top["product_id"]) if top else "")


@query("product_orders_unknown", with_order_lines() + """SELECT order_id, line_no, product_id, order_date, quantity
FROM order_lines WHERE CAST(product_id AS VARCHAR) IN ('no such product', '007', '')""")
def product_orders_unknown(spark, sf_dir):
    """B7 with keys that no product prints as: no rows."""
    ol = order_lines(spark, sf_dir, ["order_id", "line_no", "product_id", "order_date", "quantity"])
    none = [C.product_rows(ol, k) for k in ("no such product", "007", "")]
    return none[0].union(none[1]).union(none[2])


# --------------------------------------------------------------- D1-D9 risk
_RISK_IN = ["order_id", "line_no", "order_date", "quantity", "actual_days", "scheduled_days",
            "shipping_mode", "discount_rate", "order_value", "late_risk", "department", "market",
            "order_region", "category", "customer_segment", "order_type", "country"]

_RISK_CTES = ("""
rk AS (SELECT *, actual_days - scheduled_days AS delay_gap,
  CAST(CASE WHEN actual_days - scheduled_days <= 0 THEN 0 WHEN actual_days - scheduled_days <= 2 THEN 1
       ELSE 2 END AS INTEGER) AS risk_class,
  CAST(CASE shipping_mode WHEN 'Standard Class' THEN 0 WHEN 'Second Class' THEN 1 WHEN 'First Class' THEN 2
       WHEN 'Same Day' THEN 3 ELSE 0 END AS INTEGER) AS shipping_mode_enc,
  CAST(month(order_date) AS INTEGER) AS order_month, CAST(isodow(order_date) - 1 AS INTEGER) AS order_dow,
  scheduled_days - GREATEST(actual_days, 0) AS days_buffer
  FROM order_lines)""", """
rates AS (SELECT department, AVG(late_risk) AS supplier_delay_rate FROM order_lines GROUP BY department)""",
              """
codes AS (SELECT col_name, value, CAST(DENSE_RANK() OVER (PARTITION BY col_name ORDER BY value) - 1 AS INTEGER)
          AS code FROM (
  SELECT DISTINCT 'category' AS col_name, category AS value FROM order_lines UNION
  SELECT DISTINCT 'country', country FROM order_lines UNION
  SELECT DISTINCT 'customer_segment', customer_segment FROM order_lines UNION
  SELECT DISTINCT 'market', market FROM order_lines UNION
  SELECT DISTINCT 'order_region', order_region FROM order_lines UNION
  SELECT DISTINCT 'order_type', order_type FROM order_lines) WHERE value IS NOT NULL)""", """
feats AS (SELECT k.order_id, k.line_no, k.shipping_mode_enc, k.discount_rate, k.order_value,
  r.supplier_delay_rate,
  COALESCE(c1.code, -1) AS market_enc, COALESCE(c2.code, -1) AS region_enc,
  COALESCE(c3.code, -1) AS category_enc, COALESCE(c4.code, -1) AS segment_enc,
  COALESCE(c5.code, -1) AS type_enc, COALESCE(c6.code, -1) AS ocountry_enc,
  k.order_month, k.order_dow, k.quantity, k.risk_class, k.shipping_mode
  FROM rk k LEFT JOIN rates r ON k.department = r.department
  LEFT JOIN codes c1 ON c1.col_name = 'market' AND c1.value = k.market
  LEFT JOIN codes c2 ON c2.col_name = 'order_region' AND c2.value = k.order_region
  LEFT JOIN codes c3 ON c3.col_name = 'category' AND c3.value = k.category
  LEFT JOIN codes c4 ON c4.col_name = 'customer_segment' AND c4.value = k.customer_segment
  LEFT JOIN codes c5 ON c5.col_name = 'order_type' AND c5.value = k.order_type
  LEFT JOIN codes c6 ON c6.col_name = 'country' AND c6.value = k.country)""")


def _risk_base(spark, sf_dir):
    return R.delay_columns(order_lines(spark, sf_dir, _RISK_IN))


@query("risk_class", with_order_lines(_RISK_CTES[0])
       + "SELECT order_id, line_no, actual_days, scheduled_days, delay_gap, risk_class FROM rk")
def risk_class(spark, sf_dir):
    return _risk_base(spark, sf_dir).select("order_id", "line_no", "actual_days", "scheduled_days",
                                            "delay_gap", "risk_class")


@query("shipping_mode_enc", with_order_lines(_RISK_CTES[0])
       + "SELECT shipping_mode, shipping_mode_enc, COUNT(*) AS n_lines FROM rk GROUP BY 1, 2")
def shipping_mode_enc(spark, sf_dir):
    return (_risk_base(spark, sf_dir).groupBy("shipping_mode", "shipping_mode_enc")
            .agg(F.count(F.lit(1)).alias("n_lines")))


@query("delay_rate_join", with_order_lines(_RISK_CTES[1]) + """SELECT o.order_id, o.line_no, o.department,
  ROUND(r.supplier_delay_rate, 4) AS supplier_delay_rate FROM order_lines o LEFT JOIN rates r USING (department)""")
def delay_rate_join(spark, sf_dir):
    ol = order_lines(spark, sf_dir, ["order_id", "line_no", "department", "late_risk"])
    return round_doubles(R.with_delay_rate(ol).select("order_id", "line_no", "department",
                                                      "supplier_delay_rate"))


@query("label_codes", with_order_lines(_RISK_CTES[2]) + "SELECT col_name, value, code FROM codes")
def label_codes(spark, sf_dir):
    ol = order_lines(spark, sf_dir, sorted(set(R.RISK_CODED.values())))
    return R.label_code_table(ol, sorted(set(R.RISK_CODED.values())))


_RISK_FEATURE_SQL = ", ".join(
    f"ROUND({c}, 4) AS {c}" if c in ("discount_rate", "order_value", "supplier_delay_rate", "quantity") else c
    for c in RISK_FEATURES)


@query("risk_features", with_order_lines(*_RISK_CTES)
       + f"SELECT order_id, line_no, {_RISK_FEATURE_SQL}, risk_class FROM feats")
def risk_features(spark, sf_dir):
    # the rates, the codes and the rows themselves all read the lines
    base = R.delay_columns(written(order_lines(spark, sf_dir, _RISK_IN), "order-lines"))
    df = R.with_label_codes(R.with_delay_rate(base))
    return round_doubles(df.select("order_id", "line_no", *RISK_FEATURES, "risk_class").dropna())


@query("days_buffer", with_order_lines(_RISK_CTES[0])
       + "SELECT order_id, line_no, scheduled_days, actual_days, days_buffer FROM rk")
def days_buffer(spark, sf_dir):
    return _risk_base(spark, sf_dir).select("order_id", "line_no", "scheduled_days", "actual_days",
                                            "days_buffer")


def sql_arith_hash(cols: list[str], seed: int = 42) -> str:
    expr = str(seed)
    for i, c in enumerate(cols):
        expr = f"((({expr}) * 1000003 + ({c}) * {7919 + 2 * i}) % 2147483647)"
    return expr


_SPLIT_CTE = f"""
split AS (SELECT *, ({sql_arith_hash(['order_id', 'line_no', 'risk_class'])}) % 10 < 2 AS is_test FROM feats)"""


@query("stratified_split", with_order_lines(*_RISK_CTES, _SPLIT_CTE)
       + "SELECT risk_class, is_test, COUNT(*) AS n_rows FROM split GROUP BY 1, 2")
def stratified_split(spark, sf_dir):
    df = R.stratified_split(_risk_base(spark, sf_dir), ["order_id", "line_no"])
    return df.groupBy("risk_class", "is_test").agg(F.count(F.lit(1)).alias("n_rows"))


_SPLIT_HASH = sql_arith_hash(['order_id', 'line_no', 'risk_class'])


@query("stratified_split_exact", with_order_lines(*_RISK_CTES, f"""
ranked AS (SELECT risk_class, {_SPLIT_HASH} AS h,
  ROW_NUMBER() OVER (PARTITION BY risk_class ORDER BY {_SPLIT_HASH}) AS nth,
  FLOOR(COUNT(*) OVER (PARTITION BY risk_class) * 0.2 + 0.5) AS quota FROM feats)""")
       + """SELECT risk_class, nth <= quota AS is_test, COUNT(*) AS n_rows, CAST(SUM(h) AS BIGINT) AS hash_sum, MAX(h) AS last_hash
FROM ranked GROUP BY 1, 2""")
def stratified_split_exact(spark, sf_dir):
    """Exactly a fifth of each class, by hash; the hash sums tell which rows."""
    df = R.exact_stratified_split(_risk_base(spark, sf_dir), ["order_id", "line_no"])
    h = arith_hash("order_id", "line_no", F.col("risk_class"))
    return df.withColumn("h", h).groupBy("risk_class", "is_test").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("h").alias("hash_sum"), F.max("h").alias("last_hash"))


def _scored(spark, sf_dir):
    df = R.stratified_split(_risk_base(spark, sf_dir), ["order_id", "line_no"])
    train, test = df.where(~F.col("is_test")), df.where(F.col("is_test"))
    return R.prior_classifier(train, test).withColumnRenamed("risk_class", "label")


_SCORED_CTES = (_SPLIT_CTE, """
shares AS (SELECT shipping_mode,
  ROUND(COUNT(*) FILTER (WHERE risk_class = 0) / COUNT(*), 4) AS p_0,
  ROUND(COUNT(*) FILTER (WHERE risk_class = 1) / COUNT(*), 4) AS p_1,
  ROUND(COUNT(*) FILTER (WHERE risk_class = 2) / COUNT(*), 4) AS p_2
  FROM split WHERE NOT is_test GROUP BY shipping_mode)""", """
scored AS (SELECT t.risk_class AS label, COALESCE(s.p_0, 0.0) AS p_0, COALESCE(s.p_1, 0.0) AS p_1,
  COALESCE(s.p_2, 0.0) AS p_2 FROM split t LEFT JOIN shares s USING (shipping_mode) WHERE t.is_test)""", """
pred AS (SELECT *, CASE WHEN p_0 >= p_1 AND p_0 >= p_2 THEN 0 WHEN p_1 >= p_2 AND p_1 > p_0 THEN 1 ELSE 2 END
  AS prediction FROM scored)""")


@query("confusion_matrix", with_order_lines(*_RISK_CTES, *_SCORED_CTES) + """SELECT k.k AS true_class,
  COUNT(*) FILTER (WHERE p.prediction = 0) AS pred_0, COUNT(*) FILTER (WHERE p.prediction = 1) AS pred_1,
  COUNT(*) FILTER (WHERE p.prediction = 2) AS pred_2
FROM (SELECT CAST(unnest(range(3)) AS INTEGER) AS k) k LEFT JOIN pred p ON p.label = k.k GROUP BY k.k""")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_scored(spark, sf_dir))


@query("classification_report", with_order_lines(*_RISK_CTES, *_SCORED_CTES, """
per AS (SELECT k.k, COUNT(*) FILTER (WHERE p.label = k.k AND p.prediction = k.k) AS tp,
  COUNT(*) FILTER (WHERE p.prediction = k.k) AS npred, COUNT(*) FILTER (WHERE p.label = k.k) AS ntrue
  FROM (SELECT unnest(range(3)) AS k) k, pred p GROUP BY k.k),
per2 AS (SELECT tp, ntrue, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS p,
  CASE WHEN ntrue > 0 THEN tp / ntrue ELSE 0.0 END AS r FROM per WHERE npred > 0 OR ntrue > 0)""")
       + """SELECT ROUND(SUM(tp) / SUM(ntrue), 4) AS accuracy, ROUND(AVG(p), 4) AS precision,
  ROUND(AVG(r), 4) AS recall, ROUND(AVG(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 4) AS f1
FROM per2""")
def classification_report(spark, sf_dir):
    return round_doubles(M.classification_report(_scored(spark, sf_dir)))


@query("auc_ovr", with_order_lines(*_RISK_CTES, *_SCORED_CTES, """
st AS (SELECT label, 0 AS k, ROUND(p_0, 4) AS score FROM scored UNION ALL
       SELECT label, 1, ROUND(p_1, 4) FROM scored UNION ALL SELECT label, 2, ROUND(p_2, 4) FROM scored),
cnt AS (SELECT k, score, COUNT(*) FILTER (WHERE label = k) AS pos, COUNT(*) FILTER (WHERE label <> k) AS neg
        FROM st GROUP BY k, score),
cum AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY k ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS neg_below FROM cnt)""")
       + """SELECT CAST(k AS INTEGER) AS k,
  ROUND(SUM(pos * (neg_below + neg / 2.0)) / (SUM(pos) * SUM(neg)), 4) AS auc FROM cum GROUP BY k""")
def auc_ovr(spark, sf_dir):
    return round_doubles(M.auc_ovr(_scored(spark, sf_dir)))


# -------------------------------------------------------- E1, E3-E5 supplier
_STATS_SQL = """
stats_{by} AS (SELECT {by}, COALESCE(AVG(actual_days), 0) AS avg_delivery_time,
  COALESCE(STDDEV_SAMP(order_value) / (AVG(order_value) + 1e-9), 0) AS price_deviation,
  COALESCE(1 - AVG(late_risk), 0) AS fulfillment_rate, COALESCE(CAST(SUM(late_risk) AS DOUBLE), 0) AS complaint_freq
  FROM order_lines GROUP BY {by})"""
_STATS_OUT = ("ROUND(avg_delivery_time, 4) AS avg_delivery_time, ROUND(price_deviation, 4) AS price_deviation, "
              "ROUND(fulfillment_rate, 4) AS fulfillment_rate, complaint_freq")


def _supplier_in(spark, sf_dir, *extra):
    return order_lines(spark, sf_dir, ["actual_days", "order_value", "late_risk", *extra])


@query("supplier_stats", with_order_lines(_STATS_SQL.format(by="department"))
       + f"SELECT department, {_STATS_OUT} FROM stats_department")
def supplier_stats(spark, sf_dir):
    return round_doubles(S.stats(_supplier_in(spark, sf_dir, "department"), "department"))


@query("supplier_stats_by_supplier", with_order_lines(_STATS_SQL.format(by="supplier"))
       + f"SELECT supplier, {_STATS_OUT} FROM stats_supplier")
def supplier_stats_by_supplier(spark, sf_dir):
    return round_doubles(S.stats(_supplier_in(spark, sf_dir, "supplier"), "supplier"))


@query("supplier_scorecard_stats", with_order_lines(_STATS_SQL.format(by="department"))
       + """SELECT department, ROUND(avg_delivery_time, 2) AS avg_delivery_time, ROUND(price_deviation, 4) AS price_deviation,
  ROUND(fulfillment_rate, 3) AS fulfillment_rate, CAST(complaint_freq AS BIGINT) AS complaint_freq FROM stats_department""")
def supplier_scorecard_stats(spark, sf_dir):
    """E2's statistics, rounded as listed (the learned score has no exact twin)."""
    st = S.stats(_supplier_in(spark, sf_dir, "department"), "department")
    flags = S.zscore_outliers(st, "department")
    return S.scorecard(st, flags).drop("anomaly_score", "is_anomaly")


@query("anomaly_summary", with_order_lines(_STATS_SQL.format(by="supplier"), """
zs AS (SELECT AVG(avg_delivery_time) m1, STDDEV_POP(avg_delivery_time) s1, AVG(price_deviation) m2,
  STDDEV_POP(price_deviation) s2, AVG(fulfillment_rate) m3, STDDEV_POP(fulfillment_rate) s3,
  AVG(complaint_freq) m4, STDDEV_POP(complaint_freq) s4 FROM stats_supplier),
flags AS (SELECT supplier, GREATEST(CASE WHEN s1 > 0 THEN ABS(avg_delivery_time - m1) / s1 ELSE 0.0 END,
  CASE WHEN s2 > 0 THEN ABS(price_deviation - m2) / s2 ELSE 0.0 END,
  CASE WHEN s3 > 0 THEN ABS(fulfillment_rate - m3) / s3 ELSE 0.0 END,
  CASE WHEN s4 > 0 THEN ABS(complaint_freq - m4) / s4 ELSE 0.0 END) > 2 AS is_anomaly FROM stats_supplier, zs)""")
       + """SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE is_anomaly) AS anomaly_count,
  CASE WHEN COUNT(*) > 0 THEN ROUND(COUNT(*) FILTER (WHERE is_anomaly) * 100.0 / COUNT(*), 1) ELSE 0.0 END
  AS anomaly_rate FROM flags""")
def anomaly_summary(spark, sf_dir):
    """E3 over suppliers flagged by the z-score rule (the isolation forest has its own rows check)."""
    st = S.stats(_supplier_in(spark, sf_dir, "supplier"), "supplier")
    return S.anomaly_summary(S.zscore_outliers(st, "supplier"))


@query("order_supplier_metrics", with_order_lines(_STATS_SQL.format(by="department"))
       + """SELECT o.order_id, o.line_no, o.department, ROUND(COALESCE(s.avg_delivery_time, 5.0), 4) AS avg_delivery_time,
  ROUND(COALESCE(s.price_deviation, 0.1), 4) AS price_deviation, ROUND(COALESCE(s.fulfillment_rate, 0.85), 4)
  AS fulfillment_rate, COALESCE(s.complaint_freq, 10.0) AS complaint_freq
FROM order_lines o LEFT JOIN stats_department s USING (department)""")
def order_supplier_metrics(spark, sf_dir):
    ol = _supplier_in(spark, sf_dir, "order_id", "line_no", "department")
    out = S.order_supplier_metrics(ol.select("order_id", "line_no", "department"), S.stats(ol, "department"))
    return round_doubles(out.select("order_id", "line_no", "department", *SUPPLIER_FEATURES))


@query("avg_unit_value", with_order_lines()
       + "SELECT ROUND(AVG(order_value) / GREATEST(AVG(quantity), 1.0), 4) AS avg_unit_value FROM order_lines")
def avg_unit_value(spark, sf_dir):
    return round_doubles(S.avg_unit_value(order_lines(spark, sf_dir, ["order_value", "quantity"])))


# ------------------------------------------------------------ G1, G2 metrics
def _naive_test_rows(spark, sf_dir, by):
    ol = order_lines(spark, sf_dir, ["order_date", "quantity", *by])
    f = D.features(ol, by)
    # seasonal naive for day t+1 is the demand of day t+1-7, i.e. lag_7 of the next row
    f = f.withColumn("y_pred", F.lead("lag_7", 1).over(D._window(by)))
    t = D.split(D.target(f, by, horizon=1), by)
    return t.where(~F.col("is_train")).select(*by, "order_date", F.col("y_abs").alias("y_true"), "y_pred")


def sql_metrics(keys: list[str]) -> str:
    part = ("PARTITION BY " + ", ".join(keys)) if keys else ""
    kc = ", ".join(keys) + ", " if keys else ""
    grp = ("GROUP BY " + ", ".join(keys)) if keys else ""
    return with_order_lines(sql_spine(keys), sql_features(keys), f"""
feat AS (SELECT * FROM feat_all WHERE {NOT_NULL_SQL}),
tgt AS (SELECT {kc}order_date, lag_1, LEAD(demand, 1) OVER ({part} ORDER BY order_date) AS y_abs,
  LEAD(lag_7, 1) OVER ({part} ORDER BY order_date) AS y_pred FROM feat),
tgt2 AS (SELECT * FROM tgt WHERE y_abs - lag_1 IS NOT NULL),
sp AS (SELECT *, ROW_NUMBER() OVER ({part} ORDER BY order_date) <= FLOOR(COUNT(*) OVER ({part}) * 0.8) AS is_train
  FROM tgt2),
te AS (SELECT {kc}order_date, y_abs AS y_true, y_pred FROM sp WHERE NOT is_train),
rl AS (SELECT {kc}COUNT(*) OVER w = 7 AS full_, SUM(y_true) OVER w AS yt, SUM(y_pred) OVER w AS yp FROM te
  WINDOW w AS ({part} ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
g AS (SELECT {kc}COUNT(*) FILTER (WHERE full_) AS n, AVG(CASE WHEN full_ THEN (yt - yp) * (yt - yp) END) AS mse,
  AVG(CASE WHEN full_ THEN ABS(yt - yp) END) AS mae_, SUM(CASE WHEN full_ THEN (yt - yp) * (yt - yp) END) AS ssres,
  VAR_POP(CASE WHEN full_ THEN yt END) * COUNT(*) FILTER (WHERE full_) AS sstot,
  SUM(CASE WHEN full_ THEN ABS(yt - yp) END) AS sad, SUM(CASE WHEN full_ THEN ABS(yt) END) AS say
  FROM rl {grp})""") + f"""SELECT {kc}
  ROUND(CASE WHEN n > 0 THEN SQRT(mse) ELSE 0.0 END, 4) AS rmse,
  ROUND(CASE WHEN n > 0 THEN mae_ ELSE 0.0 END, 4) AS mae,
  ROUND(CASE WHEN n > 0 THEN GREATEST(CASE WHEN sstot = 0 THEN (CASE WHEN ssres = 0 THEN 1.0 ELSE 0.0 END)
        ELSE 1 - ssres / sstot END, 0.0) ELSE 0.0 END, 4) AS r2,
  ROUND(CASE WHEN n > 0 THEN LEAST(CASE WHEN say <> 0 THEN sad / say * 100 ELSE 0.0 END, 100.0) ELSE 0.0 END, 4)
  AS wape, n AS n_windows
FROM g"""


@query("forecast_metrics", sql_metrics([]))
def forecast_metrics(spark, sf_dir):
    """G1 with the seasonal-naive prediction (the exact stand-in for the regressor)."""
    return round_doubles(M.forecast_metrics(_naive_test_rows(spark, sf_dir, [])))


@query("forecast_metrics_by_product", sql_metrics(["product_id"]))
def forecast_metrics_by_product(spark, sf_dir):
    """Every product's metrics in one grouped job, from runs of equal windows.

    A product appears if it has a test row, that is a row with a target beyond the training share.
    """
    ol = order_lines(spark, sf_dir, ["order_date", "quantity", "product_id"])
    return round_doubles(M.forecast_metrics_of_runs(D.naive_window_runs(ol, ["product_id"]), D.tested_series(ol, ["product_id"]),
                                                    ["product_id"]))


# ------------------------------------------------------------------- L1-L4
_EDA_COLS = ["order_id", "line_no", "product_id", "supplier_id", "quantity", "discount_rate", "order_value", "tax",
             "inventory", "customer_id", "scheduled_days", "actual_days", "late_risk", "days_to_delivery",
             "supplier_nation", "customer_nation"]  # every numeric column of the view


@query("eda_range", with_order_lines() + """SELECT COUNT(*) AS n_rows, 29 AS n_columns,
  MIN(order_date) AS first_date, MAX(order_date) AS last_date FROM order_lines""")
def eda_range(spark, sf_dir):
    """L1 over the whole view."""
    return E.date_range(order_lines(spark, sf_dir))


@query("eda_value_counts", with_order_lines() + """SELECT 'late_risk' AS col_name, CAST(late_risk AS VARCHAR)
  AS value, COUNT(*) AS count FROM order_lines WHERE late_risk IS NOT NULL GROUP BY 1, 2 UNION ALL
SELECT 'shipping_mode', shipping_mode, COUNT(*) FROM order_lines WHERE shipping_mode IS NOT NULL GROUP BY 1, 2""")
def eda_value_counts(spark, sf_dir):
    return E.value_counts(order_lines(spark, sf_dir, ["late_risk", "shipping_mode"]), ["late_risk", "shipping_mode"])


_NULL_COLS = [*ORDER_LINE_COLUMNS, "quality", "toxic"]


@query("eda_nulls", with_order_lines("""
j AS (SELECT o.*, l.quality, l.toxic FROM order_lines o LEFT JOIN labels l ON l.doc_id = o.order_id)""")
       + "SELECT * FROM (" + " UNION ALL ".join(
           f"SELECT '{c}' AS col_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls FROM j" for c in _NULL_COLS)
       + ") WHERE nulls > 0")
def eda_nulls(spark, sf_dir):
    """L3 over every column of the view and of the sparse ``labels`` table left-joined to it, so that some hold nulls."""
    from tidewater.sources.tables import read_table
    lab = read_table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "order_id")
    return E.null_counts(order_lines(spark, sf_dir).join(lab, "order_id", "left").select(*_NULL_COLS))


@query("eda_describe", with_order_lines() + " UNION ALL ".join(
    f"""SELECT '{c}' AS col_name, COUNT({c}) AS count, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std,
  ROUND(CAST(MIN({c}) AS DOUBLE), 4) AS min, ROUND(QUANTILE_CONT({c}, 0.25), 4) AS p25, ROUND(QUANTILE_CONT({c}, 0.5), 4) AS p50,
  ROUND(QUANTILE_CONT({c}, 0.75), 4) AS p75, ROUND(CAST(MAX({c}) AS DOUBLE), 4) AS max FROM order_lines""" for c in _EDA_COLS))
def eda_describe(spark, sf_dir):
    # the statistics and the quantiles both read the lines
    d = E.describe(written(order_lines(spark, sf_dir, _EDA_COLS), "order-lines"), _EDA_COLS)
    return d.select("col_name", "count", *[F.round(c, 4).alias(c) for c in
                                          ["mean", "std", "min", "p25", "p50", "p75", "max"]])
