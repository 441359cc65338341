"""Demand-series jobs (C1-C13, F3) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import demand as D
from tidewater.plans.oracle_base import with_order_lines
from tidewater.plans.registry import query, round_doubles
from tidewater.sources.tables import order_lines


def _orders(spark, sf_dir, *extra):
    return order_lines(spark, sf_dir, ["order_date", "quantity", *extra])


# ---------------------------------------------------------------- oracle text
def sql_spine(keys: list[str], name: str = "spine") -> str:
    """CTEs daily_<name>, bounds_<name>, <name>: gap-filled daily series per key."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    join_on = " AND ".join([f"d.{c} = x.{c}" for c in keys] + ["d.order_date = x.order_date"])
    dsel = ", ".join(f"d.{c}" for c in keys)
    dsel = (dsel + ", ") if keys else ""
    return f"""
daily_{name} AS (SELECT {kc}order_date, SUM(quantity) AS demand FROM order_lines
                 WHERE order_date IS NOT NULL GROUP BY {kc}order_date),
bounds_{name} AS (SELECT {kc}MIN(order_date) AS lo, MAX(order_date) AS hi FROM daily_{name}
                  {"GROUP BY " + k if keys else ""}),
days_{name} AS (SELECT {kc}CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS order_date
                FROM bounds_{name}),
{name} AS (SELECT {dsel}d.order_date, COALESCE(x.demand, 0.0) AS demand
           FROM days_{name} d LEFT JOIN daily_{name} x ON {join_on})"""


def sql_features(keys: list[str], src: str = "spine", name: str = "feat_all") -> str:
    """CTE <name>: calendar, guarded rolling stats and lags over <src> (no dropna)."""
    part = "PARTITION BY " + ", ".join(keys) if keys else ""
    w = f"({part} ORDER BY order_date"
    def frame(n):
        return f"{w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"""
{name} AS (
  SELECT *,
    CAST(isodow(order_date) - 1 AS INTEGER) AS day_of_week,
    CAST(month(order_date) AS INTEGER) AS month,
    CAST(quarter(order_date) AS INTEGER) AS quarter,
    CAST(dayofyear(order_date) AS INTEGER) AS day_of_year,
    CAST(CASE WHEN isodow(order_date) - 1 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
    CASE WHEN COUNT(demand) OVER {frame(7)} = 7 THEN AVG(demand) OVER {frame(7)} END AS rolling_7d_mean,
    CASE WHEN COUNT(demand) OVER {frame(30)} = 30 THEN AVG(demand) OVER {frame(30)} END AS rolling_30d_mean,
    CASE WHEN COUNT(demand) OVER {frame(7)} = 7 THEN STDDEV_SAMP(demand) OVER {frame(7)} END AS rolling_7d_std,
    LAG(demand, 1) OVER {w}) AS lag_1,
    LAG(demand, 7) OVER {w}) AS lag_7,
    LAG(demand, 14) OVER {w}) AS lag_14,
    LAG(demand, 30) OVER {w}) AS lag_30
  FROM {src})"""


FEATURE_COLS_SQL = ("day_of_week, month, quarter, day_of_year, is_weekend, ROUND(rolling_7d_mean, 4) AS "
                    "rolling_7d_mean, ROUND(rolling_30d_mean, 4) AS rolling_30d_mean, ROUND(rolling_7d_std, 4) "
                    "AS rolling_7d_std, lag_1, lag_7, lag_14, lag_30")
NOT_NULL_SQL = ("rolling_7d_mean IS NOT NULL AND rolling_30d_mean IS NOT NULL AND rolling_7d_std IS NOT NULL "
                "AND lag_1 IS NOT NULL AND lag_7 IS NOT NULL AND lag_14 IS NOT NULL AND lag_30 IS NOT NULL")


def sql_naive(keys: list[str], src: str, horizon: int = 7, name: str = "naive") -> str:
    kc = ", ".join(keys) + ", " if keys else ""
    on = " AND ".join([f"s.{c} = x.{c}" for c in keys] + ["x.order_date = s.src"])
    ssel = ", ".join(f"s.{c}" for c in keys) + ", " if keys else ""
    return f"""
last_{name} AS (SELECT {kc}MAX(order_date) AS last_date FROM {src} {"GROUP BY " + ", ".join(keys) if keys else ""}),
steps_{name} AS (SELECT {kc}CAST(step AS INTEGER) AS step, CAST(last_date + CAST(step AS INTEGER) AS DATE) AS order_date,
                 CAST(last_date + CAST((((step - 1) % 7) + 7) % 7 + 1 - 7 AS INTEGER) AS DATE) AS src
                 FROM last_{name}, unnest(generate_series(1, {horizon})) AS g(step)),
{name} AS (SELECT {ssel}s.step, s.order_date, COALESCE(x.demand, 0.0) AS forecast
           FROM steps_{name} s LEFT JOIN {src} x ON {on})"""


# --------------------------------------------------------------------- C1, C2
@query("daily_demand", with_order_lines()
       + "SELECT order_date, SUM(quantity) AS demand FROM order_lines WHERE order_date IS NOT NULL GROUP BY 1")
def daily_demand(spark, sf_dir):
    return D.daily_demand(_orders(spark, sf_dir))


@query("demand_spine", with_order_lines(sql_spine([])) + "SELECT order_date, demand FROM spine")
def demand_spine(spark, sf_dir):
    return D.spine(D.daily_demand(_orders(spark, sf_dir)))


@query("demand_calendar", with_order_lines(sql_spine([]), sql_features([]))
       + "SELECT order_date, demand, day_of_week, month, quarter, day_of_year, is_weekend FROM feat_all")
def demand_calendar(spark, sf_dir):
    return D.calendar(D.spine(D.daily_demand(_orders(spark, sf_dir))))


@query("demand_rolling", with_order_lines(sql_spine([]), sql_features([]))
       + "SELECT order_date, demand, ROUND(rolling_7d_mean, 4) AS rolling_7d_mean, "
         "ROUND(rolling_30d_mean, 4) AS rolling_30d_mean, ROUND(rolling_7d_std, 4) AS rolling_7d_std "
         "FROM feat_all")
def demand_rolling(spark, sf_dir):
    s = D.rolling(D.spine(D.daily_demand(_orders(spark, sf_dir))))
    return round_doubles(s.select("order_date", "demand", "rolling_7d_mean", "rolling_30d_mean",
                                  "rolling_7d_std"))


@query("demand_lags", with_order_lines(sql_spine([]), sql_features([]))
       + "SELECT order_date, demand, lag_1, lag_7, lag_14, lag_30 FROM feat_all")
def demand_lags(spark, sf_dir):
    return D.lags(D.spine(D.daily_demand(_orders(spark, sf_dir))))


@query("demand_features", with_order_lines(sql_spine([]), sql_features([]))
       + f"SELECT order_date, demand, {FEATURE_COLS_SQL} FROM feat_all WHERE {NOT_NULL_SQL}")
def demand_features(spark, sf_dir):
    return round_doubles(D.features(_orders(spark, sf_dir)))


_TARGET_SQL = with_order_lines(sql_spine([]), sql_features([]), f"""
feat AS (SELECT * FROM feat_all WHERE {NOT_NULL_SQL}),
tgt AS (SELECT order_date, demand, lag_1, LEAD(demand, 1) OVER (ORDER BY order_date) AS y_abs FROM feat),
tgt2 AS (SELECT *, y_abs - lag_1 AS target FROM tgt WHERE y_abs - lag_1 IS NOT NULL)""")


@query("demand_target", _TARGET_SQL + "SELECT order_date, demand, lag_1, y_abs, target FROM tgt2")
def demand_target(spark, sf_dir):
    t = D.target(D.features(_orders(spark, sf_dir)), horizon=1)
    return t.select("order_date", "demand", "lag_1", "y_abs", "target")


@query("demand_split", _TARGET_SQL
       + "SELECT order_date, target, ROW_NUMBER() OVER (ORDER BY order_date) <= "
         "FLOOR(COUNT(*) OVER () * 0.8) AS is_train FROM tgt2")
def demand_split(spark, sf_dir):
    t = D.split(D.target(D.features(_orders(spark, sf_dir)), horizon=1))
    return t.select("order_date", "target", "is_train")


# ------------------------------------------------------------- C11 by product
@query("demand_features_by_product",
       with_order_lines(sql_spine(["product_id"]), sql_features(["product_id"]), f"""
feat AS (SELECT * FROM feat_all WHERE {NOT_NULL_SQL})""")
       + """SELECT product_id, COUNT(*) AS n_rows, MIN(order_date) AS first_day, MAX(order_date) AS last_day,
  ROUND(SUM(demand), 4) AS sum_demand, ROUND(SUM(rolling_7d_mean), 4) AS sum_rolling_7d_mean,
  ROUND(SUM(rolling_30d_mean), 4) AS sum_rolling_30d_mean, ROUND(SUM(rolling_7d_std), 4) AS sum_rolling_7d_std,
  ROUND(SUM(lag_1 + lag_7 + lag_14 + lag_30), 4) AS sum_lags,
  CAST(SUM(is_weekend) AS BIGINT) AS weekend_days
FROM feat GROUP BY product_id""")
def demand_features_by_product(spark, sf_dir):
    """All products' feature tables in one job, summarised per product from runs of equal days."""
    f = D.feature_runs(_orders(spark, sf_dir, "product_id"), ["product_id"])
    k = F.col("days")
    return round_doubles(f.groupBy("product_id").agg(
        F.sum(k).cast("bigint").alias("n_rows"), F.min("first_day").alias("first_day"),
        F.max(F.date_add("first_day", k - 1)).alias("last_day"), F.sum(F.col("demand") * k).alias("sum_demand"),
        F.sum(F.col("rolling_7d_mean") * k).alias("sum_rolling_7d_mean"),
        F.sum(F.col("rolling_30d_mean") * k).alias("sum_rolling_30d_mean"),
        F.sum(F.col("rolling_7d_std") * k).alias("sum_rolling_7d_std"),
        F.sum((F.col("lag_1") + F.col("lag_7") + F.col("lag_14") + F.col("lag_30")) * k).alias("sum_lags"),
        F.sum(D.weekend_days(F.col("first_day"), k)).alias("weekend_days")))


# ------------------------------------------------------------------ C12, C13
@query("dept_last30", with_order_lines(sql_spine(["department"]))
       + """SELECT department, order_date, demand FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY department ORDER BY order_date DESC) AS rk FROM spine) WHERE rk <= 30""")
def dept_last30(spark, sf_dir):
    s = D.spine(D.daily_demand(_orders(spark, sf_dir, "department"), ["department"]), ["department"])
    return D.last_days(s, ["department"], 30)


@query("forecast_naive", with_order_lines(sql_spine([]), sql_naive([], "spine"))
       + "SELECT step, order_date, forecast FROM naive")
def forecast_naive(spark, sf_dir):
    s = D.spine(D.daily_demand(_orders(spark, sf_dir)))
    return D.naive_forecast(s, horizon=7)


@query("actual_and_forecast", with_order_lines(sql_spine([]), sql_naive([], "spine"), """
act AS (SELECT order_date, CAST(NULL AS INTEGER) AS step, demand AS actual, CAST(NULL AS DOUBLE) AS forecast
        FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY order_date DESC) AS rk FROM spine) WHERE rk <= 30),
fc AS (SELECT order_date, step, CAST(NULL AS DOUBLE) AS actual, forecast FROM naive),
rows_ AS (SELECT * FROM act UNION ALL SELECT * FROM fc)""")
       + """SELECT order_date, strftime(order_date, '%m-%d') AS label,
  CASE WHEN step = 1 THEN LAG(actual, 1) OVER (ORDER BY order_date) ELSE actual END AS actual, forecast
FROM rows_""")
def actual_and_forecast(spark, sf_dir):
    s = D.spine(D.daily_demand(_orders(spark, sf_dir)))
    return D.actual_and_forecast(s, D.naive_forecast(s, horizon=7))


@query("dept_scaled_forecast", with_order_lines(sql_spine([]), sql_naive([], "spine"),
                                                sql_spine(["department"], "dspine"), """
last7 AS (SELECT department, AVG(demand) AS dept_mean FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY department ORDER BY order_date DESC) AS rk FROM dspine)
  WHERE rk <= 7 GROUP BY department),
gm AS (SELECT AVG(forecast) AS gmean FROM naive)""")
       + """SELECT l.department, n.step, n.order_date,
  ROUND(GREATEST(n.forecast * l.dept_mean / GREATEST(gm.gmean, 1.0), 0.0), 4) AS forecast
FROM last7 l, naive n, gm""")
def dept_scaled_forecast(spark, sf_dir):
    o = _orders(spark, sf_dir, "department")
    g = D.naive_forecast(D.spine(D.daily_demand(o)), horizon=7)
    ds = D.spine(D.daily_demand(o, ["department"]), ["department"])
    return round_doubles(D.dept_scaled_forecast(ds, g, ["department"], horizon=7))
