"""Daily demand series and their features.

A series is identified by the columns in ``by`` (``[]`` = one global series,
``["department"]``, ``["product_id"]``, ...).  Order lines are always summed
to one row per (series, day) first — a partial, map-side-combined aggregate —
so every window below sorts at most one row per calendar day per series.
A series with a third of all order lines still yields only its day count
(a few thousand rows) inside its window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.constants import DEMAND_FEATURES, DEMAND_LAGS

SERIES_ALL = "__all__"


def _keys(by: list[str] | None) -> list[str]:
    return list(by) if by else []


def _window(by: list[str] | None):
    keys = _keys(by)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(SERIES_ALL))
    return w.orderBy("order_date")


def daily_demand(orders: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total quantity per series and day."""
    keys = _keys(by)
    return (orders.where(F.col("order_date").isNotNull())
            .groupBy(*keys, "order_date")
            .agg(F.sum("quantity").alias("demand")))


def spine(daily: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every day from each series' first to last day; missing days get demand 0.

    The sparse daily rows of a series (at most one per calendar day, so
    bounded by the calendar, not by order volume) are gathered per key, laid
    out densely in one ``aggregate`` pass that pads each gap with zeros, and
    exploded with positions.  No join is needed, and the dense rows come out
    hash-partitioned by the series key — the partitioning the feature
    windows need — so they are never shuffled.
    """
    keys = _keys(by)
    if keys:
        # the gathered series explode ~(days / active days)-fold: lay them over the session's
        # shuffle partitions with an explicit count (AQE keeps it; it would otherwise coalesce
        # this small input into one task) — the gather and the windows reuse this partitioning
        n = int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        daily = daily.repartition(n, *keys)
    grp = daily.groupBy(*keys) if keys else daily.groupBy()
    g = grp.agg(F.array_sort(F.collect_list(F.struct("order_date", F.col("demand").cast("double").alias("demand"))))
                .alias("_d"))
    first = F.col("_d")[0]["order_date"]
    d = F.col("_d")
    # each active day becomes [zeros for the gap since the previous active day, its demand];
    # one flatten lays the series out densely in time linear in its length
    pieces = F.transform(d, lambda x, i: F.concat(
        F.array_repeat(F.lit(0.0), F.when(i == 0, F.lit(0)).otherwise(
            F.datediff(x["order_date"], d[i - 1]["order_date"]) - 1)),
        F.array(x["demand"])))
    out = g.select(*keys, first.alias("_lo"), F.posexplode(F.flatten(pieces)).alias("_i", "demand"))
    return out.select(*keys, F.date_add("_lo", F.col("_i")).alias("order_date"), "demand")


def calendar(df: DataFrame) -> DataFrame:
    """Monday=0 day of week, month, quarter, day of year, weekend flag."""
    d = F.col("order_date")
    return df.withColumns({
        "day_of_week": F.weekday(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "day_of_year": F.dayofyear(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
    })


def rolling(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of the previous 7 and 30 days and the sample std of the previous 7.

    As pandas ``rolling(n)`` on the shifted series, a value exists only once n
    previous days exist (the spine has no null demand, so that is the row
    number).  Frame sums are differences of running sums — O(1) per row,
    where a sliding frame costs O(frame) per row.  Values are first centred
    on the series' rounded mean (variance is shift-invariant; integer data
    stays integer, so its sums stay exact), which keeps the sum-of-squares
    variance accurate on long series.
    """
    keys = _keys(by)
    w = _window(by)
    wall = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(SERIES_ALL))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    c = F.round(F.avg("demand").over(wall))
    x = F.col("demand") - F.col("_c")
    df = df.withColumn("_c", c).withColumns({
        "_cs": F.sum(x).over(run), "_css": F.sum(x * x).over(run), "_rn": F.row_number().over(w)})

    def prev(col: str, n: int) -> Column:      # sum over the n rows before this one
        return F.lag(col, 1).over(w) - F.coalesce(F.lag(col, n + 1).over(w), F.lit(0.0))

    s7, ss7, s30 = prev("_cs", 7), prev("_css", 7), prev("_cs", 30)
    rn, cc = F.col("_rn"), F.col("_c")
    var7 = F.greatest((ss7 - s7 * s7 / 7) / 6, F.lit(0.0))
    return df.withColumns({
        "rolling_7d_mean": F.when(rn > 7, (s7 + 7 * cc) / 7),
        "rolling_30d_mean": F.when(rn > 30, (s30 + 30 * cc) / 30),
        "rolling_7d_std": F.when(rn > 7, F.sqrt(var7)),
    }).drop("_c", "_cs", "_css", "_rn")


def lags(df: DataFrame, by: list[str] | None = None, lag_days=DEMAND_LAGS) -> DataFrame:
    """Demand 1, 7, 14 and 30 rows back."""
    w = _window(by)
    return df.withColumns({f"lag_{n}": F.lag("demand", n).over(w) for n in lag_days})


def features(orders: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The 12-feature table; rows with any missing feature (first 30 days) dropped.

    Rolling statistics and lags share one window sort per series.
    """
    keys = _keys(by)
    s = calendar(spine(daily_demand(orders, keys), keys))
    s = lags(rolling(s, keys), keys)
    return s.select(*keys, "order_date", "demand", *DEMAND_FEATURES).dropna(subset=DEMAND_FEATURES)


def runs(daily: DataFrame, by: list[str] | None, sums: dict[str, tuple[int, int]], squares: dict[str, tuple[int, int]] | None = None,
         after: int = 0) -> DataFrame:
    """Sums of past demand of a gap-free series as runs of equal days, without laying out the days.

    ``sums`` maps a name to (a, b): the demand of the days from a to b days back (a >= b >= 0); ``squares`` the
    same for squared demand.  Such a sum changes only b and a + 1 days after a day with orders, so a series has a
    few rows for each of those, however long its gaps.  Rows: keys, _lo and _hi (the first and last day with orders),
    day (all three as days since 1970), days (length of the run) and the sums, from _lo to ``after`` days beyond _hi.

    Each sum is taken over the rows of its own frame, so no error builds up along a series.  One exchange by the
    keys serves the bounds, the merge of equal days and the frames.
    """
    keys = _keys(by)
    squares = squares or {}
    if keys:
        daily = daily.repartition(int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    parts = keys or [F.lit(SERIES_ALL)]
    wall = Window.partitionBy(*parts)
    d = daily.select(*keys, F.unix_date("order_date").alias("_d"), F.col("demand").cast("double").alias("_v"))
    d = d.withColumns({"_lo": F.min("_d").over(wall), "_hi": F.max("_d").over(wall)})
    shifts = sorted({0} | {x for a, b in (*sums.values(), *squares.values()) for x in (b, a + 1)})
    d = d.withColumn("_s", F.explode(F.array(*[F.lit(x) for x in shifts])))
    d = d.withColumns({"day": F.col("_d") + F.col("_s"), "_v": F.when(F.col("_s") == 0, F.col("_v")).otherwise(0.0)})
    at = (d.where(F.col("day") <= F.col("_hi") + after).groupBy(*keys, "day")
          .agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_v").alias("_v")))
    w = Window.partitionBy(*parts).orderBy("day")

    def past(value: Column, span: tuple[int, int]) -> Column:
        return F.sum(value).over(w.rangeBetween(-span[0], -span[1]))

    v = F.col("_v")
    cols = {name: F.coalesce(past(v, span), F.lit(0.0)) for name, span in sums.items()}
    cols |= {name: F.coalesce(past(v * v, span), F.lit(0.0)) for name, span in squares.items()}
    cols["days"] = F.coalesce(F.lead("day").over(w), F.col("_hi") + after + 1) - F.col("day")
    return at.withColumns(cols).select(*keys, "_lo", "_hi", "day", "days", *sums, *squares)


def feature_runs(orders: DataFrame, by: list[str] | None = None) -> DataFrame:
    """C5-C8 as runs of days: keys, first_day, days, demand and the rolling and lag features, equal on each day of a run.

    The days are those of ``features``; ``run_days`` lays them out.
    """
    keys = _keys(by)
    longest = max(30, *DEMAND_LAGS)
    sums = {"demand": (0, 0), "_s7": (7, 1), "_s30": (30, 1)} | {f"lag_{n}": (n, n) for n in DEMAND_LAGS}
    r = runs(daily_demand(orders, keys), keys, sums, {"_q7": (7, 1)}).where(F.col("day") >= F.col("_lo") + longest)
    return r.select(
        *keys, F.date_from_unix_date("day").alias("first_day"), "days", "demand",
        (F.col("_s7") / 7).alias("rolling_7d_mean"), (F.col("_s30") / 30).alias("rolling_30d_mean"),
        F.sqrt(F.greatest((F.col("_q7") - F.col("_s7") * F.col("_s7") / 7) / 6, F.lit(0.0))).alias("rolling_7d_std"),
        *[f"lag_{n}" for n in DEMAND_LAGS])


def run_days(feature_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The days of ``feature_runs``, one row each, with their calendar columns: the rows of ``features``."""
    d = feature_rows.withColumn("order_date", F.explode(F.sequence("first_day", F.date_add("first_day", F.col("days") - 1))))
    return calendar(d).select(*_keys(by), "order_date", "demand", *DEMAND_FEATURES)


def weekend_days(first_day: Column, days: Column) -> Column:
    """How many of the ``days`` days from ``first_day`` on are a Saturday or Sunday."""
    def before(day: Column) -> Column:  # weekend days from Monday 1969-12-29 to the day before this one
        n = day + 3
        return F.floor(n / 7) * 2 + F.greatest(F.pmod(n, F.lit(7)) - 5, F.lit(0))

    start = F.unix_date(first_day)
    return (before(start + days) - before(start)).cast("long")


def naive_window_runs(orders: DataFrame, by: list[str] | None = None, train_fraction: float = 0.8, window: int = 7) -> DataFrame:
    """Windows of the test days of C10 with the seasonal-naive prediction, as runs: keys, days, y_true, y_pred.

    A test row of day t has the demand of day t + 1 as its truth and that of a week earlier as its prediction.  The
    ``window`` rows that end at t therefore sum the ``window`` days before t + 2, and the same days a week earlier.
    Series without a full window have no rows here.
    """
    keys = _keys(by)
    skipped = max(30, *DEMAND_LAGS)
    r = runs(daily_demand(orders, keys), keys, {"y_true": (window, 1), "y_pred": (window + 7, 8)}, after=1)
    n = F.col("_hi") - F.col("_lo") - skipped                       # rows that have a target
    first = F.col("_lo") + skipped + F.floor(n * F.lit(train_fraction)) + window + 1
    start = F.greatest(F.col("day"), first)
    return (r.withColumn("days", F.col("day") + F.col("days") - start).where((n > 0) & (F.col("days") > 0))
            .select(*keys, "days", "y_true", "y_pred"))


def tested_series(orders: DataFrame, by: list[str], train_fraction: float = 0.8) -> DataFrame:
    """The keys of the series that have a test row under C10 (one is left over whenever there is a row with a target)."""
    span = orders.where(F.col("order_date").isNotNull()).groupBy(*by).agg(F.min("order_date").alias("_lo"), F.max("order_date").alias("_hi"))
    n = F.datediff("_hi", "_lo") - max(30, *DEMAND_LAGS)
    return span.where((n > 0) & (F.floor(n * F.lit(train_fraction)) < n)).select(*by)


def target(feats: DataFrame, by: list[str] | None = None, horizon: int = 1) -> DataFrame:
    """Demand ``horizon`` rows ahead minus lag_1; rows without a future value dropped."""
    w = _window(by)
    return (feats.withColumn("y_abs", F.lead("demand", horizon).over(w))
            .withColumn("target", F.col("y_abs") - F.col("lag_1"))
            .where(F.col("target").isNotNull()))


def split(df: DataFrame, by: list[str] | None = None, train_fraction: float = 0.8) -> DataFrame:
    """First floor(0.8 n) rows of each series (by date) are train."""
    keys = _keys(by)
    w = _window(by)
    wall = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(SERIES_ALL))
    n = F.count(F.lit(1)).over(wall)
    return (df.withColumn("_rn", F.row_number().over(w))
            .withColumn("is_train", F.col("_rn") <= F.floor(n * F.lit(train_fraction)))
            .drop("_rn"))


def last_days(series: DataFrame, by: list[str] | None = None, n: int = 30) -> DataFrame:
    """The newest ``n`` days of each gap-filled series (a top-n per group)."""
    keys = _keys(by)
    wall = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(SERIES_ALL))
    w = wall.orderBy(F.col("order_date").desc())
    return series.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).drop("_rk")


def naive_forecast(series: DataFrame, by: list[str] | None = None, horizon: int = 7,
                   season: int = 7) -> DataFrame:
    """Seasonal-naive forecast: day T+k repeats the value ``season`` days earlier.

    Deterministic stand-in for the regressor so that downstream jobs can be
    compared exactly; the learned forecast is ``forecast.recursive_forecast``.
    """
    keys = _keys(by)
    last = series.groupBy(*keys).agg(F.max("order_date").alias("_last"))
    steps = last.select(*keys, "_last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    steps = steps.withColumns({
        "order_date": F.date_add("_last", F.col("step")),
        "_src": F.date_add("_last", F.pmod(F.col("step") - 1, F.lit(season)) + 1 - season),
    })
    src = series.select(*keys, F.col("order_date").alias("_src"), F.col("demand").alias("forecast"))
    return (steps.join(src, on=keys + ["_src"], how="left")
            .select(*keys, "step", "order_date", F.coalesce("forecast", F.lit(0.0)).alias("forecast")))


def actual_and_forecast(series: DataFrame, forecast: DataFrame, by: list[str] | None = None,
                        n_actual: int = 30) -> DataFrame:
    """Chart rows — the last actual days, then the forecast days; label ``MM-dd``.

    The first forecast row also carries the last actual value (a ``lag`` over
    the at most n_actual + horizon rows of each series).
    """
    keys = _keys(by)
    actual = last_days(series, keys, n_actual).select(
        *keys, "order_date", F.lit(None).cast("int").alias("step"),
        F.col("demand").alias("actual"), F.lit(None).cast("double").alias("forecast"))
    fc = forecast.select(*keys, "order_date", "step", F.lit(None).cast("double").alias("actual"),
                         "forecast")
    rows = actual.unionByName(fc)
    carried = F.when(F.col("step") == 1, F.lag("actual", 1).over(_window(keys))).otherwise(F.col("actual"))
    return rows.select(*keys, "order_date", F.date_format("order_date", "MM-dd").alias("label"),
                       carried.alias("actual"), "forecast")


def dept_scaled_forecast(dept_series: DataFrame, global_forecast: DataFrame, by: list[str],
                         horizon: int = 7) -> DataFrame:
    """global forecast x mean(last 7 department actuals) / max(mean global forecast, 1), floor 0.

    The reference multiplies by hash-seeded noise as well; that noise is not
    reproducible across runs and is left out.  The global forecast has
    ``horizon`` rows (a parameter), so it is broadcast to the equi-join on step;
    its mean is a window over the ``horizon`` rows of each department.
    """
    last7 = last_days(dept_series, by, 7).groupBy(*by).agg(F.avg("demand").alias("dept_mean"))
    g = global_forecast.select("step", "order_date", "forecast")
    steps = last7.select(*by, "dept_mean",
                         F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    joined = steps.join(F.broadcast(g), on="step")
    gmean = F.avg("forecast").over(Window.partitionBy(*by))
    ratio = F.col("dept_mean") / F.greatest(gmean, F.lit(1.0))
    return joined.select(*by, "step", "order_date",
                         F.greatest(F.col("forecast") * ratio, F.lit(0.0)).alias("forecast"))
