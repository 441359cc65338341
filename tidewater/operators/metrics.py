"""Quality metrics (G1-G5) as aggregates.

Forecast metrics work per series in one grouped job.  Classification
metrics are built from the confusion counts; AUC is the rank-sum statistic
computed from (class, score) counts of the exact scores, ranked range by
range (``quantiles``), so no class meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.quantiles import before, bucketed_counts

N_CLASSES = 3


def _metric_columns(g: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics of a group from its sums over windows (n, _mse, _mae, _ssres, _sstot, _sad, _say)."""
    has = F.col("n") > 0
    r2 = (F.when(F.col("_sstot") == 0, F.when(F.col("_ssres") == 0, 1.0).otherwise(0.0))
          .otherwise(1 - F.col("_ssres") / F.col("_sstot")))
    wape = F.when(F.col("_say") != 0, F.col("_sad") / F.col("_say") * 100).otherwise(0.0)
    return g.select(
        *keys,
        F.when(has, F.sqrt("_mse")).otherwise(0.0).alias("rmse"),
        F.when(has, F.col("_mae")).otherwise(0.0).alias("mae"),
        F.when(has, F.greatest(r2, F.lit(0.0))).otherwise(0.0).alias("r2"),
        F.when(has, F.least(wape, F.lit(100.0))).otherwise(0.0).alias("wape"),
        F.col("n").alias("n_windows"),
    )


def forecast_metrics(pred: DataFrame, by: list[str] | None = None, window: int = 7) -> DataFrame:
    """RMSE, MAE, R² (floor 0), WAPE % (cap 100) on ``window``-day rolling sums.

    ``pred`` holds the test rows of each series: keys, order_date, y_true, y_pred.
    A series with fewer than ``window`` test rows reports zeros.
    """
    keys = list(by) if by else []
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("order_date")
    fr = w.rowsBetween(-(window - 1), 0)
    full = F.row_number().over(w) >= window     # the frame holds `window` rows
    r = pred.select(*keys, full.alias("_full"),
                    F.sum("y_true").over(fr).alias("_yt"), F.sum("y_pred").over(fr).alias("_yp"))
    d = F.col("_yt") - F.col("_yp")
    on = F.col("_full")
    g = r.groupBy(*keys).agg(
        F.count_if(on).alias("n"),
        F.avg(F.when(on, d * d)).alias("_mse"),
        F.avg(F.when(on, F.abs(d))).alias("_mae"),
        F.sum(F.when(on, d * d)).alias("_ssres"),
        (F.var_pop(F.when(on, F.col("_yt"))) * F.count_if(on)).alias("_sstot"),
        F.sum(F.when(on, F.abs(d))).alias("_sad"),
        F.sum(F.when(on, F.abs(F.col("_yt")))).alias("_say"),
    )
    return _metric_columns(g, keys)


def forecast_metrics_of_runs(windows: DataFrame, series: DataFrame, by: list[str]) -> DataFrame:
    """G1/G2 from window sums given as runs of ``days`` equal windows (keys, days, y_true, y_pred).

    ``series`` has one row for each series that must appear; one without a window reports zeros.
    """
    keys = list(by)
    yt, k = F.col("y_true"), F.col("days")
    d = yt - F.col("y_pred")
    wall = Window.partitionBy(*keys)
    mean = F.sum(yt * k).over(wall) / F.sum(k).over(wall)
    # equal sums have no spread, whatever the mean rounds to
    apart = F.when(F.max(yt).over(wall) > F.min(yt).over(wall), (yt - mean) * (yt - mean)).otherwise(0.0)
    g = windows.withColumn("_sp", apart * k).groupBy(*keys).agg(
        F.sum(k).alias("n"), F.sum(d * d * k).alias("_ssres"), F.sum("_sp").alias("_sstot"),
        F.sum(F.abs(d) * k).alias("_sad"), F.sum(F.abs(yt) * k).alias("_say"))
    g = g.withColumns({"_mse": F.col("_ssres") / F.col("n"), "_mae": F.col("_sad") / F.col("n")})
    g = series.select(*keys).join(g, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return _metric_columns(g, keys)


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                     n_classes: int = N_CLASSES) -> DataFrame:
    """One row per true class, one count column per predicted class (zeros filled)."""
    counts = scored.groupBy(label, prediction).count()
    wide = counts.groupBy(label).pivot(prediction, list(range(n_classes))).sum("count")
    classes = scored.sparkSession.range(n_classes).select(F.col("id").cast("int").alias(label))
    out = classes.join(wide, on=label, how="left")
    return out.select(F.col(label).alias("true_class"),
                      *[F.coalesce(F.col(str(k)), F.lit(0)).cast("long").alias(f"pred_{k}")
                        for k in range(n_classes)])


def classification_report(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                          n_classes: int = N_CLASSES) -> DataFrame:
    """Accuracy and macro precision/recall/F1 over the classes seen; undefined ratios -> 0."""
    pairs = scored.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))   # at most classes x classes rows
    per = pairs.select(F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("k"), label, prediction, "n")
    is_true, is_pred = F.col(label) == F.col("k"), F.col(prediction) == F.col("k")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    c = per.groupBy("k").agg(total(is_true & is_pred).alias("tp"), total(is_pred).alias("npred"),
                             total(is_true).alias("ntrue")).where((F.col("npred") > 0) | (F.col("ntrue") > 0))
    p = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    r = F.when(F.col("ntrue") > 0, F.col("tp") / F.col("ntrue")).otherwise(0.0)
    c = c.select("tp", "ntrue", p.alias("p"), r.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))
                ).otherwise(0.0)
    return c.agg(
        (F.sum("tp") / F.sum("ntrue")).alias("accuracy"),
        F.avg("p").alias("precision"),
        F.avg("r").alias("recall"),
        F.avg(f1).alias("f1"),
    )


def auc_ovr(scored: DataFrame, label: str = "label", prob_cols: list[str] | None = None) -> DataFrame:
    """One-vs-rest ROC AUC per class (ties count half) and the macro mean.

    AUC_k = sum over distinct scores s of pos(s) * (neg(< s) + neg(s) / 2) / (P * N).
    """
    prob_cols = prob_cols or [f"p_{k}" for k in range(N_CLASSES)]
    stacked = scored.select(label, F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("score"))
        for k, c in enumerate(prob_cols)])).alias("s")).select(label, "s.k", "s.score")
    cnt = bucketed_counts(stacked, ["k"], "score", [F.count_if(F.col(label) == F.col("k")).alias("pos"),
                                                    F.count_if(F.col(label) != F.col("k")).alias("neg")])
    cnt = before(cnt, ["k"], "score", "neg", "neg_below")
    per = cnt.groupBy("k").agg(
        (F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
         / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    return per


def macro_auc(per_class: DataFrame) -> DataFrame:
    return per_class.agg(F.avg("auc").alias("auc_macro"))
