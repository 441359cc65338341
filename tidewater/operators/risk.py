"""Delay-risk features.

The per-department delay rate is a grouped aggregate joined back (never a
window over the department, which would put a hot department's rows into
one task).  Label codes are ranks among each column's sorted distinct
values: all coded columns are stacked into one (column, value) table, made
distinct (partial aggregation), dealt by range, ranked inside each range with the counts of
the ranges before it, and joined back through a size-checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.constants import RISK_CODED, RISK_FEATURES
from tidewater.functions.exprs import arith_hash, risk_class, shipping_mode_enc
from tidewater.functions.joins import small_side
from tidewater.operators.quantiles import before, bucketed_counts
from tidewater.session import cut_lineage


def delay_columns(orders: DataFrame) -> DataFrame:
    """Gap, class, mode ordinal, month, day of week, days buffer."""
    gap = F.col("actual_days") - F.col("scheduled_days")
    return orders.withColumns({
        "delay_gap": gap,
        "risk_class": risk_class(gap),
        "shipping_mode_enc": shipping_mode_enc("shipping_mode"),
        "order_month": F.month("order_date"),
        "order_dow": F.weekday("order_date"),
        "days_buffer": F.col("scheduled_days") - F.greatest(F.col("actual_days"), F.lit(0)),
    })


def delay_rates(orders: DataFrame, by: str = "department", rates_from: DataFrame | None = None) -> DataFrame:
    """D4 look-up: mean late_risk per group, from ``rates_from`` (default: the same rows)."""
    src = orders if rates_from is None else rates_from
    return src.groupBy(by).agg(F.avg("late_risk").alias("supplier_delay_rate"))


def with_delay_rate(orders: DataFrame, by: str = "department",
                    rates_from: DataFrame | None = None) -> DataFrame:
    """Join the group's delay rate back onto each row (left join)."""
    rates = small_side(delay_rates(orders, by, rates_from))
    return orders.join(rates, on=by, how="left")


def label_code_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """D6 look-up: (column, value, code) with code = rank of value among sorted distinct values."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("kv")).select("kv.col_name", "kv.value")
    distinct = bucketed_counts(stacked.where(F.col("value").isNotNull()), ["col_name"], "value", [F.max(F.lit(1)).alias("_n")])
    # of distinct values, the rank is the number of smaller ones
    return before(distinct, ["col_name"], "value", "_n", "code").select("col_name", "value", F.col("code").cast("int").alias("code"))


def with_label_codes(df: DataFrame, coded: dict[str, str] = RISK_CODED, codes_from: DataFrame | None = None,
                     codes: DataFrame | None = None) -> DataFrame:
    """Add ``<enc>`` = code of ``coded[enc]``; null or unknown value -> -1, absent source column -> 0.

    Codes are ranks among the values of ``codes_from`` (default: the same rows), or come from a
    stored table ``codes`` of ``label_code_table``.
    """
    present = {enc: src for enc, src in coded.items() if src in df.columns}
    out = df
    for enc, src in coded.items():
        if enc not in present:
            out = out.withColumn(enc, F.lit(0))   # absent source column -> constant 0
    if not present:
        return out
    if codes is None:
        codes = label_code_table(df if codes_from is None else codes_from, sorted(set(present.values())))
    codes = small_side(codes)
    for enc, src in present.items():
        look = codes.where(F.col("col_name") == src).select(
            F.col("value").alias(f"_v_{enc}"), F.col("code").alias(enc))
        out = (out.join(look, out[src].cast("string") == look[f"_v_{enc}"], "left")
               .drop(f"_v_{enc}")
               .withColumn(enc, F.coalesce(F.col(enc), F.lit(-1))))
    return out


def features(orders: DataFrame, rates_from: DataFrame | None = None) -> DataFrame:
    """The 13 model features plus ``risk_class``; rows with a null feature dropped."""
    df = delay_columns(orders)
    df = with_delay_rate(df, "department", rates_from)
    df = with_label_codes(df)
    return df.select(*RISK_FEATURES, "risk_class").dropna()


def stratified_split(df: DataFrame, key_cols: list[str], label: str = "risk_class",
                     test_buckets: int = 2, buckets: int = 10, seed: int = 42) -> DataFrame:
    """Deterministic 80/20 split by a hash of the row keys, drawn within each class.

    Each class is split by the same hash rule, so every class keeps its share
    in expectation; no window, sort or per-class count is needed, which keeps
    the split a map-only step at any scale.
    """
    h = arith_hash(*key_cols, F.col(label), seed=seed)
    return df.withColumn("is_test", F.pmod(h, F.lit(buckets)) < test_buckets)


def exact_stratified_split(df: DataFrame, key_cols: list[str], label: str = "risk_class", share: float = 0.2, seed: int = 42) -> DataFrame:
    """Of the n rows of each class exactly floor(``share`` n + 1/2) are test rows, those with the least hash of the keys.

    A class's cut is found from counts by hash, ranked over ranges; only rows equal to the
    cut in hash and all columns are numbered, within their partitions, so a repeated row that holds a third of a class is
    still dealt over tasks.  Rows without a class stay in training; a null key hashes to 0.
    """
    h = F.coalesce(arith_hash(*key_cols, F.col(label), seed=seed), F.lit(0))
    d = cut_lineage(df.withColumns({"_v": F.struct(h.alias("h"), F.xxhash64(*df.columns).alias("all")), "_id": F.monotonically_increasing_id()}))
    counts = bucketed_counts(d.where(F.col(label).isNotNull()), [label], "_v", [F.count(F.lit(1)).alias("_n")])
    quota = counts.groupBy(label).agg(F.floor(F.sum("_n") * share + 0.5).alias("_quota"))
    ranked = before(counts, [label], "_v", "_n", "_below").join(F.broadcast(quota), label)  # a row a class
    cut = cut_lineage(ranked.where((F.col("_below") < F.col("_quota")) & (F.col("_below") + F.col("_n") >= F.col("_quota")))
                      .select(label, F.col("_v").alias("_cut"), (F.col("_quota") - F.col("_below")).alias("_take")))
    near = d.join(F.broadcast(cut), label, "left").withColumn("_part", F.shiftright("_id", 33))
    tie = F.coalesce(F.col("_v") == F.col("_cut"), F.lit(False))
    ahead = Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = near.where(tie).groupBy(label, "_part").agg(F.count(F.lit(1)).alias("_here")).select(
        label, "_part", F.coalesce(F.sum("_here").over(ahead), F.lit(0)).alias("_ahead"))  # a row a class and partition
    nth = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_id"))
    tied = near.where(tie).withColumn("_nth", nth).join(small_side(offsets), [label, "_part"])
    out = [*df.columns]
    return near.where(~tie).select(*out, F.coalesce(F.col("_v") < F.col("_cut"), F.lit(False)).alias("is_test")).unionByName(
        tied.select(*out, (F.col("_ahead") + F.col("_nth") <= F.col("_take")).alias("is_test")))


def class_shares(counts: DataFrame, by: str = "shipping_mode", label: str = "risk_class", n_classes: int = 3) -> DataFrame:
    """Share of each class per group (4 decimals) from rows of (by, label, n)."""
    total = F.sum("n")
    shares = counts.groupBy(by).agg(
        total.alias("_n"), *[F.coalesce(F.sum(F.when(F.col(label) == k, F.col("n"))), F.lit(0)).alias(f"_{k}")
                             for k in range(n_classes)])
    return shares.where(F.col("_n") > 0).select(
        by, *[F.round(F.col(f"_{k}") / F.col("_n"), 4).alias(f"p_{k}") for k in range(n_classes)])


def prior_classifier(train: DataFrame, test: DataFrame, by: str = "shipping_mode",
                     label: str = "risk_class", n_classes: int = 3) -> DataFrame:
    """Deterministic baseline: class shares of ``by``'s group in ``train`` (4 decimals) as scores."""
    counts = train.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    return classify_by_shares(class_shares(counts, by, label, n_classes), test, by, n_classes)


def classify_by_shares(shares: DataFrame, test: DataFrame, by: str = "shipping_mode", n_classes: int = 3) -> DataFrame:
    """Prediction is the highest share, ties to the lowest class; a group without shares
    scores 0 everywhere and predicts class 0."""
    scored = test.join(small_side(shares), on=by, how="left").fillna(
        0.0, subset=[f"p_{k}" for k in range(n_classes)])
    pred = F.lit(n_classes - 1)
    for k in reversed(range(n_classes - 1)):
        best = F.lit(True)
        for j in range(k + 1, n_classes):
            best = best & (F.col(f"p_{k}") >= F.col(f"p_{j}"))
        # k wins when it is at least every later class and beats every earlier one
        earlier = F.lit(True)
        for j in range(k):
            earlier = earlier & (F.col(f"p_{k}") > F.col(f"p_{j}"))
        pred = F.when(best & earlier, F.lit(k)).otherwise(pred)
    return scored.withColumn("prediction", pred.cast("int"))
