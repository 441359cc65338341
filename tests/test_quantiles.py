"""Exact quantiles and AUC against numpy."""

import numpy as np
from pyspark.sql import functions as F

from tidewater.operators import metrics as M
from tidewater.operators import risk as R
from tidewater.operators.quantiles import bucketed_counts, quantiles


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    cols = {"a": rng.normal(size=501), "b": rng.integers(0, 3, 400).astype(float), "c": np.array([7.0]),
            "d": np.concatenate([np.full(300, 1.0), [1e9]])}
    rows = [(k, float(x)) for k, v in cols.items() for x in v] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r.q for r in quantiles(df, "k", "x", [0.25, 0.5, 0.75]).collect()}
    for k, v in cols.items():
        assert np.allclose(got[k], np.quantile(v, [0.25, 0.5, 0.75]), rtol=1e-12)


def test_auc_uses_exact_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(int(y), *(float(0.5 + 1e-7 * rng.normal() + 1e-7 * (y == k)) for k in range(3))) for y in rng.integers(0, 3, 300)]
    df = spark.createDataFrame(rows, "label int, p_0 double, p_1 double, p_2 double")
    got = {r.k: r.auc for r in M.auc_ovr(df).collect()}
    for k in range(3):
        pos, neg = [r[k + 1] for r in rows if r[0] == k], [r[k + 1] for r in rows if r[0] != k]
        assert abs(got[k] - np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])) < 1e-12


def test_heavy_tail_does_not_fill_one_range(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=20_000), np.exp(rng.uniform(0, 80, 50)), [1e300]])
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, x double")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # small ranges would be put together
    spark.conf.set(coalesce, "false")
    try:
        d = bucketed_counts(df, ["k"], "x", [F.count(F.lit(1)).alias("_n")])
        sizes = [r["count"] for r in d.groupBy("_b").count().collect()]
    finally:
        spark.conf.unset(coalesce)
    assert len(sizes) == 8 and max(sizes) < 3 * len(x) / len(sizes)
    probs = [0.0, 0.03, 0.5, 0.999, 1.0]
    got = quantiles(df, "k", "x", probs).first().q
    assert np.allclose(got, np.quantile(x, probs), rtol=1e-12)


def test_codes_are_ranks_over_ranges(spark):
    df = spark.range(5000).selectExpr("CAST(pmod(id * 7919, 1700) AS STRING) AS a", "IF(id % 9 = 0, NULL, 'v' || id % 3) AS b")
    got = {(r.col_name, r.value): r.code for r in R.label_code_table(df, ["a", "b"]).collect()}
    want = {("a", v): i for i, v in enumerate(sorted({str(i) for i in range(1700)}))} | {("b", f"v{i}"): i for i in range(3)}
    assert got == want
