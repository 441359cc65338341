"""Isolation forest: planted outliers are found; the flagged share follows the contamination."""

import numpy as np

from tidewater.operators import iforest as IF


def test_planted_outliers_are_flagged(spark):
    rng = np.random.default_rng(0)
    normal = rng.normal(0.0, 1.0, size=(400, 2))
    outliers = np.array([[8.0, 8.0], [-9.0, 7.5], [10.0, -8.0], [-8.5, -9.0]])
    pts = np.vstack([normal, outliers])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, a double, b double")
    nodes, psi = IF.fit(df, ["a", "b"], n_trees=100, psi=256, seed=1)
    assert psi == 256
    n_nodes = nodes.count()
    assert n_nodes <= 100 * (2 * 256 - 1)                       # bounded by the parameters
    scored, offset = IF.score(df, nodes, ["a", "b"], psi, n_trees=100, contamination=0.01)
    flagged = {r.id for r in scored.where("is_anomaly").collect()}
    assert {400, 401, 402, 403} <= flagged
    assert len(flagged) <= 0.02 * len(pts) + 1


def test_small_table_uses_all_rows_per_tree(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "id int, x double")
    pairs, n, psi = IF.sample_for_trees(df, 5, 256, 42)
    assert n == 20 and psi == 20 and pairs.count() == 100
