"""Isolation forest (F7, F8) on Spark: sampled trees, bounded node table, vectorised scoring.

MLlib has no isolation forest.  Following Liu, Ting and Zhou (2008):

* **Sampling.**  Each of T trees sees at most psi rows drawn without
  replacement (see ``sample_for_trees``); no tree ever sees more than psi
  rows, whatever N is, and no step handles more than ~1.3 psi T^2 candidate
  pairs.
* **Building.**  ``groupBy('tree').applyInPandas`` grows each tree to height
  ceil(log2 psi) from its psi rows: random feature, random split between the
  feature's min and max.  The node table has at most T x (2 psi - 1) rows —
  a bound fixed by the parameters — so it is broadcast for scoring.
* **Scoring.**  ``mapInPandas`` walks all trees for each batch of rows with
  numpy; path length = depth + c(leaf size).  Anomaly value
  s = 2^(-E h / c(psi)); the reference's score is -s minus an offset, the
  offset being the contamination percentile of the training scores.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewater.functions.constants import IFOREST_CONTAMINATION, IFOREST_MAX_SAMPLES, IFOREST_TREES
from tidewater.operators.quantiles import quantiles
from tidewater.session import cut_lineage

# The tree builder and the scorer run in Python workers; ship this module's code with them
# (by value) so that workers need numpy and pandas but not this package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except (ImportError, AttributeError, ValueError):       # older cloudpickle: ship the package instead
    pass

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left_child int, right_child int, "
               "size long, depth int")
EULER = 0.5772156649015329


def c_factor(n):
    """Average path length of an unsuccessful search in a binary search tree of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Grow one isolation tree; returns rows (node, feature, threshold, left, right, size, depth)."""
    nodes = []
    stack = [(np.arange(len(x)), 0, 0)]          # (row indices, depth, node id)
    next_id = 1
    while stack:
        idx, depth, nid = stack.pop()
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes.append((nid, -1, 0.0, -1, -1, len(idx), depth))
            continue
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        spread = np.flatnonzero(hi > lo)
        if spread.size == 0:                          # all rows identical: a leaf
            nodes.append((nid, -1, 0.0, -1, -1, len(idx), depth))
            continue
        f = int(rng.choice(spread))
        t = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < t]
        right = idx[sub[:, f] >= t]
        lid, rid = next_id, next_id + 1
        next_id += 2
        nodes.append((nid, f, t, lid, rid, len(idx), depth))
        stack.append((right, depth + 1, rid))
        stack.append((left, depth + 1, lid))
    return nodes


def sample_for_trees(df: DataFrame, n_trees: int, psi: int, seed: int) -> tuple[DataFrame, int, int]:
    """(tree, row) pairs with at most ``psi`` rows per tree; returns the pairs, N and the used psi.

    One rule for every N: a row is a candidate of a tree when the hash of (row, tree, seed) lies in the
    lowest share (psi + 6 sqrt(psi)) / N of its range (all of it when that exceeds 1), and each tree keeps
    its ``psi`` candidates of least hash.  Rows that are equal in all columns share their hashes.
    """
    n = df.count()
    share = min(1.0, (psi + 6 * math.sqrt(psi)) / max(n, 1))
    limit = int(share * (2 ** 63 - 1025)) if share < 1 else 2 ** 63 - 1
    at = lambda t: F.shiftrightunsigned(F.xxhash64(*df.columns, t, F.lit(seed)), 1)
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: at(t) <= F.lit(limit))
    s = df.withColumn("tree", F.explode(trees)).withColumn("_u", at(F.col("tree")))
    w = Window.partitionBy("tree").orderBy("_u", *df.columns)
    return s.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= psi).drop("_rk", "_u"), n, min(psi, n)


def fit(df: DataFrame, features: list[str], n_trees: int = IFOREST_TREES, psi: int = IFOREST_MAX_SAMPLES,
        seed: int = 42) -> tuple[DataFrame, int]:
    """grow ``n_trees`` trees; returns the node table (checkpointed) and the sample size used."""
    pairs, _, psi_used = sample_for_trees(df, n_trees, psi, seed)
    max_depth = int(math.ceil(math.log2(max(psi_used, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = pdf[features].to_numpy(dtype=float)
        rows = _grow(x, rng, max_depth)
        out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left_child", "right_child", "size",
                                          "depth"])
        out.insert(0, "tree", tree)
        return out

    nodes = pairs.groupBy("tree").applyInPandas(build, NODE_SCHEMA)
    return cut_lineage(nodes), psi_used


def _tables(nodes_pdf: pd.DataFrame, n_trees: int):
    width = int(nodes_pdf["node"].max()) + 1
    shape = (n_trees, width)
    feat = np.full(shape, -1, dtype=np.int64)
    thr = np.zeros(shape)
    left = np.full(shape, -1, dtype=np.int64)
    right = np.full(shape, -1, dtype=np.int64)
    size = np.zeros(shape)
    depth = np.zeros(shape)
    t, nd = nodes_pdf["tree"].to_numpy(), nodes_pdf["node"].to_numpy()
    feat[t, nd] = nodes_pdf["feature"].to_numpy()
    thr[t, nd] = nodes_pdf["threshold"].to_numpy()
    left[t, nd] = nodes_pdf["left_child"].to_numpy()
    right[t, nd] = nodes_pdf["right_child"].to_numpy()
    size[t, nd] = nodes_pdf["size"].to_numpy()
    depth[t, nd] = nodes_pdf["depth"].to_numpy()
    return feat, thr, left, right, size, depth


def score(df: DataFrame, nodes: DataFrame, features: list[str], psi_used: int, n_trees: int = IFOREST_TREES,
          contamination: float = IFOREST_CONTAMINATION, offset: float | None = None) -> tuple[DataFrame, float]:
    """F8: ``anomaly_score`` = -s - offset and ``is_anomaly`` = score < 0 for every row.

    The node table (at most T x (2 psi - 1) rows) is collected once and
    shipped to the tasks with the function closure.
    """
    nodes_pdf = nodes.toPandas()
    feat, thr, left, right, size, depth = _tables(nodes_pdf, n_trees)
    cpsi = float(c_factor([psi_used])[0]) or 1.0

    def walk(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            total = np.zeros(len(pdf))
            rows = np.arange(len(pdf))
            for t in range(n_trees):
                cur = np.zeros(len(pdf), dtype=np.int64)
                while True:
                    f = feat[t, cur]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go_left = np.zeros(len(pdf), dtype=bool)
                    go_left[inner] = x[rows[inner], f[inner]] < thr[t, cur[inner]]
                    nxt = np.where(go_left, left[t, cur], right[t, cur])
                    cur = np.where(inner, nxt, cur)
                total += depth[t, cur] + c_factor(size[t, cur])
            s = np.power(2.0, -(total / n_trees) / cpsi)
            out = pdf.copy()
            out["raw_score"] = -s
            yield out

    schema = StructType(list(df.schema.fields) + [StructField("raw_score", DoubleType())])
    scored = cut_lineage(df.mapInPandas(walk, schema))   # all trees are walked once
    if offset is None:
        cut = quantiles(scored.select(F.lit("all").alias("k"), "raw_score"), "k", "raw_score", [contamination]).first()
        offset = float(cut["q"][0]) if cut else 0.0
    out = scored.withColumn("anomaly_score", F.col("raw_score") - F.lit(offset)) \
        .withColumn("is_anomaly", F.col("anomaly_score") < 0).drop("raw_score")
    return out, offset
