"""Operators 11 and 13 against plain versions."""

import hashlib
import math

import numpy as np
import pytest

from tidewater.llm import pq_links, walsh_clusters as wc

SCHEMA = "vec_id long, embedding array<double>"


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [64 * n // d for n, d in (float(x).as_integer_ratio() for x in v)]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        mine = [[] for _ in cents]
        for _, v in kept:
            mine[near(v)[1]].append(v)
        cents = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(mine, cents)]
    found = [(i, *near(v)) for i, v in kept]
    total = {j: sum(d for _, d, c in found if c == j) for j in range(len(cents))}
    return sorted(((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for i, d, c in found), key=repr)


def clusters(spark, rows, **more):
    out = wc.centroid_clusters(spark.createDataFrame(rows, SCHEMA), **more).collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out), key=repr)


def test_transform_is_exact():
    rng = np.random.default_rng(0)
    v = rng.integers(-(1 << 24), 1 << 24, (20, 64))
    w = wc.walsh(v)
    assert ((w.astype(object) ** 2).sum(axis=1) == 64 * (v.astype(object) ** 2).sum(axis=1)).all()
    changes = (np.diff(wc._signs()[wc.COARSE_TO_FINE], axis=1) != 0).sum(axis=1)
    assert list(changes) == list(range(64))


@pytest.mark.parametrize("spread", [1, 3, 1 << 20])
def test_search_equals_all_distances(spread):
    rng = np.random.default_rng(spread)
    v, c = rng.integers(-spread, spread + 1, (400, 64)), rng.integers(-spread, spread + 1, (16, 64))
    c[9] = c[2]  # a tie
    d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    best, dist = wc.nearest(wc.walsh(v), wc.walsh(c))
    assert (best == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()
    objects = wc.nearest(wc.walsh(v[:50].astype(object)), wc.walsh(c.astype(object)))
    assert (objects[0] == best[:50]).all() and (objects[1] == dist[:50]).all()


def test_clusters_of_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    out = wc.centroid_clusters(df).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out), key=repr) == \
        plain_clusters(rows)


def test_cluster_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(30)]
    rows += [rows[3], rows[3], (7, rng.normal(size=64).tolist()), (None, rng.normal(size=64).tolist()), (50, None), (51, []), (52, [1.0] * 63),
             (53, [None] + [1.0] * 63), (54, [float("nan")] + [0.0] * 63), (55, [float("inf")] * 64), (56, [0.0] * 64), (57, [-0.5 / 64] * 64)]
    assert clusters(spark, rows) == plain_clusters(rows)
    assert clusters(spark, rows[:5]) == plain_clusters(rows[:5])  # fewer vectors than centroids
    assert clusters(spark, [r for r in rows if r[0] == 50]) == []
    wide = rows[:20] + [(60, [1e7] * 64), (61, [-3e7] * 64)]  # beyond the 64-bit search, within 64-bit distances
    assert clusters(spark, wide) == plain_clusters(wide)
    huge = clusters(spark, rows[:20] + [(i, [v] * 64) for i, v in enumerate([1e300, 1.7e308, -1e200], 70)], rounds=1)
    assert len(huge) == 23 and all(r[4] is None or r[4] >= 0 for r in huge)
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS v", "'x' AS cluster", "1 AS distance", "2 AS h")
    assert len(wc.centroid_clusters(clash).collect()) == len(plain_clusters(rows))


def plain_links(rows, least=0.9):
    def unit(v):
        if v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        e = max(abs(x) for x in v)
        w = np.array([x / e for x in v])
        return w / math.sqrt((w * w).sum())
    units = [unit(v) for _, v in rows]
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, (vec, _) in enumerate(rows):
        if vec is not None:
            best[find(i)] = min(best.get(find(i), vec), vec)
    return sorted(((vec, links[i], best.get(find(i)), vec is not None and vec == best.get(find(i))) for i, (vec, _) in enumerate(rows)), key=repr)


def links(spark, rows, schema=SCHEMA, **more):
    out = pq_links.near_vectors(spark.createDataFrame(rows, schema), **more).collect()
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), key=repr)


def near_groups(seed, groups=60, dim=64):
    """Groups whose members lie at cosines just above and below 0.9 of each other, in random directions."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        for target in rng.uniform(0.86, 0.999, rng.integers(1, 8)):
            side = rng.normal(size=dim)
            side -= base * (side @ base)
            side /= np.linalg.norm(side)
            rows.append((len(rows), ((target * base + math.sqrt(1 - target * target) * side) * rng.uniform(0.1, 50)).tolist()))
    return rows


def test_links_equal_all_pairs(spark):
    rows = near_groups(1)
    assert links(spark, rows) == plain_links(rows)


def test_links_of_a_dense_group_across_lists(spark):
    # neighbours closer to the planes between centroids than to any centroid, in few dimensions: many lists meet there
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 3)))]
    assert links(spark, rows) == plain_links(rows)


def test_copies_count_but_pair_once(spark):
    base = near_groups(4, 10)
    rows = base + [(100 + i, base[0][1]) for i in range(40)] + [(200 + i, [2 * x for x in base[0][1]]) for i in range(5)]
    assert links(spark, rows) == plain_links(rows)


def test_link_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (1, v), (None, v), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [None, 1.0, 2.0]), (6, [float("nan"), 1.0, 2.0]),
            (7, [float("inf"), 1.0, 2.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0, 3.0, 0.0]), (10, [1e300, 2e300, 3e300]), (11, [1e-300, 2e-300, 3e-300]),
            (4, [0.0, 0.0, 0.0]), (None, [0.0, -0.0, 5.0]), (12, [0.0, 0.0, 5.0]), (None, None), (None, [-9.0, 1.0, 1.0])]
    assert links(spark, rows) == plain_links(rows)
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS v", "'x' AS number", "1 AS weight", "2 AS _row", "3 AS home")
    assert len(pq_links.near_vectors(clash).collect()) == len(rows)
    assert pq_links.near_vectors(clash.limit(0)).collect() == []
    assert links(spark, [(2, None), (4, [0.0])]) == [(2, 0, 2, True), (4, 0, 4, True)]


def test_blocks_bound_their_members():
    counts = {i: n for i, n in enumerate([10, 5000, 4000, 200, 100_000, 1, 1, 4096])}
    held = {}
    for lst, (first, parts) in pq_links._blocks(counts).items():
        for b in range(first, first + parts):
            held[b] = held.get(b, 0) + counts[lst] / parts
    assert sorted(held) == list(range(len(held))) and max(held.values()) <= 2 * pq_links.BLOCK_ROWS


def test_recall_of_a_smaller_reach():
    rows = near_groups(6, 200)
    x = pq_links.unit_rows(np.array([v for _, v in rows]))
    index = pq_links.train(list(x), 32)
    home, _, _, probed = pq_links.encode(index, x, math.sqrt(0.2) / 2)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert (probed[i, home[j]] | probed[j, home[i]]).all()
    _, _, _, fewer = pq_links.encode(index, x, 0.1)
    assert fewer.sum() < probed.sum() and (fewer[i, home[j]] | fewer[j, home[i]]).mean() >= 0.9
