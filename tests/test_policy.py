"""Reorder policy: bins, reward parts, fitted Q and the read-outs."""


from tidewater.functions.constants import INV_BINS
from tidewater.functions.exprs import bin_index
from tidewater.operators import policy as P


def test_bins_left_closed_and_clamped(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (99.9,), (100.0,), (1999.0,), (2000.0,), (9e9,)], "x double")
    got = [r[0] for r in df.select(bin_index("x", INV_BINS)).collect()]
    assert got == [0, 0, 0, 1, 4, 5, 5]


def test_reward_parts_sum_to_total(spark):
    df = spark.createDataFrame([(100.0, 200.0, 0), (950.0, 0.0, 3), (500.0, 100.0, 4), (10.0, 5.0, 5)],
                               "inventory double, demand double, anomaly int")
    out = P.reward_breakdown(P.with_actions(df)).collect()
    for r in out:
        parts = sum(r[c] or 0.0 for c in P.COMPONENTS)
        assert abs(round(parts, 3) - r.total) < 1e-9
    hold_short = [r for r in out if r.inventory == 100.0 and r.action_id == 0][0]
    assert hold_short.holding_cost == 5.0 and hold_short.stockout_penalty == -50.0   # shortfall: positive holding
    assert hold_short.total == -45.0 and hold_short.projected_inventory == 0.0
    large = [r for r in out if r.inventory == 950.0 and r.action_id == 3][0]
    assert large.overcapacity_penalty == -20.0 and large.action_cost == -2.0
    switch = [r for r in out if r.inventory == 10.0 and r.action_id == 5][0]
    assert switch.anomaly_mitigation == 10.0


def test_best_action_ties_and_confidence(spark):
    q = spark.createDataFrame([(7, 0, 0.0), (7, 5, 0.0), (7, 2, -1.0)], "state int, action_id int, q double")
    states = spark.createDataFrame([(7,), (9,)], "state int")
    b = {r.state: r for r in P.best_action(P.q_full(q, states)).collect()}
    assert b[7].action_id == 0                      # tie between HOLD and SWITCH -> lowest id
    assert b[9].action_id == 0 and abs(b[9].confidence - 1 / 6) < 1e-12   # unseen state: all zero


def test_fitted_q_one_sweep_is_mean_reward(spark):
    t = spark.createDataFrame([(1, 0, 2000, 3), (1, 0, 4000, 3), (1, 1, -1000, 1)],   # thousandths
                              "state int, action_id int, reward long, next_state int")
    q1 = {(r.state, r.action_id): r.q for r in P.fit_q(t, 1).collect()}
    assert q1[(1, 0)] == 3.0 and q1[(1, 1)] == -1.0
    q2 = {(r.state, r.action_id): r.q for r in P.fit_q(t, 2).collect()}
    assert abs(q2[(1, 1)] - (-1.0 + 0.95 * 3.0)) < 1e-12      # next state 1 has V = 3
    assert q2[(1, 0)] == 3.0                                   # next state 3 unseen -> V = 0


def _plain_sweeps(rows, gamma, limit, sweeps=None):
    """Every pair in every sweep, in Python integers; rows of (state, action, reward in thousandths, next state)."""
    import math
    from collections import defaultdict
    by_pair = defaultdict(list)
    for s, a, r, t in rows:
        by_pair[s, a].append((r, t))
    value, k = dict.fromkeys(by_pair, 0), 0
    worth = {}
    while True:
        new = {p: math.floor(float(sum(r * 1000 + worth.get(t, 0) for r, t in steps)) / float(len(steps)) + 0.5)
               for p, steps in by_pair.items()}
        move = max(abs(new[p] - value[p]) for p in new)
        value, k = new, k + 1
        if move <= limit or k == sweeps:
            return value, move, k
        worth = {s: math.floor(max(v for (x, _), v in value.items() if x == s) * gamma + 0.5) for s, _ in value}


def test_converged_values_equal_plain_sweeps(spark):
    import random
    from tidewater.operators import policy as P
    rng = random.Random(11)
    rows = [(g, rng.randrange(12), rng.randrange(6), rng.randrange(-60_000, 90_000), rng.randrange(14))
            for g in ("a", "b", None) for _ in range(300)]
    rows += [("lone", 3, 0, 5_000, 3)] * 4
    tr = spark.createDataFrame(rows, "grp string, state int, action_id int, reward long, next_state int")
    limit = P.residual_limit()
    got = P.fit_q_converged(tr, ["grp"]).collect()
    for g in ("a", "b", None, "lone"):
        want, move, k = _plain_sweeps([r[1:] for r in rows if r[0] == g], P.GAMMA, limit)
        mine = {(r.state, r.action_id): r for r in got if r.grp == g}
        assert {p: v / 1e6 for p, v in want.items()} == {p: r.q for p, r in mine.items()}
        assert all(r.residual <= limit for r in mine.values())
    lone = next(r for r in got if r.grp == "lone")
    assert abs(lone.q - 5 / (1 - P.GAMMA)) <= (P.GAMMA * lone.residual + 2) / (1 - P.GAMMA) / 1e6   # the stated bound
    pooled = {(r.state, r.action_id): r.q for r in P.fit_q_converged(tr.where("grp = 'a'"), sweeps=20).collect()}
    assert pooled == {(r.state, r.action_id): r.q for r in P.fit_q(tr.where("grp = 'a'"), 20).collect()}
    assert P.fit_q_converged(tr.limit(0), ["grp"]).collect() == []


def test_sweeps_are_exact_beyond_64_bit_sums():
    import numpy as np
    from tidewater.operators import qsweeps
    state, action, following = np.array([1, 1, 2, 2]), np.array([0, 0, 0, 1]), np.array([1, 2, 1, 9])
    n, r = np.array([3, 1, 2, 5]), np.array([9_000, -4_000, 7_000, 1_000])
    small = qsweeps.solve(state, action, following, n, r, 0.95, 40, None)
    large = qsweeps.solve(state, action, following, n * 10 ** 14, r * 10 ** 14, 0.95, 40, None)
    assert small[2].tolist() == large[2].tolist() and small[3:] == large[3:]
