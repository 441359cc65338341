"""Fitted-Q sweeps over one series' transition counts, in whole millionths (the task side of H5).

The counts of a series are bounded by the bins of states and actions.  A sweep recomputes only the pairs with a
next state whose worth has changed.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# workers need numpy and pandas, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT = 1_000_000
SAFE = 2 ** 62


def solve(state, action, following, n, r, gamma: float, limit: int, sweeps: int | None) -> tuple:
    """(state, action, value in millionths) of every pair seen, the last largest move, and the number of sweeps.

    ``r`` is the reward sum in thousandths.  A pair's value is the mean over its transitions of reward + gamma x
    the best value of the next state (0 if never seen), rounded half up.
    """
    pairs, pair = np.unique(np.stack([state, action], axis=1), axis=0, return_inverse=True)
    order = np.argsort(pair.reshape(-1), kind="stable")
    pair = pair.reshape(-1)[order]
    states, home = np.unique(pairs[:, 0], return_inverse=True)
    at = np.searchsorted(states, following[order])
    known = (at < len(states)) & (states[np.minimum(at, len(states) - 1)] == following[order])
    at = np.where(known, at, len(states))                       # unseen states share the last place, worth 0
    weight = n[order].astype(object)                            # Python integers: exact at any count
    reward = r[order].astype(object) * 1000
    if int(weight.sum()) * max(1, int(max(abs(reward).max(), 1) / (1 - gamma))) * 2 < SAFE:
        weight, reward = weight.astype(np.int64), reward.astype(np.int64)
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    total_n = np.add.reduceat(weight, starts).astype(float)
    heads = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])  # pairs are in order of state
    value = np.zeros(len(pairs), dtype=np.int64)
    worth = np.zeros(len(states) + 1, dtype=np.int64)
    todo = np.ones(len(pairs), dtype=bool)
    done, move = 0, 0
    while sweeps is None or done < sweeps:
        rows = todo[pair]
        gain = reward[rows] + weight[rows] * worth[at[rows]]
        p = pair[rows]
        cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        fresh = np.floor(np.add.reduceat(gain, cut).astype(float) / total_n[todo] + 0.5).astype(np.int64)
        move = int(np.abs(fresh - value[todo]).max())
        value[todo] = fresh
        done += 1
        best = np.floor(np.maximum.reduceat(value, heads) * gamma + 0.5).astype(np.int64)
        changed = np.r_[best != worth[:-1], False]
        worth[:-1] = best
        todo = np.zeros(len(pairs), dtype=bool)
        todo[pair[changed[at]]] = True
        if not todo.any():
            move = 0
        # doubles cannot tell apart smaller moves of very large values
        if move <= max(limit, int(np.abs(value).max()) >> 48) or not todo.any():
            break
    return pairs[:, 0], pairs[:, 1], value, move, done


def solve_frame(pdf: pd.DataFrame, n_keys: int, gamma: float, limit: int, sweeps: int | None) -> pd.DataFrame:
    keys = list(pdf.columns[:n_keys])
    cols = [pdf[c].to_numpy() for c in ("state", "action_id", "next_state", "n", "r")]
    state, action, value, move, done = solve(*cols, gamma, limit, sweeps)
    out = pd.DataFrame({"state": state.astype(np.int32), "action_id": action.astype(np.int32), "q": value / float(UNIT)})
    out["residual"], out["sweeps"] = move, np.int32(done)
    for i, k in enumerate(keys):
        out.insert(i, k, pdf[k].iloc[0])
    return out
