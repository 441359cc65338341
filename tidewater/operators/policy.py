"""Reorder policy: states, one-step rewards, fitted action values and their read-outs.

A state is (inventory bin, demand bin, risk bin, anomaly, days bin), encoded
as one integer ``state`` in [0, 1440).  The action-value table therefore has
at most 1440 x 6 = 8640 rows, a bound fixed by the bins, and is broadcast.

Fitted Q iteration (H5) replaces the reference's random-episode simulator:
transitions come from observed rows (each state row x each of the six actions,
by ``explode`` of a literal array, no join) and are reduced map-side to counts
and reward sums per (state, action, next state), a table bounded by the bins.
Every sweep reads only that table.  Rewards are whole thousandths and values
whole millionths, so sums are exact and no result depends on their order.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.constants import (ACTIONS, ANOMALY_MITIGATION, DAY_BINS, DEMAND_BINS,
                                           EMERGENCY_ACTION_COST, FULFILMENT_PER_UNIT, GAMMA,
                                           HOLDING_COST_PER_UNIT, INV_BINS, OVERCAPACITY_LIMIT,
                                           OVERCAPACITY_PENALTY, REORDER_QTY, RISK_BINS,
                                           STANDARD_ACTION_COST, STOCKOUT_PENALTY)
from tidewater.functions.exprs import bin_index, round_half_up
from tidewater.functions.joins import small_side
from tidewater.operators import qsweeps
from tidewater.session import cut_lineage

N_STATES = len(INV_BINS) * len(DEMAND_BINS) * len(RISK_BINS) * 2 * len(DAY_BINS)
# Action values are whole multiples of 10^-6 (ties: lowest action id wins).
Q_DIGITS = 6
Q_SCALE = 10 ** Q_DIGITS
COMPONENTS = ["holding_cost", "stockout_penalty", "demand_fulfillment", "overcapacity_penalty",
              "action_cost", "anomaly_mitigation"]


# ------------------------------------------------------------------ H1 state
def state_bins(inv="inventory", demand="demand", risk="risk", anomaly="anomaly", days="days") -> dict:
    return {
        "inv_b": bin_index(inv, INV_BINS),
        "dem_b": bin_index(demand, DEMAND_BINS),
        "risk_b": bin_index(risk, RISK_BINS),
        "anom_b": F.when(F.coalesce(F.col(anomaly) if isinstance(anomaly, str) else anomaly,
                                    F.lit(0)) != 0, 1).otherwise(0),
        "days_b": bin_index(days, DAY_BINS),
    }


def state_code(b: dict) -> Column:
    return ((((b["inv_b"] * len(DEMAND_BINS) + b["dem_b"]) * len(RISK_BINS) + b["risk_b"]) * 2
             + b["anom_b"]) * len(DAY_BINS) + b["days_b"])


def with_state(df: DataFrame, **cols) -> DataFrame:
    """H1: add the five bin indices and the state code."""
    b = state_bins(**cols)
    return df.withColumns(b).withColumn("state", state_code({k: F.col(k) for k in b}))


# ---------------------------------------------------------------- H2-H4 reward
def actions_array() -> Column:
    return F.array(*[F.struct(F.lit(a).alias("action_id"), F.lit(n).alias("action"),
                              F.lit(float(REORDER_QTY[a])).alias("qty")) for a, n in ACTIONS.items()])


def with_actions(df: DataFrame) -> DataFrame:
    """H2: one row per input row and action (six rows, fixed), with the reorder quantity."""
    return df.withColumn("_a", F.explode(actions_array())).select("*", "_a.*").drop("_a")


def reward_parts(inv: Column, demand: Column, action_id: Column, anomaly: Column) -> dict:
    """H3: reward components; a component that does not apply is null.

    Holding cost is charged on the unclamped inventory after the step (so a
    shortfall makes it positive); inventory is floored at 0 after that.
    """
    qty = F.element_at(F.array(*[F.lit(float(REORDER_QTY[a])) for a in ACTIONS]), action_id + 1)
    after = inv + qty - demand
    floored = F.greatest(after, F.lit(0.0))
    return {
        "inv_after": after,
        "holding_cost": round_half_up(-after * HOLDING_COST_PER_UNIT, 3),
        "stockout_penalty": F.when(after < 0, F.lit(STOCKOUT_PENALTY)),
        "demand_fulfillment": F.when(after >= 0, round_half_up(demand * FULFILMENT_PER_UNIT, 3)),
        "overcapacity_penalty": F.when(floored > OVERCAPACITY_LIMIT, F.lit(OVERCAPACITY_PENALTY)),
        "action_cost": (F.when(action_id == 4, F.lit(EMERGENCY_ACTION_COST))
                        .when(action_id.isin(1, 2, 3), F.lit(STANDARD_ACTION_COST))),
        "anomaly_mitigation": F.when((action_id == 5) & (F.coalesce(anomaly, F.lit(0)) != 0),
                                     F.lit(ANOMALY_MITIGATION)),
        "projected_inventory": round_half_up(floored, 2),
    }


def total_reward(parts: dict) -> Column:
    s = F.lit(0.0)
    for c in COMPONENTS:
        s = s + F.coalesce(parts[c], F.lit(0.0))
    return round_half_up(s, 3)


def reward_breakdown(df: DataFrame, inv="inventory", demand="demand", action_id="action_id",
                     anomaly="anomaly") -> DataFrame:
    """H3: add the six components, ``total`` and ``projected_inventory`` (floored)."""
    parts = reward_parts(F.col(inv), F.col(demand), F.col(action_id), F.col(anomaly))
    out = df.withColumns({k: v for k, v in parts.items() if k != "inv_after"})
    return out.withColumn("total", total_reward({c: F.col(c) for c in COMPONENTS}))


def projected_inventory_ui(inv: Column, demand_avg: Column, qty: Column) -> Column:
    """H4: what the screen shows — inventory - 7-day average demand + reorder quantity, no floor."""
    return inv - demand_avg + qty


# ------------------------------------------------------------ H5 fitted Q
def reward_milli(inv_after: Column, demand: Column, action_id: Column, anomaly: Column) -> Column:
    """One-step reward in whole thousandths: each component rounded half up, then summed as integers."""
    milli = lambda c: F.floor(c * 1000.0 + 0.5)
    const = lambda v: F.lit(int(round(v * 1000))).cast("long")
    zero = F.lit(0).cast("long")
    return (milli(-inv_after * HOLDING_COST_PER_UNIT)
            + F.when(inv_after < 0, const(STOCKOUT_PENALTY)).otherwise(milli(demand * FULFILMENT_PER_UNIT))
            + F.when(inv_after > OVERCAPACITY_LIMIT, const(OVERCAPACITY_PENALTY)).otherwise(zero)
            + F.when(action_id == 4, const(EMERGENCY_ACTION_COST))
            .when(action_id.isin(1, 2, 3), const(STANDARD_ACTION_COST)).otherwise(zero)
            + F.when((action_id == 5) & (F.coalesce(anomaly, F.lit(0)) != 0), const(ANOMALY_MITIGATION)).otherwise(zero))


def _steps(s: DataFrame, demand: str, risk: str, anomaly: str, days: str, keep: list[str] | None = None) -> DataFrame:
    """(keep, state, action_id, reward, next_state) of rows that carry n_demand, n_risk, n_anomaly and lead_days."""
    s = with_actions(with_state(s, inv="inventory", demand=demand, risk=risk, anomaly=anomaly, days=days))
    after = F.col("inventory") + F.col("qty") - F.col(demand)
    s = s.withColumns({
        "reward": reward_milli(after, F.col(demand), F.col("action_id"), F.col(anomaly)),
        "n_inv": F.greatest(after, F.lit(0.0)),
        "n_days": F.when(F.col("action_id").isin(1, 2, 3, 4), F.coalesce("lead_days", F.col(days)))
        .otherwise(F.greatest(F.col(days) - 1, F.lit(1.0))),
        "n_anom": F.when(F.col("action_id") == 5, F.lit(0)).otherwise(F.col("n_anomaly"))})
    nb = state_bins(inv="n_inv", demand="n_demand", risk="n_risk", anomaly="n_anom", days="n_days")
    return s.select(*(keep or []), "state", "action_id", "reward", state_code(nb).alias("next_state"))


def transitions(states: DataFrame, by: list[str], lead_days: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """(keep, state, action, reward in thousandths, next_state) for every series row with a next day and each action.

    Next inventory is the floored inventory after the step; next demand,
    risk and anomaly are the next day's (anomaly 0 after SWITCH_SUPPLIER);
    next days is the group's mean real shipping days after a reorder
    (``lead_days``: by + lead_days column), else max(1, days - 1).
    """
    w = Window.partitionBy(*by).orderBy("order_date")
    s = states.withColumns({
        "n_demand": F.lead("demand7", 1).over(w),
        "n_risk": F.lead("risk", 1).over(w),
        "n_anomaly": F.lead("anomaly", 1).over(w),
    }).where(F.col("n_demand").isNotNull())
    if lead_days is not None:
        s = s.join(lead_days, on=by, how="left")
    else:
        s = s.withColumn("lead_days", F.lit(None).cast("double"))
    return _steps(s, "demand7", "risk", "anomaly", "days", keep)


def daily_changes(states: DataFrame, by: list[str]) -> DataFrame:
    """By + order_date + change: how much the mean daily demand of the trailing week moves to the next day."""
    w = Window.partitionBy(*by).orderBy("order_date")
    return states.select(*by, "order_date", ((F.lead("demand7", 1).over(w) - F.col("demand7")) / 7.0).alias("change"))


def order_transitions(orders: DataFrame, changes: DataFrame, lead_days: DataFrame, by: list[str]) -> DataFrame:
    """Transitions from the state of every order line, in the columns that decisions read.

    Demand moves by its group's observed change of that day (0 on the last day); risk and
    anomaly stay (anomaly 0 after SWITCH_SUPPLIER); days as in ``transitions``.
    """
    s = orders.join(small_side(changes), [*by, "order_date"], "left").join(small_side(lead_days), by, "left")
    s = s.withColumns({"n_demand": F.greatest(F.col("demand_7d_avg_raw") + F.coalesce("change", F.lit(0.0)), F.lit(0.0)),
                       "n_risk": F.col("risk_score"), "n_anomaly": F.col("is_anomaly")})
    return _steps(s, "demand_7d_avg_raw", "risk_score", "is_anomaly", "days_to_delivery")


def transition_counts(trans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n and reward sum per (series, state, action, next state): bounded by the bins, combined map-side."""
    return trans.groupBy(*(by or []), "state", "action_id", "next_state").agg(
        F.count(F.lit(1)).alias("n"), F.sum("reward").alias("r"))


def q_sweep(counts: DataFrame, q: DataFrame | None, gamma: float = GAMMA) -> DataFrame:
    """One sweep: Q'(s,a) = mean over transitions of r + gamma * max_a' Q(s', a'), in whole millionths."""
    t = counts
    worth = F.lit(0).cast("long")
    if q is not None:
        v = q.groupBy("state").agg(F.floor(F.max("m") * F.lit(gamma) + 0.5).alias("worth"))
        t = t.join(F.broadcast(v.withColumnRenamed("state", "next_state")), "next_state", "left")  # at most N_STATES rows
        worth = F.coalesce(F.col("worth"), F.lit(0).cast("long"))
    wide = lambda c: c.cast("decimal(28,0)")
    total = F.sum(wide(F.col("r")) * 1000 + wide(F.col("n")) * worth).cast("double")
    return t.groupBy("state", "action_id").agg(F.floor(total / F.sum("n").cast("double") + 0.5).alias("m"))


def fit_q(trans: DataFrame, sweeps: int, gamma: float = GAMMA, checkpoint_every: int = 5) -> DataFrame:
    """H5: ``sweeps`` rounds of fitted Q iteration from Q0 = 0; returns state, action_id, q.

    The transitions are reduced and written once; the Q table (at most 8640 rows) is
    written with a reliable checkpoint every ``checkpoint_every`` sweeps and at the end.
    """
    counts = cut_lineage(transition_counts(trans))
    q = None
    for k in range(1, sweeps + 1):
        q = q_sweep(counts, q, gamma)
        if k % checkpoint_every == 0 or k == sweeps:
            q = cut_lineage(q)
    return q.select("state", "action_id", (F.col("m") / float(Q_SCALE)).alias("q"))


def fit_q_converged(trans: DataFrame, by: list[str] | None = None, gamma: float = GAMMA, sweeps: int | None = None) -> DataFrame:
    """H5 to convergence, a policy for each series: by, state, action_id, q, residual and sweeps.

    ``trans`` has the keys ``by`` (none: one policy) beside state, action_id, reward and next_state.  A series' sweeps
    run in one task over its transition counts, a table whose size the bins fix, not the data; series are spread
    over the tasks.  They end when no value moves by more than ``residual_limit(gamma)`` millionths (or after
    ``sweeps`` of them); ``residual`` is the last largest move.  Values are those of as many ``fit_q`` sweeps.

    Rounding adds at most two millionths a sweep, so a move d is followed by one of at most gamma d + 2: the moves
    fall to the limit whatever the table, and the values then lie within (gamma d + 2) / (1 - gamma) of the exact ones.
    Values above some 10^10 units, whose millionths a double cannot hold, end at moves of 2^-48 of the largest value.
    """
    keys = list(by or [])
    counts = transition_counts(trans, keys)
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in counts.schema.fields if f.name in keys)
    schema = f"{types}state int, action_id int, q double, residual long, sweeps int"
    solve = partial(qsweeps.solve_frame, n_keys=len(keys), gamma=gamma, limit=residual_limit(gamma), sweeps=sweeps)
    counts = counts.select(*keys, F.col("state").cast("int"), F.col("action_id").cast("int"), F.col("next_state").cast("int"),
                           F.col("n").cast("long"), F.col("r").cast("long"))
    return counts.groupBy(*keys).applyInPandas(lambda pdf: solve(pdf), schema)  # a partial has no name for Spark


def residual_limit(gamma: float = GAMMA) -> int:
    """The move, in millionths, that sweeps are sure to come down to."""
    return math.ceil(2 / (1 - gamma) + 1e-9)


# ----------------------------------------------------------- H6-H11 read-outs
def q_full(q: DataFrame, states: DataFrame) -> DataFrame:
    """All six actions for each requested state; pairs never seen keep Q = 0 and trained = false."""
    base = with_actions(states.select("state").distinct()).select("state", "action_id", "action")
    return base.join(q, ["state", "action_id"], "left").withColumns(
        {"trained": F.col("q").isNotNull(), "q": F.coalesce("q", F.lit(0.0))})


def best_action(qf: DataFrame) -> DataFrame:
    """H6/H7: argmax action (ties -> lowest id), its Q, and its softmax weight (max-shifted).

    The best action's shifted exponent is 1, so its weight is 1 / sum(exp(q - max q)).
    """
    m = F.max("q").over(Window.partitionBy("state"))
    e = qf.withColumn("_e", F.exp(F.col("q") - m))
    return e.groupBy("state").agg(
        F.max_by("action_id", F.struct(F.round("q", Q_DIGITS), -F.col("action_id"))).alias("action_id"),
        F.max("q").alias("q_value"),
        F.bool_or("trained").alias("trained"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", F.floor(F.col("q") * 1000.0 + 0.5) / 1000.0))))
        .alias("q_values"),
        (1.0 / F.sum("_e")).alias("confidence"))


def action_rank(qf: DataFrame) -> DataFrame:
    """H9: rank of each action by Q (descending), ties by action id."""
    w = Window.partitionBy("state").orderBy(F.round("q", Q_DIGITS).desc(), "action_id")
    return qf.withColumn("rank", F.row_number().over(w))


def action_scale(qf: DataFrame) -> DataFrame:
    """Bar position (q - min(0, min q)) / span x 100 and the clamped (q + 20) x 2.5 score."""
    w = Window.partitionBy("state")
    lo = F.least(F.min("q").over(w), F.lit(0.0))
    hi = F.max("q").over(w)
    span = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    return qf.withColumns({
        "bar_pct": (F.col("q") - lo) / span * 100,
        "card_pct": F.least(F.greatest((F.col("q") + 20) * 2.5, F.lit(0.0)), F.lit(100.0)),
    })
