"""Reorder-policy jobs (H1-H11) over department-day states, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.constants import ACTIONS, DAY_BINS, DEMAND_BINS, INV_BINS, REORDER_QTY, RISK_BINS
from tidewater.functions.exprs import round_half_up
from tidewater.operators import policy as P
from tidewater.operators import supplier as S
from tidewater.plans.demand_plans import sql_spine
from tidewater.plans.oracle_base import with_order_lines
from tidewater.plans.registry import query, round_doubles
from tidewater.sources.fixtures import series_states
from tidewater.sources.tables import order_lines


# ---------------------------------------------------------------- oracle text
def sql_bin(x: str, edges: list) -> str:
    whens = " ".join(f"WHEN {x} >= {e} THEN {i}" for i, e in reversed(list(enumerate(edges))) if i > 0)
    return f"(CASE {whens} ELSE 0 END)"


def sql_state(inv, dem, risk, anom, days) -> str:
    a = f"(CASE WHEN COALESCE({anom}, 0) <> 0 THEN 1 ELSE 0 END)"
    return (f"(((({sql_bin(inv, INV_BINS)} * {len(DEMAND_BINS)} + {sql_bin(dem, DEMAND_BINS)}) * {len(RISK_BINS)}"
            f" + {sql_bin(risk, RISK_BINS)}) * 2 + {a}) * {len(DAY_BINS)} + {sql_bin(days, DAY_BINS)})")


ACTIONS_SQL = "actions_t AS (SELECT * FROM (VALUES " + ", ".join(
    f"({a}, '{n}', {float(REORDER_QTY[a])})" for a, n in ACTIONS.items()) + ") AS t(action_id, action, qty))"

SERIES_STATES_CTES = sql_spine(["department"], "dsp") + """,
daily_st AS (SELECT department, order_date, COUNT(*) AS lines, SUM(late_risk) AS late, SUM(actual_days) AS days_sum
             FROM order_lines GROUP BY 1, 2),
st0 AS (SELECT s.department, s.order_date, s.demand, COALESCE(d.lines, 0) AS lines, COALESCE(d.late, 0) AS late,
        COALESCE(d.days_sum, 0) AS days_sum FROM dsp s LEFT JOIN daily_st d USING (department, order_date)),
st1 AS (SELECT department, order_date, SUM(demand) OVER w AS demand7,
  CAST(50 + (((dayofyear(order_date) * 31 + COALESCE(TRY_CAST(regexp_extract(department, '([0-9]+)$', 1) AS INTEGER), 0) * 17)
        % 750) + 750) % 750 AS DOUBLE) AS inventory,
  CASE WHEN SUM(lines) OVER w > 0 THEN SUM(late) OVER w / SUM(lines) OVER w ELSE 0.0 END AS risk,
  CASE WHEN SUM(lines) OVER w > 0 THEN ROUND(SUM(days_sum) OVER w / SUM(lines) OVER w) ELSE 0.0 END AS days
  FROM st0 WINDOW w AS (PARTITION BY department ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
ss AS (SELECT *, CAST(CASE WHEN risk >= 0.6 THEN 1 ELSE 0 END AS INTEGER) AS anomaly FROM st1)"""


def sql_half_up(x: str, digits: int) -> str:
    k = f"CAST({10.0 ** digits} AS DOUBLE)"
    return f"(FLOOR({x} * {k} + 0.5) / {k})"


def sql_parts(inv, dem, act, anom, prefix="") -> str:
    after = f"({inv} + qty - {dem})"
    return f"""{sql_half_up(f"(-{after} * CAST(0.05 AS DOUBLE))", 3)} AS {prefix}holding_cost,
  CASE WHEN {after} < 0 THEN CAST(-50.0 AS DOUBLE) END AS {prefix}stockout_penalty,
  CASE WHEN {after} >= 0 THEN {sql_half_up(f"({dem} * CAST(0.5 AS DOUBLE))", 3)} END AS {prefix}demand_fulfillment,
  CASE WHEN GREATEST({after}, 0.0) > 1000 THEN CAST(-20.0 AS DOUBLE) END AS {prefix}overcapacity_penalty,
  CASE WHEN {act} = 4 THEN CAST(-15.0 AS DOUBLE) WHEN {act} IN (1, 2, 3) THEN CAST(-2.0 AS DOUBLE) END AS {prefix}action_cost,
  CASE WHEN {act} = 5 AND COALESCE({anom}, 0) <> 0 THEN CAST(10.0 AS DOUBLE) END AS {prefix}anomaly_mitigation,
  {sql_half_up(f"GREATEST({after}, 0.0)", 2)} AS {prefix}projected_inventory, {after} AS {prefix}inv_after"""


def sql_total(prefix="") -> str:
    return sql_half_up("(" + " + ".join(f"COALESCE({prefix}{c}, CAST(0.0 AS DOUBLE))" for c in P.COMPONENTS) + ")", 3)


def sql_reward_milli(dem: str, act: str, anom: str, after: str) -> str:
    """Whole thousandths: each component rounded half up, then added."""
    return f"""(CAST(FLOOR((-{after} * CAST(0.05 AS DOUBLE)) * 1000.0 + 0.5) AS BIGINT)
  + CASE WHEN {after} < 0 THEN -50000 ELSE CAST(FLOOR(({dem} * CAST(0.5 AS DOUBLE)) * 1000.0 + 0.5) AS BIGINT) END
  + CASE WHEN {after} > 1000 THEN -20000 ELSE 0 END
  + CASE WHEN {act} = 4 THEN -15000 WHEN {act} IN (1, 2, 3) THEN -2000 ELSE 0 END
  + CASE WHEN {act} = 5 AND COALESCE({anom}, 0) <> 0 THEN 10000 ELSE 0 END)"""


def sql_steps(src: str, dem: str, risk: str, anom: str, days: str, out: str) -> str:
    """CTE ``out``: counts and reward sums per (state, action, next state) of the rows of ``src``."""
    after = f"(inventory + qty - {dem})"
    return f"""{out}_1 AS (SELECT s.*, a.action_id, a.qty FROM {src} s, actions_t a),
{out}_2 AS (SELECT *, {after} AS i_after, {sql_reward_milli(dem, 'action_id', anom, after)} AS reward FROM {out}_1),
{out}_3 AS (SELECT *, GREATEST(i_after, 0.0) AS n_inv,
  CASE WHEN action_id IN (1, 2, 3, 4) THEN COALESCE(lead_days, {days}) ELSE GREATEST({days} - 1, 1.0) END AS n_days,
  CASE WHEN action_id = 5 THEN 0 ELSE n_anomaly END AS n_anom FROM {out}_2),
{out} AS MATERIALIZED (SELECT {sql_state("inventory", dem, risk, anom, days)} AS state, action_id,
  {sql_state("n_inv", "n_demand", "n_risk", "n_anom", "n_days")} AS next_state, COUNT(*) AS n, SUM(reward) AS r
  FROM {out}_3 GROUP BY 1, 2, 3)"""


def sql_sweeps(counts: str, sweeps: int, prefix: str = "q") -> str:
    """CTEs ``{prefix}1`` .. ``{prefix}{sweeps}`` (state, action_id, q) over ``counts``."""
    out = []
    for k in range(1, sweeps + 1):
        join = f"""LEFT JOIN (SELECT state, CAST(FLOOR(MAX(m) * CAST(0.95 AS DOUBLE) + 0.5) AS BIGINT) AS worth
  FROM {prefix}m{k - 1} GROUP BY 1) v ON v.state = t.next_state""" if k > 1 else ""
        worth = "COALESCE(v.worth, 0)" if k > 1 else "0"
        out.append(f"""{prefix}m{k} AS MATERIALIZED (SELECT t.state, t.action_id,
  CAST(FLOOR(CAST(SUM(t.r * 1000 + t.n * {worth}) AS DOUBLE) / CAST(SUM(t.n) AS DOUBLE) + 0.5) AS BIGINT) AS m
  FROM {counts} t {join} GROUP BY 1, 2),
{prefix}{k} AS (SELECT state, action_id, m / CAST(1000000.0 AS DOUBLE) AS q FROM {prefix}m{k})""")
    return ",\n".join(out)


TRANSITIONS_CTES = ACTIONS_SQL + """,
lead_d AS (SELECT department, AVG(actual_days) AS lead_days FROM order_lines GROUP BY department),
nx AS (SELECT * FROM (SELECT s.*, l.lead_days, LEAD(demand7, 1) OVER w AS n_demand, LEAD(risk, 1) OVER w AS n_risk,
       LEAD(anomaly, 1) OVER w AS n_anomaly FROM ss s LEFT JOIN lead_d l USING (department)
       WINDOW w AS (PARTITION BY department ORDER BY order_date)) WHERE n_demand IS NOT NULL),
""" + sql_steps("nx", "demand7", "risk", "anomaly", "days", "tc") + ",\n" + sql_sweeps("tc", 2) + """,
ss_state AS (SELECT ss.*, """ + sql_state("inventory", "demand7", "risk", "anomaly", "days") + """ AS state FROM ss),
qf AS (SELECT d.state, a.action_id, a.action, a.qty, COALESCE(q2.q, 0.0) AS q
       FROM (SELECT DISTINCT state FROM ss_state) d CROSS JOIN actions_t a
       LEFT JOIN q2 ON q2.state = d.state AND q2.action_id = a.action_id),
qr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY state ORDER BY ROUND(q, 6) DESC, action_id) AS rank FROM qf),
best AS (SELECT b.state, b.action_id, b.action, b.qty, b.q AS q_value,
  1.0 / (SELECT SUM(EXP(x.q - m.mq)) FROM qf x, (SELECT MAX(q) AS mq FROM qf y WHERE y.state = b.state) m
         WHERE x.state = b.state) AS confidence
  FROM qr b WHERE rank = 1)"""


# ----------------------------------------------------------------- Spark side
def _states(spark, sf_dir):
    return P.with_state(series_states(spark, sf_dir), inv="inventory", demand="demand7", risk="risk",
                        anomaly="anomaly", days="days")


def _lead_days(spark, sf_dir):
    st = S.stats(order_lines(spark, sf_dir, ["department", "actual_days", "order_value", "late_risk"]))
    return st.select("department", F.col("avg_delivery_time").alias("lead_days"))


def _q(spark, sf_dir, sweeps):
    tr = P.transitions(series_states(spark, sf_dir), ["department"], _lead_days(spark, sf_dir))
    return P.fit_q(tr, sweeps)


def _qf(spark, sf_dir, sweeps=2):
    return P.q_full(_q(spark, sf_dir, sweeps), _states(spark, sf_dir))


def _rounded(q, digits: int = 4):
    return q.withColumn("q", round_half_up("q", digits))


@query("series_states", with_order_lines(SERIES_STATES_CTES)
       + "SELECT department, order_date, demand7, inventory, ROUND(risk, 4) AS risk, days, anomaly FROM ss")
def series_states_q(spark, sf_dir):
    return round_doubles(series_states(spark, sf_dir))


@query("decision_state", with_order_lines(SERIES_STATES_CTES) + f"""SELECT department, order_date,
  {sql_bin('inventory', INV_BINS)} AS inv_b, {sql_bin('demand7', DEMAND_BINS)} AS dem_b,
  {sql_bin('risk', RISK_BINS)} AS risk_b, CASE WHEN anomaly <> 0 THEN 1 ELSE 0 END AS anom_b,
  {sql_bin('days', DAY_BINS)} AS days_b, {sql_state('inventory', 'demand7', 'risk', 'anomaly', 'days')} AS state
FROM ss""")
def decision_state(spark, sf_dir):
    return _states(spark, sf_dir).select("department", "order_date", "inv_b", "dem_b", "risk_b", "anom_b",
                                         "days_b", "state")


@query("action_outcomes", with_order_lines(SERIES_STATES_CTES, ACTIONS_SQL) + """SELECT department, action_id,
  COUNT(*) AS n_rows, ROUND(SUM(inventory + qty - demand7), 4) AS sum_inv_after,
  COUNT(*) FILTER (WHERE inventory + qty - demand7 < 0) AS n_short,
  ROUND(SUM(inventory - demand7 / 7.0 + qty), 4) AS sum_projected_ui
FROM ss, actions_t GROUP BY 1, 2""")
def action_outcomes(spark, sf_dir):
    """H2 (six actions per state row) and H4 (the screen's unfloored projection), summed per group."""
    a = P.with_actions(series_states(spark, sf_dir))
    after = F.col("inventory") + F.col("qty") - F.col("demand7")
    ui = P.projected_inventory_ui(F.col("inventory"), F.col("demand7") / 7.0, F.col("qty"))
    return round_doubles(a.groupBy("department", "action_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(after).alias("sum_inv_after"),
        F.count_if(after < 0).alias("n_short"), F.sum(ui).alias("sum_projected_ui")))


@query("reward_breakdown", with_order_lines(SERIES_STATES_CTES, ACTIONS_SQL, """
rb AS (SELECT ss.department, a.action_id, """ + sql_parts("inventory", "demand7", "a.action_id", "anomaly") + """
       FROM ss, actions_t a),
rb2 AS (SELECT *, """ + sql_total() + """ AS total FROM rb)""") + "SELECT department, action_id, "
       + ", ".join(f"ROUND(SUM(COALESCE({c}, CAST(0.0 AS DOUBLE))), 4) AS sum_{c}, COUNT({c}) AS n_{c}" for c in P.COMPONENTS)
       + ", ROUND(SUM(total), 4) AS sum_total, ROUND(SUM(projected_inventory), 4) AS sum_projected "
         "FROM rb2 GROUP BY 1, 2")
def reward_breakdown(spark, sf_dir):
    """H3 for every state row and action, summed per (department, action) with applying counts."""
    a = P.reward_breakdown(P.with_actions(series_states(spark, sf_dir)), demand="demand7")
    aggs = []
    for c in P.COMPONENTS:
        aggs += [F.sum(F.coalesce(c, F.lit(0.0))).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}")]
    return round_doubles(a.groupBy("department", "action_id").agg(
        *aggs, F.sum("total").alias("sum_total"), F.sum("projected_inventory").alias("sum_projected")))


@query("action_values_k1", with_order_lines(SERIES_STATES_CTES, TRANSITIONS_CTES)
       + f"SELECT state, action_id, {sql_half_up('q', 4)} AS q FROM q1")
def action_values_k1(spark, sf_dir):
    """H5, one fitted-Q sweep (Q1 = mean one-step reward)."""
    return _rounded(_q(spark, sf_dir, 1))


@query("action_values_k2", with_order_lines(SERIES_STATES_CTES, TRANSITIONS_CTES)
       + f"SELECT state, action_id, {sql_half_up('q', 4)} AS q FROM q2")
def action_values_k2(spark, sf_dir):
    """H5, two sweeps: Q2 = mean of r + 0.95 max_a' Q1(s', a')."""
    return _rounded(_q(spark, sf_dir, 2))


@query("action_values_k20", with_order_lines(SERIES_STATES_CTES, TRANSITIONS_CTES, sql_sweeps("tc", 20, "z"))
       + f"SELECT state, action_id, {sql_half_up('q', 4)} AS q FROM z20")
def action_values_k20(spark, sf_dir):
    """H5 run to 20 sweeps (the oracle unrolls them)."""
    return _rounded(_q(spark, sf_dir, 20))


@query("action_values_converged")
def action_values_converged(spark, sf_dir):
    """H5 until no value moves by more than the residual limit (no oracle: some 300 sweeps)."""
    tr = P.transitions(series_states(spark, sf_dir), ["department"], _lead_days(spark, sf_dir))
    return _rounded(P.fit_q_converged(tr))


@query("department_action_values_k2", with_order_lines(SERIES_STATES_CTES, TRANSITIONS_CTES, """
dtc AS MATERIALIZED (SELECT department, """ + sql_state("inventory", "demand7", "risk", "anomaly", "days") + """ AS state, action_id,
  """ + sql_state("n_inv", "n_demand", "n_risk", "n_anom", "n_days") + """ AS next_state, COUNT(*) AS n, SUM(reward) AS r
  FROM tc_3 GROUP BY 1, 2, 3, 4),
dm1 AS (SELECT department, state, action_id, CAST(FLOOR(CAST(SUM(r * 1000) AS DOUBLE) / CAST(SUM(n) AS DOUBLE) + 0.5) AS BIGINT) AS m
  FROM dtc GROUP BY 1, 2, 3),
dw1 AS (SELECT department, state AS next_state, CAST(FLOOR(MAX(m) * CAST(0.95 AS DOUBLE) + 0.5) AS BIGINT) AS worth FROM dm1 GROUP BY 1, 2),
dm2 AS (SELECT department, state, action_id, CAST(FLOOR(CAST(SUM(r * 1000 + n * COALESCE(worth, 0)) AS DOUBLE)
  / CAST(SUM(n) AS DOUBLE) + 0.5) AS BIGINT) AS m FROM dtc LEFT JOIN dw1 USING (department, next_state) GROUP BY 1, 2, 3)""")
       + "SELECT department, state, action_id, " + sql_half_up("(m / CAST(1000000.0 AS DOUBLE))", 4) + " AS q FROM dm2")
def department_action_values_k2(spark, sf_dir):
    """H5 with a policy of its own for each department, two sweeps."""
    tr = P.transitions(series_states(spark, sf_dir), ["department"], _lead_days(spark, sf_dir), keep=["department"])
    return _rounded(P.fit_q_converged(tr, ["department"], sweeps=2).drop("residual", "sweeps"))


@query("department_action_values")
def department_action_values(spark, sf_dir):
    """H5 to convergence with a policy of its own for each department."""
    tr = P.transitions(series_states(spark, sf_dir), ["department"], _lead_days(spark, sf_dir), keep=["department"])
    return _rounded(P.fit_q_converged(tr, ["department"]))


@query("best_action", with_order_lines(SERIES_STATES_CTES, TRANSITIONS_CTES)
       + "SELECT state, action_id, action, " + sql_half_up("q_value", 3) + " AS q_value, ROUND(confidence, 4) AS confidence FROM best")
def best_action(spark, sf_dir):
    """H6/H7 on the K=2 values for every state the series visit (unvisited pairs are 0 -> HOLD on ties)."""
    qf = _qf(spark, sf_dir)
    b = P.best_action(qf)
    names = F.element_at(F.array(*[F.lit(n) for n in ACTIONS.values()]), F.col("action_id") + 1)
    return b.select("state", "action_id", names.alias("action"), round_half_up("q_value", 3).alias("q_value"),
                    F.round("confidence", 4).alias("confidence"))


@query("action_values_wide", with_order_lines(SERIES_STATES_CTES, TRANSITIONS_CTES) + "SELECT state, "
       + ", ".join(sql_half_up(f"MAX(q) FILTER (WHERE action_id = {a})", 3) + f" AS \"{n}\"" for a, n in ACTIONS.items())
       + " FROM qf GROUP BY state")
def action_values_wide(spark, sf_dir):
    """H8: one column per action name, values rounded to 3."""
    qf = _qf(spark, sf_dir)
    wide = qf.groupBy("state").pivot("action", list(ACTIONS.values())).agg(F.max("q"))
    return wide.select("state", *[round_half_up(n, 3).alias(n) for n in ACTIONS.values()])


@query("action_value_map", with_order_lines(SERIES_STATES_CTES, TRANSITIONS_CTES) + "SELECT state, map_from_entries(list((action, "
       + sql_half_up("q", 3) + ") ORDER BY action)) AS q_values FROM qf GROUP BY state")
def action_value_map(spark, sf_dir):
    """H8 as one map per state: action name -> value, rounded to 3."""
    return P.best_action(_qf(spark, sf_dir)).select("state", "q_values")


@query("action_rank", with_order_lines(SERIES_STATES_CTES, TRANSITIONS_CTES)
       + f"SELECT state, action_id, {sql_half_up('q', 4)} AS q, rank FROM qr")
def action_rank(spark, sf_dir):
    r = P.action_rank(_qf(spark, sf_dir))
    return _rounded(r.select("state", "action_id", "q", F.col("rank")))


@query("action_scale", with_order_lines(SERIES_STATES_CTES, TRANSITIONS_CTES, """
sc AS (SELECT *, LEAST(MIN(q) OVER (PARTITION BY state), 0.0) AS lo, MAX(q) OVER (PARTITION BY state) AS hi FROM qf)""")
       + "SELECT state, action_id, " + sql_half_up("((q - lo) / CASE WHEN hi - lo = 0 THEN 1.0 ELSE hi - lo END * 100)", 4)
       + " AS bar_pct, " + sql_half_up("LEAST(GREATEST((q + 20) * 2.5, 0.0), 100.0)", 4) + " AS card_pct FROM sc")
def action_scale(spark, sf_dir):
    s = P.action_scale(_qf(spark, sf_dir))
    return s.select("state", "action_id", round_half_up("bar_pct", 4).alias("bar_pct"),
                    round_half_up("card_pct", 4).alias("card_pct"))


def _sql_extreme(fn: str, sign: str, order: int) -> str:
    """The largest (smallest) reward part beyond zero as a struct (v, i, part), the first of equal ones; null if none."""
    return f"{fn}([" + ", ".join(
        f"CASE WHEN {c} {sign} 0 THEN {{'v': {c}, 'i': {order * i}, 'part': '{c}'}} END" for i, c in enumerate(P.COMPONENTS)) + "])"


_JUST_SQL = with_order_lines(SERIES_STATES_CTES, TRANSITIONS_CTES, """
pick AS MATERIALIZED (SELECT state, MAX(CASE WHEN rank = 1 THEN action END) AS best, MAX(CASE WHEN rank = 2 THEN action END) AS runner_up,
  MAX(CASE WHEN rank = 1 THEN qty END) AS qty, MAX(CASE WHEN rank = 1 THEN action_id END) AS action_id FROM qr GROUP BY state),
dj AS (SELECT s.department, s.order_date, p.best, p.runner_up, p.qty, p.action_id, s.inventory, s.demand7, s.anomaly
       FROM ss_state s JOIN pick p USING (state)),
dj2 AS MATERIALIZED (SELECT dj.*, """ + sql_parts("inventory", "demand7", "action_id", "anomaly") + """ FROM dj),
dj3 AS (SELECT *, """ + _sql_extreme("list_max", ">", -1) + " AS hi, " + _sql_extreme("list_min", "<", 1) + """ AS lo FROM dj2)""")


@query("decision_justification", _JUST_SQL + """SELECT department, order_date, best, runner_up, hi.part AS top_reward,
  hi.v AS top_reward_value, lo.part AS top_cost, lo.v AS top_cost_value, """ + sql_total() + """ AS total FROM dj3""")
def decision_justification(spark, sf_dir):
    """Best and runner-up action, largest positive and most negative reward part of the best action."""
    qf = _qf(spark, sf_dir)
    rk = P.action_rank(qf)
    best = rk.where(F.col("rank") == 1).select("state", F.col("action").alias("best"), "action_id")
    ru = rk.where(F.col("rank") == 2).select("state", F.col("action").alias("runner_up"))
    st = _states(spark, sf_dir).select("department", "order_date", "state", "inventory", "demand7", "anomaly")
    d = st.join(F.broadcast(best), "state").join(F.broadcast(ru), "state")
    d = P.reward_breakdown(d, demand="demand7")
    items = F.array(*[F.struct(F.col(c).alias("v"), F.lit(-i).alias("neg_idx"), F.lit(c).alias("part"))
                      for i, c in enumerate(P.COMPONENTS)])
    items_lo = F.array(*[F.struct(F.col(c).alias("v"), F.lit(i).alias("idx"), F.lit(c).alias("part"))
                         for i, c in enumerate(P.COMPONENTS)])
    top = F.array_max(F.filter(items, lambda s: s["v"] > 0))
    low = F.array_min(F.filter(items_lo, lambda s: s["v"] < 0))
    return d.select("department", "order_date", "best", "runner_up",
                    top["part"].alias("top_reward"), top["v"].alias("top_reward_value"),
                    low["part"].alias("top_cost"), low["v"].alias("top_cost_value"), "total")
