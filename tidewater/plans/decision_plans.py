"""Per-order decisions (J1-J10, F9, F10, B8, B9, B11, A6, A7) with their oracles.

``decisions`` is the flagship: every order line gets a 7-day forecast scaled
to the order, a delay-risk label, the supplier (department) anomaly flag, the
best reorder action for its state, and the least-cost route between its
supplier's and customer's nations.  The policy is fitted on transitions from
the states of the order lines themselves, in the columns the decision reads,
so every order's state is a trained one.  The model stages use deterministic
predictors here (seasonal-naive forecast, class shares per shipping mode,
z-score outlier rule, fitted Q with two sweeps), so the whole chain has an
exact SQL twin; ``order_decisions_learned`` (in ``model_plans``) runs the same chain with the
learned models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.constants import ACTIONS
from tidewater.functions.exprs import round_half_up
from tidewater.functions.joins import small_side
from tidewater.operators import decide as DC
from tidewater.operators import demand as D
from tidewater.operators import policy as P
from tidewater.operators import risk as R
from tidewater.operators import routes as RT
from tidewater.operators import supplier as S
from tidewater.plans.core_plans import _RISK_CTES, _SPLIT_CTE
from tidewater.plans.demand_plans import sql_naive, sql_spine
from tidewater.plans.oracle_base import with_order_lines
from tidewater.plans.policy_plans import (SERIES_STATES_CTES, TRANSITIONS_CTES, sql_parts, sql_state, sql_steps,
                                          sql_sweeps, sql_total)
from tidewater.plans.registry import query, round_doubles
from tidewater.session import cut_lineage, written
from tidewater.plans.route_plans import EDGES_SQL, LANES_SQL, NODES_SQL, ROUNDS, sql_relaxation
from tidewater.sources import fixtures as FX
from tidewater.sources import versions as V
from tidewater.sources.tables import order_lines, read_table

DECISION_IN = ["order_id", "line_no", "order_date", "quantity", "order_value", "discount_rate", "inventory",
               "days_to_delivery", "shipping_mode", "actual_days", "scheduled_days", "late_risk", "department",
               "supplier_nation", "customer_nation", "city", "country", "product_id", "market", "order_region", "category",
               "customer_segment", "order_type", "tax"]
# what only the learned delay classifier reads
LEARNED_IN = ["market", "order_region", "category", "customer_segment", "order_type"]
RULE_IN = [c for c in DECISION_IN if c not in LEARNED_IN]


# ----------------------------------------------------------------- Spark side
def decision_inputs(spark, sf_dir, policy_sweeps: int | None = 2, columns: list[str] | None = None) -> dict:
    """The look-up tables of the chain, each small and built once.

    The order lines (``columns``, default RULE_IN) are joined once and written; every pass reads the written ones.

    The two scalar inputs (unit value, 7-value base forecast) are read here, so the chain
    also runs inside a streaming query.  ``policy_sweeps=None`` leaves the policy to the caller.
    """
    base = R.delay_columns(written(order_lines(spark, sf_dir, columns or RULE_IN), "order-lines"))
    sums = order_sums(R.stratified_split(base, ["order_id", "line_no"]))
    days = sums.where(F.col("set") == "day")
    pairs = sums.where(F.col("set") == "pair").select(
        F.col("supplier_nation").cast("int").alias("source"), F.col("customer_nation").cast("int").alias("target"),
        F.col("quantity").alias("volume"), (F.col("tax") / (F.col("n") * 100)).alias("avg_tax"))
    stats = cut_lineage(S.stats_of_sums(days))
    fc = D.naive_forecast(D.spine(days.groupBy("order_date").agg(F.sum("quantity").alias("demand"))), horizon=7)
    total = days.agg(F.sum("value"), F.sum("quantity"), F.sum("n")).first()
    unit_value = (total[0] / total[2]) / max(total[1] / total[2], 1.0) if total[2] else 0.0
    adj = RT.adjacency(RT.edge_weights(FX.net_edges(spark, sf_dir, pairs.where(F.col("source") != F.col("target")))))
    # to every node, since orders to come may join nations that had no lane so far
    best_paths = RT.shortest_paths(adj, pairs.select(F.col("source").alias("start")))
    x = dict(orders=base, flags=S.zscore_outliers(stats, "department"),
             shares=R.class_shares(sums.where(F.col("set") == "mode").select("shipping_mode", "risk_class",
                                                                            F.col("n_train").alias("n"))),
             forecast=fc, base_fc=base_forecast(fc), unit_value=float(unit_value), auv=F.round(F.lit(float(unit_value)), 6),
             routes=cut_lineage(RT.route_table(best_paths, FX.net_nodes(spark, sf_dir))), stats=stats,
             changes=P.daily_changes(FX.states_of_days(days.select(
                 "department", "order_date", F.col("quantity").alias("demand"), F.col("n").alias("lines"), "late",
                 F.col("days").alias("days_sum"))), ["department"]),
             lead_days=stats.select("department", F.col("avg_delivery_time").alias("lead_days")))
    if policy_sweeps:
        x["q"] = order_policy(x, policy_sweeps)
    return x


def publish_inputs(spark, x: dict, store: str) -> V.Version:
    """The look-ups and the policy of ``decision_inputs`` as one committed version."""
    unit = spark.createDataFrame([(x["unit_value"],)], "unit_value double")
    tables = {"unit": unit, **{k: x[k] for k in ("flags", "shares", "forecast", "routes", "q")}}
    return V.publish(spark, store, {k: V.as_table(t) for k, t in tables.items()})


def published_inputs(spark, version: V.Version) -> dict:
    """What ``decisions`` needs, from a committed version."""
    x = {k: version.table(spark, k) for k in ("flags", "shares", "forecast", "routes", "q")}
    unit = version.table(spark, "unit").first().unit_value
    return x | {"base_fc": base_forecast(x["forecast"]), "auv": F.round(F.lit(unit), 6)}


def order_sums(orders: DataFrame) -> DataFrame:
    """Every sum the look-ups need in one pass over the order lines, combined map-side and written once.

    Three groupings in one aggregate: ``day`` (department, day), ``mode`` (shipping mode, delay class)
    and ``pair`` (supplier nation, customer nation).
    """
    sets = {"day": ["department", "order_date"], "mode": ["shipping_mode", "risk_class"],
            "pair": ["supplier_nation", "customer_nation"]}
    keys = [F.col(c) for cols in sets.values() for c in cols]
    # the bits of the grouping id are set for the keys a grouping leaves out
    names = {int("".join("0" if k in cols else "1" for ks in sets.values() for k in ks), 2): n for n, cols in sets.items()}
    g = orders.groupingSets([[F.col(c) for c in cols] for cols in sets.values()], *keys).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_test")).alias("n_train"),
        F.sum("quantity").alias("quantity"), F.sum("order_value").alias("value"),
        F.sum(F.col("order_value") * F.col("order_value")).alias("value2"), F.sum("late_risk").alias("late"),
        F.sum("actual_days").alias("days"), F.sum(FX.tax_cents()).alias("tax"))
    which = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return cut_lineage(g.withColumn("set", which[F.col("_g").cast("int")]).drop("_g"))


def base_forecast(fc: DataFrame) -> Column:
    """The forecast (one row a step of a fixed horizon) as a literal array of (step, forecast)."""
    return F.array(*[F.struct(F.lit(r["step"]).alias("step"), F.lit(float(r["forecast"])).alias("forecast"))
                     for r in fc.orderBy("step").collect()])


def order_policy(x: dict, sweeps: int) -> DataFrame:
    """Q values fitted on the transitions of the order lines' own states."""
    return P.fit_q(P.order_transitions(order_states(x), x["changes"], x["lead_days"], ["department"]), sweeps)


def order_states(x: dict) -> DataFrame:
    """``x['orders']`` with risk, supplier flag, scaled forecast and the state they make."""
    scorer = x.get("risk_scorer")
    o = scorer(x["orders"]) if scorer else R.classify_by_shares(x["shares"], x["orders"])
    o = o.withColumns({"risk_level": DC.risk_label(F.col("prediction"))})
    o = o.withColumn("risk_score", DC.risk_score(F.col("risk_level")))
    o = o.join(small_side(x["flags"]), "department", "left").withColumns({
        "is_anomaly": F.coalesce(F.col("is_anomaly").cast("int"), F.lit(0)),
        "anomaly_score": F.round("anomaly_score", 4)})
    mult = DC.order_multiplier(F.col("order_value"), x["auv"], F.col("days_to_delivery").cast("double"),
                               F.col("quantity"))
    o = o.withColumns({"_base": x["base_fc"], "_mult": mult})
    fc, mean = DC.scaled_forecast(F.transform("_base", lambda s: s["forecast"]), F.col("_mult"))
    o = o.withColumns({"forecast_raw": fc}).withColumn(
        "demand_7d_avg_raw", F.aggregate("forecast_raw", F.lit(0.0), lambda acc, v: acc + v) / F.size("forecast_raw"))
    return P.with_state(o, inv="inventory", demand="demand_7d_avg_raw", risk="risk_score", anomaly="is_anomaly",
                        days="days_to_delivery")


def decisions(spark, sf_dir, inputs: dict | None = None) -> DataFrame:
    """The chain over ``inputs['orders']`` (batch or stream).  ``inputs['risk_scorer']``, when
    given, maps the orders to orders with an integer ``prediction`` column (a learned model);
    otherwise the class shares per shipping mode decide."""
    x = inputs or decision_inputs(spark, sf_dir)
    o = order_states(x)
    # every possible state (the bins fix 1440): no distinct over the orders, and usable from a stream
    states = spark.range(P.N_STATES).select(F.col("id").cast("int").alias("state"))
    best = P.best_action(P.q_full(x["q"], states))
    o = o.join(small_side(best), "state", "left")
    rt = x["routes"].select(F.col("start").alias("supplier_nation"), F.col("goal").alias("customer_nation"),
                            F.col("total_cost").alias("route_cost"), "path_names")
    o = o.join(small_side(rt), ["supplier_nation", "customer_nation"], "left").withColumn(
        "path_names", F.coalesce("path_names", F.array().cast("array<string>")))
    o = o.withColumn("action", DC.action_name(F.col("action_id")))
    emergency = DC.is_emergency(F.col("action"), F.col("risk_score"), F.col("is_anomaly"))
    o = o.withColumns({
        "is_emergency": emergency,
        "route_type": DC.route_type(emergency),
        "trigger": DC.route_trigger(emergency, F.col("action"), F.col("is_anomaly"), F.col("risk_score")),
        "demand_forecast_7d": F.transform("forecast_raw", lambda v: round_half_up(v, 2)),
        "demand_7d_avg": round_half_up("demand_7d_avg_raw", 2),
    })
    return o


DECISION_COLS = ["order_id", "line_no", "department", "demand_forecast_7d", "demand_7d_avg", "risk_level",
                 "risk_score", "is_anomaly", "anomaly_score", "state", "trained", "action_id", "action", "q_value",
                 "confidence", "route_cost", "path_names", "is_emergency", "route_type", "trigger"]


def _decision_out(d):
    return d.select(*[round_half_up(c, 3).alias(c) if c == "q_value" else
                      F.round(c, 4).alias(c) if c == "confidence" else F.col(c) for c in DECISION_COLS])


# ---------------------------------------------------------------- oracle text
_DEC_CTES = [*_RISK_CTES, _SPLIT_CTE, """
shares AS (SELECT shipping_mode,
  ROUND(COUNT(*) FILTER (WHERE risk_class = 0) / COUNT(*), 4) AS p_0,
  ROUND(COUNT(*) FILTER (WHERE risk_class = 1) / COUNT(*), 4) AS p_1,
  ROUND(COUNT(*) FILTER (WHERE risk_class = 2) / COUNT(*), 4) AS p_2
  FROM split WHERE NOT is_test GROUP BY shipping_mode)""", """
stats_department AS (SELECT department, COALESCE(AVG(actual_days), 0) AS avg_delivery_time,
  COALESCE(STDDEV_SAMP(order_value) / (AVG(order_value) + 1e-9), 0) AS price_deviation,
  COALESCE(1 - AVG(late_risk), 0) AS fulfillment_rate, COALESCE(CAST(SUM(late_risk) AS DOUBLE), 0) AS complaint_freq
  FROM order_lines GROUP BY department),
zd AS (SELECT AVG(avg_delivery_time) m1, STDDEV_POP(avg_delivery_time) s1, AVG(price_deviation) m2,
  STDDEV_POP(price_deviation) s2, AVG(fulfillment_rate) m3, STDDEV_POP(fulfillment_rate) s3,
  AVG(complaint_freq) m4, STDDEV_POP(complaint_freq) s4 FROM stats_department),
dflag AS (SELECT department, GREATEST(CASE WHEN s1 > 0 THEN ABS(avg_delivery_time - m1) / s1 ELSE 0.0 END,
  CASE WHEN s2 > 0 THEN ABS(price_deviation - m2) / s2 ELSE 0.0 END,
  CASE WHEN s3 > 0 THEN ABS(fulfillment_rate - m3) / s3 ELSE 0.0 END,
  CASE WHEN s4 > 0 THEN ABS(complaint_freq - m4) / s4 ELSE 0.0 END) AS zmax FROM stats_department, zd)""",
             sql_spine([]), sql_naive([], "spine"), """
base AS (SELECT list(forecast ORDER BY step) AS base FROM naive),
auv AS (SELECT ROUND(AVG(order_value) / GREATEST(AVG(quantity), 1.0), 6) AS auv FROM order_lines),
d0 AS (SELECT k.*, COALESCE(s.p_0, 0.0) AS p_0, COALESCE(s.p_1, 0.0) AS p_1, COALESCE(s.p_2, 0.0) AS p_2
  FROM rk k LEFT JOIN shares s USING (shipping_mode)),
d1 AS (SELECT *, CASE WHEN p_0 >= p_1 AND p_0 >= p_2 THEN 'LOW' WHEN p_1 >= p_2 AND p_1 > p_0 THEN 'MEDIUM'
  ELSE 'HIGH' END AS risk_level FROM d0),
d2 AS (SELECT d1.*, CAST(CASE risk_level WHEN 'LOW' THEN 0.2 WHEN 'MEDIUM' THEN 0.55 WHEN 'HIGH' THEN 0.85 ELSE 0.5 END AS DOUBLE)
  AS risk_score, CAST(COALESCE(CASE WHEN f.zmax > 2 THEN 1 ELSE 0 END, 0) AS INTEGER) AS is_anomaly,
  ROUND(f.zmax, 4) AS anomaly_score FROM d1 LEFT JOIN dflag f USING (department)),
d3 AS (SELECT d2.*, LEAST(GREATEST(order_value / GREATEST(auv.auv, 1.0), 0.5), 1.8)
  * (1 + GREATEST(CAST(3.0 AS DOUBLE) - days_to_delivery, 0.0) * CAST(0.12 AS DOUBLE)) * LEAST(8.0, 1 + quantity / 400.0) AS mult, base.base
  FROM d2, auv, base),
d4 AS (SELECT *, list_transform(base, lambda v: GREATEST(v * mult, 0.0)) AS fc FROM d3),
d5 AS (SELECT *, list_reduce(fc, lambda a, b: a + b) / len(fc) AS demand_raw FROM d4),
d6 AS MATERIALIZED (SELECT *, """ + sql_state("inventory", "demand_raw", "risk_score", "is_anomaly", "days_to_delivery")
             + """ AS state FROM d5)""", SERIES_STATES_CTES, TRANSITIONS_CTES, """
dch AS (SELECT department, order_date, (LEAD(demand7, 1) OVER (PARTITION BY department ORDER BY order_date) - demand7)
  / CAST(7.0 AS DOUBLE) AS change FROM ss),
d6n AS (SELECT d6.*, l.lead_days, GREATEST(demand_raw + COALESCE(c.change, CAST(0.0 AS DOUBLE)), CAST(0.0 AS DOUBLE)) AS n_demand,
  risk_score AS n_risk, is_anomaly AS n_anomaly FROM d6 LEFT JOIN dch c USING (department, order_date)
  LEFT JOIN lead_d l USING (department))""", sql_steps("d6n", "demand_raw", "risk_score", "is_anomaly", "days_to_delivery", "oc"),
             sql_sweeps("oc", 2, "p"), """
oq AS (SELECT d.state, a.action_id, a.action, p2.q IS NOT NULL AS seen, COALESCE(p2.q, 0.0) AS q
  FROM (SELECT DISTINCT state FROM d6) d
  CROSS JOIN actions_t a LEFT JOIN p2 ON p2.state = d.state AND p2.action_id = a.action_id),
oqr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY state ORDER BY ROUND(q, 6) DESC, action_id) AS rank FROM oq),
obest AS (SELECT b.state, b.action_id, b.action, b.q AS q_value,
  (SELECT BOOL_OR(x.seen) FROM oq x WHERE x.state = b.state) AS trained,
  1.0 / (SELECT SUM(EXP(x.q - (SELECT MAX(y.q) FROM oq y WHERE y.state = b.state))) FROM oq x WHERE x.state = b.state)
  AS confidence FROM oqr b WHERE rank = 1)""", NODES_SQL, LANES_SQL, EDGES_SQL, sql_relaxation(ROUNDS), """
rr AS (SELECT q.start, q.goal, b.path, b.cents FROM reqs q LEFT JOIN rbest b ON b.start = q.start AND b.node = q.goal),
rpn AS (SELECT start, goal, list(name ORDER BY pos) AS path_names FROM (
  SELECT rr.start, rr.goal, u.pos, n.name FROM rr, unnest(rr.path) WITH ORDINALITY AS u(node_id, pos)
  JOIN nodes n ON n.node_id = u.node_id) GROUP BY 1, 2),
d7 AS (SELECT d6.*, ob.action_id, ob.action, ob.q_value, ob.trained, ob.confidence, rr.cents / 100.0 AS route_cost,
  COALESCE(rpn.path_names, []) AS path_names
  FROM d6 LEFT JOIN obest ob USING (state)
  LEFT JOIN rr ON rr.start = d6.supplier_nation AND rr.goal = d6.customer_nation
  LEFT JOIN rpn ON rpn.start = d6.supplier_nation AND rpn.goal = d6.customer_nation),
dec AS (SELECT *, (action = 'EMERGENCY_REORDER' OR risk_score > 0.8 OR is_anomaly = 1) AS is_emergency FROM d7),
decf AS (SELECT *, CASE WHEN is_emergency THEN 'EMERGENCY' ELSE 'STANDARD' END AS route_type,
  CASE WHEN NOT is_emergency THEN 'None: least-cost route'
       WHEN action = 'EMERGENCY_REORDER' THEN 'Reorder policy: EMERGENCY_REORDER'
       WHEN is_anomaly = 1 THEN 'Supplier statistics: department flagged as unusual'
       ELSE format('Delay risk: score {} > 0.8', CAST(risk_score AS VARCHAR)) END AS trigger,
  list_transform(fc, lambda v: FLOOR(v * 100.0 + 0.5) / 100.0) AS demand_forecast_7d, FLOOR(demand_raw * 100.0 + 0.5) / 100.0 AS demand_7d_avg FROM dec)"""]

DECISIONS_SQL = with_order_lines(*_DEC_CTES)


@query("order_decisions", DECISIONS_SQL + """SELECT order_id, line_no, department, demand_forecast_7d, demand_7d_avg,
  risk_level, risk_score, is_anomaly, anomaly_score, state, trained, action_id, action, FLOOR(q_value * 1000.0 + 0.5) / 1000.0 AS q_value,
  ROUND(confidence, 4) AS confidence, route_cost, path_names, is_emergency, route_type, trigger FROM decf""")
def order_decisions(spark, sf_dir):
    """One decision row per order line (forecast, risk, anomaly, action, route)."""
    return _decision_out(decisions(spark, sf_dir))


@query("decision_coverage", DECISIONS_SQL + "SELECT action, trained, COUNT(*) AS n_lines FROM decf GROUP BY 1, 2")
def decision_coverage(spark, sf_dir):
    """Order lines by chosen action and by whether their state was trained."""
    return decisions(spark, sf_dir).groupBy("action", "trained").agg(F.count(F.lit(1)).alias("n_lines"))


@query("risk_score", with_order_lines(*_DEC_CTES[:6], """
d0 AS (SELECT k.*, COALESCE(s.p_0, 0.0) AS p_0, COALESCE(s.p_1, 0.0) AS p_1, COALESCE(s.p_2, 0.0) AS p_2
  FROM rk k LEFT JOIN shares s USING (shipping_mode)),
d1 AS (SELECT *, CASE WHEN p_0 >= p_1 AND p_0 >= p_2 THEN 'LOW' WHEN p_1 >= p_2 AND p_1 > p_0 THEN 'MEDIUM'
  ELSE 'HIGH' END AS risk_level FROM d0)""") + """SELECT shipping_mode, risk_level,
  CAST(CASE risk_level WHEN 'LOW' THEN 0.2 WHEN 'MEDIUM' THEN 0.55 WHEN 'HIGH' THEN 0.85 ELSE 0.5 END AS DOUBLE) AS risk_score,
  COUNT(*) AS n_lines FROM d1 GROUP BY 1, 2""")
def risk_score_q(spark, sf_dir):
    """J1 (with F5's label from the shipping-mode class shares), counted per mode and label."""
    base = R.delay_columns(order_lines(spark, sf_dir, DECISION_IN))
    split = R.stratified_split(base, ["order_id", "line_no"])
    o = R.prior_classifier(split.where(~F.col("is_test")), base)
    o = o.withColumn("risk_level", DC.risk_label(F.col("prediction")))
    return o.groupBy("shipping_mode", "risk_level").agg(
        F.first(DC.risk_score(F.col("risk_level"))).alias("risk_score"), F.count(F.lit(1)).alias("n_lines"))


@query("order_multiplier", with_order_lines("""
auv AS (SELECT ROUND(AVG(order_value) / GREATEST(AVG(quantity), 1.0), 6) AS auv FROM order_lines)""")
       + """SELECT order_id, line_no, ROUND(LEAST(GREATEST(order_value / GREATEST(auv.auv, 1.0), 0.5), 1.8)
  * (1 + GREATEST(CAST(3.0 AS DOUBLE) - days_to_delivery, 0.0) * CAST(0.12 AS DOUBLE)) * LEAST(8.0, 1 + quantity / 400.0), 6) AS multiplier
FROM order_lines, auv""")
def order_multiplier(spark, sf_dir):
    """F9 for every order line."""
    ol = order_lines(spark, sf_dir, ["order_id", "line_no", "order_value", "quantity", "days_to_delivery"])
    auv = F.round(ol.agg(F.avg("order_value") / F.greatest(F.avg("quantity"), F.lit(1.0))).scalar(), 6)
    m = DC.order_multiplier(F.col("order_value"), auv, F.col("days_to_delivery").cast("double"), F.col("quantity"))
    return ol.select("order_id", "line_no", F.round(m, 6).alias("multiplier"))


@query("order_forecast_mean", DECISIONS_SQL
       + "SELECT order_id, line_no, demand_forecast_7d, demand_7d_avg FROM decf")
def order_forecast_mean(spark, sf_dir):
    """each order's scaled 7-day forecast and its mean."""
    return decisions(spark, sf_dir).select("order_id", "line_no", "demand_forecast_7d", "demand_7d_avg")


@query("emergency_orders", DECISIONS_SQL + """SELECT department, is_emergency, COUNT(*) AS n_lines
FROM decf GROUP BY 1, 2""")
def emergency_orders(spark, sf_dir):
    """J2 counted per department."""
    d = decisions(spark, sf_dir)
    return d.groupBy("department", "is_emergency").agg(F.count(F.lit(1)).alias("n_lines"))


@query("route_trigger", DECISIONS_SQL + """SELECT route_type, trigger, COUNT(*) AS n_lines FROM decf GROUP BY 1, 2""")
def route_trigger(spark, sf_dir):
    """Route type and trigger text, counted."""
    d = decisions(spark, sf_dir)
    return d.groupBy("route_type", "trigger").agg(F.count(F.lit(1)).alias("n_lines"))


@query("decision_summary", DECISIONS_SQL + """SELECT order_id, line_no,
  format('Demand, mean of 7 forecast days: {:.1f}', ROUND(demand_raw, 1)) AS step_1_demand,
  format('Delay class {}, score {}', risk_level, CAST(risk_score AS VARCHAR)) AS step_2_risk,
  format('Supplier {}, score {}', CASE WHEN is_anomaly = 1 THEN 'unusual' ELSE 'usual' END,
         COALESCE(CAST(anomaly_score AS VARCHAR), 'unknown')) AS step_3_anomaly,
  'Reorder policy: ' || action AS step_4_rl,
  route_type || ': ' || array_to_string(path_names, ' → ') AS step_5_route FROM decf""")
def decision_summary(spark, sf_dir):
    """The five summary sentences per order line."""
    d = DC.summary_lines(decisions(spark, sf_dir))
    return d.select("order_id", "line_no", "step_1_demand", "step_2_risk", "step_3_anomaly", "step_4_rl",
                    "step_5_route")


@query("audit_brief", DECISIONS_SQL + """SELECT order_id, line_no, format('Decision to review. Expected demand per day over the next week: {}. Delay class: {}. Supplier: {}. Stock action: {}. Route: {}, handled as {}.',
  CAST(demand_7d_avg AS VARCHAR), risk_level, CASE WHEN is_anomaly = 1 THEN 'flagged' ELSE 'not flagged' END, action, route_type,
  CASE WHEN is_emergency THEN 'urgent' ELSE 'routine' END) AS brief FROM decf""")
def audit_brief(spark, sf_dir):
    """The audit brief text per order line."""
    d = decisions(spark, sf_dir)
    return d.select("order_id", "line_no", DC.audit_brief(d).alias("brief"))


@query("history_rows", DECISIONS_SQL + """,
hrates AS (SELECT department, AVG(late_risk) AS r FROM order_lines GROUP BY department)
SELECT order_id, line_no, city, department, FLOOR(order_value * 100.0 + 0.5) / 100.0 AS value, risk_level AS risk,
  is_anomaly = 1 AS anomaly, action, route_type, array_to_string(path_names, ' -> ') AS path,
  ROUND(LEAST(GREATEST(hrates.r, 0.0), 1.0), 4) AS delay_rate
FROM decf LEFT JOIN hrates USING (department)""")
def history_rows(spark, sf_dir):
    """J7 with J10's delay rate (department mean of late lines, clamped to [0, 1]; jitter left out)."""
    x = decision_inputs(spark, sf_dir)
    d = decisions(spark, sf_dir, x)
    rates = small_side(R.delay_rates(x["orders"]))
    d = d.join(rates, "department", "left")
    return d.select("order_id", "line_no", "city", "department", round_half_up("order_value", 2).alias("value"),
                    F.col("risk_level").alias("risk"), (F.col("is_anomaly") == 1).alias("anomaly"), "action",
                    "route_type", F.concat_ws(" -> ", "path_names").alias("path"),
                    F.round(F.least(F.greatest("supplier_delay_rate", F.lit(0.0)), F.lit(1.0)), 4).alias("delay_rate"))


def decision_record(d: DataFrame) -> DataFrame:
    """order_id, line_no and each decision as a nested record."""
    reward = P.reward_parts(F.col("inventory").cast("double"), F.col("demand_7d_avg_raw"), F.col("action_id"), F.col("is_anomaly"))
    parts = {c: reward[c] for c in P.COMPONENTS}
    d = DC.summary_lines(d)
    rec = F.struct(
        F.col("demand_forecast_7d"), F.col("demand_7d_avg"), F.col("risk_level"), F.col("risk_score"),
        F.struct(*[F.col(f"p_{i}").alias(n) for i, n in enumerate(DC.RISK_LABELS)]).alias("risk_probabilities"),
        F.struct((F.col("is_anomaly") == 1).alias("is_anomaly"), F.col("anomaly_score").alias("score")).alias("anomaly"),
        F.struct("action", "action_id", round_half_up("q_value", 3).alias("q_value"),
                 F.round("confidence", 4).alias("confidence"), "q_values", "trained",
                 F.struct(F.struct(*[v.alias(c) for c, v in parts.items()]).alias("components"),
                          P.total_reward(parts).alias("total"),
                          reward["projected_inventory"].alias("projected_inventory")).alias("reward_breakdown"),
                 ).alias("rl_action"),
        F.struct("path_names", F.col("route_cost").alias("total_cost"), "route_type", "trigger").alias("route"),
        F.col("is_emergency"),
        F.struct("step_1_demand", "step_2_risk", "step_3_anomaly", "step_4_rl", "step_5_route").alias("pipeline_summary"),
        F.struct("inventory", "days_to_delivery", F.col("supplier_nation").alias("start_node"),
                 F.col("customer_nation").alias("goal_node"), "order_value", "discount_rate", "quantity")
        .alias("current_state"))
    return d.select("order_id", "line_no", rec.alias("decision"))


@query("decision_json")
def decision_json(spark, sf_dir):
    """Each decision serialised to JSON (rows check: JSON number text differs by engine; see decision_fields)."""
    return decision_record(decisions(spark, sf_dir)).withColumn("decision", F.to_json("decision"))


# where a consumer of the JSON finds each field
_FIELDS = {
    "forecast": "demand_forecast_7d", "demand_7d_avg": "demand_7d_avg", "risk_level": "risk_level", "risk_score": "risk_score",
    **{f"p_{i}": f"risk_probabilities.{n}" for i, n in enumerate(DC.RISK_LABELS)},
    "is_anomaly": "anomaly.is_anomaly", "anomaly_score": "anomaly.score", "action": "rl_action.action",
    "action_id": "rl_action.action_id", "q_value": "rl_action.q_value", "confidence": "rl_action.confidence",
    "trained": "rl_action.trained", **{c: f"rl_action.reward_breakdown.components.{c}" for c in P.COMPONENTS},
    "total": "rl_action.reward_breakdown.total", "projected_inventory": "rl_action.reward_breakdown.projected_inventory",
    "path_names": "route.path_names", "total_cost": "route.total_cost", "route_type": "route.route_type", "trigger": "route.trigger",
    "is_emergency": "is_emergency", "step_2_risk": "pipeline_summary.step_2_risk", "step_4_rl": "pipeline_summary.step_4_rl",
    "inventory": "current_state.inventory", "days_to_delivery": "current_state.days_to_delivery",
    "start_node": "current_state.start_node", "goal_node": "current_state.goal_node",
    "order_value": "current_state.order_value", "quantity": "current_state.quantity",
}


@query("decision_fields", DECISIONS_SQL + """,
oqv AS (SELECT state, """ + ", ".join(
    f"MAX(CASE WHEN action = '{a}' THEN FLOOR(q * 1000.0 + 0.5) / 1000.0 END) AS q_{a.lower()}" for a in ACTIONS.values()) + """ FROM oq GROUP BY state),
acts AS (SELECT action_id, qty FROM actions_t),
jf0 AS (SELECT decf.*, acts.qty, oqv.* EXCLUDE (state) FROM decf JOIN acts USING (action_id) JOIN oqv USING (state)),
jf AS (SELECT *, """ + sql_parts("inventory", "demand_raw", "action_id", "is_anomaly") + """ FROM jf0)
SELECT order_id, line_no, demand_forecast_7d AS forecast, demand_7d_avg, risk_level, risk_score, p_0, p_1, p_2,
  is_anomaly = 1 AS is_anomaly, anomaly_score, action, action_id, FLOOR(q_value * 1000.0 + 0.5) / 1000.0 AS q_value,
  ROUND(confidence, 4) AS confidence, trained, """ + ", ".join(P.COMPONENTS) + ", " + sql_total() + """ AS total, projected_inventory,
  path_names, route_cost AS total_cost, route_type, trigger, is_emergency,
  format('Delay class {}, score {}', risk_level, CAST(risk_score AS VARCHAR)) AS step_2_risk,
  'Reorder policy: ' || action AS step_4_rl, inventory, days_to_delivery, supplier_nation AS start_node,
  customer_nation AS goal_node, ROUND(order_value, 4) AS order_value, quantity, """ + ", ".join(
    f"q_{a.lower()}" for a in ACTIONS.values()) + " FROM jf")
def decision_fields(spark, sf_dir):
    """A6 read back: the JSON text of every decision parsed again, its fields as columns."""
    rec = decision_record(decisions(spark, sf_dir))
    text = rec.select("order_id", "line_no", F.to_json("decision").alias("text"))
    d = text.withColumn("d", F.from_json("text", rec.schema["decision"].dataType))
    fields = [F.col(f"d.{place}").alias(name) for name, place in _FIELDS.items() if name != "order_value"]
    values = [F.col("d.rl_action.q_values")[a].alias(f"q_{a.lower()}") for a in ACTIONS.values()]
    return d.select("order_id", "line_no", *fields, F.round("d.current_state.order_value", 4).alias("order_value"), *values)


@query("history_latest", DECISIONS_SQL + """,
h AS (SELECT order_id, line_no, order_date, product_id, quantity, order_value, department, action, route_type FROM decf
      ORDER BY order_date DESC, order_id DESC, line_no DESC, product_id DESC, quantity DESC, order_value DESC LIMIT 50)
SELECT *, CAST(COUNT(*) OVER () - ROW_NUMBER() OVER (ORDER BY order_date DESC, order_id DESC, line_no DESC,
  product_id DESC, quantity DESC, order_value DESC) + 1 AS BIGINT) AS row_no FROM h""")
def history_latest(spark, sf_dir):
    """The newest 50 decisions, numbered 50..1 (total order: date, keys, then row values)."""
    d = decisions(spark, sf_dir)
    cols = ["order_date", "order_id", "line_no", "product_id", "quantity", "order_value"]
    d = d.select("order_id", "line_no", "order_date", "product_id", "quantity", "order_value", "department",
                 "action", "route_type")
    return DC.history_latest(d, cols)


@query("sample_orders", with_order_lines() + """SELECT order_id, line_no, order_date, quantity FROM order_lines
ORDER BY (((((42 * 1000003 + order_id * 7919) % 2147483647) * 1000003 + line_no * 7921) % 2147483647)),
  order_id, line_no LIMIT 5""")
def sample_orders(spark, sf_dir):
    """Five order lines drawn by a seeded hash of their keys."""
    ol = order_lines(spark, sf_dir, ["order_id", "line_no", "order_date", "quantity"])
    return DC.sample_orders(ol, ["order_id", "line_no"], n=5)


@query("chat_context", """SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS contents,
  COUNT(*) AS n_turns FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk
  FROM conversations) WHERE rk <= 6 AND role IN ('user', 'assistant') AND text IS NOT NULL AND text <> ''
GROUP BY conv_id""")
def chat_context(spark, sf_dir):
    """The replayed turns of every conversation."""
    return DC.chat_context(read_table(spark, sf_dir, "conversations"))


_DEFAULTED = list(DC.REQUEST_DEFAULTS)
_ABSENT_SQL = ", ".join(f"CAST({DC.REQUEST_DEFAULTS[c]} AS DOUBLE) AS {c}" for c in
                        ("supplier_delay_rate", "avg_delivery_time", "price_deviation", "fulfillment_rate",
                         "complaint_freq", "avg_order_value_per_unit"))


@query("requests_defaulted", with_order_lines() + f"""SELECT order_id, line_no,
  CASE WHEN order_id % 3 = 0 THEN 120.0 ELSE CAST(inventory AS DOUBLE) END AS inventory,
  CASE WHEN order_id % 5 = 0 THEN 5.0 ELSE CAST(days_to_delivery AS DOUBLE) END AS days_to_delivery,
  CASE WHEN line_no = 1 THEN 0 ELSE CAST(supplier_nation AS INTEGER) END AS start_node,
  CASE WHEN line_no = 2 THEN 6 ELSE CAST(customer_nation AS INTEGER) END AS goal_node,
  CASE WHEN order_id % 7 = 0 THEN 1.0 ELSE quantity END AS order_quantity,
  CASE WHEN order_id % 11 = 0 THEN 500.0 ELSE ROUND(order_value, 4) END AS order_value,
  CASE WHEN line_no = 3 THEN 0.1 ELSE discount_rate END AS discount_rate, {_ABSENT_SQL} FROM order_lines""")
def requests_defaulted(spark, sf_dir):
    """Order lines as pipeline requests, some fields left null by rule and six absent; all 13 come out filled."""
    ol = order_lines(spark, sf_dir, ["order_id", "line_no", "inventory", "days_to_delivery", "supplier_nation",
                                     "customer_nation", "quantity", "order_value", "discount_rate"])
    oid, line = F.col("order_id"), F.col("line_no")
    req = ol.select("order_id", "line_no", F.when(oid % 3 != 0, F.col("inventory").cast("double")).alias("inventory"),
                    F.when(oid % 5 != 0, F.col("days_to_delivery").cast("double")).alias("days_to_delivery"),
                    F.when(line != 1, F.col("supplier_nation").cast("int")).alias("start_node"),
                    F.when(line != 2, F.col("customer_nation").cast("int")).alias("goal_node"),
                    F.when(oid % 7 != 0, F.col("quantity")).alias("order_quantity"),
                    F.when(oid % 11 != 0, F.round("order_value", 4)).alias("order_value"),
                    F.when(line != 3, F.col("discount_rate")).alias("discount_rate"))
    return DC.apply_defaults(req).select("order_id", "line_no", *_DEFAULTED)


_FORM_SQL = """
form AS (SELECT order_id AS o_id, line_no AS l_no, quantity,
  CASE shipping_mode WHEN 'Same Day' THEN 'Emergency' WHEN 'First Class' THEN 'Expedited' ELSE 'Standard' END AS urgency,
  CASE (((customer_nation % 5) + 5) % 5) WHEN 0 THEN 'Bengaluru' WHEN 1 THEN 'Mumbai' WHEN 2 THEN 'Chennai'
       WHEN 3 THEN 'Delhi' ELSE 'Pune' END AS hub,
  CASE (((supplier_nation % 6) + 6) % 6) WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'Delhi' WHEN 2 THEN 'Chennai'
       WHEN 3 THEN 'Kochi' WHEN 4 THEN 'Guwahati' ELSE 'Surat' END AS source,
  CASE late_risk WHEN 0 THEN 'High' ELSE (CASE WHEN actual_days >= 5 THEN 'Low' ELSE 'Medium' END) END AS reliability,
  inventory - 100 AS inventory, order_value, discount_rate FROM order_lines)"""


def _form(spark, sf_dir):
    """Order lines rendered as order-form inputs (labels chosen by rule; some labels unknown on purpose)."""
    ol = order_lines(spark, sf_dir, ["order_id", "line_no", "quantity", "shipping_mode", "customer_nation",
                                     "supplier_nation", "late_risk", "actual_days", "inventory", "order_value",
                                     "discount_rate"])
    hubs = F.array(*[F.lit(x) for x in ["Bengaluru", "Mumbai", "Chennai", "Delhi", "Pune"]])
    srcs = F.array(*[F.lit(x) for x in ["Mumbai", "Delhi", "Chennai", "Kochi", "Guwahati", "Surat"]])
    return ol.select(
        F.struct("order_id", "line_no").alias("request_id"), "quantity",
        F.when(F.col("shipping_mode") == "Same Day", "Emergency").when(F.col("shipping_mode") == "First Class",
                                                                       "Expedited").otherwise("Standard").alias("urgency"),
        F.element_at(hubs, (F.pmod("customer_nation", F.lit(5)) + 1).cast("int")).alias("hub"),
        F.element_at(srcs, (F.pmod("supplier_nation", F.lit(6)) + 1).cast("int")).alias("source"),
        F.when(F.col("late_risk") == 0, "High").when(F.col("actual_days") >= 5, "Low").otherwise("Medium")
        .alias("reliability"),
        (F.col("inventory") - 100).cast("double").alias("inventory"), "order_value", "discount_rate")


@query("requests_from_presets", with_order_lines(_FORM_SQL, """
urg AS (SELECT * FROM (VALUES ('Standard', 6, 0), ('Expedited', 3, 1), ('Emergency', 1, 2)) t(urgency, days_to_delivery, shipping_mode_enc)),
rel AS (SELECT * FROM (VALUES ('High', 0.95, 3.0, 3.0, 0.05, 0.10), ('Medium', 0.85, 5.0, 10.0, 0.10, 0.20),
  ('Low', 0.55, 9.0, 28.0, 0.40, 0.45)) t(reliability, fulfillment_rate, avg_delivery_time, complaint_freq, price_deviation,
  supplier_delay_rate)),
hubn AS (SELECT * FROM (VALUES ('Bengaluru', 6), ('Mumbai', 0), ('Chennai', 2), ('Delhi', 1)) t(hub, hub_node)),
srcn AS (SELECT * FROM (VALUES ('Mumbai', 0), ('Delhi', 1), ('Chennai', 2), ('Kochi', 11), ('Guwahati', 17)) t(source, source_node)),
f1 AS (SELECT f.*, u.days_to_delivery, u.shipping_mode_enc, r.fulfillment_rate, r.avg_delivery_time, r.complaint_freq,
  r.price_deviation, r.supplier_delay_rate, COALESCE(h.hub_node, 6) AS goal, COALESCE(s.source_node, 0) AS start0,
  CASE WHEN COALESCE(f.quantity, 0) = 0 THEN 1.0 ELSE GREATEST(f.quantity, 1.0) END AS qty
  FROM form f JOIN urg u ON u.urgency = f.urgency JOIN rel r ON r.reliability = f.reliability
  LEFT JOIN hubn h ON h.hub = f.hub LEFT JOIN srcn s ON s.source = f.source)""") + """SELECT o_id AS order_id, l_no AS line_no,
  CAST(GREATEST(CASE WHEN inventory >= 0 THEN inventory ELSE 120.0 END, 0.0) AS DOUBLE) AS inventory,
  CAST(days_to_delivery AS DOUBLE) AS days_to_delivery,
  CASE WHEN start0 = goal THEN (CASE WHEN goal = 0 THEN 1 ELSE 0 END) ELSE start0 END AS start_node, goal AS goal_node,
  qty AS order_quantity, CAST(shipping_mode_enc AS DOUBLE) AS shipping_mode_enc,
  CAST(days_to_delivery + 1 AS DOUBLE) AS actual_days, CAST(days_to_delivery AS DOUBLE) AS scheduled_days,
  CASE WHEN discount_rate >= 0 THEN LEAST(discount_rate, 1.0) ELSE 0.1 END AS discount_rate,
  ROUND(CASE WHEN order_value > 0 THEN order_value ELSE qty * 100.0 END, 4) AS order_value,
  CAST(supplier_delay_rate AS DOUBLE) AS supplier_delay_rate, CAST(avg_delivery_time AS DOUBLE) AS avg_delivery_time,
  CAST(price_deviation AS DOUBLE) AS price_deviation, CAST(fulfillment_rate AS DOUBLE) AS fulfillment_rate,
  CAST(complaint_freq AS DOUBLE) AS complaint_freq FROM f1""")
def requests_from_presets(spark, sf_dir):
    """Order lines entered through the order form's presets (urgency, reliability, hub, source)."""
    r = DC.requests_from_presets(_form(spark, sf_dir))
    r = r.select(F.col("request_id.order_id").alias("order_id"), F.col("request_id.line_no").alias("line_no"),
                 *[c for c in r.columns if c != "request_id"])
    return round_doubles(r)


@query("dept_series_or_global", with_order_lines(sql_spine([]), sql_spine(["department"], "dsp"), """
req AS (SELECT DISTINCT p_brand AS department FROM part UNION SELECT DISTINCT p_type FROM part),
dl AS (SELECT department, order_date, demand FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY department
  ORDER BY order_date DESC) AS rk FROM dsp) WHERE rk <= 30),
gl AS (SELECT order_date, demand FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY order_date DESC) AS rk FROM spine) WHERE rk <= 30)""")
       + """SELECT dl.department, dl.order_date, dl.demand, 'department' AS source FROM dl JOIN req USING (department)
UNION ALL SELECT r.department, g.order_date, g.demand, 'global' FROM req r, gl g
WHERE r.department NOT IN (SELECT department FROM dl)""")
def dept_series_or_global(spark, sf_dir):
    """Requested names (brands and part types from ``part``); types have no department rows -> global series."""
    p = read_table(spark, sf_dir, "part")
    requested = p.select(F.col("p_brand").alias("department")).union(
        p.select(F.col("p_type").alias("department"))).distinct()
    ol = order_lines(spark, sf_dir, ["order_date", "quantity", "department"])
    dl = D.last_days(D.spine(D.daily_demand(ol, ["department"]), ["department"]), ["department"], 30)
    gl = D.last_days(D.spine(D.daily_demand(ol.select("order_date", "quantity"))), None, 30)
    return DC.dept_series_or_global(requested, dl, gl)


# ------------------------------------------------------------ H12 allocation
def warehouse_offers(spark, sf_dir) -> DataFrame:
    """Warehouses (nodes of type warehouse) with capacity, unit cost and shipping cost to each reachable goal.

    capacity = floor(total lane capacity at the node / 100); cost_per_unit = mean order value per unit of
    lines supplied from the node's nation / 100 (2 decimals); shipping_cost = least-cost route time from
    the warehouse to the goal x 0.01 (2 decimals).
    """
    nodes = FX.net_nodes(spark, sf_dir)
    wh = nodes.where(F.col("type") == "warehouse").select(F.col("node_id").alias("warehouse"))
    e = cut_lineage(FX.net_edges(spark, sf_dir))  # read three times
    cap = (e.select(F.col("source").alias("warehouse"), "capacity")
           .unionByName(e.select(F.col("target").alias("warehouse"), "capacity"))
           .groupBy("warehouse").agg(F.floor(F.sum("capacity") / 100).cast("double").alias("capacity")))
    ol = order_lines(spark, sf_dir, ["supplier_nation", "order_value", "quantity"])
    unit = ol.groupBy(F.col("supplier_nation").cast("int").alias("warehouse")).agg(
        F.round(F.avg(F.col("order_value") / F.col("quantity")) / 100, 2).alias("cost_per_unit"))
    adj = RT.adjacency(RT.edge_weights(e))
    best = RT.shortest_paths(adj, wh.select(F.col("warehouse").alias("start")))
    ship = best.select(F.col("start").alias("warehouse"), F.col("node").alias("goal"),
                       F.round(F.col("cents") / 100.0 * 0.01, 2).alias("shipping_cost"))
    return (ship.join(F.broadcast(wh), "warehouse").join(cap, "warehouse")
            .join(unit, "warehouse", "left").fillna(0.0, subset=["cost_per_unit"]))


@query("least_cost_allocation", DECISIONS_SQL + """,
probs AS (SELECT DISTINCT CAST(CASE action_id WHEN 1 THEN 150.0 WHEN 2 THEN 400.0 WHEN 3 THEN 800.0 WHEN 4 THEN 600.0
  ELSE 0.0 END AS DOUBLE) AS target, risk_level = 'HIGH' AS is_high_risk, CAST(customer_nation AS INTEGER) AS goal
  FROM decf),
probs2 AS (SELECT *, CAST(target AS VARCHAR) || ':' || CAST(is_high_risk AS VARCHAR) || ':' || CAST(goal AS VARCHAR)
  AS problem_id FROM probs WHERE target > 0),
wh AS (SELECT node_id AS warehouse FROM nodes WHERE type = 'warehouse'),
cap AS (SELECT warehouse, CAST(FLOOR(SUM(capacity) / 100) AS DOUBLE) AS capacity FROM (
  SELECT source AS warehouse, capacity FROM edges UNION ALL SELECT target, capacity FROM edges) GROUP BY 1),
unitc AS (SELECT CAST(supplier_nation AS INTEGER) AS warehouse, ROUND(AVG(order_value / quantity) / 100, 2) AS cost_per_unit
  FROM order_lines GROUP BY 1),
""" + sql_relaxation(ROUNDS, "SELECT warehouse AS start FROM wh", "wb", "wbest") + """,
offers AS (SELECT b.start AS warehouse, b.node AS goal, ROUND(b.cents / 100.0 * 0.01, 2) AS shipping_cost, c.capacity,
  COALESCE(u.cost_per_unit, 0.0) AS cost_per_unit FROM wbest b JOIN cap c ON c.warehouse = b.start
  LEFT JOIN unitc u ON u.warehouse = b.start),
al AS (SELECT p.problem_id, p.target, o.warehouse, o.capacity,
  o.cost_per_unit + o.shipping_cost * CASE WHEN p.is_high_risk THEN 1.5 ELSE 1.0 END AS unit_cost
  FROM probs2 p JOIN offers o USING (goal)),
al2 AS (SELECT *, LEAST(capacity, GREATEST(0.0, target - COALESCE(SUM(capacity) OVER (PARTITION BY problem_id
  ORDER BY unit_cost, warehouse ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))) AS qty FROM al)
SELECT problem_id, target, list(warehouse ORDER BY warehouse) FILTER (WHERE qty > 0) AS warehouses,
  list(qty ORDER BY warehouse) FILTER (WHERE qty > 0) AS quantities,
  CASE WHEN SUM(capacity) >= target THEN 'OPTIMAL' ELSE 'INFEASIBLE' END AS status,
  ROUND(SUM(qty * unit_cost), 4) AS total_cost FROM al2 GROUP BY problem_id, target""")
def least_cost_allocation(spark, sf_dir):
    """Where to buy each order's reorder quantity: warehouses filled in unit-cost order under capacity."""
    d = decisions(spark, sf_dir)
    target = DC.action_qty(F.col("action_id"))
    probs = d.select(target.alias("target"), (F.col("risk_level") == "HIGH").alias("is_high_risk"),
                     F.col("customer_nation").cast("int").alias("goal")).distinct().where(F.col("target") > 0)
    probs = probs.withColumn("problem_id", F.concat_ws(":", F.col("target").cast("string"),
                                                        F.col("is_high_risk").cast("string"),
                                                        F.col("goal").cast("string")))
    out = DC.least_cost_allocation(probs, warehouse_offers(spark, sf_dir))
    return out.withColumn("total_cost", F.round("total_cost", 4))
