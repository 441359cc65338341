"""Model-backed jobs (F1, F2, F4-F8, E2, A3, A4, G1-G5 with models): rows/schema checks only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.constants import RISK_FEATURES, SUPPLIER_FEATURES
from tidewater.functions.joins import small_side
from tidewater.operators import boosting as B
from tidewater.operators import demand as D
from tidewater.operators import iforest as IF
from tidewater.operators import metrics as M
from tidewater.operators import models as ML
from tidewater.operators import policy as P
from tidewater.operators import risk as R
from tidewater.operators import supplier as S
from tidewater.plans.registry import query, round_doubles
from tidewater.session import cut_lineage, scratch_path
from tidewater.sources import versions as V
from tidewater.sources.tables import order_lines

_RISK_IN = ["order_id", "line_no", "order_date", "quantity", "actual_days", "scheduled_days", "shipping_mode",
            "discount_rate", "order_value", "late_risk", "department", "market", "order_region", "category",
            "customer_segment", "order_type", "country"]


def _global_rows(spark, sf_dir, by=None):
    ol = order_lines(spark, sf_dir, ["order_date", "quantity", *(by or [])])
    return ML.demand_training_rows(D.features(ol, by), by)


def _demand_model(spark, sf_dir, by=None):
    return ML.fit_demand_model(_global_rows(spark, sf_dir, by))


@query("demand_gbt_predictions")
def demand_gbt_predictions(spark, sf_dir):
    """boosted-tree demand on the held-out 20% of the global series."""
    rows = _global_rows(spark, sf_dir)
    model = ML.fit_demand_model(rows)
    test = rows.where(~F.col("is_train"))
    return round_doubles(ML.predict_demand_rows(model, test).select("order_date", "demand", "y_pred"))


@query("model_forecast_metrics")
def model_forecast_metrics(spark, sf_dir):
    """G1 with the boosted-tree prediction (7-day rolling sums on the held-out rows)."""
    rows = _global_rows(spark, sf_dir)
    model = ML.fit_demand_model(rows)
    p = ML.predict_demand_rows(model, rows.where(~F.col("is_train")))
    return round_doubles(M.forecast_metrics(p.select("order_date", F.col("demand").alias("y_true"), "y_pred")))


@query("forecast_gbt")
def forecast_gbt(spark, sf_dir):
    """7-day recursive forecast for every department with one model over all department series."""
    by = ["department"]
    model = _demand_model(spark, sf_dir, by)
    ol = order_lines(spark, sf_dir, ["order_date", "quantity", "department"])
    state = ML.history_state(D.spine(D.daily_demand(ol, by), by), by)
    return round_doubles(ML.recursive_forecast(model, state, by, horizon=7))


@query("forecast_gbt_by_product")
def forecast_gbt_by_product(spark, sf_dir):
    """F2 for every product: the global model on each product's own history, 7 recursive steps."""
    ol = order_lines(spark, sf_dir, ["order_date", "quantity", "product_id"])
    state = ML.history_of_days(D.daily_demand(ol, ["product_id"]), ["product_id"])
    return round_doubles(ML.recursive_forecast(_demand_model(spark, sf_dir), state, ["product_id"], horizon=7))


def _risk_features(orders, train):
    """The model columns of ``orders``; department rates and label codes come from the training rows alone."""
    return R.with_label_codes(R.with_delay_rate(orders, rates_from=train), codes_from=train)


def _risk_train(spark, sf_dir):
    """All order lines with the split, and the training rows the rates and codes are taken from."""
    base = R.exact_stratified_split(R.delay_columns(order_lines(spark, sf_dir, _RISK_IN)), ["order_id", "line_no"])
    return base, base.where(~F.col("is_test"))


def _risk_split(spark, sf_dir):
    base, train = _risk_train(spark, sf_dir)
    return _risk_features(base, train)


def _risk_fit(feats):
    """The forest on the training rows of ``feats``."""
    return ML.fit_risk_model(feats.where(~F.col("is_test")), key=[F.col(c) for c in ("order_id", "line_no", *RISK_FEATURES)])


def _risk_scored(spark, sf_dir):
    s = cut_lineage(_risk_split(spark, sf_dir).select("order_id", "line_no", "is_test", "risk_class", *RISK_FEATURES))
    model = _risk_fit(s)
    return ML.score_risk(model, s.where(F.col("is_test"))), model


@query("risk_rf_predictions")
def risk_rf_predictions(spark, sf_dir):
    """random-forest delay class and probabilities on the held-out rows."""
    scored, _ = _risk_scored(spark, sf_dir)
    # written once: the trees grow as they score
    return round_doubles(cut_lineage(scored.select("order_id", "line_no", F.col("risk_class").alias("label"), "prediction",
                                                   "p_0", "p_1", "p_2")))


@query("model_classification_report")
def model_classification_report(spark, sf_dir):
    """G3-G5 for the forest on held-out rows: accuracy, macro P/R/F1 and macro one-vs-rest AUC."""
    scored, _ = _risk_scored(spark, sf_dir)
    s = cut_lineage(scored.select(F.col("risk_class").alias("label"), "prediction", "p_0", "p_1", "p_2"))
    rep = M.classification_report(s)
    auc = M.macro_auc(M.auc_ovr(s))
    return round_doubles(rep.withColumn("auc_macro", auc.scalar()))


@query("risk_importances")
def risk_importances(spark, sf_dir):
    """feature importances of the fitted forest."""
    _, model = _risk_scored(spark, sf_dir)
    return round_doubles(ML.importances(model))


def _supplier_scores(spark, sf_dir, by):
    # a row a group, read by the fit, the scores and the caller
    st = cut_lineage(S.stats(order_lines(spark, sf_dir, [by, "actual_days", "order_value", "late_risk"]), by))
    nodes, psi = IF.fit(st, SUPPLIER_FEATURES)
    scored, _ = IF.score(st, nodes, SUPPLIER_FEATURES, psi)
    return st, scored


@query("supplier_iforest")
def supplier_iforest(spark, sf_dir):
    """Isolation-forest score and flag for every supplier (300 trees, contamination 0.03)."""
    _, scored = _supplier_scores(spark, sf_dir, "supplier")
    return round_doubles(scored.select("supplier", "anomaly_score", "is_anomaly"))


@query("supplier_scorecard")
def supplier_scorecard(spark, sf_dir):
    """The department scorecard with isolation-forest scores, rounded as listed."""
    st, scored = _supplier_scores(spark, sf_dir, "department")
    return S.scorecard(st, scored.select("department", "anomaly_score", "is_anomaly"))


@query("anomaly_summary_iforest")
def anomaly_summary_iforest(spark, sf_dir):
    """E3 over the isolation-forest flags of all suppliers."""
    _, scored = _supplier_scores(spark, sf_dir, "supplier")
    return S.anomaly_summary(scored)


def train(spark, sf_dir, place: str) -> V.Version:
    """A3: fit all models on the tables of ``sf_dir`` and publish them at ``place`` as one version.

    Nothing is visible before the last part is written; an interrupted run leaves the version before it.
    """
    from tidewater.plans.policy_plans import _q
    base, rows = _risk_train(spark, sf_dir)
    st = S.stats(order_lines(spark, sf_dir, ["department", "actual_days", "order_value", "late_risk"]))

    def forest(path):
        nodes, psi = IF.fit(st, SUPPLIER_FEATURES)
        _, offset = IF.score(st, nodes, SUPPLIER_FEATURES, psi)
        nodes.withColumns({"psi": F.lit(psi), "offset": F.lit(offset)}).write.parquet(path)

    return V.publish(spark, place, {
        "demand": lambda path: B.save(_demand_model(spark, sf_dir), spark, path),
        "risk": lambda path: ML.save_model(_risk_fit(_risk_features(rows, rows)), path),
        # what scoring needs of the training rows: the department rates and the label codes
        "risk_rates": V.as_table(R.delay_rates(rows)),
        "risk_codes": V.as_table(R.label_code_table(rows, sorted(set(R.RISK_CODED.values())))),
        "iforest": forest,
        "q_table": V.as_table(_q(spark, sf_dir, 2))})


def score(spark, sf_dir, place: str) -> dict:
    """A4: what the newest version at ``place`` says of the tables of ``sf_dir``, by artifact; absent ones are left out.

    ``risk``: delay class and probabilities of every order line.  ``demand``: the 7-day forecast of
    every department.  ``iforest``: anomaly score and flag of every department.  ``q_table``: the best action of every trained state.
    """
    version = V.newest(spark, place)
    out = {}
    if version is None:
        return out
    if {"risk", "risk_rates", "risk_codes"} <= set(version.parts):
        orders = R.delay_columns(order_lines(spark, sf_dir, _RISK_IN))
        rated = orders.join(small_side(version.table(spark, "risk_rates")), "department", "left")
        out["risk"] = ML.score_risk(ML.load_model(spark, f"{version.folder}/risk"),
                                    R.with_label_codes(rated, codes=version.table(spark, "risk_codes")))
    if "demand" in version.parts:
        by = ["department"]
        series = D.spine(D.daily_demand(order_lines(spark, sf_dir, ["order_date", "quantity", *by]), by), by)
        out["demand"] = ML.recursive_forecast(B.load(spark, f"{version.folder}/demand"), ML.history_state(series, by), by)
    if "iforest" in version.parts:
        st = S.stats(order_lines(spark, sf_dir, ["department", "actual_days", "order_value", "late_risk"]))
        nodes = version.table(spark, "iforest")
        facts = nodes.select("psi", "offset").first()
        scored, _ = IF.score(st, nodes.drop("psi", "offset"), SUPPLIER_FEATURES, facts.psi, offset=facts.offset)
        out["iforest"] = scored.select("department", "anomaly_score", "is_anomaly")
    if "q_table" in version.parts:
        q = version.table(spark, "q_table")
        out["q_table"] = P.best_action(P.q_full(q, q.select("state").distinct()))
    return out


@query("models_roundtrip")
def models_roundtrip(spark, sf_dir):
    """A3/A4: train into a folder, load from it, and compare with models fitted here, artifact by artifact."""
    from tidewater.plans.policy_plans import _q
    base = scratch_path(spark, "models")
    version = train(spark, sf_dir, base)
    scored = score(spark, sf_dir, base)
    rows = _global_rows(spark, sf_dir)
    test = rows.where(~F.col("is_train"))
    a = ML.predict_demand_rows(ML.fit_demand_model(rows), test).select("order_date", F.col("y_pred").alias("a"))
    b = ML.predict_demand_rows(B.load(spark, f"{version.folder}/demand"), test).select("order_date", F.col("y_pred").alias("b"))
    demand = a.join(b, "order_date").agg(F.lit("demand_gbt").alias("artifact"), F.count(F.lit(1)).alias("n_rows"),
                                         F.count_if(F.abs(F.col("a") - F.col("b")) < 1e-9).alias("n_equal"))
    _, fitted = _risk_scored(spark, sf_dir)
    # both models score the same rows in one pass ((order, line) is not a unique key)
    loaded = scored["risk"].withColumnRenamed("prediction", "a").drop("p_0", "p_1", "p_2")
    risk = cut_lineage(ML.score_risk(fitted, loaded).agg(F.lit("risk_rf").alias("artifact"), F.count(F.lit(1)).alias("n_rows"),
                                                         F.count_if(F.col("a") == F.col("prediction")).alias("n_equal")))
    qq = _q(spark, sf_dir, 2).join(version.table(spark, "q_table").withColumnRenamed("q", "q2"),
                                   ["state", "action_id"]).agg(
        F.lit("q_table").alias("artifact"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("q") == F.col("q2")).alias("n_equal"))
    st = S.stats(order_lines(spark, sf_dir, ["department", "actual_days", "order_value", "late_risk"]))
    nodes, psi = IF.fit(st, SUPPLIER_FEATURES)
    sa, _ = IF.score(st, nodes, SUPPLIER_FEATURES, psi)
    sb = scored["iforest"]
    forest = sa.select("department", F.col("anomaly_score").alias("a")).join(
        sb.select("department", F.col("anomaly_score").alias("b")), "department").agg(
        F.lit("iforest").alias("artifact"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.abs(F.col("a") - F.col("b")) < 1e-12).alias("n_equal"))
    return demand.unionByName(risk).unionByName(qq).unionByName(forest)


@query("order_decisions_learned")
def order_decisions_learned(spark, sf_dir):
    """J4 with learned models: recursive boosted-tree forecast as the base, forest delay class,
    isolation-forest department flags and 20-sweep fitted Q values (rows check)."""
    from tidewater.plans import decision_plans as DP
    x = DP.decision_inputs(spark, sf_dir, policy_sweeps=None, columns=DP.DECISION_IN)
    # forecast: 7 recursive steps of the global series
    model = _demand_model(spark, sf_dir)
    ol = order_lines(spark, sf_dir, ["order_date", "quantity"])
    fc = ML.recursive_forecast(model, ML.history_state(D.spine(D.daily_demand(ol))), horizon=7)
    x["base_fc"] = DP.base_forecast(fc)
    # risk: the forest on the 13 order-time features, fitted on the train split; every order is scored once
    split = R.exact_stratified_split(x["orders"], ["order_id", "line_no"])
    feats = cut_lineage(_risk_features(split, split.where(~F.col("is_test"))))
    x["orders"] = cut_lineage(ML.score_risk(_risk_fit(feats), feats).select(*x["orders"].columns, "prediction"))
    x["risk_scorer"] = lambda orders: orders
    # anomaly: the isolation forest on department statistics
    st = S.stats(order_lines(spark, sf_dir, ["department", "actual_days", "order_value", "late_risk"]))
    nodes, psi = IF.fit(st, SUPPLIER_FEATURES)
    scored, _ = IF.score(st, nodes, SUPPLIER_FEATURES, psi)
    x["flags"] = scored.select("department", "anomaly_score", "is_anomaly")
    x["q"] = DP.order_policy(x, 20)
    return DP._decision_out(DP.decisions(spark, sf_dir, x))
