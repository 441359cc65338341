"""Lane weights and shortest routes for many start/goal pairs in one job.

The reference runs one heap search per request.  Here every requested start
is relaxed at once: a frontier of improved (start, node) rows is joined with
the adjacency table, the candidates are reduced to their minimum per
(start, node), and only rows that beat the current best form the next
frontier.  The loop ends when nothing improves (at most |nodes| - 1 rounds
with positive weights).  A state row is (start, node, cost, hops) and no list; paths are rebuilt
from predecessors, for the requested pairs only.  Every round is cut from its lineage with a
reliable checkpoint.

Weights are rounded to cents as in the reference and summed as integers, so
costs are exact and ties are real ties.  Ties are broken by fewer hops, then
by the lexicographically smallest node list, which makes the chosen path
the same in every engine.  The minimum is returned even where the
reference's heuristic is not admissible and its search would return more.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.constants import (AIR_COST_MULTIPLIER, FUEL_COST_PER_KM, NO_PATH_ERROR,
                                           TIME_COST_FACTOR)
from tidewater.functions.exprs import round_half_up
from tidewater.functions.joins import small_side
from tidewater.session import cut_lineage

log = logging.getLogger(__name__)


def edge_weights(edges: DataFrame, mode: str = "time") -> DataFrame:
    """``time`` = distance x traffic; ``cost`` = fuel + time cost, x10 by air; rounded to 2."""
    lane_mode = F.coalesce(F.col("mode"), F.lit("ground"))
    if mode == "time":
        w = F.col("distance") * F.col("traffic")
    else:
        w = F.col("distance") * FUEL_COST_PER_KM + F.col("distance") * F.col("traffic") * TIME_COST_FACTOR
        w = F.when(lane_mode == "air", w * AIR_COST_MULTIPLIER).otherwise(w)
    return edges.withColumn("mode", lane_mode).withColumn("weight", round_half_up(w, 2))


def adjacency(weighted: DataFrame) -> DataFrame:
    """Both directions of every lane (parallel lanes kept), weight in integer cents."""
    cents = F.round(F.col("weight") * 100).cast("long")
    fwd = weighted.select(F.col("source").alias("src"), F.col("target").alias("dst"), cents.alias("w_cents"),
                          "mode")
    back = weighted.select(F.col("target").alias("src"), F.col("source").alias("dst"), cents.alias("w_cents"),
                           "mode")
    return fwd.unionByName(back)


def routing_adjacency(adj: DataFrame) -> DataFrame:
    """The cheapest lane per ordered node pair (a node list cannot tell parallel lanes apart)."""
    return adj.groupBy("src", "dst").agg(F.min("w_cents").alias("w_cents"))


def relax(adj: DataFrame, starts: DataFrame, goals: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """Least (cents, hops) from every start to the nodes it reaches: start, node, cents, hops.

    One aggregate a round merges the state with the candidates and marks what improved; it is written once, with a
    reliable checkpoint.  With ``goals`` (start, goal) the frontier of a start drops what is dearer than all its
    goals, once it has reached them all, so only rows that its goals need are complete.
    """
    a = adj
    state = cut_lineage(starts.select("start").distinct().select(
        "start", F.col("start").alias("node"), F.lit(0).cast("long").alias("cents"), F.lit(0).alias("hops"), F.lit(True).alias("fresh")))
    wanted = None if goals is None else cut_lineage(goals.select("start", F.col("goal").alias("node")).distinct())
    rounds = 0
    while True:
        rounds += 1
        front = state.where("fresh")
        if wanted is not None:
            reach = wanted.join(state.select("start", "node", "cents"), ["start", "node"], "left").groupBy("start").agg(
                F.when(F.count("cents") == F.count(F.lit(1)), F.max("cents")).alias("_far"))
            front = front.join(reach, "start", "left").where(F.col("_far").isNull() | (F.col("cents") <= F.col("_far")))
        cand = front.join(a, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.struct(
            (F.col("cents") + F.col("w_cents")).alias("cents"), (F.col("hops") + 1).alias("hops")).alias("k"), F.lit(None).alias("old"))
        held = state.select("start", "node", F.struct("cents", "hops").alias("k"), F.struct("cents", "hops").alias("old"))
        best = held.unionByName(cand).groupBy("start", "node").agg(F.min("k").alias("k"), F.min("old").alias("old"))
        state = cut_lineage(best.select("start", "node", "k.*", (F.col("old").isNull() | (F.col("k") < F.col("old"))).alias("fresh")))
        n = state.where("fresh").count()
        log.info("route relaxation round %d: %d improved", rounds, n)
        if n == 0 or (max_rounds is not None and rounds >= max_rounds):
            return state.drop("fresh")


def predecessors(state: DataFrame, adj: DataFrame) -> DataFrame:
    """(start, node, pred): the node before each node on its path.

    Among the nodes that give the least cost and hops, the one whose own path is the least node list.  Paths
    of one start with equal hops are ordered by (order of the predecessor's path, node), so an order
    per level of hops decides without any list; levels are only needed where some node has a choice.
    """
    before = state.select("start", F.col("node").alias("pred"), F.col("cents").alias("_c"), F.col("hops").alias("_h"))
    choice = cut_lineage(before.join(adj, F.col("pred") == F.col("src")).join(
        state, (before["start"] == state["start"]) & (F.col("dst") == F.col("node")) & (F.col("_c") + F.col("w_cents") == F.col("cents"))
        & (F.col("_h") + 1 == F.col("hops"))).select(before["start"], "node", "pred", "hops"))
    facts = choice.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("start", "node").alias("nodes"), F.max("hops").alias("deep")).first()
    if facts.n == facts.nodes:
        return choice.select("start", "node", "pred")
    level = state.where(F.col("hops") == 0).select("start", F.col("node").alias("pred"), F.lit(0).alias("_r"))
    out = None
    for h in range(1, facts.deep + 1):
        best = choice.where(F.col("hops") == h).join(level, ["start", "pred"]).groupBy("start", "node").agg(
            F.min(F.struct("_r", "pred")).alias("_p"))
        order = F.row_number().over(Window.partitionBy("start").orderBy("_p._r", "node"))
        found = cut_lineage(best.select("start", "node", "_p.pred", order.alias("_r")))
        level = found.select("start", F.col("node").alias("pred"), "_r")
        out = found.drop("_r") if out is None else out.union(found.drop("_r"))
    return out


def rebuild_paths(state: DataFrame, preds: DataFrame, requests: DataFrame) -> DataFrame:
    """(start, goal, path) of the requested pairs that are reached, by pointer doubling over the predecessors."""
    seen = requests.select("start", "goal").distinct().join(state.select("start", F.col("node").alias("goal"), "hops"), ["start", "goal"])
    seen = seen.select("start", "goal", F.col("goal").alias("node"), F.col("hops").alias("pos"))
    deep = state.agg(F.max("hops")).first()[0] or 0
    jump, step = preds, 1
    while step <= deep:
        back = seen.join(jump, ["start", "node"]).select("start", "goal", F.col("pred").alias("node"), (F.col("pos") - step).alias("pos"))
        seen = cut_lineage(seen.union(back))
        step *= 2
        if step <= deep:
            mid = jump.select("start", F.col("node").alias("pred"), F.col("pred").alias("far"))
            jump = cut_lineage(jump.join(mid, ["start", "pred"]).select("start", "node", F.col("far").alias("pred")))
    return seen.groupBy("start", "goal").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("_p")).select(
        "start", "goal", F.transform("_p", lambda s: s["node"]).alias("path"))


def shortest_paths(adj: DataFrame, starts: DataFrame, goals: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """I4: least-cost path from every start to its goals (``goals``: start, goal), or to every node it reaches.

    ``starts``: one column ``start``.  Returns start, node, cents, hops, path.
    """
    a = cut_lineage(routing_adjacency(adj))
    state = relax(a, starts, goals, max_rounds)
    wanted = state.select("start", F.col("node").alias("goal")) if goals is None else goals
    paths = rebuild_paths(state, predecessors(state, a), wanted)
    return state.join(paths.withColumnRenamed("goal", "node"), ["start", "node"])


def routes(requests: DataFrame, best: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per request the node list, names, cost (2 decimals); no path -> empty lists and an error."""
    r = requests.join(best.withColumnRenamed("node", "goal"), ["start", "goal"], "left")
    named = path_names(r.where(F.col("path").isNotNull()).select("start", "goal", "path"), nodes)
    r = r.join(named, ["start", "goal"], "left")
    found = F.col("path").isNotNull()
    return r.select(
        "start", "goal",
        F.coalesce("path", F.array().cast("array<int>")).alias("path"),
        F.coalesce("path_names", F.array().cast("array<string>")).alias("path_names"),
        F.when(found, F.col("cents") / 100.0).alias("total_cost"),
        F.when(found, F.col("hops")).alias("hops"),
        F.when(~found, F.lit(NO_PATH_ERROR)).alias("error"))


def route_table(best: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every reachable (start, goal) with its node list, names and cost — the look-up for orders.

    Built from the relaxation result alone (|starts| x |reachable nodes| rows);
    pairs that are absent are unreachable.
    """
    b = best.withColumnRenamed("node", "goal")
    named = path_names(b.select("start", "goal", "path"), nodes)
    return b.join(named, ["start", "goal"], "left").select(
        "start", "goal", "path", "path_names", (F.col("cents") / 100.0).alias("total_cost"), "hops")


def path_names(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names along each path: explode with positions, look the names up, reassemble in order."""
    ex = paths.select("start", "goal", F.posexplode("path").alias("pos", "node_id"))
    names = small_side(nodes.select("node_id", "name"))
    j = ex.join(names, "node_id", "left")
    return (j.groupBy("start", "goal")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("_p"))
            .select("start", "goal", F.transform("_p", lambda s: s["name"]).alias("path_names")))


def route_legs(routed: DataFrame) -> DataFrame:
    """Consecutive node pairs of each path; leg key = ``min-max`` of the two ids."""
    ex = routed.select("start", "goal", F.posexplode("path").alias("pos", "a"))
    nxt = routed.select("start", "goal", F.posexplode("path").alias("pos", "b")).withColumn("pos", F.col("pos") - 1)
    legs = ex.join(nxt, ["start", "goal", "pos"])
    return legs.select("start", "goal", F.col("pos").alias("leg"), "a", "b",
                       F.concat_ws("-", F.least("a", "b").cast("string"),
                                   F.greatest("a", "b").cast("string")).alias("leg_key"))


def city_name(name) -> F.Column:
    """Text after the first '-', the whole text when there is none."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(c, r"^[^-]*-", "")


def valid_requests(requests: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with known, different start and goal; and the rejected ones with a reason."""
    ids = nodes.select(F.col("node_id"))
    s_ok = requests.join(ids.withColumnRenamed("node_id", "start"), "start", "left_semi")
    ok = s_ok.join(ids.withColumnRenamed("node_id", "goal"), "goal", "left_semi").where(
        F.col("start") != F.col("goal"))
    known_s = ids.select(F.col("node_id").alias("start"), F.lit(True).alias("_s"))
    known_g = ids.select(F.col("node_id").alias("goal"), F.lit(True).alias("_g"))
    flagged = requests.join(known_s, "start", "left").join(known_g, "goal", "left")
    reason = (F.when(F.col("_s").isNull(), F.concat(F.lit("unknown start "), F.col("start").cast("string")))
              .when(F.col("_g").isNull(), F.concat(F.lit("unknown goal "), F.col("goal").cast("string")))
              .when(F.col("start") == F.col("goal"), F.lit("start equals goal")))
    rejected = flagged.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_s", "_g")
    return ok, rejected
