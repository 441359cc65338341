"""Lane network and route jobs (A5, B10, B13, I1-I7) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import routes as RT
from tidewater.plans.oracle_base import with_order_lines
from tidewater.plans.registry import query, round_doubles
from tidewater.sources import fixtures as FX

# ---------------------------------------------------------------- oracle text
NODES_SQL = """nodes AS (SELECT CAST(n_nationkey AS INTEGER) AS node_id,
  CASE n_nationkey % 3 WHEN 0 THEN 'Warehouse' WHEN 1 THEN 'Supplier' ELSE 'Hub' END || '-' || n_name AS name,
  CAST(-40.0 AS DOUBLE) + CAST(3.3 AS DOUBLE) * n_nationkey AS lat, CAST((((n_nationkey * 47) % 360) + 360) % 360 - 180 AS DOUBLE) AS lon,
  CASE n_nationkey % 3 WHEN 0 THEN 'warehouse' WHEN 1 THEN 'supplier' ELSE 'hub' END AS type FROM nation)"""


def sql_haversine(lat1, lon1, lat2, lon2) -> str:
    a = (f"POW(SIN(RADIANS({lat2} - {lat1}) / 2), 2) + COS(RADIANS({lat1})) * COS(RADIANS({lat2})) * "
         f"POW(SIN(RADIANS({lon2} - {lon1}) / 2), 2)")
    return f"(6371.0 * 2 * ATAN2(SQRT({a}), SQRT(1 - ({a}))))"


LANES_SQL = """lanes AS (SELECT CAST(supplier_nation AS INTEGER) AS source, CAST(customer_nation AS INTEGER) AS target,
  SUM(quantity) AS volume, CAST(SUM(CAST(ROUND(tax * 100) AS BIGINT)) AS DOUBLE) / (COUNT(*) * 100) AS avg_tax FROM order_lines WHERE supplier_nation <> customer_nation GROUP BY 1, 2)"""

EDGES_SQL = """edges AS (SELECT t.source, t.target, ROUND(""" + sql_haversine("a.lat", "a.lon", "b.lat", "b.lon") + """, 6) AS distance,
  CASE WHEN (t.source + t.target) % 7 = 0 THEN 0.1 ELSE FLOOR((1 + t.avg_tax) * CAST(1000000.0 AS DOUBLE) + 0.5) / CAST(1000000.0 AS DOUBLE) END AS traffic,
  CAST(t.volume AS BIGINT) AS capacity,
  CASE WHEN (t.source + t.target) % 7 = 0 THEN 'air' ELSE 'ground' END AS mode
  FROM lanes t JOIN nodes a ON a.node_id = t.source JOIN nodes b ON b.node_id = t.target),
weighted AS (SELECT *, FLOOR(distance * traffic * CAST(100.0 AS DOUBLE) + 0.5) / CAST(100.0 AS DOUBLE) AS w_time,
  FLOOR(CASE WHEN mode = 'air' THEN (distance * 0.08 + distance * traffic * 0.5) * 10.0
        ELSE distance * 0.08 + distance * traffic * 0.5 END * CAST(100.0 AS DOUBLE) + 0.5) / CAST(100.0 AS DOUBLE) AS w_cost FROM edges),
adj AS (SELECT source AS src, target AS dst, CAST(ROUND(w_time * 100) AS BIGINT) AS w_cents, mode FROM weighted
  UNION ALL SELECT target, source, CAST(ROUND(w_time * 100) AS BIGINT), mode FROM weighted),
radj AS (SELECT src, dst, MIN(w_cents) AS w_cents FROM adj GROUP BY 1, 2),
reqs AS (SELECT DISTINCT CAST(supplier_nation AS INTEGER) AS start, CAST(customer_nation AS INTEGER) AS goal
  FROM order_lines)"""


def sql_relaxation(rounds: int, starts_sql: str = "SELECT DISTINCT start FROM reqs", prefix: str = "b",
                   out: str = "rbest") -> str:
    ctes = [f"{prefix}0 AS MATERIALIZED (SELECT DISTINCT start, start AS node, CAST(0 AS BIGINT) AS cents, 0 AS hops, "
            f"[start] AS path FROM ({starts_sql}))"]
    for k in range(rounds):
        ctes.append(f"""{prefix}{k + 1} AS MATERIALIZED (SELECT start, node, m['cents'] AS cents, m['hops'] AS hops,
  m['path'] AS path FROM (SELECT start, node, MIN({{'cents': cents, 'hops': hops, 'path': path}}) AS m FROM (
    SELECT start, node, cents, hops, path FROM {prefix}{k} UNION ALL
    SELECT b.start, a.dst, b.cents + a.w_cents, b.hops + 1, list_append(b.path, a.dst) FROM {prefix}{k} b
    JOIN radj a ON a.src = b.node WHERE NOT list_contains(b.path, a.dst)) GROUP BY start, node))""")
    ctes.append(f"{out} AS (SELECT * FROM {prefix}{rounds})")
    return ",\n".join(ctes)


ROUNDS = 24  # nodes - 1: enough for any simple path in the 25-node network
ROUTE_SQL = with_order_lines(NODES_SQL, LANES_SQL, EDGES_SQL, sql_relaxation(ROUNDS))


# ----------------------------------------------------------------- Spark side
def _weighted(spark, sf_dir, mode="time"):
    return RT.edge_weights(FX.net_edges(spark, sf_dir), mode)


def _best(spark, sf_dir):
    adj = RT.adjacency(_weighted(spark, sf_dir))
    requests = FX.route_requests(spark, sf_dir)
    return RT.shortest_paths(adj, requests.select("start"), requests)


@query("net_nodes", with_order_lines(NODES_SQL) + "SELECT node_id, name, ROUND(lat, 4) AS lat, lon, type FROM nodes")
def net_nodes(spark, sf_dir):
    return round_doubles(FX.net_nodes(spark, sf_dir))


@query("net_edges", with_order_lines(NODES_SQL, LANES_SQL, EDGES_SQL)
       + "SELECT source, target, distance, traffic, capacity, mode FROM edges")
def net_edges(spark, sf_dir):
    """A5: the lane table (every observed lane, 6 decimals), mode defaulting to ground."""
    return FX.net_edges(spark, sf_dir)


@query("haversine_km", with_order_lines(NODES_SQL, LANES_SQL) + "SELECT l.source, l.target, ROUND("
       + sql_haversine("a.lat", "a.lon", "b.lat", "b.lon")
       + ", 4) AS distance FROM lanes l JOIN nodes a ON a.node_id = l.source JOIN nodes b ON b.node_id = l.target")
def haversine_km(spark, sf_dir):
    """I1 on every observed lane."""
    from tidewater.functions.exprs import haversine_km as hv
    lanes = FX.lane_volumes(spark, sf_dir)
    n = FX.net_nodes(spark, sf_dir)
    a = n.select(F.col("node_id").alias("source"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = n.select(F.col("node_id").alias("target"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    j = lanes.join(F.broadcast(a), "source").join(F.broadcast(b), "target")
    return j.select("source", "target", F.round(hv("lat1", "lon1", "lat2", "lon2"), 4).alias("distance"))


@query("edge_weights", with_order_lines(NODES_SQL, LANES_SQL, EDGES_SQL)
       + "SELECT source, target, mode, w_time, w_cost FROM weighted")
def edge_weights(spark, sf_dir):
    """I2 in both modes."""
    t = _weighted(spark, sf_dir, "time").select("source", "target", "mode", F.col("weight").alias("w_time"))
    c = _weighted(spark, sf_dir, "cost").select("source", "target", F.col("weight").alias("w_cost"))
    return t.join(c, ["source", "target"])


@query("adjacency", with_order_lines(NODES_SQL, LANES_SQL, EDGES_SQL) + "SELECT src, dst, w_cents, mode FROM adj")
def adjacency(spark, sf_dir):
    """Every lane in both directions, weights in cents."""
    return RT.adjacency(_weighted(spark, sf_dir))


@query("route_costs", ROUTE_SQL + """SELECT start, node, cents / 100.0 AS cost, hops, path FROM rbest
WHERE (start, node) IN (SELECT start, goal FROM reqs)""")
def route_costs(spark, sf_dir):
    """I4: least-cost path of every requested (start, goal) pair."""
    b = _best(spark, sf_dir).join(FX.route_requests(spark, sf_dir).withColumnRenamed("goal", "node"), ["start", "node"])
    return b.select("start", "node", (F.col("cents") / 100.0).alias("cost"), "hops", "path")


_ROUTES_OUT = ROUTE_SQL + """,
r AS (SELECT q.start, q.goal, b.path, b.cents, b.hops FROM reqs q LEFT JOIN rbest b ON b.start = q.start AND b.node = q.goal),
pn AS (SELECT start, goal, list(name ORDER BY pos) AS path_names FROM (
  SELECT r.start, r.goal, u.pos, n.name FROM r, unnest(r.path) WITH ORDINALITY AS u(node_id, pos)
  JOIN nodes n ON n.node_id = u.node_id) GROUP BY 1, 2)
"""


@query("routes", _ROUTES_OUT + """SELECT r.start, r.goal, COALESCE(r.path, []) AS path,
  COALESCE(pn.path_names, []) AS path_names, r.cents / 100.0 AS total_cost, r.hops,
  CASE WHEN r.path IS NULL THEN 'No path found' END AS error
FROM r LEFT JOIN pn USING (start, goal)""")
def routes(spark, sf_dir):
    """Each requested (supplier nation, customer nation) pair, with node names."""
    b = _best(spark, sf_dir)
    return RT.routes(FX.route_requests(spark, sf_dir), b, FX.net_nodes(spark, sf_dir))


@query("route_legs", ROUTE_SQL + """,
r AS (SELECT q.start, q.goal, b.path FROM reqs q JOIN rbest b ON b.start = q.start AND b.node = q.goal),
e AS (SELECT r.start, r.goal, CAST(u.pos - 1 AS INTEGER) AS leg, u.a, r.path[u.pos + 1] AS b
      FROM r, unnest(r.path) WITH ORDINALITY AS u(a, pos))
SELECT start, goal, leg, a, b, CAST(LEAST(a, b) AS VARCHAR) || '-' || CAST(GREATEST(a, b) AS VARCHAR) AS leg_key
FROM e WHERE b IS NOT NULL""")
def route_legs(spark, sf_dir):
    """Consecutive node pairs of every routed request."""
    b = _best(spark, sf_dir)
    r = RT.routes(FX.route_requests(spark, sf_dir), b, FX.net_nodes(spark, sf_dir))
    return RT.route_legs(r.where(F.size("path") > 0))


@query("city_name", with_order_lines(NODES_SQL)
       + "SELECT node_id, name, regexp_replace(name, '^[^-]*-', '') AS city FROM nodes")
def city_name(spark, sf_dir):
    """Display city of each node."""
    n = FX.net_nodes(spark, sf_dir)
    return n.select("node_id", "name", RT.city_name("name").alias("city"))


REQUESTS_SQL = """,
areqs AS (SELECT start, goal FROM reqs UNION ALL SELECT start + 100, goal FROM reqs WHERE goal = 0
  UNION ALL SELECT start, goal + 100 FROM reqs WHERE start = 1)
"""


def _with_unknown_nodes(spark, sf_dir):
    """The route requests and, by rule, some whose start or goal is no known node."""
    q = FX.route_requests(spark, sf_dir)
    return (q.unionByName(q.where("goal = 0").withColumn("start", F.col("start") + 100))
            .unionByName(q.where("start = 1").withColumn("goal", F.col("goal") + 100)))


@query("route_requests_valid", with_order_lines(NODES_SQL, LANES_SQL, EDGES_SQL)
       + REQUESTS_SQL + """SELECT q.start, q.goal FROM areqs q WHERE q.start IN (SELECT node_id FROM nodes)
  AND q.goal IN (SELECT node_id FROM nodes) AND q.start <> q.goal""")
def route_requests_valid(spark, sf_dir):
    """Requests whose start and goal are known nodes and differ."""
    ok, _ = RT.valid_requests(_with_unknown_nodes(spark, sf_dir), FX.net_nodes(spark, sf_dir))
    return ok.select("start", "goal")


@query("route_requests_rejected", with_order_lines(NODES_SQL, LANES_SQL, EDGES_SQL)
       + REQUESTS_SQL + """SELECT start, goal, CASE WHEN start NOT IN (SELECT node_id FROM nodes) THEN 'unknown start ' || CAST(start AS VARCHAR)
  WHEN goal NOT IN (SELECT node_id FROM nodes) THEN 'unknown goal ' || CAST(goal AS VARCHAR)
  ELSE 'start equals goal' END AS reason
FROM areqs WHERE start NOT IN (SELECT node_id FROM nodes) OR goal NOT IN (SELECT node_id FROM nodes) OR start = goal""")
def route_requests_rejected(spark, sf_dir):
    """Rejected requests with the reason the reference reports."""
    _, bad = RT.valid_requests(_with_unknown_nodes(spark, sf_dir), FX.net_nodes(spark, sf_dir))
    return bad.select("start", "goal", "reason")


@query("candidate_lanes", with_order_lines(NODES_SQL, LANES_SQL, EDGES_SQL)
       + """SELECT q.start, q.goal FROM reqs q JOIN nodes s ON s.node_id = q.start AND s.type IN ('supplier', 'warehouse')
  JOIN nodes g ON g.node_id = q.goal AND g.type IN ('warehouse', 'hub') WHERE q.start <> q.goal""")
def candidate_lanes(spark, sf_dir):
    """Requests whose start is a supplier or warehouse and goal a warehouse or hub, start != goal."""
    n = FX.net_nodes(spark, sf_dir)
    starts = n.where(F.col("type").isin("supplier", "warehouse")).select(F.col("node_id").alias("start"))
    goals = n.where(F.col("type").isin("warehouse", "hub")).select(F.col("node_id").alias("goal"))
    q = FX.route_requests(spark, sf_dir)
    return (q.join(F.broadcast(starts), "start", "left_semi").join(F.broadcast(goals), "goal", "left_semi")
            .where(F.col("start") != F.col("goal")).select("start", "goal"))
