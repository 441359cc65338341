"""Routes: a toy network with a known answer, and properties on the fixture network."""


from tidewater.operators import routes as RT
from tidewater.sources import fixtures as FX

from sfdirs import SF_MID


def _toy(spark):
    e = spark.createDataFrame([
        (0, 1, 10.0, 1.0, 5, "ground"), (1, 2, 10.0, 1.0, 5, "ground"), (0, 2, 25.0, 1.0, 5, None),
        (2, 3, 5.0, 1.0, 5, "ground"), (0, 3, 100.0, 0.1, 5, "air"),
    ], "source int, target int, distance double, traffic double, capacity long, mode string")
    nodes = spark.createDataFrame([(i, f"Hub-City{i}") for i in range(5)], "node_id int, name string")
    return e, nodes


def test_toy_shortest_paths(spark):
    e, nodes = _toy(spark)
    adj = RT.adjacency(RT.edge_weights(e, "time"))
    req = spark.createDataFrame([(0, 3), (3, 0), (0, 4)], "start int, goal int")
    best = RT.shortest_paths(adj, req.select("start"))
    r = {(x.start, x.goal): x for x in RT.routes(req, best, nodes).collect()}
    assert r[(0, 3)].path == [0, 3] and abs(r[(0, 3)].total_cost - 10.0) < 1e-9   # air: 100 km x 0.1 beats 25
    assert r[(3, 0)].total_cost == r[(0, 3)].total_cost                                   # undirected
    assert r[(0, 4)].path == [] and r[(0, 4)].error == "No path found"
    assert r[(0, 3)].path_names[0] == "Hub-City0"


def test_cost_mode_multiplies_air(spark):
    e, _ = _toy(spark)
    w = {(x.source, x.target): x.weight for x in RT.edge_weights(e, "cost").collect()}
    assert abs(w[(0, 3)] - round((100 * 0.08 + 100 * 0.1 * 0.5) * 10, 2)) < 1e-9
    assert abs(w[(0, 2)] - round(25 * 0.08 + 25 * 0.5, 2)) < 1e-9          # missing mode -> ground


def test_fixture_routes_properties(spark):
    adj = RT.adjacency(RT.edge_weights(FX.net_edges(spark, SF_MID)))
    starts = FX.route_requests(spark, SF_MID).select("start")
    best = RT.shortest_paths(adj, starts)
    b = {(r.start, r.node): r.cents for r in best.collect()}
    for (s, n), c in b.items():
        if (n, s) in b:
            assert b[(n, s)] == c                                  # symmetric
    for r in adj.collect():
        if (r.src, r.dst) in b:
            assert b[(r.src, r.dst)] <= r.w_cents                  # never worse than a direct lane


def test_city_name(spark):
    df = spark.createDataFrame([("Warehouse-Mumbai",), ("Hub-New-Delhi",), ("Solo",)], "name string")
    assert [r[0] for r in df.select(RT.city_name("name")).collect()] == ["Mumbai", "New-Delhi", "Solo"]


def test_request_validation(spark):
    nodes = spark.createDataFrame([(0, "a"), (1, "b")], "node_id int, name string")
    req = spark.createDataFrame([(0, 1), (0, 0), (5, 1), (1, 9)], "start int, goal int")
    ok, bad = RT.valid_requests(req, nodes)
    assert [(r.start, r.goal) for r in ok.collect()] == [(0, 1)]
    reasons = {(r.start, r.goal): r.reason for r in bad.collect()}
    assert reasons[(0, 0)] == "start equals goal"
    assert reasons[(5, 1)] == "unknown start 5"
    assert reasons[(1, 9)] == "unknown goal 9"


def _plain_paths(lanes, start):
    """Least (cents, hops, node list) by exhaustive relaxation over lists."""
    best = {start: (0, 0, [start])}
    while True:
        new = dict(best)
        for n, (c, h, p) in best.items():
            for a, b, w in lanes:
                for x, y in ((a, b), (b, a)):
                    if x == n and y not in p and (y not in new or (c + w, h + 1, p + [y]) < new[y]):
                        new[y] = (c + w, h + 1, p + [y])
        if new == best:
            return best
        best = new


def test_paths_with_many_ties_equal_plain_lists(spark):
    import random
    rng = random.Random(4)
    lanes = {(a, b): rng.randint(1, 3) for a in range(14) for b in range(a) if rng.random() < 0.35}
    lanes = [(a, b, w) for (a, b), w in lanes.items()] + [(20, 21, 1)]
    adj = spark.createDataFrame(lanes + [(b, a, w) for a, b, w in lanes], "src int, dst int, w_cents long")
    starts = spark.createDataFrame([(0,), (3,), (20,)], "start int")
    want = {(s, n): v for s in (0, 3, 20) for n, v in _plain_paths(lanes, s).items()}
    got = {(r.start, r.node): (r.cents, r.hops, r.path) for r in RT.shortest_paths(adj, starts).collect()}
    assert got == want
    pairs = [(0, 5), (0, 9), (3, 3), (20, 5), (3, 21)]
    goals = spark.createDataFrame(pairs, "start int, goal int")
    some = {(r.start, r.node): (r.cents, r.hops, r.path) for r in RT.shortest_paths(adj, starts, goals).collect()}
    assert some == {k: want[k] for k in pairs if k in want}
    a = RT.routing_adjacency(adj)
    assert RT.relax(a, starts, goals).count() <= RT.relax(a, starts).count()


def test_routes_over_the_large_supplier_customer_network(spark):
    """Lanes between single suppliers and customers (FIXTURES, large network); no list in the state, few requested pairs."""
    lanes = FX.net_edges_large(spark, SF_MID).checkpoint()
    assert lanes.count() > 40_000
    adj = RT.adjacency(lanes.withColumn("mode", RT.F.lit("ground")))
    pairs = spark.createDataFrame([(0, 1_000_010), (0, 1_000_999), (5, 1_000_400), (7, 7)], "start int, goal int")
    state = RT.relax(RT.routing_adjacency(adj).checkpoint(), pairs.select("start"), pairs)
    assert state.columns == ["start", "node", "cents", "hops"]
    w = {}
    for r in adj.select("src", "dst", "w_cents").collect():
        w[(r.src, r.dst)] = min(w.get((r.src, r.dst), 1 << 60), r.w_cents)
    for r in RT.shortest_paths(adj, pairs.select("start"), pairs).collect():
        assert r.path[0] == r.start and r.path[-1] == r.node and len(r.path) == r.hops + 1
        assert sum(w[x] for x in zip(r.path, r.path[1:])) == r.cents
