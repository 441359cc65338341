"""Operator 12 against a plain trie on small and random conversations."""

import hashlib
import random
import zlib

import pytest

from tidewater.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, turn_key(r or "", x or ""), (r or "", x or "")))
    own = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    trunc = lambda c: c - (abs(c) % 5) * (1 if c >= 0 else -1)
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(trunc(c), [])[:h] + turns[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], set()).add(c)
    kids, below = {}, {}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, m in nodes.items():
        s = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += s
            leaves[p[:d]] += p not in kids
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest())
                  for p, m in nodes.items())


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r[n] for n in NAMES) for r in pt.prefix_trie(df, **more).collect())


def sort_key(rows):
    return sorted(rows, key=lambda r: (r[1], r[0]))


def random_rows(seed, convs=40, words="abc", longest=14):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-10, 3 * convs), convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("seed,more", [(1, {}), (2, {"shard_symbols": 12, "shard_paths": 4}),
                                       (3, {"level_turns": 5, "shard_symbols": 7, "shard_paths": 4})])
def test_random_conversations(spark, seed, more):
    rows = random_rows(seed, 160)
    assert sort_key(run(spark, rows, **more)) == sort_key(plain_trie(rows))


def test_copies_and_one_long_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 30) for t in range(12)]  # equal conversations
    rows += [(1000, t, "user", f"own {t}") for t in range(150)]  # a third of all turns
    rows += [(1001, t, "user", f"own {t}") for t in range(60)]
    assert sort_key(run(spark, rows, level_turns=25)) == sort_key(plain_trie(rows))


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r[n] for n in NAMES) for r in pt.prefix_trie(df).collect()), key=lambda r: (r[1], r[0]))
    assert got == sort_key(plain_trie(rows))


def test_edges(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (None, 0, "user", "x"), (2, 0, "user", "é漢😀"),
            (2, 0, "assistant", "tie"), (5, 0, "", "w" * 50_000), (5, 1, "user", "a,b"), (6, 0, "user", "one"), (7, 3, "user", "late"),
            (7, None, "user", "early"), (-7, 1, "user", "one"), (11, 0, "user", "alone"), (11, 0, "user", "alone")]
    assert sort_key(run(spark, rows)) == sort_key(plain_trie(rows))
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "'x' AS pos", "1 AS seq", "2 AS root", "3 AS level")
    assert len(pt.prefix_trie(clash).collect()) == len(plain_trie(rows))
    assert pt.prefix_trie(clash.limit(0)).collect() == []
    assert pt.prefix_trie(clash.where("conv_id IS NULL")).collect() == []


def test_median_order_balances_a_level():
    tree = pt.TernaryTree()
    for i in pt.medians_first(1023):
        tree.insert([0, i], [0, 1])
    depth = {tree.equal[tree.top]: 1}
    for x in list(depth):
        stack = [x]
        while stack:
            y = stack.pop()
            for z in (tree.low[y], tree.high[y]):
                if z >= 0:
                    depth[z] = depth[y] + 1
                    stack.append(z)
    assert len(depth) == 1023 and max(depth.values()) == 10
    assert [tree.symbol[x] for x in tree.parents_first()] == [0, *range(1023)]
