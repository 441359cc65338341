"""Operator 12: the prefix trie of rebuilt conversations.

Turns are dictionary-encoded: every distinct (role, text) gets a number, and only numbers
and byte counts travel on.  A conversation is then a sequence of numbers.  Equal
sequences are counted once; the distinct ones are sorted and dealt by range into shards of at most about
``SHARD_SYMBOLS`` numbers.  A shard inserts its sequences into a ternary search tree, the
median first, and walks it with a stack, adding up members, leaves and savings.  Nodes on a shard's first
or last path may have members in another shard: these two paths go on to the next round with what
the shard has added up for them, and are merged by the same trees, until one shard is left.

Sequences are cut into levels of ``LEVEL_TURNS`` turns, so no row holds an unbounded
conversation.  The node at the end of a full level is the root of a trie of the next level; levels are
worked from the deepest up.  Where only one conversation goes on, its further nodes are a chain that needs no tree.

Positions come from one global sort and counts per partition, so a conversation that holds a third
of all turns is spread over tasks.  Only the digest of a node's list of ends is made in one task for each node, in a stream,
since SHA-256 takes its input in order.

Results: rows with a null conversation id belong to no conversation and are left out.  Null roles and texts
are empty; null turns come first; equal turns are ordered by a hash of role and text, and
repeated rows are turns of their own.  The remainder c % 5 has the sign of c.  Only the id, turn, role and text columns
are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tidewater.llm.common import cut_lineage, number_rows, ship_package

GROUP, HEAD_TURNS = 5, 9
SHARD_SYMBOLS = 1 << 15
# A shard has at least so many paths (of at most LEVEL_TURNS numbers), so every round leaves fewer; 16 times
# as many are merged in one last shard.
SHARD_PATHS = 64
LEVEL_TURNS = 512
NO_CONV = (1 << 63) - 1
PARTITION_BIT = 33  # of monotonically_increasing_id

PAYLOAD = ("n", "m", "kids", "leaves", "saved", "ends", "cls")
PATH = "seq array<long>, size array<long>, " + ", ".join(f"p_{c} array<long>" for c in PAYLOAD)
NODE = ("depth long, conv_id long, parent_conv_id long, parent_key binary, node_key binary, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends long, cls long")


class TernaryTree:
    """Ternary search tree over sequences of numbers; a node is one distinct prefix.

    Each node carries what is known of its prefix: n members, m least conversation, kids, leaves, saved
    (of finished children), ends (conversations that end here) and cls (the least of these).
    """

    def __init__(self) -> None:
        self.top = -1
        self.symbol: list[int] = []
        self.low: list[int] = []
        self.equal: list[int] = []
        self.high: list[int] = []
        self.parent: list[int] = []
        self.size: list[int] = []
        self.n: list[int] = []
        self.m: list[int] = []
        self.kids: list[int] = []
        self.leaves: list[int] = []
        self.saved: list[int] = []
        self.ends: list[int] = []
        self.cls: list[int] = []

    def _new(self, symbol: int, parent: int, size: int) -> int:
        for column, value in ((self.symbol, symbol), (self.low, -1), (self.equal, -1), (self.high, -1), (self.parent, parent),
                              (self.size, size), (self.n, 0), (self.m, NO_CONV), (self.kids, 0), (self.leaves, 0),
                              (self.saved, 0), (self.ends, 0), (self.cls, 0)):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, seq: list[int], sizes: list[int]) -> list[int]:
        """The nodes of the prefixes of ``seq``, made where they lack."""
        symbol, low, equal, high = self.symbol, self.low, self.equal, self.high
        path, parent = [], -1
        for s, size in zip(seq, sizes):
            x = self.top if parent < 0 else equal[parent]
            if x < 0:
                x = self._new(s, parent, size)
                if parent < 0:
                    self.top = x
                else:
                    equal[parent] = x
            else:
                while symbol[x] != s:
                    side = low if s < symbol[x] else high
                    if side[x] < 0:
                        side[x] = self._new(s, parent, size)
                    x = side[x]
            path.append(x)
            parent = x
        return path

    def add(self, path: list[int], payload: list[list[int]]) -> None:
        """Add payload lists to the last nodes of a path."""
        n, m, kids, leaves, saved, ends, cls = payload
        for i, x in enumerate(path[len(path) - len(n):]):
            self.n[x] += n[i]
            self.m[x] = min(self.m[x], m[i])
            self.kids[x] += kids[i]
            self.leaves[x] += leaves[i]
            self.saved[x] += saved[i]
            if ends[i]:
                self.ends[x] += ends[i]
                self.cls[x] = cls[i]

    def parents_first(self) -> list[int]:
        """All nodes, each after its parent, in ascending order of siblings."""
        out, stack = [], [(self.top, False)] if self.top >= 0 else []
        while stack:
            x, ready = stack.pop()
            if ready:
                out.append(x)
                if self.equal[x] >= 0:
                    stack.append((self.equal[x], False))
                continue
            if self.high[x] >= 0:
                stack.append((self.high[x], False))
            stack.append((x, True))
            if self.low[x] >= 0:
                stack.append((self.low[x], False))
        return out

    def sum_up(self, order: list[int], open_: set[int]) -> None:
        """Children into parents; ``open_`` nodes stay as they are, for the next round."""
        for x in reversed(order):
            if x in open_:
                continue
            if not self.kids[x]:
                self.leaves[x] += 1
            self.saved[x] += (self.n[x] - 1) * self.size[x]
            p = self.parent[x]
            if p >= 0:
                self.n[p] += self.n[x]
                self.m[p] = min(self.m[p], self.m[x])
                self.kids[p] += 1
                self.leaves[p] += self.leaves[x]
                self.saved[p] += self.saved[x]


def medians_first(n: int) -> Iterator[int]:
    """The numbers below ``n``, the middle of every range before its halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            stack += [(mid + 1, b), (a, mid)]


def _shard(paths: list[tuple], level: int, first_turn: int, later: bool, last: bool) -> tuple[list[tuple], list[tuple]]:
    """(finished nodes, boundary paths) of one shard of sorted paths.

    ``later``: the paths come from an earlier round, where their nodes were open.  ``last``: no other
    shard exists, so none stays open.
    """
    tree = TernaryTree()
    ends_of: dict[int, list[int]] = {}
    for i in medians_first(len(paths)):
        seq, sizes, *payload = paths[i]
        path = tree.insert(seq, sizes)
        tree.add(path, payload)
        if i in (0, len(paths) - 1):
            ends_of[i] = path
    first, final = ends_of[0], ends_of[len(paths) - 1]
    open_ = set() if last else {*first, *final}
    order = tree.parents_first()
    tree.sum_up(order, open_)
    depth, keys = {}, {}

    def key(x: int) -> bytes:
        """Identity of an open node: a hash over its path."""
        trail = []
        while x >= 0 and x not in keys:
            trail.append(x)
            x = tree.parent[x]
        known = keys[x] if x >= 0 else level.to_bytes(8, "little")
        for y in reversed(trail):
            known = keys[y] = hashlib.blake2b(known + tree.symbol[y].to_bytes(8, "little", signed=True), digest_size=16).digest()
        return known

    nodes = []
    for x in order:
        p = tree.parent[x]
        depth[x] = depth[p] + 1 if p >= 0 else 0
        if x in open_:
            continue
        known = None if p < 0 else tree.symbol[p] if not depth[p] else tree.m[p] if p not in open_ else None
        nodes.append((depth[x] + first_turn, tree.m[x] if depth[x] else tree.symbol[x], known, key(p) if p >= 0 and known is None else None,
                      key(x) if later else None, tree.n[x], tree.kids[x], tree.leaves[x], tree.saved[x], tree.ends[x],
                      tree.cls[x] if tree.ends[x] else None))
    if last:
        return nodes, []
    columns = (tree.n, tree.m, tree.kids, tree.leaves, tree.saved, tree.ends, tree.cls)
    empty = (0, NO_CONV, 0, 0, 0, 0, 0)
    out = [(first, set())] if first is final else [(first, set()), (final, set(first))]
    return nodes, [([tree.symbol[x] for x in path], [tree.size[x] for x in path],
                    *([e if x in told else c[x] for x in path] for c, e in zip(columns, empty))) for path, told in out]


def _round(paths: DataFrame, level: int, first_turn: int, later: bool, last: bool, parts: int, shard_symbols: int,
           shard_paths: int) -> DataFrame:
    """One round of trees over (seq, size, payload): finished nodes and boundary paths (seq not null) in one table."""
    schema = T.StructType.fromDDL(f"{NODE}, {PATH}")
    arrow = to_arrow_schema(schema)
    n_node = len(T.StructType.fromDDL(NODE))
    n_path = len(arrow) - n_node

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple]) -> pa.RecordBatch:
            nodes, rest = _shard(held, level, first_turn, later, last)
            rows = [x + (None,) * n_path for x in nodes] + [(None,) * n_node + x for x in rest]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        held, symbols = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                symbols += len(row[0])
                if symbols >= shard_symbols and len(held) >= shard_paths and not last:
                    yield flush(held)
                    held, symbols = [], 0
        if held:
            yield flush(held)

    ship_package(paths.sparkSession)
    dealt = paths.coalesce(1) if last else paths.repartitionByRange(parts, "seq")
    return dealt.sortWithinPartitions("seq").mapInArrow(run, schema)


def trie_nodes(paths: DataFrame, level: int = 0, first_turn: int = 0, shard_symbols: int = SHARD_SYMBOLS,
               shard_paths: int = SHARD_PATHS) -> DataFrame:
    """The finished nodes of the tries of ``paths`` (checkpointed), round by round."""
    names = [f.name for f in T.StructType.fromDDL(PATH)]
    paths = paths.select(*names)
    most = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done: list[DataFrame] = []
    while True:
        size = paths.agg(F.count(F.lit(1)).alias("paths"), F.coalesce(F.sum(F.size("seq")), F.lit(0)).alias("symbols")).first()
        last = size.symbols <= shard_symbols or size.paths <= 16 * shard_paths
        parts = max(1, min(most, size.paths // shard_paths))
        out = cut_lineage(_round(paths, level, first_turn, bool(done), last, parts, shard_symbols, shard_paths))
        done.append(out.where(F.col("seq").isNull()).drop(*names))
        if last:
            return reduce(DataFrame.union, done)
        paths = out.where(F.col("seq").isNotNull()).select(*names)


def place_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos from 1, id, bytes): dictionary-encoded turns, numbered in their conversation."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.octet_length(text).cast("long").alias("bytes"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("key"),
        F.monotonically_increasing_id().alias("_u"))
    rows = cut_lineage(rows)
    words = cut_lineage(rows.select("key").distinct())
    ids = number_rows(words, words.count(), None, F.col("key"), "id")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("_u")]
    coded = rows.join(ids, "key")
    placed = cut_lineage(coded.repartitionByRange(*order).sortWithinPartitions(*order)
                         .select("conv", "id", "bytes", F.monotonically_increasing_id().alias("_g")))
    part = F.shiftright("_g", PARTITION_BIT)
    counts = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))  # a row a partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    at = F.col("_o") + F.col("_g").bitwiseAND(F.lit((1 << PARTITION_BIT) - 1))
    numbered = cut_lineage(placed.withColumn("_p", part).join(offsets, "_p").select("conv", "id", "bytes", at.alias("at")))
    first = numbered.groupBy("conv").agg(F.min("at").alias("start"))
    return numbered.join(first, "conv").select("conv", (F.col("at") - F.col("start") + 1).alias("pos"), "id", "bytes")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv, total; rows: conv, pos, id, bytes) after the exchange of heads inside a group of five."""
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD_TURNS
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumns(
        {"h": head, "base": F.col("conv") - F.col("conv") % GROUP})
    convs = cut_lineage(convs)
    bases = convs.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = cut_lineage(convs.join(bases, "base", "left").withColumn("lead", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
                        .withColumn("total", F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    heads = turns.where(F.col("pos") < HEAD_TURNS).withColumnRenamed("conv", "base")
    led = convs.select("conv", "base", "h").join(heads, "base").where(F.col("pos") <= F.col("h")).select("conv", "pos", "id", "bytes")
    rest = (turns.join(convs.select("conv", "h", "lead"), "conv").where(F.col("pos") > F.col("h"))
            .select("conv", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "id", "bytes"))
    return convs.select("conv", "total"), cut_lineage(led.union(rest))


def _units(chunks: DataFrame, level: int, turns: int) -> DataFrame:
    """Distinct sequences of one level with their counts; ``chunks``: conv, total, root, ids, sizes."""
    ending = F.col("total") <= (level + 1) * turns
    return cut_lineage(chunks.groupBy("root", "ids").agg(
        F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("m"),
        F.count_if(ending).alias("ends"), F.min(F.when(ending, F.col("conv"))).alias("cls")))


def _as_paths(units: DataFrame, carried: DataFrame | None) -> DataFrame:
    """Units as paths whose last node holds the counts; what goes on below it comes from ``carried`` (m, kids, leaves, saved)."""
    on = F.col("n") - F.col("ends")
    if carried is not None:
        units = units.join(carried, "m", "left")
    got = lambda c, alone: F.coalesce(F.col(c), F.lit(0).cast("long")) if carried is not None else F.lit(0).cast("long")
    below = {c: F.when(on == 0, F.lit(0).cast("long")).when(on == 1, F.lit(alone).cast("long")).otherwise(got(c, alone))
             for c, alone in (("kids", 1), ("leaves", 1), ("saved", 0))}
    last = {"n": F.col("n"), "m": F.col("m"), **below, "ends": F.col("ends"), "cls": F.coalesce("cls", F.lit(0).cast("long"))}
    return units.select(F.concat(F.array("root"), "ids").alias("seq"),
                        F.concat(F.array(F.lit(0).cast("long")), "sizes").alias("size"),
                        *[F.array(last[c]).alias(f"p_{c}") for c in PAYLOAD])


def _ends_digest(members: DataFrame) -> DataFrame:
    """(cls, ends_sha256) of (cls, conv): the digest of each class's ids, ascending, in a stream."""
    schema = "cls long, ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for batch in batches:
            for cls, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if cls != at:
                    if state is not None:
                        out.append((at, state.hexdigest()))
                    at, state = cls, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], names=["cls", "ends_sha256"])
                out = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], names=["cls", "ends_sha256"])

    return members.repartition("cls").sortWithinPartitions("cls", "conv").mapInArrow(run, schema)


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                level_turns: int = LEVEL_TURNS, shard_symbols: int = SHARD_SYMBOLS,
                shard_paths: int = SHARD_PATHS) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = cut_lineage(place_turns(df, conv_col, turn_col, role_col, text_col))
    convs, rows = rebuild(turns)
    top = convs.agg(F.min("conv").alias("root"), F.max("total").alias("longest")).first()
    level_of = F.floor((F.col("pos") - 1) / level_turns).cast("long")
    entry = F.sort_array(F.collect_list(F.struct("pos", "id", "bytes")))  # at most level_turns entries
    chunks = (rows.groupBy("conv", level_of.alias("level")).agg(entry.alias("e"))
              .select("conv", "level", F.col("e.id").alias("ids"), F.col("e.bytes").alias("sizes")))
    empty = F.array().cast("array<long>")
    turnless = convs.where(F.col("total") == 0).select("conv", F.lit(0).cast("long").alias("level"), empty.alias("ids"), empty.alias("sizes"),
                                                       "total")
    chunks = cut_lineage(chunks.join(convs, "conv").select("conv", "level", "ids", "sizes", "total").union(turnless))
    levels = ((top.longest or 1) - 1) // level_turns + 1 if top.root is not None else 0
    starts = chunks.where(F.col("level") == 0).withColumn("root", F.lit(top.root).cast("long"))
    chains = None
    if levels > 1:
        # nodes at the ends of full levels, told apart by two hashes over the whole prefix
        full = chunks.where((F.col("total") >= level_turns) & (F.size("ids") == level_turns))
        prefix = Window.partitionBy("conv").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
        full = full.select("conv", "total", (F.col("level") + 1).alias("level"),
                           *[F.bit_xor(F.xxhash64(F.lit(s), "level", "ids")).over(prefix).alias(f"h{s}") for s in (1, 2)])
        full = cut_lineage(full)
        goes_on = F.col("total") > F.col("level") * level_turns
        ends = cut_lineage(full.groupBy("level", "h1", "h2").agg(F.min("conv").alias("root"), F.count_if(goes_on).alias("on")))
        below = cut_lineage(full.where(goes_on).join(ends, ["level", "h1", "h2"]).select("conv", "level", "root", "on"))
        starts = starts.unionByName(chunks.join(below.where(F.col("on") > 1).drop("on"), ["conv", "level"]))
        single = below.where(F.col("on") == 1).groupBy("conv").agg(F.min_by(F.struct("level", "root"), "level").alias("from"))
        chains = (rows.join(single, "conv").join(convs, "conv").where(F.col("pos") > F.col("from.level") * level_turns))
    starts = cut_lineage(starts)
    nodes: list[DataFrame] = []
    several: list[DataFrame] = []
    carried = None
    for level in range(levels - 1, -1, -1):
        here = starts.where(F.col("level") == level)
        if level and here.isEmpty():
            continue
        units = _units(here, level, level_turns)
        paths = _as_paths(units, carried)
        found = trie_nodes(cut_lineage(paths) if carried is not None else paths, level, level * level_turns, shard_symbols, shard_paths)
        if level:
            at_root = F.col("depth") == level * level_turns
            carried = cut_lineage(found.where(at_root).select(F.col("conv_id").alias("m"), F.col("n_children").alias("kids"),
                                                              F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
            found = found.where(~at_root)
        nodes.append(found)
        ending = here.where(F.col("total") <= (level + 1) * level_turns)
        several.append(ending.join(units.where(F.col("ends") > 1).select("root", "ids", "cls"), ["root", "ids"]).select("cls", "conv"))
    spark = df.sparkSession
    if not nodes:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
                                         "saved_tokens long, ends_sha256 string")
    found = reduce(DataFrame.union, nodes)
    keys = found.where(F.col("node_key").isNotNull()).select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    out = (found.join(keys, "parent_key", "left")
           .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent")).drop("_parent", "parent_key", "node_key"))
    if chains is not None:
        long = lambda c: c.cast("long")
        start = F.col("pos") == F.col("from.level") * level_turns + 1
        at_end = F.col("pos") == F.col("total")
        out = out.unionByName(chains.select(
            F.col("pos").alias("depth"), F.col("conv").alias("conv_id"), F.when(start, F.col("from.root")).otherwise(F.col("conv")).alias("parent_conv_id"),
            long(F.lit(1)).alias("n_convs"), long(~at_end).alias("n_children"), long(F.lit(1)).alias("n_leaves"), long(F.lit(0)).alias("saved_tokens"),
            long(at_end).alias("ends"), F.when(at_end, F.col("conv")).alias("cls")))
    digests = _ends_digest(reduce(DataFrame.union, several))
    shared = F.when(F.col("ends") > 1, F.col("cls"))
    return (out.withColumn("_cls", shared).join(digests.withColumnRenamed("cls", "_cls"), "_cls", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.when(F.col("ends") == 1, F.col("cls").cast("string")).otherwise(F.lit("")), 256))
                    .alias("ends_sha256")))
