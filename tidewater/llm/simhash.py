"""Operator 2: SimHash near-duplicates by a binary trie self-join.

Fingerprints: one bit per position, set when more than half of the text's word
shingles (repeats included) have it set in their XXH64.

Linking: the distinct fingerprints form a binary trie, and pairs of its nodes are
traversed together from the root.  A pair carries the bits in which its two prefixes
differ and is dropped as soon as that exceeds its budget.  Two traversals share the
work so that few pairs survive the dense upper levels: of two fingerprints within
``d`` bits, either the first halves differ in at most d // 2 bits, or the second
halves in at most d - d // 2 - 1, so one traversal starts with the first half under
the first budget, the other with the second half under the second; both end with the
whole budget.  The union is exact.

Upper levels run as Spark joins of node pairs, two bits a round, until both nodes of
a pair hold at most ``LEAF_KEYS`` fingerprints; each such pair is then one bounded
group, traversed further in numpy.  A group reports a spanning forest of its links
(at most one row per fingerprint), never all pairs.  Equal fingerprints are one key.

Results: null and empty texts and texts without words have fingerprint zero and link
like any other.  Rows with a null id take part and get the least non-null id they
reach (null if none).  Repeated rows are kept, one output row each.  Only the named
columns are read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import cut_lineage, map_batches, ship_package
from tidewater.llm.components import components
from tidewater.session import scratch_path

BITS, HALF = 64, 32
SEED = 42
LEAF_KEYS = 32_768
STEP = 2
# Node pairs of one numpy step, and pairs of leaves settled by comparing bits directly.
CHUNK = 1 << 17
DIRECT = 16

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_OFFSET = np.arange(8, dtype=np.intp) * 256


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` lower-cased words, space-joined; fewer words: of all of them."""
    import xxhash
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())], dtype=np.uint64)


def fingerprint(text: str | None, size: int) -> int:
    """The fingerprint as a signed 64-bit number (Spark's long)."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    digits = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_OFFSET
    counts = np.bincount(digits.ravel(), minlength=2048).reshape(8, 256) @ _BIT_TABLE
    bits = (2 * counts.ravel() > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text column unless ``keep_text``) plus fp (long)."""
    rest = [c for c in docs.columns if c != text_col]
    src = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col))

    def run(batch: pa.RecordBatch) -> dict:
        out = {c: batch.column(i) for i, c in enumerate(kept)}
        return out | {"fp": [fingerprint(t, shingle) for t in batch.column(len(rest)).to_pylist()]}

    kept = [*rest, text_col] if keep_text else rest
    return map_batches(src, run, T.StructType([*(src.schema[c] for c in kept), T.StructField("fp", T.LongType())]))


class _Forest:
    """Least-label union of index pairs, vectorised."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def trie_forest(left: np.ndarray, right: np.ndarray | None, head: int, budget: int, same_depth: int, diff: int) -> tuple:
    """Spanning forest of the links between sorted keys ``left`` and ``right`` (None: within left).

    ``head`` bounds the differing bits in the first half, ``budget`` in all.  The two
    nodes' prefixes have ``same_depth`` bits and differ in ``diff`` of them already.
    Returns index pairs (node, root) into left followed by right.
    """
    keys = left if right is None else np.concatenate([left, right])
    n, off = len(keys), 0 if right is None else len(left)
    forest = _Forest(n)
    ones: dict[int, np.ndarray] = {}

    def ones_before(depth: int) -> np.ndarray:
        if depth not in ones:
            bit = (keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int32))]).astype(np.int32)
        return ones[depth]

    def settle(al, ah, bl, bh) -> None:
        """Compare all leaves of small node pairs by their bits, and link those within both budgets."""
        nb = bh - bl
        size = (ah - al) * nb
        total = int(size.sum())
        if not total:
            return
        pair = np.repeat(np.arange(len(size)), size)
        k = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        i, j = al[pair] + k // nb[pair], bl[pair] + k % nb[pair]
        x = keys[i] ^ keys[j]
        near = (np.bitwise_count(x) <= budget) & (np.bitwise_count(x >> np.uint64(HALF)) <= head) & (i != j)
        if near.any():
            forest.link(i[near], j[near])

    arr = lambda v: np.array([v], dtype=np.int32)
    stack = [(same_depth, arr(0), arr(len(left)), arr(off), arr(n), arr(diff))]
    while stack:
        depth, al, ah, bl, bh, df = stack.pop()
        if len(al) > CHUNK:
            for s in range(0, len(al), CHUNK):
                stack.append((depth, *(x[s:s + CHUNK] for x in (al, ah, bl, bh, df))))
            continue
        small = (ah - al).astype(np.int64) * (bh - bl) <= DIRECT
        if depth >= BITS:
            small[:] = True
        if small.any():
            settle(al[small], ah[small], bl[small], bh[small])
            big = ~small
            al, ah, bl, bh, df = al[big], ah[big], bl[big], bh[big], df[big]
        if not len(al):
            continue
        c = ones_before(depth)
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        allowed = min(head, budget) if depth < HALF else budget
        kids = []
        same = al == bl
        for (x0, x1), (y0, y1), cost in (((al, am), (bl, bm), 0), ((am, ah), (bm, bh), 0),
                                         ((al, am), (bm, bh), 1), ((am, ah), (bl, bm), 1)):
            ok = (x1 > x0) & (y1 > y0) & (df + cost <= allowed)
            if cost and x0 is am:
                ok &= ~same  # of a node with itself, the mixed pair counts once
            kids.append([x0[ok], x1[ok], y0[ok], y1[ok], (df[ok] + cost).astype(np.int32)])
        merged = [np.concatenate(p) for p in zip(*kids)]
        if len(merged[0]):
            stack.append((depth + 1, *merged))
    node = np.nonzero(forest.label != np.arange(n))[0]
    return node, forest.label[node]


def _prefix(key: str, depth: int) -> Column:
    return F.shiftrightunsigned(F.col(key), BITS - depth) if depth else F.lit(0).cast("long")


def _rotate(c: Column) -> Column:
    return F.shiftleft(c, HALF).bitwiseOR(F.shiftrightunsigned(c, HALF))


def trie_links(fps: DataFrame, max_bits: int, leaf_keys: int = LEAF_KEYS) -> DataFrame:
    """Links (u, v) that join exactly the fingerprints of ``fps`` (distinct fp) reachable within ``max_bits`` steps."""
    spark = fps.sparkSession
    heads = [max_bits // 2, max_bits - max_bits // 2 - 1]
    turns = [o for o, h in enumerate(heads) if h >= 0]
    keys = reduce(DataFrame.union, [fps.select(F.lit(o).alias("o"), (_rotate(F.col("fp")) if o else F.col("fp")).alias("key"))
                                    for o in turns])
    head = F.when(F.col("o") == 0, heads[0]).otherwise(heads[1])
    n = fps.count()
    front = spark.createDataFrame([(o, 0, 0, 0, n, n) for o in turns], "o int, a long, b long, diff int, ca long, cb long")
    leaves, depth = [], 0
    while True:
        done = (F.greatest("ca", "cb") <= leaf_keys) if depth < BITS else F.lit(True)
        leaves.append((depth, front.where(done)))
        front = front.where(~done)
        if depth >= BITS or front.isEmpty():
            break
        depth += STEP
        nodes = cut_lineage(keys.groupBy("o", _prefix("key", depth).alias("p")).agg(F.count(F.lit(1)).alias("c"))
                            .withColumn("parent", F.shiftrightunsigned("p", STEP)))
        kid = lambda s: nodes.select(F.col("o"), F.col("parent").alias(s), F.col("p").alias(f"p{s}"), F.col("c").alias(f"n{s}"))
        allowed = F.least(head, F.lit(max_bits)) if depth <= HALF else F.lit(max_bits)
        diff = F.col("diff") + F.bit_count(F.col("pa").bitwiseXOR(F.col("pb")).bitwiseAND(F.lit((1 << STEP) - 1)))
        front = cut_lineage(front.drop("ca", "cb").join(kid("a"), ["o", "a"]).join(kid("b"), ["o", "b"])
                            .where((F.col("a") != F.col("b")) | (F.col("pa") <= F.col("pb")))
                            .select("o", F.col("pa").alias("a"), F.col("pb").alias("b"), diff.cast("int").alias("diff"),
                                    F.col("na").alias("ca"), F.col("nb").alias("cb")).where(F.col("diff") <= allowed))
    routed = []
    for d, pairs in leaves:
        sides = pairs.select("o", "a", "b", "diff", F.lit(0).alias("side"), F.col("a").alias("p")).union(
            pairs.where(F.col("a") != F.col("b")).select("o", "a", "b", "diff", F.lit(1), F.col("b")))
        routed.append(keys.withColumn("p", _prefix("key", d)).join(sides, ["o", "p"])
                      .select("o", F.lit(d).alias("depth"), "a", "b", "diff", "side", "key"))
    work = reduce(DataFrame.union, routed)

    def search(task: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, at, _, _, diff = (x.as_py() for x in task)
        side, key = [], []
        for b in batches:
            side.append(b.column("side").to_numpy())
            key.append(b.column("key").to_numpy())
        side, key = np.concatenate(side), np.concatenate(key).view(np.uint64)
        left, right = np.sort(key[side == 0]), np.sort(key[side == 1])
        node, root = trie_forest(left, right if len(right) else None, heads[o], max_bits, at, diff)
        both = np.concatenate([left, right])
        u, v = both[node], both[root]
        if o:
            turn = lambda x: (x << np.uint64(HALF)) | (x >> np.uint64(HALF))
            u, v = turn(u), turn(v)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    ship_package(spark)
    return work.groupBy("o", "depth", "a", "b", "diff").applyInArrow(search, "u long, v long")


def class_ids(rows: DataFrame, max_bits: int, rank: Column, leaf_keys: int = LEAF_KEYS) -> DataFrame:
    """(fp, best): the least ``rank`` among all rows (with fp) that a fingerprint reaches over links of ``max_bits``."""
    classes = cut_lineage(rows.groupBy("fp").agg(F.min(rank).alias("best")))
    roots = components(trie_links(classes.select("fp"), max_bits, leaf_keys))
    rooted = cut_lineage(classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "best", F.coalesce("root", "fp").alias("root")))
    # written before it is joined back, so that the join is dealt out anew and a large component can be split
    least = cut_lineage(rooted.groupBy("root").agg(F.min("best").alias("best")))
    return rooted.drop("best").join(least, "root").select("fp", "best")


def near_duplicates(docs: DataFrame, shingle: int, max_bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id (least id reachable)."""
    rows = cut_lineage(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shingle))
    best = class_ids(rows, max_bits, F.col("doc_id")).withColumnRenamed("best", "component_id")
    return rows.join(best, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int, max_bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the least id (null ids last, then the earliest row).

    Rows get a number that is stored with their fingerprint, so a recomputed task cannot renumber them.
    """
    spark = docs.sparkSession
    place = scratch_path(spark, "simhash-rows")
    cols = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols if c != text_col]).alias("_doc"),
                         F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    fingerprints(packed, shingle, "_text", keep_text=True).write.parquet(place)
    stored = spark.read.parquet(place)
    order = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    rows = stored.select("_row", "_id", "fp")
    best = class_ids(rows, max_bits, order)
    gone = rows.join(best, "fp").where(F.col("best.row") != F.col("_row")).select("_row")
    return stored.join(gone, "_row", "left_anti").select(
        *[(F.col("_text") if c == text_col else F.col("_doc")[c]).alias(c) for c in cols])
