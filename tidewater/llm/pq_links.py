"""Operator 13: near-duplicate embeddings by product quantisation.

Links: cosine >= ``min_cosine`` in double precision.  Of unit vectors that is a
distance of at most r = sqrt(2 - 2 * min_cosine), which every filter below uses.

1. Equal vectors collapse to one class with a weight, so copies never pair up.
2. An index is fitted on a bounded sample: coarse centroids, and codebooks of the residuals
   in ``SUBSPACES`` subspaces.  Every class is indexed: its list (nearest
   centroid), its residual codes, and the distance e between it and its decoded form.
3. Probes.  Let a and b be in different lists.  The plane halfway between the two centroids
   separates them, and the distances of a and b from it add up to at most |a - b|.  So of
   two vectors within r, one lies within r / 2 of that plane, and probing every
   list whose plane is that near (``reach``) finds all links.  A smaller reach probes less
   and may lose links.
4. In a probed list the asymmetric distance of the query to each decoded member comes from
   table look-ups; a member whose distance exceeds r + e cannot link (triangle
   inequality) and is dropped.  The rest are settled by the exact cosine.

Lists are packed into blocks of members of bounded size, large lists split, and queries of a block are dealt
into groups, so no list, copy group or hot vector meets in one task.  A pair that both sides would find counts where the
class of smaller number is the query.  A group returns link counts per class and a spanning forest of its links,
never pairs.

Results: vectors that are null, empty, zero, or hold a null or non-finite component link with
nothing, not even their copies.  Vectors of different lengths never link.  Null ids: the row takes part, kept is false, and a
component id is the least non-null id (null if there is none).  Repeated rows and ids are rows of their own and link like
others.  Only the id and vector columns are read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import cut_lineage, map_batches, ship_package
from tidewater.llm.components import components

MIN_COSINE = 0.9
# Rows of the sample that the index is fitted on (least hashes of the class number).
SAMPLE_ROWS = 16_384
MAX_LISTS = 1024
SUBSPACES, CODES = 8, 128
TRAIN_ROUNDS = 8
# Members of a block (twice that at most) and queries of a group.
BLOCK_ROWS, GROUP_ROWS = 4096, 32_768
CHUNK = 1024
# Covers the rounding of 32-bit table sums and of distances near the limit.
SLACK = 1e-4


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # lists x dim
    books: np.ndarray      # subspaces x codes x width (zero padded)
    spans: tuple           # (start, end) of each subspace
    gaps: np.ndarray       # lists x lists, distances between centroids


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; a power of two is taken out first, so norms neither overflow nor vanish."""
    scaled = scale_rows(x)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def scale_rows(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two (exact), the largest component between 1/2 and 1."""
    _, e = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(np.ldexp(x, -(e // 2)[:, None]), -(e - e // 2)[:, None])


def _means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd's algorithm from the first ``k`` rows of a sample in hash order."""
    c = x[:k].copy()
    for _ in range(rounds):
        at = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
        order = np.argsort(at, kind="stable")
        full = np.unique(at)
        sums = np.add.reduceat(x[order], np.searchsorted(at[order], full), axis=0)
        c[full] = sums / np.bincount(at, minlength=len(c))[full][:, None]
    return c


def train(sample: list[np.ndarray], lists: int) -> Index:
    """The index from a bounded sample of vectors; its dimension is the commonest in the sample."""
    sizes = np.array([len(v) for v in sample])
    values, counts = np.unique(sizes, return_counts=True)
    dim = int(values[counts.argmax()])
    x = unit_rows(np.stack([v for v in sample if len(v) == dim]))
    c = _means(x, min(lists, len(x)), TRAIN_ROUNDS)
    rest = x - c[((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)]
    m = min(SUBSPACES, dim)
    edges = [dim * i // m for i in range(m + 1)]
    books = np.zeros((m, min(CODES, len(x)), max(b - a for a, b in zip(edges, edges[1:]))))
    for s, (a, b) in enumerate(zip(edges, edges[1:])):
        books[s, :, :b - a] = _means(np.ascontiguousarray(rest[:, a:b]), books.shape[1], TRAIN_ROUNDS)
    gaps = np.sqrt(np.maximum((c * c).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (c @ c.T), 0.0))
    return Index(c, books, tuple(zip(edges, edges[1:])), gaps)


def _fit(u: np.ndarray, dim: int) -> np.ndarray:
    """The first ``dim`` components, zero padded."""
    out = np.zeros((len(u), dim))
    w = min(dim, u.shape[1])
    out[:, :w] = u[:, :w]
    return out


def encode(index: Index, u: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list, codes, error, probed) of unit rows of any one length; ``probed`` is a mask over lists."""
    c = index.centroids
    x = _fit(u, c.shape[1])
    d = (c * c).sum(axis=1) - 2 * (x @ c.T)
    home = d.argmin(axis=1)
    probed = d - d[np.arange(len(x)), home][:, None] <= 2 * (reach + SLACK) * index.gaps[home] + SLACK
    probed[np.arange(len(x)), home] = True
    decoded = c[home].copy()
    codes = np.empty((len(x), len(index.spans)), dtype=np.uint8)
    for s, (a, b) in enumerate(index.spans):
        book = index.books[s, :, :b - a]
        rest = x[:, a:b] - c[home][:, a:b]
        codes[:, s] = ((book * book).sum(axis=1) - 2 * (rest @ book.T)).argmin(axis=1)
        decoded[:, a:b] += book[codes[:, s]]
    tail = np.maximum((u * u).sum(axis=1) - (x * x).sum(axis=1), 0.0)
    error = np.sqrt(((x - decoded) ** 2).sum(axis=1) + tail)
    return home, codes, error, probed


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least reachable index of each of ``n`` nodes over the links (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _candidates(index: Index, qx: np.ndarray, probed: np.ndarray, home: np.ndarray, codes: np.ndarray, error: np.ndarray,
                square: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member) pairs that the asymmetric distances leave, list by list.

    ``square`` is the squared norm of each decoded member, ``home`` its list.
    """
    width = index.books.shape[1]
    books = index.books.astype(np.float32)
    asked = np.ascontiguousarray(qx.T, dtype=np.float32)
    to_list = (index.centroids @ qx.T).astype(np.float32)
    rows = codes.astype(np.intp) + np.arange(codes.shape[1]) * width
    # 1 + square - 2 * dot <= (radius + error)^2, solved for the dot product with the decoded member
    least = ((1 + square - (radius + error + SLACK) ** 2) / 2).astype(np.float32)
    tables = np.empty((len(index.spans) * width, asked.shape[1]), dtype=np.float32)
    for lst in np.unique(home):
        q = np.nonzero(probed[:, lst])[0]
        if not len(q):
            continue
        own = tables[:, :len(q)]
        mine = asked[:, q]
        for s, (a, b) in enumerate(index.spans):
            np.matmul(books[s, :, :b - a], mine[a:b], out=own[s * width:(s + 1) * width])
        m = np.nonzero(home == lst)[0]
        for part in np.array_split(m, -(-len(m) // CHUNK)):
            dot = own[rows[part, 0]]
            for s in range(1, rows.shape[1]):
                dot += own[rows[part, s]]
            at, qi = np.nonzero(dot >= least[part][:, None] - to_list[lst, q])
            yield q[qi], part[at]


def _search(index: Index, min_cosine: float, radius: float, group: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one group: per class number its added link weight, and forest links (u, v); see ``link_counts``."""
    member = group["side"] == 0
    number, weight, home, vectors = group["number"], group["weight"], group["home"], group["v"]
    n = len(number)
    added = np.zeros(n, dtype=np.int64)
    found_i, found_j = [], []
    sizes = np.array([len(v) for v in vectors])
    lists = len(index.centroids)
    for dim in np.unique(sizes):
        mi, qi = np.nonzero(member & (sizes == dim))[0], np.nonzero(~member & (sizes == dim))[0]
        if not len(mi) or not len(qi):
            continue
        mv = scale_rows(np.stack([vectors[i] for i in mi]).astype(np.float64))
        mn = np.sqrt((mv * mv).sum(axis=1))
        bits = lambda at: np.unpackbits(np.frombuffer(b"".join(group["probes"][i] for i in at), dtype=np.uint8)
                                        .reshape(len(at), -1), axis=1, count=lists).astype(bool)
        m_probes = bits(mi)
        codes = np.frombuffer(b"".join(group["codes"][i] for i in mi), dtype=np.uint8).reshape(len(mi), -1)
        decoded = index.centroids[home[mi]].copy()
        for s, (a, b) in enumerate(index.spans):
            decoded[:, a:b] += index.books[s, codes[:, s], :b - a]
        square, error = (decoded * decoded).sum(axis=1), group["error"][mi]
        for s in range(0, len(qi), CHUNK):
            q = qi[s:s + CHUNK]
            qv = scale_rows(np.stack([vectors[i] for i in q]).astype(np.float64))
            qn = np.sqrt((qv * qv).sum(axis=1))
            unit = _fit(qv / qn[:, None], index.centroids.shape[1])
            for a, b in _candidates(index, unit, bits(q), home[mi], codes, error, square, radius):
                # found from both sides: it counts where the smaller number asks
                twice = m_probes[b, home[q][a]]
                once = np.where(twice, number[q][a] < number[mi][b], number[q][a] != number[mi][b])
                a, b = a[once], b[once]
                for t in range(0, len(a), CHUNK * 64):
                    x, y = a[t:t + CHUNK * 64], b[t:t + CHUNK * 64]
                    cosine = np.einsum("ij,ij->i", qv[x], mv[y]) / (qn[x] * mn[y])
                    near = cosine >= min_cosine
                    i, j = q[x[near]], mi[y[near]]
                    np.add.at(added, i, weight[j])
                    np.add.at(added, j, weight[i])
                    found_i.append(i)
                    found_j.append(j)
    if not found_i:
        return added, np.empty(0, dtype=np.intp), np.empty(0, dtype=np.intp)
    root = _forest(n, np.concatenate(found_i), np.concatenate(found_j))
    node = np.nonzero(root != np.arange(n))[0]
    return added, node, root[node]


def _lists_for(n: int) -> int:
    """About the square root of the classes, as a power of two."""
    return int(min(MAX_LISTS, max(1, 1 << max(0, (max(n, 1).bit_length() + 1) // 2))))


def index_classes(classes: DataFrame, index: Index, reach: float) -> DataFrame:
    """``classes`` (number, weight, v) plus home, codes, error and probes (a bit a list)."""
    names = classes.columns

    def run(batch: pa.RecordBatch) -> dict:
        out = {n: batch.column(n) for n in names}
        vectors = [np.asarray(v, dtype=np.float64) for v in batch.column("v").to_numpy(zero_copy_only=False)]
        sizes = np.array([len(v) for v in vectors])
        n = len(vectors)
        home, error = np.zeros(n, dtype=np.int32), np.zeros(n)
        codes, probes = [b""] * n, [b""] * n
        for dim in np.unique(sizes):
            at = np.nonzero(sizes == dim)[0]
            h, c, e, p = encode(index, unit_rows(np.stack([vectors[i] for i in at])), reach)
            home[at], error[at] = h, e
            packed = np.packbits(p, axis=1)
            for r, i in enumerate(at):
                codes[i], probes[i] = c[r].tobytes(), packed[r].tobytes()
        return out | {"home": home, "error": error, "codes": codes, "probes": probes}

    extra = T.StructType.fromDDL("home int, error double, codes binary, probes binary")
    return map_batches(classes, run, T.StructType([*classes.schema.fields, *extra.fields]))


def _blocks(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Per list (first block, blocks): small lists share a block of at most twice BLOCK_ROWS, larger ones are split."""
    out, block, filled = {}, 0, 0
    for lst in sorted(counts):
        n = counts[lst]
        if n > BLOCK_ROWS:
            block += bool(filled)
            parts = -(-n // BLOCK_ROWS)
            out[lst] = (block, parts)
            block, filled = block + parts, 0
        else:
            out[lst] = (block, 1)
            filled += n
            if filled >= BLOCK_ROWS:
                block, filled = block + 1, 0
    return out


def link_counts(classes: DataFrame, min_cosine: float = MIN_COSINE, reach: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(number, added): the weight of other classes linked to each class that has links; and links (u, v) of a spanning forest.

    ``classes``: checkpointed rows (number: unique long, weight: long, v: array of finite numbers, not all zero).
    """
    spark = classes.sparkSession
    radius = float(np.sqrt(2 - 2 * min_cosine))
    sample = classes.select("v").orderBy(F.xxhash64("number"), "number").limit(SAMPLE_ROWS)  # bounded by SAMPLE_ROWS
    rows = [np.asarray(r.v, dtype=np.float64) for r in sample.collect()]
    if not rows:
        none = spark.createDataFrame([], "u long, v long, added long")
        return none.select(F.col("u").alias("number"), "added"), none.select("u", "v")
    n = classes.count()
    index = train(rows, _lists_for(n))
    indexed = cut_lineage(index_classes(classes, index, radius / 2 if reach is None else reach))
    counts = {r.home: r.c for r in indexed.groupBy("home").agg(F.count(F.lit(1)).alias("c")).collect()}  # a row a list
    place = _blocks(counts)
    groups = max(1, -(-n // GROUP_ROWS))
    lists = len(index.centroids)
    first = np.array([place.get(i, (0, 0))[0] for i in range(lists)])
    parts = np.array([place.get(i, (0, 0))[1] for i in range(lists)])

    def targets(batch: pa.RecordBatch) -> dict:
        """Blocks that a class is asked in: all blocks of the lists it probes."""
        mask = np.unpackbits(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1),
                             axis=1, count=lists).astype(bool)
        out = []
        for row in mask:
            asked = np.nonzero(row & (parts > 0))[0]
            out.append(np.unique(np.concatenate([np.arange(first[i], first[i] + parts[i]) for i in asked])))
        return {f: batch.column(f) for f in batch.schema.names} | {"blocks": out}

    hashed = F.xxhash64("number")
    part = F.element_at(F.array(*[F.lit(int(p)) for p in np.maximum(parts, 1)]), F.col("home") + 1)
    start = F.element_at(F.array(*[F.lit(int(p)) for p in first]), F.col("home") + 1)
    members = indexed.select(F.lit(0).alias("side"), (start + F.pmod(hashed, part)).cast("int").alias("block"),
                             F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "number", "weight", "home", "v",
                             "error", "codes", "probes")
    asked = map_batches(indexed.select("probes", "number", "weight", "home", "v"), targets,
                        T.StructType([*indexed.select("probes", "number", "weight", "home", "v").schema.fields,
                                      *T.StructType.fromDDL("blocks array<int>").fields]))
    queries = asked.select(F.lit(1).alias("side"), F.explode("blocks").alias("block"),
                           F.pmod(F.xxhash64("number", F.lit(1)), F.lit(groups)).cast("int").alias("grp"), "number", "weight", "home",
                           "v", F.lit(0.0).alias("error"), F.lit(b"").alias("codes"), "probes")

    def search(task: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list] = {c: [] for c in ("side", "number", "weight", "home", "error")}
        vectors, codes, probes = [], [], []
        for b in batches:
            for c in got:
                got[c].append(b.column(c).to_numpy())
            vectors += list(b.column("v").to_numpy(zero_copy_only=False))
            codes += b.column("codes").to_pylist()
            probes += b.column("probes").to_pylist()
        group = {c: np.concatenate(x) for c, x in got.items()} | {"v": vectors, "codes": codes, "probes": probes}
        added, node, root = _search(index, min_cosine, radius, group)
        number = group["number"]
        linked = np.nonzero(added)[0]
        u = np.concatenate([number[linked], number[node]])
        v = pa.array(np.concatenate([np.zeros(len(linked), dtype=np.int64), number[root]]),
                     mask=np.arange(len(u)) < len(linked))
        extra = np.concatenate([added[linked], np.zeros(len(node), dtype=np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(extra)], names=["u", "v", "added"])

    ship_package(spark)
    found = cut_lineage(members.unionByName(queries).groupBy("block", "grp").applyInArrow(search, "u long, v long, added long"))
    added = found.where(F.col("v").isNull()).groupBy(F.col("u").alias("number")).agg(F.sum("added").alias("added"))
    return added, found.where(F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select("u", "v")


def near_vectors(df: DataFrame, min_cosine: float = MIN_COSINE, reach: float | None = None, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (least id reachable), kept (the id is its own component's)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    good = F.coalesce(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = cut_lineage(rows.withColumn("v", F.when(good, F.col("v"))).withColumn("_row", F.monotonically_increasing_id()))
    valid = rows.where(F.col("v").isNotNull())
    classes = cut_lineage(valid.groupBy("v").agg(F.min("_row").alias("number"), F.count(F.lit(1)).alias("weight"),
                                                 F.min("vec_id").alias("best")))
    added, links = link_counts(classes.select("number", "weight", "v"), min_cosine, reach)
    roots = components(links)
    rooted = cut_lineage(classes.drop("v").join(roots.withColumnRenamed("node", "number"), "number", "left")
                         .join(added, "number", "left")
                         .select("number", "weight", "best", F.coalesce("root", "number").alias("root"),
                                 (F.coalesce("added", F.lit(0).cast("long")) + F.col("weight") - 1).alias("n_links")))
    least = cut_lineage(rooted.groupBy("root").agg(F.min("best").alias("component_id")))
    facts = rooted.join(least, "root").select("number", "n_links", "component_id")
    # a class is found again by its vector; rows of a hot class are split by the join
    back = classes.select("number", "v").join(facts, "number").drop("number")
    linked = valid.select("vec_id", "v").join(back, "v").drop("v")
    alone = rows.where(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", "n_links", "component_id",
                      F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
