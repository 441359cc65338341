"""Operator 11: centroid clustering by a progressive search over Walsh-Hadamard coefficients.

Every component x of a vector becomes the integer floor(64 * x).  The transform of
64 integers by the 64 x 64 Hadamard matrix is exact and keeps squared distances up to the
factor 64, so differences of coefficients, taken from coarse (few sign changes) to
fine, add up to the distance from below.  After each block of coefficients the leading
centroid of a vector is finished at once; its whole distance is the bound by which centroids whose
partial sum is already larger are dropped.  What survives takes all 64
coefficients; ties go to the smaller number.

A round is one pass over the table: each task returns the sums of its vectors per
centroid (at most ``k`` of them, in 32-bit limbs, so sums are exact whatever the size), Spark
adds them, and the driver divides ``k`` x 64 numbers.

Results: vectors that are null, have another length than 64, or hold a null or
non-finite component get no row.  The first centroids are the kept vectors of least
hash; equal hashes (repeated ids, null ids, whose id counts as empty) go by the
vector's components.  Repeated rows are rows of their own, and fewer than ``k`` kept
rows give as many centroids.  A distance beyond 64 bits is null, as are the inertias that hold it.  Only the id and
vector columns are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.llm.common import cut_lineage, ship_package

DIM = 64
SCALE = 64
CLUSTERS, ROUNDS = 16, 3
# Coefficients seen after each step of the search.
STEPS = (2, 4, 8, 16, 32, 64)
# Integers up to here keep every sum of a search within 64 bits; others take Python integers.
NARROW = 1 << 24
CHUNK = 4096
LIMB = 32
LONG_MAX = (1 << 63) - 1


def _signs() -> np.ndarray:
    h = np.ones((1, 1), dtype=np.int64)
    while len(h) < DIM:
        h = np.block([[h, h], [h, -h]])
    return h


# Rows of the Hadamard matrix by their number of sign changes: coarse to fine.
COARSE_TO_FINE = np.argsort((np.diff(_signs(), axis=1) != 0).sum(axis=1), kind="stable")


def to_integers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(64 x) of finite rows: (narrow rows as int64, mask of narrow rows); see ``wide_integers`` for the rest."""
    narrow = (np.abs(x) < NARROW // SCALE).all(axis=1)
    return np.floor(x[narrow] * SCALE).astype(np.int64), narrow


def wide_integers(x: np.ndarray) -> np.ndarray:
    """floor(64 x) as Python integers, for any finite double."""
    out = np.empty(x.shape, dtype=object)
    for at, value in np.ndenumerate(x):
        n, d = float(value).as_integer_ratio()
        out[at] = SCALE * n // d
    return out


def walsh(v: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, coefficients from coarse to fine; exact for int64 and for objects."""
    w, half = v, 1
    while half < DIM:
        pairs = w.reshape(len(v), DIM // (2 * half), 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        w = np.stack([a + b, a - b], axis=2).reshape(len(v), DIM)
        half *= 2
    return w[:, COARSE_TO_FINE]


def nearest(w: np.ndarray, wc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest of the transformed centroids ``wc`` for each transformed vector."""
    n, k = len(w), len(wc)
    rows = np.arange(n)
    part = np.zeros((n, k), dtype=w.dtype)
    alive = np.ones((n, k), dtype=bool)
    bound = ((w - wc[0]) ** 2).sum(axis=1)
    finished = np.zeros(n, dtype=np.int64)
    begin = 0
    for end in STEPS:
        i, c = np.nonzero(alive)
        part[i, c] += ((w[i, begin:end] - wc[c, begin:end]) ** 2).sum(axis=1)
        begin = end
        lead = np.where(alive, part, (bound + 1)[:, None]).argmin(axis=1)
        fresh = rows[lead != finished]
        if len(fresh):
            whole = ((w[fresh] - wc[lead[fresh]]) ** 2).sum(axis=1)
            bound[fresh] = np.minimum(bound[fresh], whole)
            finished[fresh] = lead[fresh]
        alive &= part <= bound[:, None]
    best = np.where(alive, part, (bound + 1)[:, None]).argmin(axis=1)
    return best, part[rows, best] // DIM


def _assign(x: np.ndarray, centroids: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, integers, cluster, distance) of parts of ``x``, narrow rows in 64-bit arithmetic, wide ones exactly too."""
    own, narrow = to_integers(x)
    small = all(abs(v) < NARROW for c in centroids for v in c)
    parts = [(np.nonzero(narrow)[0], own if small else own.astype(object))]
    if not narrow.all():
        parts.append((np.nonzero(~narrow)[0], wide_integers(x[~narrow])))
    for at, v in parts:
        wc = walsh(np.array(centroids, dtype=np.int64 if small and v.dtype != object else object))
        for s in range(0, len(v), CHUNK):
            q = v[s:s + CHUNK]
            yield at[s:s + CHUNK], q, *nearest(walsh(q), wc)


def _components(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, DIM)


def _limbs(value: int) -> list[int]:
    sign, mag, out = (-1 if value < 0 else 1), abs(value), []
    while mag:
        out.append(sign * (mag & ((1 << LIMB) - 1)))
        mag >>= LIMB
    return out


def _kept(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) == DIM) & F.forall(vector, finite), F.lit(False))


def kept_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    src = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return src.where(_kept(F.col("v")))


def first_centroids(kept: DataFrame, k: int) -> list[list[int]]:
    """Integers of the ``k`` vectors of least hash (the one collect of rows, bounded by ``k``)."""
    text = F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = kept.select(F.sha2(text, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [list(wide_integers(np.array([r.v]))[0]) for r in rows]


def next_centroids(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floors of the means of what each centroid is nearest to; a centroid without vectors stays."""
    k = len(centroids)
    schema = "cluster int, place int, limb int, value long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, DIM), dtype=object)
        counts = [0] * k
        for batch in batches:
            for _, q, cluster, _ in _assign(_components(batch.column(0)), centroids):
                for c in np.unique(cluster):
                    mine = q[cluster == c]
                    sums[c] += mine.sum(axis=0).astype(object)
                    counts[c] += len(mine)
        out = [(c, DIM, 0, counts[c]) for c in range(k) if counts[c]]
        out += [(c, i, p, x) for c in range(k) for i in range(DIM) for p, x in enumerate(_limbs(int(sums[c][i])))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    ship_package(kept.sparkSession)
    total = {(c, i): 0 for c in range(k) for i in range(DIM + 1)}
    for r in (kept.select("v").mapInArrow(run, schema).groupBy("cluster", "place", "limb")
              .agg(F.sum("value").alias("value")).collect()):  # k x 65 numbers of a few limbs
        total[(r.cluster, r.place)] += r.value << (LIMB * r.limb)
    return [[total[(c, i)] // n for i in range(DIM)] if (n := total[(c, DIM)]) else list(centroids[c]) for c in range(k)]


def fit(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> list[list[int]]:
    """The centroids after ``rounds`` rounds."""
    kept = kept_vectors(df, id_col, vector_col)
    centroids = first_centroids(kept, k)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(kept, centroids)
    return centroids


def assign(df: DataFrame, centroids: list[list[int]], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per kept vector: id, cluster, distance (squared, in the integer grid)."""
    kept = kept_vectors(df, id_col, vector_col)
    schema = T.StructType.fromDDL(f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, cluster, distance in _assign(_components(batch.column(1)), centroids):
                long = [int(d) if d <= LONG_MAX else None for d in distance] if distance.dtype == object else distance
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cluster.astype(np.int32)),
                                                  pa.array(long, pa.int64())], schema=arrow)

    ship_package(df.sparkSession)
    return (kept if centroids else kept.limit(0)).mapInArrow(run, schema)


def centroid_clusters(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id",
                      vector_col: str = "embedding") -> DataFrame:
    """Per kept vector: id, cluster, distance, cluster_inertia, inertia and the digest of its centroid."""
    centroids = fit(df, k, rounds, id_col, vector_col)
    rows = cut_lineage(assign(df, centroids, id_col, vector_col))
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(  # a row a cluster
        F.when(F.count("distance") == F.count(F.lit(1)), F.try_sum("distance")).alias("s")).collect()}
    inertia = sum(sums.values()) if None not in sums.values() else None
    if inertia is not None and inertia > LONG_MAX:
        inertia = None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = df.sparkSession.createDataFrame([(c, s, inertia, digest[c]) for c, s in sums.items()],
                                            "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                           "centroid_sha256")
