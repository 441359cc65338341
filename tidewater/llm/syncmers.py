"""Operator 5: document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the least hash of its s-mers lies at its
first or last place.  The choice depends on the k-mer alone, so equal passages give
equal anchors wherever they stand, and the anchors' order supports positional
matching.  The fingerprint keeps the ``sketch`` least distinct anchor hashes of the
whole text as hex digits; the likeness of two fingerprints is the share of anchors
in common (Dice) that these bottom sketches estimate, exact when the union has no
more than ``sketch`` anchors.  A text shorter than k is one anchor of its own.

The edited text of a document replaces its last floor(n / 2) code points by the
first as many (or all) of the next document's in id order.  Documents are range
dealt to ranges of ids once; neighbours meet inside a range, and only a copy of the
first row of each range goes to the one before.

Results: null and empty texts have no anchors, the fingerprint "" and likeness 1
to each other, 0 to any other text.  Rows with a null id come first; repeated ids
are ordered by a hash of the text, then by row, and repeated rows follow one another.  A single
row is its own next document.  Only the id and text columns are read.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.llm.common import map_batches

K, S = 16, 6
SKETCH = 128
SAMPLE_PER_PART = 64
_MULT = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that order by hash is unrelated to the text."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_MULT), n, 1 << 64))


def anchors(text: str | None, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every closed syncmer of the whole text, in text order."""
    if not text:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    if len(cp) < k:
        h = np.uint64(len(cp))
        with np.errstate(over="ignore"):
            for c in cp:
                h = h * _MULT + c
            return _mix(np.array([h], dtype=np.uint64)), np.zeros(1, dtype=np.int64)
    with np.errstate(over="ignore"):
        runs, span = cp, 1  # polynomial hash of `span` code points from each place
        while span * 2 <= s:
            runs = runs[:-span] * _power(span) + runs[span:]
            span *= 2
        for i in range(span, s):
            runs = runs[:-1] * _MULT + cp[i:]
        mers = _mix(runs)
        width = k - s + 1
        low, w = mers, 1
        while w * 2 <= width:
            low = np.minimum(low[:-w], low[w:])
            w *= 2
        if w < width:
            low = np.minimum(low[:len(low) - (width - w)], low[width - w:])
        n = len(cp) - k + 1
        at = np.nonzero((mers[:n] == low) | (mers[width - 1:width - 1 + n] == low))[0]
        whole, i = runs[at], s  # hash of the k-mer from its s-mers, the rest by single code points
        while i + s <= k:
            whole = whole * _power(s) + runs[at + i]
            i += s
        for j in range(i, k):
            whole = whole * _MULT + cp[at + j]
        return _mix(whole), at


def sketch(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The ``size`` least distinct anchor hashes (32 bits of each), sorted."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:size]


def to_hex(sk: np.ndarray) -> str:
    return sk.astype(">u4").tobytes().hex()


def matches(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places in b of the anchors that a has too, in the order of a; the i-th of equal anchors matches the i-th."""
    (ha, _), (hb, _) = a, b
    oa, ob = np.argsort(ha, kind="stable"), np.argsort(hb, kind="stable")
    ua, fa, ca = np.unique(ha[oa], return_index=True, return_counts=True)
    ub, fb, cb = np.unique(hb[ob], return_index=True, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    times = np.minimum(ca[ia], cb[ib])
    turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at_a, at_b = oa[np.repeat(fa[ia], times) + turn], ob[np.repeat(fb[ib], times) + turn]
    return at_b[np.argsort(at_a)]


def chain(places: np.ndarray) -> int:
    """Length of the longest ascending run of matches, adjacent or not."""
    if (np.diff(places) > 0).all():
        return len(places)
    tails: list[int] = []
    for p in places.tolist():
        at = bisect_left(tails, p)
        if at == len(tails):
            tails.append(p)
        else:
            tails[at] = p
    return len(tails)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of anchors that match by hash in the same order: twice the longest chain over the anchors of both."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    return 2 * chain(matches(a, b)) / (len(a[0]) + len(b[0]))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def syncmer_anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, hashes and positions of its anchors in text order, for positional matching."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        found = [anchors(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "hashes": [h.view(np.int64) for h, _ in found], "positions": [p for _, p in found]}

    return map_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), run,
                       f"doc_id {id_type}, hashes array<long>, positions array<long>")


def _row_key(row: tuple) -> tuple:
    """Order of rows: null ids first, then id, tie, row number."""
    return (row[0] is not None, row[0] if row[0] is not None else 0, row[1], row[2])


def _bounds(keys: DataFrame, parts: int) -> list[tuple]:
    """At most ``parts`` - 1 split points from about SAMPLE_PER_PART sampled keys a part (they only balance the parts)."""
    one_in = max(1, keys.count() // (SAMPLE_PER_PART * parts))  # tasks hand over sampled rows only
    seen = sorted(_row_key(tuple(r)) for r in keys.where(F.pmod(F.xxhash64("_row"), F.lit(one_in)) == 0).collect())
    return sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if len(seen) > parts else []


def _place(df: DataFrame, bounds: list[tuple]) -> DataFrame:
    """``df`` (doc_id, _tie, _row, ...) with pid, the part between two bounds that a row falls in."""
    at = [df.columns.index(c) for c in ("doc_id", "_tie", "_row")]

    def run(batch: pa.RecordBatch) -> dict:
        keys = zip(*(batch.column(i).to_pylist() for i in at))
        return {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {
            "pid": [bisect_right(bounds, _row_key(k)) for k in keys]}

    return map_batches(df, run, T.StructType([*df.schema.fields, T.StructField("pid", T.IntegerType())]))


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    src = (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
           .withColumns({"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}))
    keys = src.select("doc_id", "_tie", "_row")
    bounds = _bounds(keys, parts)
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "_tie", "_row")).alias("first")
    heads = [(r.pid, r.first.doc_id, r.first._tie) for r in
             _place(keys, bounds).groupBy("pid").agg(first).orderBy("pid").collect()]  # one row a part
    before = [(heads[i - 1][0], h[1], h[2]) for i, h in enumerate(heads)]
    wanted = spark.createDataFrame(before, f"pid int, want {id_type}, tie long")
    # the text of a head is that of any row with its id and tie
    guests = (src.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("want")) & (F.col("_tie") == F.col("tie")))
              .groupBy("pid", "want", "tie").agg(F.min("text").alias("text"))
              .select(F.col("want").alias("doc_id"), "text", F.col("tie").alias("_tie"), F.lit(0).cast("long").alias("_row"), "pid",
                      F.lit(1).alias("guest")))
    rows = _place(src.select("doc_id", "text", "_tie", "_row"), bounds).withColumn("guest", F.lit(0)).unionByName(guests)
    dealt = (rows.repartitionById(parts, "pid")
             .sortWithinPartitions("guest", F.col("doc_id").asc_nulls_first(), "_tie", "_row")
             .select("doc_id", "text", "guest"))
    schema = T.StructType.fromDDL(f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, "
                                  "edited_fingerprint string, near_edited double, near_next double")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one is still to come: id, text, anchors
        for batch in batches:
            out = []
            for doc_id, text, _ in zip(*(c.to_pylist() for c in batch.columns)):
                own = anchors(text)
                if held is not None:
                    new = edited(held[1], text)
                    changed = anchors(new)
                    out.append((held[0], len(held[1]), hashlib.sha256(new.encode()).hexdigest(), to_hex(sketch(held[2][0])),
                                to_hex(sketch(changed[0])), likeness(held[2], changed), likeness(held[2], own)))
                held = (doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return dealt.mapInArrow(run, schema)
