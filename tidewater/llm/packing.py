"""Operator 4: training sequences packed by Karmarkar-Karp multiway differencing.

Token ids: a text of plain Latin characters is lower-cased and cut into the tokenizer's
pre-tokens, and a bounded memo maps each distinct one to the ids of the library's
merges.  Any other text, and one that holds a special string, goes through the whole
tokenizer.
Every document ends with ``end_id``.

Packing: a document of at least ``capacity`` tokens is cut into full pieces and a
rest; full pieces are sequences by themselves.  The other pieces are dealt evenly
into groups of about GROUP_PIECES (round robin over a checkpointed table, so no key
can be hot), and each group is partitioned into k = ceil(tokens / capacity) windows:
partial partitions are merged two at a time, those of greatest imbalance first, the
fullest windows of one against the emptiest of the other.  When a window exceeds the
capacity, k rises and the group is partitioned anew.  One document in CUT_ONE_IN is
cut small beforehand, so that small pieces are left to even out the windows.

Results: a null or empty text is one piece holding the end id alone.  Ties go to the
earlier piece.  Repeated rows and null ids are packed like any other; each row has
its own pieces.  Only the id and text columns are read.  An empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.llm.common import cut_lineage, map_batches, ship_package

GROUP_PIECES = 4096
CUT_ONE_IN, CUT_TOKENS = 64, 32
COARSE = 512
MEMO_ENTRIES = 250_000
# Ids of a sequence are unique over groups: the group's number is shifted past its windows.
GROUP_SHIFT = 24


# A text of these characters alone has one lower and one composed form per character.
SIMPLE = re.compile(r"[\n\x20-~À-ÖØ-öø-ÿ]*")
# Pre-tokens of a lower-cased simple text: fixed pattern of the tokenizer file, letters first as nothing else starts with one.
PRE_TOKEN = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{-~]+")


def _byte_chars() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 and up in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(256 + other.index(b)) if b in set(other) else chr(b) for b in range(256)]


class _Memo(dict):
    """Pre-token -> ids as bytes, by the library's merges; bounded, refilled on demand."""

    def __init__(self, merge) -> None:
        super().__init__()
        self.merge, self.chars = merge, _byte_chars()

    def __missing__(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join(self.chars[b] for b in word.encode())
        found = array("I", [t.id for t in self.merge(mapped)]).tobytes()
        if len(word) <= 64:
            if len(self) > MEMO_ENTRIES:
                self.clear()
            self[word] = found
        return found


class TextEncoder:
    """Text -> ids as little-endian unsigned 32-bit bytes, exactly as the library encodes the whole text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.get = _Memo(self.tok.model.tokenize).__getitem__

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SIMPLE.fullmatch(text) and not any(x in text for x in self.special):
            return b"".join(map(self.get, PRE_TOKEN.findall(text.lower())))
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return TextEncoder(path)


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Partition item numbers into ``k`` windows of near-equal sums.

    A partial partition is its non-empty windows, fullest first.  Each window is a
    node of a binary forest over the items, so a merge joins nodes and moves no lists.
    """
    n = len(sizes)
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)
    free = n
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, sa, na = heapq.heappop(heap)
        _, _, sb, nb = heapq.heappop(heap)
        a, b = len(sa), len(sb)
        over = max(0, a + b - k)  # windows that meet, crosswise; the others stay alone
        if over:
            sb, nb = sb[::-1], nb[::-1]  # b's emptiest windows first, against a's fullest of those that must meet
            i, j = np.arange(a - over, a), np.arange(over)
            sums = sa[i] + sb[j]
            joined = np.arange(free, free + over)
            left[joined], right[joined] = na[i], nb[j]
            free += over
            s = np.concatenate([sa[:a - over], sb[over:], sums])
            nodes = np.concatenate([na[:a - over], nb[over:], joined])
        else:
            s, nodes = np.concatenate([sa, sb]), np.concatenate([na, nb])
        order = np.argsort(-s, kind="stable")
        s, nodes = s[order], nodes[order]
        spread = int(s[0] - (s[-1] if len(s) == k else 0))
        heapq.heappush(heap, (-spread, tick, s, nodes))
        tick += 1
    windows = []
    for node in (heap[0][3] if heap else []):
        items, stack = [], [int(node)]
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += [int(left[x]), int(right[x])]
        windows.append(sorted(items))
    return windows


def fit_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``, as few as found.

    Their number starts at ceil(total / capacity) and rises in doubling steps while a
    window exceeds the capacity; the last step is then halved down to the least number that held,
    to within one in COARSE.
    """
    if not sizes:
        return []

    def attempt(k: int) -> list[list[int]] | None:
        windows = karmarkar_karp(sizes, k)
        return windows if all(sum(sizes[i] for i in w) <= capacity for w in windows) else None

    least = -(-sum(sizes) // capacity)
    failed, step = least - 1, 1
    while (best := attempt(min(len(sizes), failed + step))) is None:
        failed, step = failed + step, 2 * step
    low, high = failed, min(len(sizes), failed + step)
    while high - low > 1 + least // COARSE:
        mid = (low + high) // 2
        found = attempt(mid)
        low, high, best = (low, mid, found) if found else (mid, high, best)
    return best


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens; pieces are full but a document's last.

    One document in CUT_ONE_IN (by a hash of id and text) is cut into pieces of CUT_TOKENS, which
    even out the windows; all others stay whole up to ``capacity``.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = T.StructType.fromDDL(f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batch: pa.RecordBatch) -> dict:
        encode = encoder(path).encode
        ids = [encode(t) + end for t in batch.column(1).to_pylist()]
        names = batch.column(0).to_pylist()
        step = [4 * (CUT_TOKENS if zlib.crc32(str(i).encode(), zlib.crc32(x)) % CUT_ONE_IN == 0 else capacity)
                for i, x in zip(names, ids)]
        cuts = [(r, s) for r, x in enumerate(ids) for s in range(0, len(x), step[r])]
        parts = [ids[r][s:s + step[r]] for r, s in cuts]
        return {"doc_id": batch.column(0).take(pa.array([r for r, _ in cuts], pa.int32())), "start": [s // 4 for _, s in cuts],
                "length": [len(p) // 4 for p in parts], "ids_crc32": [zlib.crc32(p) for p in parts],
                "doc_tokens": [len(ids[r]) // 4 for r, _ in cuts]}

    return map_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), run, schema)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with length, at most ``capacity``) plus sequence_id and offset."""
    n = pieces.count()
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    arrow = to_arrow_schema(schema)
    at = pieces.columns.index("length")

    def place(table: pa.Table, group: int) -> pa.Table:
        sizes = table.column(at).to_pylist()
        windows = [[i] for i, s in enumerate(sizes) if s >= capacity]
        rest = [i for i, s in enumerate(sizes) if s < capacity]
        windows += [[rest[i] for i in w] for w in fit_windows([sizes[i] for i in rest], capacity)]
        seq, off = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        for w, items in enumerate(windows):
            seq[items] = (group << GROUP_SHIFT) + w
            off[items] = np.concatenate([[0], np.cumsum([sizes[i] for i in items])[:-1]])
        return pa.Table.from_arrays([*table.columns, pa.array(seq), pa.array(off)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn, held = TaskContext.get().partitionId(), 0, []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            while rows >= 2 * GROUP_PIECES:  # a part holds one group unless dealing was uneven
                t = pa.Table.from_batches(held)
                yield from place(t.slice(0, GROUP_PIECES).combine_chunks(), (part << 14) + turn).to_batches()
                held, rows, turn = t.slice(GROUP_PIECES).to_batches(), rows - GROUP_PIECES, turn + 1
        if rows:
            yield from place(pa.Table.from_batches(held), (part << 14) + turn).to_batches()

    ship_package(pieces.sparkSession)
    return pieces.repartition(max(1, -(-n // GROUP_PIECES))).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(cut_lineage(token_pieces(docs, path, capacity, end_id, id_col, text_col)), capacity)
