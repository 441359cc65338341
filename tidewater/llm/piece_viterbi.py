"""Operator 10: piece encoding and decoding by a Viterbi search shared over prefixes.

The piece table and scores are those of a SentencePiece model file.  A text is put
into marked form (a space mark before it and for every space) and cut where no piece
can cross (``pieces.cut_pattern``).  The
distinct marked words of a batch are sorted, which lays them out as a trie in
depth-first order; the forward scores of a word's prefix stay in place for the next
word, so each trie node is scored once.  The best path has the greatest sum of piece
scores; of equal paths the one whose last piece is longest, and so on backwards.  A
character outside the table becomes its UTF-8 byte pieces.

Scores are summed exactly (whole numbers in double precision), so a word's pieces do
not depend on the text around it.  Decoding joins pieces, turns byte pieces back to
characters, marks to spaces, and drops the leading mark: an exact inverse but for a
literal mark in the text, which comes back as a space.

Results: null and empty texts give no pieces and decode to the empty text.  Repeated
rows and null ids are kept, one output row each.  Only the id and text columns are
read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import map_batches
from tidewater.llm.pieces import MARK, cut_pattern

MEMO_ENTRIES = 600_000
# Longer words are forgotten after their batch, so the memo is bounded in bytes too.
MEMO_CHARS = 64
UNKNOWN_PENALTY = 10.0


class PieceModel:
    """Piece table, exact encoder and decoder."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.text_of: list[str] = []
        self.byte_id = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_id[b] = i
                self.text_of.append(chr(b) if b < 128 else chr(0xDC00 + b))  # decoded with the bytes around it
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text_of.append("")
            else:
                self.pieces[piece] = (i, sp.get_score(i))
                self.text_of.append(piece)
        # every ending of a piece: a string that is none cannot end a longer piece either
        self.endings = {p[k:] for p in self.pieces for k in range(len(p))}
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        self.pattern = cut_pattern(list(self.pieces))
        if self.pattern is None:
            raise ValueError("a piece holds the space mark after another character; words cannot be cut apart")
        self.memo: dict[str, bytes] = {}

    def paths(self, words: list[str]):
        """Yield (word, ids) for distinct sorted marked words, scoring each shared prefix once."""
        get, endings, unknown = self.pieces.get, self.endings, self.unknown
        best, back = [0.0], [(0, -1)]  # per prefix length: score, and (start, id) of its last piece
        before = ""
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], back[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                top, last = float("-inf"), (0, -1)
                for start in range(end - 1, -1, -1):
                    tail = word[start:end]
                    if tail not in endings:
                        break
                    hit = get(tail)
                    if hit is not None:
                        score = best[start] + hit[1]
                        if score >= top:
                            top, last = score, (start, hit[0])
                if word[end - 1] not in self.pieces and best[end - 1] + unknown > top:
                    top, last = best[end - 1] + unknown, (end - 1, -1)
                best.append(top)
                back.append(last)
            ids: list[int] = []
            end = len(word)
            while end:
                start, i = back[end]
                if i >= 0:
                    ids.append(i)
                else:
                    ids += [self.byte_id[b] for b in reversed(word[start:end].encode("utf-8", "surrogatepass"))]
                end = start
            ids.reverse()
            yield word, ids
            before = word

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts."""
        cut = [self.pattern.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        words = {w for ws in cut for w in ws}
        fresh = words.difference(self.memo)
        if len(self.memo) + len(fresh) > MEMO_ENTRIES:
            self.memo, fresh = {}, words
        for word, ids in self.paths(sorted(fresh)):
            self.memo[word] = array("I", ids).tobytes()
        get = self.memo.__getitem__
        out = [np.frombuffer(b"".join(map(get, ws)), dtype="<u4") for ws in cut]
        for word in [w for w in words if len(w) > MEMO_CHARS]:
            del self.memo[word]
        return out

    def decode(self, ids) -> str:
        text = "".join(map(self.text_of.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids))
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ids (array of int)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "ids": [x.astype(np.int32) for x in model(path).encode(batch.column(1).to_pylist())]}

    return map_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), run,
                       f"doc_id {id_type}, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, ids): id and text; null ids give the empty text."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "text": [model(path).decode(x or []) for x in batch.column(1).to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {id_type}, text string")


def piece_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, round_trip."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        m, texts = model(path), batch.column(1).to_pylist()
        ids = m.encode(texts)
        back = [m.decode(x) for x in ids]
        return {"doc_id": batch.column(0), "n_pieces": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                "decoded_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in back],
                "round_trip": [b == (t or "").replace(MARK, " ") for b, t in zip(back, texts)]}

    return map_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), run,
                       f"doc_id {id_type}, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
