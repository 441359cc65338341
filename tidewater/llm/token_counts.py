"""Operator 1: exact SentencePiece token counts with a whole-token shortcut.

The piece table is read once per worker.  Two facts are proved from it before
any text is seen: (1) where no piece can cross (before a space mark, around a line
feed, between a letter and a sign that follows none; ``pieces.cut_pattern``), so that
every pre-token can be counted alone; (2) which pieces, given to the library alone,
come back as exactly one token.  Pre-tokens in that proven
set count 1 straight away; only the others are merged by the library, once per
distinct string in a bounded memo.

Results: null text counts as empty (0 bytes, 0 tokens, not over the limit).
Null or repeated ids and repeated rows are kept, one output row per input row.
Only the id and text columns are read, so extra or clashing columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import map_batches
from tidewater.llm.pieces import MARK, cut_pattern

MEMO_ENTRIES = 400_000


class _Memo(dict):
    """Pre-token -> token count.  Starts from the proven whole tokens; bounded, refilled on demand."""

    def __init__(self, whole: dict[str, int], count) -> None:
        super().__init__(whole)
        self._whole, self._count = whole, count

    def __missing__(self, seg: str) -> int:
        if len(self) > MEMO_ENTRIES:
            self.clear()
            self.update(self._whole)
        n = self._count(seg)
        if len(seg) <= 64:
            self[seg] = n
        return n


class WholeTokenCounter:
    """Counts tokens of whole texts as the library does, from pre-tokens."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())
                  if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        self.pattern = cut_pattern(pieces)
        whole = {p: 1 for p in pieces if self.pattern and self.pattern.fullmatch(p) and self._merge(p) == 1}
        if self.pattern and self.pattern.fullmatch("\n"):
            whole["\n"] = 1
        self.whole = whole
        self.memo = _Memo(whole, self._merge)

    def _merge(self, seg: str) -> int:
        if seg.startswith(MARK):
            # the library puts one mark before any non-empty text; a lone mark needs a text that is cut off again
            return len(self.sp.encode(seg[1:])) if len(seg) > 1 else len(self.sp.encode("\n")) - 1
        return len(self.sp.encode("\n" + seg)) - 2

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.pattern is None:
            return len(self.sp.encode(text))
        marked = MARK + text.replace(" ", MARK)
        return sum(map(self.memo.__getitem__, self.pattern.findall(marked)))


@lru_cache(maxsize=2)
def counter(model_path: str) -> WholeTokenCounter:
    return WholeTokenCounter(model_path)


def token_counts(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        c = counter(model_path)
        n = [c.count(t) for t in texts]
        return {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) if t else 0 for t in texts],
                "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), run,
                       f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
