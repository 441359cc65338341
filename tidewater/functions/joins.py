"""Join helpers: broadcast only behind a size check, with a shuffle join beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of text form above which a look-up side is joined by shuffle instead of broadcast.
DEFAULT_BROADCAST_BYTES = 16 << 20


def small_side(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Return ``df`` hinted for broadcast when its rows, as text, take at most ``max_bytes``.

    Used for look-up tables derived from the data (distinct category values,
    per-group statistics, class shares, routes per node pair) whose size is
    bounded in practice but not by the schema.  The side is written once with
    a reliable checkpoint to the shared folder — it survives executor loss,
    holds no executor memory, and the measure and the join read the same files.
    Above the bound the hint is dropped and Spark plans a shuffle join (AQE
    may still pick a broadcast from runtime statistics).
    """
    from tidewater.session import cut_lineage
    side = cut_lineage(df)
    size = side.agg(F.sum(F.length(F.to_json(F.struct(*side.columns))))).first()[0] or 0
    return F.broadcast(side) if size <= max_bytes else side

