"""What may be broadcast: sides whose size was measured first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL, SMALL_BYTES = 200_000, 32 << 20  # rows, and bytes as JSON, that are broadcast at most


def fits(rows: DataFrame) -> bool:
    """Whether ``rows`` are few and short enough to broadcast; looked at up to the bound."""
    n, size = rows.limit(SMALL + 1).select(F.struct("*").alias("x")).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json("x")))).first()
    return n <= SMALL and (size or 0) <= SMALL_BYTES


def bounded(rows: DataFrame) -> DataFrame:
    """``rows`` marked for broadcast if they are few, else as they are: then the join shuffles."""
    return F.broadcast(rows) if fits(rows) else rows


def dimension(rows: DataFrame, name: str) -> DataFrame:
    """A small dimension that meets stated queries by containment of text, which no key can find: it
    is broadcast, and one over the bound is an error, not a join of everything with everything."""
    if not fits(rows):
        raise ValueError(f"{name}: over {SMALL} rows or {SMALL_BYTES} bytes, too large to be held against every query")
    return F.broadcast(rows)
