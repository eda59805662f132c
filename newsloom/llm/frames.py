"""Small helpers for frames that hold whole texts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.batches import small_batches  # noqa: F401

BROADCAST_ROWS = 1_000_000


def bounded(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows``, a written table of narrow rows, marked for broadcast if they are at most ``most``.

    Beyond that Spark joins by a shuffle; the rows of the result are the same.
    """
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def of_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is in ``ids``, a written table; with ``left_anti``, the others."""
    return docs.join(bounded(ids), "doc_id", how)


def cleared(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without columns of these names (in any case), which the caller makes itself."""
    taken = {n.lower() for n in names}
    return docs.drop(*[c for c in docs.columns if c.lower() in taken])
