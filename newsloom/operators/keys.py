"""Keyed joins that hold up when one key owns a large share of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One key's rows are spread over this many cells, so a key with a third of all
# rows still gives each task at most a 3072nd of them.
CELLS = 1024


def without(rows: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """Rows whose key is not in ``known``.

    A left join with a null test, not ``left_anti``: the optimizer moves an anti join
    below the projections of ``rows``, which would shuffle whole article texts where
    only their scores are wanted.
    """
    marker = known.select(*keys).distinct().withColumn("_known", F.lit(True))
    joined = rows.join(marker, keys, "left")
    return joined.filter(F.col("_known").isNull()).select(*rows.columns)


def deal(rows: DataFrame, row_id: str, cells: int = CELLS) -> DataFrame:
    """Number rows into cells by ``row_id``, for use beside a key that may own many rows."""
    return rows.withColumn("_cell", F.pmod(F.xxhash64(row_id), F.lit(cells)))


def attach(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    row_id: str,
    how: str = "left",
    cells: int = CELLS,
) -> DataFrame:
    """Join ``facts`` (one row per key) onto ``rows`` (any number per key).

    Rows of one key are dealt out to cells by ``row_id``. Only the cells that occur
    are looked up, so a key is repeated at most ``min(rows, cells)`` times on the small
    side and no task ever holds all rows of a key. Nothing is assumed about which keys
    are busy, and null keys are spread too.
    """
    dealt = deal(rows, row_id, cells)
    looked_up = dealt.select(key, "_cell").distinct().join(facts, key, how)
    extra = [c for c in facts.columns if c != key]
    return dealt.join(looked_up, [key, "_cell"], how).select(*rows.columns, *extra)
