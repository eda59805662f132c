"""Duplicates by content hash, against the store and within a batch."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import content_hash
from newsloom.operators.keys import CELLS, attach, deal


def _stored_hashes(store: DataFrame) -> DataFrame:
    return store.select("content_hash").distinct().withColumn("_stored", F.lit(True))


def known_duplicates(
    batch: DataFrame, store: DataFrame, row_id: str = "id", cells: int = CELLS
) -> DataFrame:
    """Flag each batch row whose hash is stored; stored duplicates count as well."""
    marked = attach(batch, _stored_hashes(store), "content_hash", row_id, cells=cells)
    return marked.withColumn("is_known", F.coalesce("_stored", F.lit(False))).drop("_stored")


def mark_duplicates(
    batch: DataFrame, store: DataFrame | None = None, seq: str = "batch_seq", cells: int = CELLS
) -> DataFrame:
    """Set ``is_duplicate`` and ``dup_reason`` (``store``, ``batch`` or null).

    A hash in the store makes every row a duplicate; otherwise the first row in ``seq``
    order is kept. ``seq`` must be unique in the batch.

    A popular hash (empty content, say) may own a large part of the batch, so rows are
    never gathered by hash. They are dealt into cells, each cell is reduced to its first
    row before the shuffle, and only the cells of a hash, at most ``cells`` of them, meet.
    """
    dealt = deal(batch, seq, cells)
    per_cell = dealt.groupBy("content_hash", "_cell").agg(F.min(seq).alias("_first"))
    verdicts = per_cell.withColumn(
        "_first", F.min("_first").over(Window.partitionBy("content_hash"))
    )
    if store is not None:
        verdicts = verdicts.join(_stored_hashes(store), "content_hash", "left")
    else:
        verdicts = verdicts.withColumn("_stored", F.lit(None).cast("boolean"))
    reason = F.when(F.col("_stored"), F.lit("store")).when(F.col(seq) > F.col("_first"), F.lit("batch"))
    kept = [c for c in batch.columns if c not in ("is_duplicate", "dup_reason")]
    return (
        dealt.join(verdicts, ["content_hash", "_cell"], "left")
        .select(*kept, reason.alias("dup_reason"))
        .withColumn("is_duplicate", F.col("dup_reason").isNotNull())
    )


def unique_articles(marked: DataFrame) -> DataFrame:
    return marked.filter(~F.col("is_duplicate"))


def dedup_stats(marked: DataFrame) -> DataFrame:
    """Counts of one marked batch. Empty and blank articles share one hash; they are shown apart.

    Only hashes are looked at, so no text goes through the verdict join.
    """
    return marked.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("is_duplicate")).alias("unique"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count_if(F.col("dup_reason") == "store").alias("store_duplicates"),
        F.count_if(F.col("dup_reason") == "batch").alias("batch_duplicates"),
        F.count_if((F.col("content_hash") == content_hash(F.lit(""))) & F.col("is_duplicate")).alias("empty_duplicates"),
    )
