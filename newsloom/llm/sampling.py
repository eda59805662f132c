"""Bounded samples of labelled rows to learn from."""

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.llm.frames import bounded
from newsloom.sources.store import staged

_LOTS = 1 << 40


def bounded_sample(labelled: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` ids of each label, as a written table ``doc_id, <label>``.

    Ids are drawn by hash. A label's count first tells which hashes can belong to its first
    ``per_label``, so that no more than about twice as many rows of a label meet in a task.
    """
    lot = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(_LOTS))
    rows = labelled.select("doc_id", label).withColumn("_lot", lot)
    counts = staged(rows.groupBy(label).agg(F.count("*").alias("_n")))
    near = rows.join(bounded(counts), label).filter(F.col("_lot") * F.col("_n").cast("double") <= 2.0 * per_label * _LOTS)
    place = F.row_number().over(Window.partitionBy(label).orderBy("_lot", "doc_id"))
    return staged(near.withColumn("_place", place).filter(F.col("_place") <= per_label).select("doc_id", label))
