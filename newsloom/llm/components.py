"""Connected components of links between ids, by joins only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.sources.store import staged


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every id in ``links`` (``a, b``): the smallest id it is connected with.

    Each round a node takes the smallest label beside it and then that label's own label,
    so distances are about halved. Labels are written out every round; the driver sees their sum
    only. A hub's neighbours are reduced to a minimum before they are shuffled.
    """
    pairs = links.select("a", "b")
    both = staged(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    total = _sum(labels)
    while True:
        beside = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(beside, labels.node == beside.a, "left").select(
            "node", F.least("label", "near").alias("label")
        )
        nearer = staged(nearer)
        hop = nearer.select(F.col("node").alias("_via"), F.col("label").alias("_far"))
        jumped = nearer.join(hop, nearer.label == hop._via, "left")
        labels = staged(jumped.select("node", F.least("label", "_far").alias("label")))
        before, total = total, _sum(labels)
        if total == before:
            return labels


def _sum(labels: DataFrame):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
