"""Exact candidate pairs of similar sets by their rarest elements, for groups too large for pairwise looks."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.frames import bounded
from newsloom.sources.store import staged

SAMPLED_SETS = 20_000
COUNTED = 200_000
SIZE_STEP = 1.04


def _bucket(size: Column) -> Column:
    return F.floor(F.log(F.greatest(size, F.lit(1))) / float(np.log(SIZE_STEP)))


def _common_elements(docs: DataFrame, members: DataFrame, sets_of: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent elements in a bounded sample of the sets, and how often they occur there.

    They only decide the order in which elements are looked at; the pairs found do not depend on them.
    """
    share = SAMPLED_SETS / max(members.count(), 1)
    lot = F.pmod(F.xxhash64(F.lit("order"), "doc_id"), F.lit(1 << 30))
    sampled = staged(members.filter(lot <= share * (1 << 30)).select("doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in sets_of(batches):
            values, times = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times)], names=["x", "n"])

    texts = docs.select("doc_id", "text").join(bounded(sampled), "doc_id", "left_semi")
    counted = texts.mapInArrow(count, "x long, n long").groupBy("x").agg(F.sum("n").alias("n")).filter("n > 2")
    top = counted.orderBy(F.desc("n"), "x").limit(COUNTED).toArrow()
    values, times = top["x"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(values)
    return values[order], times[order]


def prefix_pairs(docs: DataFrame, members: DataFrame, sets_of: Callable, percent: int) -> DataFrame:
    """``a < b``: pairs of ``members`` (``doc_id, comp``, a written table) of different components that may be similar.

    Sets whose intersection is ``percent`` per cent of their union share an element among their first ones in any common
    order; with rare ones first, few others have it. If the first element they share stands at place i of a set of n, at most
    n - i are shared, which bounds the size of the other set. So a set posts its first elements under
    its size, and looks each of them up under the smaller sizes that its place allows. Postings are
    met by component first, so that a large component is not held against itself.
    """
    common = docs.sparkSession.sparkContext.broadcast(_common_elements(docs, members, sets_of))

    def first_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, times = common.value
        for batch, sets in sets_of(batches):
            rows = []
            for own in sets:
                n = len(own)
                at = np.minimum(np.searchsorted(values, own), max(len(values) - 1, 0))
                often = np.where(values[at] == own, times[at], 0) if len(values) else np.zeros(n, np.int64)
                kept = n - (n * percent + 99) // 100 + 1
                rows.append(own[np.lexsort((own, often))][:kept])
            lengths = np.array([len(r) for r in rows])
            which = np.repeat(np.arange(len(rows)), lengths)
            place = np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            n = np.array([len(s) for s in sets], np.int64)[which]
            largest = (100 + percent) * (n - place) // percent - n
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(which)) for c in ("doc_id", "comp")),
                    pa.array(n),
                    pa.array(np.concatenate(rows).view(np.int64)),
                    pa.array(largest),
                ],
                names=["doc_id", "comp", "n", "x", "largest"],
            )

    texts = docs.select("doc_id", "text").join(bounded(members), "doc_id")
    posts = staged(texts.mapInArrow(first_elements, "doc_id long, comp long, n long, x long, largest long"))
    least = F.ceil(F.col("n") * percent / 100)
    most = F.least("n", "largest")
    sizes = F.sequence(_bucket(least), _bucket(most))
    probes = posts.filter(most >= least).select("doc_id", "comp", "n", "x", "largest", F.explode(sizes).alias("size"))
    # Those who look under this size are as large or larger, so a place that allows no such set posts nothing.
    posts = posts.filter("largest >= n").withColumn("size", _bucket(F.col("n")))
    keys = ["x", "size"]
    own = probes.select(*keys, F.col("comp").alias("_own")).distinct()
    other = posts.select(*keys, F.col("comp").alias("_other")).distinct()
    met = own.join(other, keys).filter("_own <> _other")
    left = probes.select(*keys, F.col("comp").alias("_own"), F.struct("doc_id", "n", "largest").alias("p"))
    right = posts.select(*keys, F.col("comp").alias("_other"), F.struct("doc_id", "n", "largest").alias("q"))
    both = left.join(met, [*keys, "_own"]).join(right, [*keys, "_other"])
    both = both.filter("p.n >= q.n and q.n <= p.largest and p.n <= q.largest")
    return both.select(F.least("p.doc_id", "q.doc_id").alias("a"), F.greatest("p.doc_id", "q.doc_id").alias("b")).distinct()
