"""Near-duplicate documents by SuperMinHash, banding, full verification and union-find grouping."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.bytewords import chunks, windows
from newsloom.llm.components import components
from newsloom.llm.frames import bounded, of_ids, small_batches
from newsloom.llm.prefix_join import prefix_pairs
from newsloom.llm.superminhash import band_keys, signatures
from newsloom.operators.keys import attach
from newsloom.sources.store import staged

SHINGLE = 5
SIMILAR_PERCENT = 80
BANDS = 32
ROWS = 5
# Of 160 slots, pairs at 0.8 agree in 128 with a deviation of at most 5.1. What agrees in less than 102.4 is not verified: a pair
# at exactly 0.8 is missed so with a chance of 3 in ten million, a tenth of what the banding misses.
PRETEST = 0.64
CELL = 256
SMALL_BUCKET = 32


def _shingle_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple]:
    for batch, words in chunks(batches):
        hashes, _, offsets = windows(words, shingle, whole_if_shorter=True)
        yield batch, [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands, sig`` per row: size and digest of the shingle set, band keys, slots."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _shingle_sets(batches, shingle):
            sizes = np.array([len(s) for s in sets], np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            slots = signatures(np.concatenate(sets), offsets, BANDS * ROWS)
            keys = band_keys(slots, BANDS)
            low = (slots & np.uint32(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, np.int32), keys.ravel()),
                    pa.array([row.tobytes() for row in low], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands", "sig"],
            )

    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary"
    return docs.select("doc_id", "text").mapInArrow(sketch, schema)


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose slots agree often enough to be verified."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for c in ("sig_a", "sig_b")
        )
        alike = (left == right).mean(axis=1) >= PRETEST
        yield batch.select(["a", "b"]).filter(pa.array(alike))


def _verified(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` (a written table) whose full shingle sets are similar enough.

    Pairs are dealt by their first document and a cell of some ``CELL`` of its partners; the first
    document's set comes ahead of those of its partners, and is all that a task holds.
    """
    ids = staged(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _shingle_sets(batches, shingle):
            packed = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packed], names=["doc_id", "shingles"])

    needed = of_ids(docs.select("doc_id", "text"), ids).mapInArrow(as_sets, "doc_id long, shingles binary")
    partners = pairs.groupBy("a").agg(F.count("*").alias("_n"))
    cell = F.pmod(F.xxhash64("b"), F.ceil(F.col("_n") / CELL))
    dealt = staged(pairs.join(partners, "a").select("a", "b", cell.alias("cell")))
    roles = staged(
        dealt.select("a", "cell", F.col("b").alias("doc_id"), F.lit(1).alias("role")).union(
            dealt.select("a", "cell", F.col("a").alias("doc_id"), F.lit(0).alias("role")).distinct()
        )
    )
    met = needed.join(bounded(roles), "doc_id").select("a", "cell", "role", "doc_id", "shingles")
    met = met.repartition("a", "cell").sortWithinPartitions("a", "cell", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, at = None, None
        for batch in batches:
            links = []
            columns = (batch.column(c).to_pylist() for c in ("a", "cell", "role", "doc_id"))
            for i, (a, cell, role, doc) in enumerate(zip(*columns, strict=True)):
                own = np.frombuffer(batch.column("shingles")[i].as_buffer(), np.uint64)
                if role == 0:
                    first, at = own.copy(), (a, cell)
                elif at == (a, cell):
                    common = _common(first, own)
                    if 100 * common >= percent * (len(first) + len(own) - common):
                        links.append((a, doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"]
            )

    return met.mapInArrow(compare, "a long, b long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    place = np.searchsorted(x, y)
    place[place == len(x)] = 0
    return int((x[place] == y).sum())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs`` (``doc_id, text``).

    Documents are linked whose sets of ``shingle``-word shingles have an intersection of at least ``percent``
    per cent of their union; a component is what links connect, and its smallest id is kept.

    * Documents with equal sets are one class and represented by the smallest id.
    * Representatives that share a key in one of 32 bands of five slots are candidates. A pair at 0.8 is missed
      with a chance of 0.000003, if no other path connects it. Each bucket is first compared with one member, then,
      where it still holds several components, with another one. What is left in small buckets is compared pair by
      pair, in larger ones by an exact join on the rarest shingles. Nothing is capped.
    * Candidates are verified on their full sets, taken from the texts again.
    * A text without words, or null, has an empty set and is linked with nothing.
    * A row without an id is linked with nothing, has no component and is kept. Rows that share an id
      are one document: what one of them is linked with, all are.
    * Columns besides ``doc_id`` and ``text`` are not looked at; an empty table gives an empty table.
    """
    small_batches(docs)
    sketched = staged(sketches(docs, shingle))
    nodes = sketched.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = staged(nodes.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    reps = nodes.join(classes, (nodes.set_key == classes.set_key) & (nodes.doc_id == classes.rep))
    reps = staged(reps.select("rep", F.col("n_shingles").alias("n"), "bands", "sig").dropDuplicates(["rep"]))
    labels = _grouped(docs, reps, shingle, percent)
    labelled = classes.join(labels, classes.rep == labels.node, "left").select(
        "set_key", F.coalesce("label", "rep").alias("_component")
    )
    found = attach(nodes.select("doc_id", "n_shingles", "set_key"), labelled, "set_key", "doc_id")
    lone = sketched.filter(F.col("doc_id").isNull() | (F.col("n_shingles") == 0))
    found = found.select("doc_id", "n_shingles", F.col("_component").alias("component_id")).union(
        lone.select("doc_id", "n_shingles", "doc_id")
    )
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.withColumn("kept", kept)


def _grouped(docs: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Labels (``node, label``) of the representatives that are linked with others."""
    rows = reps.select("rep", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    members = staged(rows.join(shared, "key").withColumn("comp", F.col("rep")))
    links = tested = None
    for step in ("first", "random", "rest"):
        if step == "rest":
            candidates = _other_pairs(docs, members, shingle, percent)
        else:
            candidates = _star_pairs(members, step, percent)
        if tested is not None:
            candidates = candidates.join(tested, ["a", "b"], "left_anti")
        near = staged(_alike(candidates, reps))
        if near.isEmpty():
            continue
        tested = near if tested is None else staged(tested.union(near))
        new = staged(_verified(docs, near, shingle, percent))
        links = new if links is None else links.union(new)
        labels = components(links)
        label = labels.withColumnRenamed("node", "rep")
        members = staged(
            members.drop("comp").join(label, "rep", "left").select("rep", "n", "key", F.coalesce("label", "rep").alias("comp"))
        )
    if links is None:
        return reps.limit(0).select(F.col("rep").alias("node"), F.col("rep").alias("label"))
    return labels


def _in_open_buckets(members: DataFrame) -> DataFrame:
    """The members of buckets with more than one component, with the number of members as ``_n``."""
    keys = members.groupBy("key").agg(
        F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count("*").alias("_n")
    )
    return members.join(keys.filter("_low < _high").select("key", "_n"), "key")


def _star_pairs(members: DataFrame, step: str, percent: int) -> DataFrame:
    """Pairs ``a < b``: one member of each open bucket with those of other components."""
    rows = _in_open_buckets(members)
    order = F.col("rep") if step == "first" else F.xxhash64("rep", "key")
    chosen = rows.groupBy("key").agg(F.min_by(F.struct("rep", "n", "comp"), order).alias("x"))
    return _met(chosen, rows, percent)


def _other_pairs(docs: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs ``a < b`` of different components in what buckets are still open.

    In a bucket of up to ``SMALL_BUCKET`` members they are taken as they are. The members of larger ones are held
    against each other by their rarest shingles instead.
    """
    rows = staged(_in_open_buckets(members))
    small = rows.filter(F.col("_n") <= SMALL_BUCKET)
    near = _met(small.select("key", F.struct("rep", "n", "comp").alias("x")), small, percent)
    large = staged(rows.filter(F.col("_n") > SMALL_BUCKET).select(F.col("rep").alias("doc_id"), "comp").distinct())
    if large.isEmpty():
        return near
    return near.union(prefix_pairs(docs, large, lambda batches: _shingle_sets(batches, shingle), percent)).distinct()


def _met(chosen: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    met = chosen.join(rows, "key").filter(F.col("x.comp") != F.col("comp"))
    fits = F.least("x.n", "n") * 100 >= F.greatest("x.n", "n") * percent
    low, high = F.least("x.rep", "rep"), F.greatest("x.rep", "rep")
    return met.filter(fits).select(low.alias("a"), high.alias("b")).distinct()


def _alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    sig = reps.select("rep", "sig")
    left = pairs.join(sig, pairs.a == sig.rep).select("a", "b", F.col("sig").alias("sig_a"))
    both = left.join(sig, left.b == sig.rep).select("a", "b", "sig_a", F.col("sig").alias("sig_b"))
    return both.mapInArrow(_agreement, "a long, b long")
