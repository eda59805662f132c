"""Ranked lexical search over a length-stratified index."""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.bytewords import NOT_ALNUM, chunks, words_of
from newsloom.llm.decontamination import item_blocks
from newsloom.llm.frames import small_batches
from newsloom.sources.store import staged

BEST = 10
BLOCK_WORDS = 2_000_000
SEGMENT_POSTINGS = 1_000_000
SEGMENT_ROWS = 32_768
CELLS_AT_ONCE = 2_000_000
# Shares of an item's strata that are visited before its threshold is looked at again.
VISITS = (1 / 32, 1 / 8, 1 / 3, 1)


@dataclass
class Items:
    """What is asked: for each item the numbers of its terms and how often it has them."""

    ids: list
    vocabulary: np.ndarray  # hashes of the terms, ascending; a term's number is its place
    item: np.ndarray
    term: np.ndarray
    repeats: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> "Items":
        words = words_of(pa.array(texts, pa.string()), NOT_ALNUM)
        vocabulary, number = np.unique(words.hashes, return_inverse=True)
        key, repeats = np.unique(number * len(ids) + words.text_of_word(), return_counts=True)
        term, item = np.divmod(key, max(len(ids), 1))
        return cls(ids, vocabulary, item, term, repeats.astype(np.int64))


def _postings(shared):
    """Per row with a word: its length in words, and the asked terms it holds with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch, words in chunks(batches, NOT_ALNUM):
            place = np.searchsorted(vocabulary, words.hashes)
            place[place == len(vocabulary)] = 0
            hit = vocabulary[place] == words.hashes
            key, tf = np.unique(words.text_of_word()[hit] * len(vocabulary) + place[hit], return_counts=True)
            row, term = np.divmod(key, len(vocabulary))
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            arrays = [
                batch.column("doc_id"),
                pa.array(np.diff(words.offsets).astype(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
            ]
            found = pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "terms", "tfs"])
            yield found.filter(pa.array(np.diff(words.offsets) > 0))

    return count


def _holders(vocabulary_size: int):
    """How many rows of a task hold each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(vocabulary_size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=vocabulary_size)
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(held[term])], names=["term", "rows"])

    return count


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Segment:
    """An index over some rows: strata of equal normaliser, in them postings by term and count.

    The impact of a term is computed once for each stratum and count, and shared by the
    postings of that level. The impact of a run's largest count bounds what its term adds
    to any row of the stratum.
    """

    def __init__(self, doc_id, n, offsets, terms, tfs, weights, rows: int, words: int):
        self.doc_id = doc_id
        m = 25 + 75 * n * rows // words
        self.strata, stratum = np.unique(m, return_inverse=True)
        self.stratum_of_row = stratum
        row = np.repeat(np.arange(len(n)), np.diff(offsets))
        order = np.lexsort((tfs, terms, stratum[row]))
        self.row, term, tf, at = row[order], terms[order], tfs[order].astype(np.int64), stratum[row][order]
        level = _runs(at, term, tf)
        worth = weights[term[level]] * (1_000_000_000 * tf[level] // (1000 * tf[level] + 8 * self.strata[at[level]]))
        self.impact = np.repeat(worth, np.diff(np.r_[level, len(tf)]))
        self.run = _runs(at, term)
        self.size = np.diff(np.r_[self.run, len(tf)])
        self.stratum_of_run, self.term_of_run = at[self.run], term[self.run]
        self.top = self.impact[self.run + self.size - 1] if len(tf) else self.impact


class Best:
    """The best rows found so far for each item, and the score that a row has to reach."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.doc_id = np.empty(0, np.int64)
        self.known = np.empty(0, bool)
        self.least = np.ones(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc_id: np.ndarray, known: np.ndarray) -> None:
        item, score = np.r_[self.item, item], np.r_[self.score, score]
        doc_id, known = np.r_[self.doc_id, doc_id], np.r_[self.known, known]
        order = np.lexsort((doc_id, ~known, -score, item))
        first = np.searchsorted(item[order], item[order])
        order = order[np.arange(len(order)) - first < self.k]
        self.item, self.score, self.doc_id, self.known = item[order], score[order], doc_id[order], known[order]
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.least)) == self.k)
        last = np.searchsorted(self.item, full, "right") - 1
        self.least[full] = np.maximum(self.least[full], self.score[last])


def _search(segment: Segment, items: Items, known: np.ndarray, best: Best) -> None:
    """Look a segment up for all items, some at a time, so that no table of scores or postings grows large."""
    postings = np.bincount(segment.term_of_run, weights=segment.size, minlength=len(items.vocabulary))
    work = np.bincount(items.item, weights=postings[items.term], minlength=len(items.ids))
    part = np.cumsum(np.maximum(work, len(segment.doc_id))) // CELLS_AT_ONCE
    for first, after in zip(_runs(part), [*_runs(part)[1:], len(part)], strict=True):
        mine = np.flatnonzero((items.item >= first) & (items.item < after))
        # An entry for each run and each item of the part that asks for its term.
        begin = np.searchsorted(items.term[mine], segment.term_of_run, "left")
        size = np.searchsorted(items.term[mine], segment.term_of_run, "right") - begin
        ask, run = mine[_ranges(begin, size)], np.repeat(np.arange(len(segment.run)), size)
        _visit(segment, items.item[ask] - first, items.repeats[ask], run, known, best, first, after - first)


def _visit(segment: Segment, item, repeats, run, known: np.ndarray, best: Best, first: int, n: int) -> None:
    strata, rows = len(segment.strata), len(segment.doc_id)
    bound = np.zeros((n, strata), np.int64)
    stratum = segment.stratum_of_run[run]
    np.add.at(bound, (item, stratum), repeats * segment.top[run])
    place = np.empty((n, strata), np.int64)
    np.put_along_axis(place, np.argsort(-bound, axis=1, kind="stable"), np.arange(strata)[None, :], axis=1)
    score = np.zeros(n * rows, np.int64)
    done = 0
    for share in VISITS:
        upto = math.ceil(strata * share)
        # A stratum whose bound is below the threshold holds no row that belongs to the best.
        visit = (place >= done) & (place < upto) & (bound >= best.least[first : first + n, None])
        done = upto
        chosen = np.flatnonzero(visit[item, stratum])
        if not len(chosen):
            continue
        size = segment.size[run[chosen]]
        posting = _ranges(segment.run[run[chosen]], size)
        cell = np.repeat(item[chosen] * rows, size) + segment.row[posting]
        np.add.at(score, cell, np.repeat(repeats[chosen], size) * segment.impact[posting])
        table = score.reshape(n, rows)
        found, row = np.nonzero(visit[:, segment.stratum_of_row] & (table >= best.least[first : first + n, None]))
        got = table[found, row]
        # Of many equal rows only the best of this visit are carried on.
        if len(found) > best.k * n:
            order = np.lexsort((segment.doc_id[row], ~known[row], -got, found))
            place_of = np.arange(len(order)) - np.searchsorted(found[order], found[order])
            order = order[place_of < best.k]
            found, row, got = found[order], row[order], got[order]
        best.add(found + first, got, segment.doc_id[row], known[row])


def _best_of_task(shared, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, rows, words = shared.value
        best = Best(len(items.ids), k)
        for held in _segments(batches):
            doc = held.column("doc_id")
            terms = held.column("terms")
            offsets = terms.offsets.to_numpy() - terms.offsets[0].as_py()
            segment = Segment(
                doc.fill_null(0).to_numpy(), held.column("n").to_numpy(), offsets, terms.flatten().to_numpy(),
                held.column("tfs").flatten().to_numpy(), weights, rows, words,
            )
            _search(segment, items, doc.is_valid().to_numpy(False), best)
        arrays = [
            pa.array(best.item),
            pa.array([items.ids[i] for i in best.item.tolist()], pa.int64()),
            pa.array(best.doc_id, mask=~best.known),
            pa.array(best.score),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["item", "item_id", "doc_id", "score"])

    return search


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in pieces of some ``SEGMENT_POSTINGS`` postings."""
    held, postings, rows = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            piece = batch.slice(at, 4096)
            held.append(piece)
            postings += len(piece.column("terms").flatten())
            rows += piece.num_rows
            if postings >= SEGMENT_POSTINGS or rows >= SEGMENT_ROWS:
                yield pa.concat_batches(held)
                held, postings, rows = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def rank(docs: DataFrame, items: DataFrame, k: int = BEST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best rows of ``docs`` (``doc_id, text``) for each row of ``items``
    (``item_id, text``).

    Terms are runs of letters and digits and of all characters beyond ASCII, A-Z in lower case. A term's weight falls with the number of
    documents that hold it; a document's score sums, over the item's terms with repeats, the weight times the saturated
    count of the term, normalised by the document's length.

    The texts are read once per block of items (of some ``block_words`` words, which bounds what is broadcast): that gives
    each document's length and its counts of the terms asked for. The index is built of these rows where they are, in
    segments: documents of one normaliser are a stratum, its postings are ordered by term and count, and a count's impact is
    computed once per stratum. For each item the strata are visited by falling bounds; those whose bound is below the
    score of the k-th best so far are left out, which loses nothing. Tasks give their best rows, of which the best of all remain.

    * A null or empty text, or one without a term, is no document and counts nowhere; an item without a term finds nothing.
    * Only scores above 0 are found. Equal scores go by ``doc_id``, rows without an id last.
    * Every row is a document or an item of its own, repeated rows too.
    * Columns besides ``doc_id``, ``item_id`` and ``text`` are not looked at. If either table is empty, so is the result.
    """
    spark = docs.sparkSession
    small_batches(docs)
    parts = []
    for ids, texts in item_blocks(items, block_words):
        asked = Items.of(ids, texts)
        if len(asked.vocabulary):
            parts.append(_ranked_block(docs, asked, k))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _ranked_block(docs: DataFrame, asked: Items, k: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    vocabulary = context.broadcast(asked.vocabulary)
    schema = "doc_id long, n long, terms array<int>, tfs array<int>"
    held = staged(docs.select("doc_id", "text").mapInArrow(_postings(vocabulary), schema))
    vocabulary.destroy()
    rows, words = held.agg(F.count("*"), F.sum("n")).first()
    counted = held.select("terms").mapInArrow(_holders(len(asked.vocabulary)), "term long, rows long")
    holders = np.zeros(len(asked.vocabulary), np.int64)
    for r in counted.groupBy("term").agg(F.sum("rows").alias("rows")).collect():
        holders[r["term"]] = r["rows"]
    weights = [math.floor(1000 * math.log((2 * rows + 2) / (2 * df + 1))) for df in holders.tolist()]
    shared = context.broadcast((asked, np.array(weights, np.int64), rows, words or 1))
    schema = "item long, item_id long, doc_id long, score long"
    found = held.mapInArrow(_best_of_task(shared, k), schema)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = staged(best.select("item_id", "rank", "doc_id", "score"))
    shared.destroy()
    return out
