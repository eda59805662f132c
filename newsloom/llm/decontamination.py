"""Benchmark decontamination: documents that hold a benchmark item, also in another order."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.bytewords import NOT_ALNUM, Words, chunks, windows, words_of
from newsloom.llm.frames import of_ids, small_batches
from newsloom.llm.string_tiling import covered_words
from newsloom.sources.store import staged

LEAST = 5
COVERAGE = 0.5
BLOCK_WORDS = 2_000_000
_GAP = np.uint64(0)  # stands between pieces of a text; no word's hash


def item_blocks(benchmark: DataFrame, most: int) -> Iterator[tuple[list, list]]:
    """The items in blocks of some ``most`` words, which bounds what is broadcast at a time."""
    size = F.regexp_count(F.col("text"), F.lit("[A-Za-z0-9\\x80-\\x{10FFFF}]+"))
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text", size.alias("_n"))
    total = items.agg(F.sum("_n")).first()[0] or 0
    n = total // most + 1
    for k in range(n if total else 0):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text").collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = LEAST,
    coverage: float = COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``doc_id, item_id, item_words, covered_words, n_tiles, longest_tile, coverage`` per leak.

    Words are runs of letters and digits, A-Z in lower case. Windows of ``least`` words that a document and an item
    share are its seeds; over the places of the seeds, greedy string tiling finds the item's words that
    occur in the document in tiles of ``least`` words or more, in whatever order. A leak is a
    document and an item whose tiles cover at least ``coverage`` of the item's words.

    The items are read in blocks of about ``block_words`` words, one pass over the texts per block,
    so that what is broadcast does not grow with the benchmark. A document is judged in its own task.

    * Null and empty texts leak nothing; an item of fewer than ``least`` words cannot be found.
    * Equal documents are each reported, equal items (with different ids) too; exactly repeated
      rows of either table give repeated rows.
    * Columns besides ``doc_id``, ``text`` and ``item_id`` are not looked at; if either table is empty, so is the result.
    """
    schema = "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, longest_tile long"
    small_batches(docs)
    found = None
    for ids, texts in item_blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast((ids, *_index(texts, least)))
        part = docs.select("doc_id", "text").mapInArrow(_finder(shared, least, coverage), schema)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def _index(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The items' words with each item's range of them, and their windows by hash with the item of each."""
    items = words_of(pa.array(texts, pa.string()), NOT_ALNUM)
    seeds, at, _ = windows(items, least)
    order = np.argsort(seeds, kind="stable")
    return items.hashes, items.offsets, seeds[order], items.text_of_word()[at][order]


def _finder(shared, least: int, coverage: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, *index = shared.value
        for batch, words in chunks(batches, NOT_ALNUM):
            yield _table(_leaks_in(batch, words, ids, *index, least, coverage))

    return find


def _leaks_in(batch, words: Words, ids, item_words, item_bounds, seeds, item_of, least, coverage) -> list[tuple]:
    hashes, at, _ = windows(words, least)
    if not len(seeds) or not len(hashes):
        return []
    low = np.searchsorted(seeds, hashes, "left")
    hit = seeds[np.minimum(low, len(seeds) - 1)] == hashes
    low, at = low[hit], at[hit]
    high = np.searchsorted(seeds, hashes[hit], "right")
    text_of = np.searchsorted(words.offsets, at, "right") - 1
    # A row for each seed and item that has it, by text and item.
    repeat = high - low
    entry = np.repeat(low, repeat) + np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    item, text, place = item_of[entry], np.repeat(text_of, repeat), np.repeat(at, repeat)
    order = np.lexsort((place, item, text))
    item, text, place = item[order], text[order], place[order]
    if not len(item):
        return []
    pair = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (text[1:] != text[:-1])])
    out = []
    for start, end in zip(pair, [*pair[1:], len(item)], strict=True):
        pattern = item_words[item_bounds[item[start]] : item_bounds[item[start] + 1]]
        sought = np.unique(place[start:end])
        # Tiles lie within runs of seeds, so an upper bound of what they can cover is cheap.
        if len(sought) + (least - 1) * (1 + (np.diff(sought) > 1).sum()) < coverage * len(pattern):
            continue
        covered, n, longest = covered_words(_around(words.hashes, sought, least), pattern, least)
        if covered >= coverage * len(pattern):
            doc = batch.column("doc_id")[int(text[start])].as_py()
            out.append((doc, ids[item[start]], len(pattern), covered, n, longest))
    return out


def _around(hashes: np.ndarray, places: np.ndarray, least: int) -> np.ndarray:
    """The words of the windows at ``places``, with a gap wherever words are left out."""
    parts, start = [], 0
    for end in [*(np.flatnonzero(np.diff(places) > 1) + 1), len(places)]:
        parts += [hashes[places[start] : places[end - 1] + least], np.array([_GAP])]
        start = end
    return np.concatenate(parts)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "item_id", "item_words", "covered_words", "n_tiles", "longest_tile"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that leak no item; rows without an id are never removed."""
    return of_ids(docs, staged(leaks(docs, benchmark, **limits).select("doc_id").distinct()), "left_anti")
