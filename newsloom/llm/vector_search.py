"""Nearest vectors by cosine: tiles of int8 products first, what may still win in double precision."""

from collections.abc import Iterator
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.sources.store import staged

NEAREST = 5
BLOCK_BYTES = 64 << 20
TILE_ROWS = 2048
TILE_QUERIES = 1024
PAIRS_AT_ONCE = 32_768
# Products of int8 values are whole numbers; a sum of this many of them is exact in single precision.
EXACT_TERMS = 1040
# More than the rounding of the bounds themselves, which are computed in single precision.
SLACK = 4e-6


def _ordered_dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of the rows of ``x`` and ``y``, added up in the order of the components."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dimension, ids, rows)`` of the vectors that take part."""
    column = batch.column("embedding")
    starts = column.offsets.to_numpy()[:-1].astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    usable = column.is_valid().to_numpy(False) & batch.column("vec_id").is_valid().to_numpy(False)
    ids = batch.column("vec_id").fill_null(0).to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
    for size in np.unique(sizes[usable & (sizes > 0)]):
        mine = np.flatnonzero(usable & (sizes == size))
        rows = flat[starts[mine][:, None] + np.arange(size)]
        with np.errstate(over="ignore", invalid="ignore"):
            square = _ordered_dot(rows, rows)
        good = np.isfinite(square) & (square > 0)
        if good.any():
            yield int(size), ids[mine][good], rows[good]


class Quantised:
    """Unit vectors as int8, with the length of what rounding leaves of each."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.square = _ordered_dot(rows, rows)
        unit = rows / np.sqrt(self.square)[:, None]
        scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / scale[:, None]).astype(np.int8)
        self.error = np.linalg.norm(unit - self.codes * scale[:, None], axis=1)
        self.scale = scale

    def __len__(self) -> int:
        return len(self.rows)

    def tile(self, at: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.codes[at:to].astype(np.float32), self.scale[at:to].astype(np.float32), self.error[at:to]

    def cosine(self, mine: np.ndarray, other: "Quantised", theirs: np.ndarray) -> np.ndarray:
        """The measure itself, on the vectors as they were given."""
        out = np.empty(len(mine))
        for at in range(0, len(mine), PAIRS_AT_ONCE):
            m, t = mine[at : at + PAIRS_AT_ONCE], theirs[at : at + PAIRS_AT_ONCE]
            found = _ordered_dot(self.rows[m], other.rows[t]) / np.sqrt(self.square[m] * other.square[t])
            out[at : at + PAIRS_AT_ONCE] = np.clip(found, -1, 1)
        return out


def _bounds(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of all cosines of two tiles, and how far each may be off."""
    (x, x_scale, x_error), (y, y_scale, y_error) = left, right
    product = np.zeros((len(x), len(y)), np.float32 if x.shape[1] <= EXACT_TERMS else np.float64)
    for at in range(0, x.shape[1], EXACT_TERMS):
        product += x[:, at : at + EXACT_TERMS] @ y[:, at : at + EXACT_TERMS].T
    product *= x_scale[:, None]
    product *= y_scale
    off = x_error[:, None] + (1 + x_error)[:, None] * y_error + SLACK
    return product, off.astype(np.float32)


def _distinct(ids: np.ndarray, rows: np.ndarray, most: int | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different vectors among ``rows`` and, for each, its smallest ``most`` ids (all, if None)."""
    packed = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 8))).ravel()
    _, first, group = np.unique(packed, return_index=True, return_inverse=True)
    order = np.lexsort((ids, group))
    ids, group = ids[order], group[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (group[1:] != group[:-1])]
    ids, group = ids[new], group[new]
    edges = np.searchsorted(group, np.arange(len(first) + 1))
    return rows[first], [ids[a:b][:most] for a, b in zip(edges[:-1], edges[1:], strict=True)]


class _Search:
    """The best of all rows seen by a task, for the queries of one dimension."""

    def __init__(self, queries: Quantised, most: int):
        self.queries, self.most = queries, most
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(queries))]
        self.worst = np.full(len(queries), -np.inf)

    def look_at(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(rows), TILE_ROWS):
            # Only the smallest ids of equal vectors can be among the nearest.
            different, owners = _distinct(ids[at : at + TILE_ROWS], rows[at : at + TILE_ROWS], self.most)
            vectors = Quantised(different)
            whole = vectors.tile(0, len(vectors))
            for q in range(0, len(self.queries), TILE_QUERIES):
                self._tile(vectors, owners, whole, q)

    def _tile(self, vectors: Quantised, owners: list[np.ndarray], whole: tuple, q: int) -> None:
        estimate, off = _bounds(self.queries.tile(q, q + TILE_QUERIES), whole)
        least = self.worst[q : q + len(estimate)].copy()
        if len(vectors) >= self.most:
            place = len(vectors) - self.most
            sure = np.partition(estimate - off, place, axis=1)[:, place]
            least = np.maximum(least, sure)
        query, found = np.nonzero(estimate + off >= least[:, None])
        score = self.queries.cosine(query + q, vectors, found)
        better = np.flatnonzero(score >= self.worst[query + q])
        for i in better[np.argsort(-score[better], kind="stable")].tolist():
            self._offer(int(query[i]) + q, float(score[i]), owners[found[i]])

    def _offer(self, query: int, score: float, ids: np.ndarray) -> None:
        heap = self.heaps[query]
        for vec_id in ids.tolist():
            entry = (score, -vec_id)
            if entry in heap:
                continue
            if len(heap) < self.most:
                heappush(heap, entry)
            elif entry > heap[0]:
                heappushpop(heap, entry)
            else:
                break
        if len(heap) == self.most:
            self.worst[query] = heap[0][0]


def _nearest_in(shared, k: int, most: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = {size: _Search(Quantised(rows), most) for size, (rows, _) in shared.value.items()}
        for batch in batches:
            for size, ids, rows in _by_dimension(batch):
                if size in by_size:
                    by_size[size].look_at(ids, rows)
        for size, done in by_size.items():
            query, found, score = [], [], []
            for heap, owners in zip(done.heaps, shared.value[size][1], strict=True):
                best = sorted(heap, reverse=True)
                for own in owners.tolist():
                    mine = [(s, -i) for s, i in best if -i != own][:k]
                    query += [own] * len(mine)
                    found += [i for _, i in mine]
                    score += [s for s, _ in mine]
            arrays = [pa.array(query, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` nearest to each row of ``queries``.

    Both have ``vec_id`` and ``embedding`` (numbers). Nearness is the cosine in double precision; equal scores go by
    ``vec_id``. Queries are held against all rows in blocks of at most ``block_bytes``, one pass over ``vectors`` per
    block. A task multiplies tiles of int8 codes; the lengths of the rounding errors bound each cosine from both
    sides, and only pairs whose upper bound reaches the best lower bounds are computed from the given
    vectors and go to the query's heap. The result is exact.

    * A vector that is null, empty or zero, holds a null, NaN or infinite component, or has a length out of the range
      of doubles takes no part, and neither does a row without an id.
    * Vectors of different dimensions are not compared.
    * Rows with a query's id are never found for it. Equal rows count once; an id with several vectors is a candidate with each of them.
    * Equal vectors are computed once per tile, whatever their number.
    * Columns besides ``vec_id`` and ``embedding`` are not looked at. If either table is empty, so is the result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    asked = queries.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).distinct()
    asked = staged(asked.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)))
    per_id = asked.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum(F.size("embedding")).alias("terms"))
    own, terms = per_id.agg(F.max("n"), F.sum("terms")).first()
    blocks = 8 * (terms or 0) // block_bytes + 1
    schema = "query_id long, vec_id long, score double"
    parts = [spark.createDataFrame([], schema)]
    for block in range(blocks if own else 0):
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(_gathered(mine.toArrow()))
        found = rows.mapInArrow(_nearest_in(shared, k, k + own), schema)
        parts.append(staged(_ranked(found, k)))
        shared.destroy()
    out = parts[0].withColumn("rank", F.lit(0)) if len(parts) == 1 else parts[1]
    for part in parts[2:]:
        out = out.union(part)
    return out.select("query_id", "rank", "vec_id", "score")


def _gathered(block: pa.Table) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """The different vectors of a block of queries by dimension, each with the ids that ask for it."""
    parts: dict[int, list] = {}
    for batch in block.to_batches():
        for size, ids, rows in _by_dimension(batch):
            parts.setdefault(size, []).append((ids, rows))
    return {
        size: _distinct(np.concatenate([i for i, _ in found]), np.concatenate([r for _, r in found]), None)
        for size, found in parts.items()
    }


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best of all tasks; a row that two tasks found stands once."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)
    return ranked.dropDuplicates(["query_id", "rank"])
