"""Line dedup: lines that many documents share are dropped from all of them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.once import settle
from newsloom.llm.frames import BROADCAST_ROWS, bounded, cleared
from newsloom.llm.text import lower_ascii, trimmed
from newsloom.operators.keys import attach
from newsloom.sources.store import staged

MIN_DOCS = 10
MIN_CHARS = 1


def line_key(line: Column) -> Column:
    return lower_ascii(trimmed(line))


def _hashed(line: Column) -> Column:
    """128 bits of a line's key: two 64-bit hashes with different beginnings."""
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row with 128 bits that stand for it."""
    return docs.withColumns(
        {"_row_a": F.xxhash64("doc_id", "text"), "_row_b": F.xxhash64(F.lit("row"), "text", "doc_id")}
    )


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n")


def common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Hashes of the line keys that occur in ``min_docs`` documents or more.

    A document counts once per key, however often it has the line, because its keys are
    made distinct before they leave it. Counts are summed in part before the shuffle, so
    a line of every document is no more work than any other.
    """
    long_enough = F.filter(_lines(), lambda x: F.length(trimmed(x)) >= min_chars)
    keys = F.array_distinct(F.transform(long_enough, _hashed))
    rows = docs.select(F.inline(keys))
    return rows.groupBy("a", "b").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def _of_common(each: DataFrame, common: DataFrame, most: int) -> DataFrame:
    """The rows of ``each`` whose hash is in ``common``, a written table.

    Up to ``most`` common hashes, counted first, go to the lines, so that no line is shuffled. Beyond that lines go
    to the hashes, each hash's lines dealt into cells, since the line of all documents is as many rows as there are documents.
    """
    hashes = bounded(common, most)
    if hashes is not common:
        return each.join(hashes, ["a", "b"], "left_semi")
    key = F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string")).alias("_hash")
    met = attach(each.select("*", key), common.select(key), "_hash", "_row_a", how="inner")
    return met.drop("_hash")


def drop_common_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped``.

    Lines are exploded as (row, position, hash), met with the common hashes, and the
    positions to drop go back to their row, whose other lines are joined by position; line
    texts themselves are never exploded. ``broadcast_rows`` says up to how many common hashes go to the lines instead of
    the lines to them; the result is the same.

    * A null or empty text is one empty line, which has no key and stays.
    * Every row counts as a document of its own, also rows that are equal in all columns.
    * A null ``doc_id`` is an id like any other.
    * Other columns are passed through, but for those with a name made here, which are replaced or dropped.
    * An empty table gives an empty table.
    """
    docs = cleared(docs, "kept_text", "n_lines", "n_dropped", "_row_a", "_row_b", "_drop", "_lines")
    common = staged(common_lines(docs, min_docs, min_chars).select("a", "b"))
    keyed = _keyed(docs)
    each = keyed.select("_row_a", "_row_b", F.posexplode(F.transform(_lines(), _hashed)).alias("_pos", "_x"))
    each = each.select("_row_a", "_row_b", "_pos", F.col("_x.a").alias("a"), F.col("_x.b").alias("b"))
    dropped = _of_common(each, common, broadcast_rows)
    per_row = dropped.groupBy("_row_a", "_row_b").agg(F.collect_set("_pos").alias("_drop"))
    # Texts are split after the join, so that they are shuffled once and not beside their lines.
    joined = settle(keyed.join(per_row, ["_row_a", "_row_b"], "left"), [*docs.columns, "_drop"], _lines=_lines())
    drop = F.coalesce("_drop", F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), drop)
    return joined.select(
        *docs.columns,
        F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n").alias("kept_text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(drop).cast("long").alias("n_dropped"),
    )
