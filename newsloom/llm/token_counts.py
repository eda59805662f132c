"""Token counts of documents in flat token files, by a scan for the end-of-document id."""

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.bytewords import pieces
from newsloom.sources.store import shared_folder

BLOCK_TOKENS = 1 << 20
RUN = 1024
# Fixed value: how texts are split for the given byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file of a byte-level tokenizer: a base64 token and its id per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def write_tokens(docs: DataFrame, ranks: dict[bytes, int], block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Token files of ``docs`` and the list of the documents in them: two written tables.

    Each task writes one flat file of ids with the end-of-document id, the first one that the
    vocabulary leaves free, after each document. A file is stored as its blocks ``file, block, payload`` of
    ``block_tokens`` little-endian ids (two bytes each, or four if the vocabulary is larger), which cut
    through documents anywhere. The list ``file, ordinal, doc_id`` names the documents in order; it
    says nothing of where they lie. A null text has no tokens but is a document.
    """
    spark = docs.sparkSession
    shared, end = spark.sparkContext.broadcast(ranks), max(ranks.values()) + 1
    kind = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        file, block, ordinal = f"part-{TaskContext.get().partitionId():06d}", 0, 0
        waiting: list[np.ndarray] = []
        held = 0

        def row(what: str, **values) -> pa.RecordBatch:
            names = {"block": pa.int64(), "payload": pa.binary(), "ordinal": pa.int64(), "doc_id": pa.int64()}
            n = max(len(v) for v in values.values())
            columns = [pa.array(values.get(c, [None] * n), t) for c, t in names.items()]
            return pa.RecordBatch.from_arrays(
                [pa.array([what] * n), pa.array([file] * n), *columns], names=["kind", "file", *names]
            )

        for batch in pieces(batches):
            ids = batch.column("doc_id").to_pylist()
            yield row("list", ordinal=list(range(ordinal, ordinal + len(ids))), doc_id=ids)
            ordinal += len(ids)
            for text in batch.column("text").to_pylist():
                found = coder.encode_ordinary(text or "")
                found.append(end)
                waiting.append(np.array(found, kind))
                held += len(found)
            while held >= block_tokens:
                joined = np.concatenate(waiting)
                yield row("tokens", block=[block], payload=[joined[:block_tokens].tobytes()])
                block, waiting, held = block + 1, [joined[block_tokens:]], held - block_tokens
        if held:
            yield row("tokens", block=[block], payload=[np.concatenate(waiting).tobytes()])

    path = shared_folder(spark)
    schema = "kind string, file string, block long, payload binary, ordinal long, doc_id long"
    rows = docs.select("doc_id", "text").mapInArrow(encode, schema)
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    # The folder of a kind is only there if it has rows.
    written = spark.read.schema(schema).parquet(path)
    tokens = written.filter("kind = 'tokens'").select("file", "block", "payload")
    listed = written.filter("kind = 'list'").select("file", "ordinal", "doc_id")
    return tokens, listed


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of flat token files that others have written, each file with all its ids one after the other.

    Spark reads such a file whole, as one value, so files are to be smaller than an executor's share of memory.
    """
    size = width * block_tokens
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0)
    last = F.floor((F.col("length") - 1) / size)
    blocks = F.transform(
        F.sequence(F.lit(0).cast("long"), last),
        lambda b: F.struct(b.alias("block"), F.substring(F.col("content"), b * size + 1, F.lit(size)).alias("payload")),
    )
    return files.select(F.col("path").alias("file"), F.inline(blocks))


def scan(tokens: DataFrame, end: int, width: int = 2) -> DataFrame:
    """``file, ordinal, start, n_tokens, complete`` of each document in the blocks ``file, block, payload``.

    Every block is searched for the end id by itself. A prefix scan over the blocks of a file, of
    three numbers each, then tells how many ids and how many documents come before a block
    and where the last document before it ended, so documents that go over any number of
    blocks are put together. The scan has two levels, runs of ``RUN`` blocks and the runs of a file, so that one
    huge file is not summed up in one task.

    * Two ends in a row, or an end that comes first, are a document of no tokens.
    * Ids after the last end of a file are a last document with ``complete`` false.
    * Blocks may have any length; they are taken in the order of ``block``, which should be unique in a file.
    * A null or empty payload is a block of no ids. Columns besides the three are not looked at; no blocks, no rows.
    """
    kind = np.dtype(f"<u{width}")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = batch.column("payload")[i]
                ids = np.frombuffer(cell.as_buffer(), kind) if cell.is_valid else np.empty(0, kind)
                at = np.flatnonzero(ids == end)
                last = int(at[-1]) if len(at) else None
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("file").slice(i, 1),
                        batch.column("block").slice(i, 1),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([last], pa.int64()),
                        pa.array([at.tolist()], pa.list_(pa.int64())),
                    ],
                    names=["file", "block", "n", "last", "ends"],
                )

    found = tokens.select("file", "block", "payload").mapInArrow(
        search, "file string, block long, n long, last long, ends array<long>"
    )
    found = found.withColumn("run", F.floor(F.col("block") / RUN))
    run = Window.partitionBy("file", "run").orderBy("block")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    near = found.withColumns(
        {
            "_base": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "_docs": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
        }
    ).withColumn("_last", F.max(F.col("_base") + F.col("last")).over(before))
    runs = near.groupBy("file", "run").agg(
        F.sum("n").alias("n"), F.sum(F.size("ends")).alias("docs"), F.max(F.col("_base") + F.col("last")).alias("last")
    )
    earlier = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns(
        {
            "base_run": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
            "docs_run": F.coalesce(F.sum("docs").over(earlier), F.lit(0)),
        }
    )
    runs = runs.withColumn("last_run", F.max(F.col("base_run") + F.col("last")).over(earlier))
    total = Window.partitionBy("file")
    runs = runs.withColumn("is_last_run", F.max("run").over(total) == F.col("run")).drop("n", "docs", "last")
    final = F.max("block").over(Window.partitionBy("file", "run")) == F.col("block")
    placed = near.withColumn("_final", final).join(runs, ["file", "run"])
    base = F.col("base_run") + F.col("_base")
    # What ended last before the block: an absolute place, or -1 at the beginning of a file.
    previous = F.coalesce(F.col("base_run") + F.col("_last"), F.col("last_run"), F.lit(-1))
    inside = placed.select(
        "file",
        (F.col("docs_run") + F.col("_docs")).alias("_docs"),
        base.alias("_from"),  # not "_base": within the lambda below, that would mean this column
        previous.alias("_previous"),
        "n",
        F.transform("ends", lambda x: x + base).alias("_ends"),
        (F.col("_final") & F.col("is_last_run")).alias("_final"),
    )
    stop = F.col("_from") + F.col("n")
    open_from = F.coalesce(F.get("_ends", F.size("_ends") - 1), F.col("_previous")) + 1
    ends = F.when(F.col("_final") & (open_from < stop), F.concat("_ends", F.array(stop))).otherwise(F.col("_ends"))
    inside = inside.select("file", "_docs", "_previous", "_ends", ends.alias("_stops"))
    each = inside.select("*", F.posexplode("_stops").alias("_k", "_stop"))
    start = F.when(F.col("_k") == 0, F.col("_previous")).otherwise(F.get("_stops", F.col("_k") - 1)) + 1
    return each.select(
        "file",
        (F.col("_docs") + F.col("_k")).alias("ordinal"),
        start.alias("start"),
        (F.col("_stop") - start).alias("n_tokens"),
        (F.col("_k") < F.size("_ends")).alias("complete"),
    )


def token_counts(docs: DataFrame, vocabulary: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, file, ordinal, start, n_tokens`` of each row of ``docs``, counted in their token files.

    The vocabulary file is read on the driver, where it need only be, and broadcast.
    """
    ranks = read_ranks(vocabulary)
    tokens, listed = write_tokens(docs, ranks, block_tokens)
    end = max(ranks.values()) + 1
    found = scan(tokens, end, 2 if end < 1 << 16 else 4)
    return listed.join(found, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
