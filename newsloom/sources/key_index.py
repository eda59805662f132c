"""Side tables of the keys that a store holds, bucketed and sorted by key.

Asking whether keys are stored costs what the asker brings: its keys are dealt into the table's buckets, and the
history is read bucket by bucket where it lies, without a shuffle. Appending writes new files into the same buckets.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


@dataclass(frozen=True)
class KeyIndex:
    """The index of one key column, ``key``, under ``path``; ``name`` is the table's name in the session.

    Each row has the key, the smallest row id it came with, and the number of the batch that brought it. The number of
    buckets is fixed when the index is made; a large store wants as many as its shuffles have partitions.
    """

    name: str
    path: str
    key: str
    buckets: int = BUCKETS

    def opened(self, spark: SparkSession) -> DataFrame:
        """The index as a table, made if there is none. Its folder is all there is to keep: another session opens it again."""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{self.name}` (`{self.key}` STRING, first_id STRING, batch BIGINT) USING parquet "
            f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        return spark.table(self.name)

    def known(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """``key`` of everything stored, or of what batches earlier than ``before`` have stored; keys may repeat.

        A batch that is run again after a failure asks for what was there before it, so that it does not find its own rows.
        """
        rows = self.opened(spark)
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        return rows.select(self.key)

    def add(self, rows: DataFrame, batch: int = -1, row_id: str = "id") -> None:
        """Add the keys of ``rows`` (with ``row_id``) that earlier batches have not brought; null keys are left out.

        Repeating it adds rows that are there already, which changes no answer.
        """
        spark = rows.sparkSession
        new = rows.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(row_id).alias("first_id"))
        new = new.join(self.known(spark, batch), self.key, "left_anti")
        # Dealt into the buckets, each task writes one file of one bucket.
        dealt = new.repartition(self.buckets, self.key)
        dealt.select(self.key, "first_id", F.lit(batch).cast("long").alias("batch")).write.insertInto(self.name)


def history_indexes(path: str, name: str, buckets: int = BUCKETS) -> tuple[KeyIndex, KeyIndex]:
    """The two indexes that ingest asks: content hashes and article ids."""
    return tuple(KeyIndex(f"{name}_{key}", f"{path}/{key}", key, buckets) for key in ("content_hash", "id"))
