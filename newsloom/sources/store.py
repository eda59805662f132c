"""Stored tables: Parquet folders with the fixed schemas, split by day."""

import tempfile
from datetime import datetime, timedelta
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.keyed_append import accepted_rows
from newsloom.operators.lookups import before
from newsloom.operators.retention import retain_translations
from newsloom.reference_data import ARTICLE_RETENTION_DAYS, BRIEF_RETENTION_DAYS
from newsloom.schemas import ARTICLES, BRIEFS, TABLES, TRANSLATIONS, Table

# The time whose day decides a row's folder. The other tables are small and not split.
DAY_OF = {"articles": "fetched_at", "briefs": "processed_at", "translations": "translated_at", "api_logs": "timestamp"}
# Columns of few values that split the days of a table once more, so that counts and filters by them are a matter of folders.
SPLIT_BY = {"articles": ["is_duplicate"], "translations": ["language"]}
# Distinct ids that a row group's Bloom filter is laid out for, about what a row group of texts holds: some 1.2 MB each.
BLOOM_IDS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the place all executors share, which ``spark.checkpoint.dir`` names.

    Only a local session may do without the setting; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is not None:
        return f"{base.rstrip('/')}/newsloom-{uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="newsloom-")


def staged(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Write rows that several later steps read, and go on from the written table.

    Unlike a cached frame it survives the loss of executors, and each reader takes only
    the columns it needs.
    """
    spark = rows.sparkSession
    path = path or f"{shared_folder(spark)}/rows"
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def create_store(spark: SparkSession, root: str) -> None:
    """Make all six tables; those that exist keep their rows."""
    for table in TABLES.values():
        write_table(spark.createDataFrame([], table.schema), root, table)


def folders_of(table: Table) -> list[str]:
    """The columns whose values name the folders of a stored table."""
    return ["day", *SPLIT_BY.get(table.name, [])] if table.name in DAY_OF else []


def full_schema(table: Table) -> T.StructType:
    """The declared columns, and the day where it names a folder."""
    day = [T.StructField("day", T.DateType())] if table.name in DAY_OF else []
    return T.StructType([*table.schema.fields, *day])


def write_table(rows: DataFrame, root: str, table: Table, mode: str = "append", bloom_ids: int = BLOOM_IDS) -> None:
    """Write rows under the table's folder, by day where it has one.

    Files are sorted by key and carry Bloom filters of the ids, so a look-up by id opens the footers of all files
    but reads only row groups that may hold it.
    """
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema])
    path, folders = f"{root}/{table.name}", folders_of(table)
    if folders:
        # Rebalancing by day gives few files per day and still splits a day that is too big for one task.
        rows = rows.withColumn("day", F.to_date(DAY_OF[table.name])).hint("rebalance", "day")
    writer = rows.sortWithinPartitions(*folders, *table.key).write.mode(mode)
    if "id" in table.key:
        writer = writer.option("parquet.bloom.filter.enabled#id", "true")
        writer = writer.option("parquet.bloom.filter.expected.ndv#id", str(bloom_ids))
    (writer.partitionBy(*folders) if folders else writer).parquet(path)


def read_table(
    spark: SparkSession, root: str, table: Table, since: datetime | None = None
) -> DataFrame:
    """The table in its declared layout; with ``since``, folders of earlier days are not listed."""
    rows = spark.read.schema(full_schema(table)).parquet(f"{root}/{table.name}")
    if since is not None:
        rows = rows.filter(F.col("day") >= F.lit(since.date()))
    return rows.select(*table.columns)


def append_accepted(admitted: DataFrame, root: str, table: Table, written_at: datetime) -> None:
    write_table(accepted_rows(admitted, table, written_at), root, table)


def write_kept(
    spark: SparkSession,
    root: str,
    new_root: str,
    as_of: datetime,
    article_days: int = ARTICLE_RETENTION_DAYS,
    brief_days: int = BRIEF_RETENTION_DAYS,
) -> None:
    """Copy what retention keeps to a new store; days wholly past the limit are never read.

    Parquet has no delete, and a folder must not be overwritten while it is read.
    """
    articles = read_table(spark, root, ARTICLES, since=as_of - timedelta(days=article_days))
    write_table(articles.filter(~before("fetched_at", as_of, article_days)), new_root, ARTICLES)
    briefs = read_table(spark, root, BRIEFS, since=as_of - timedelta(days=brief_days))
    kept = briefs.filter(~before("processed_at", as_of, brief_days))
    write_table(kept, new_root, BRIEFS)
    write_table(
        retain_translations(read_table(spark, root, TRANSLATIONS), kept), new_root, TRANSLATIONS
    )
    for name in TABLES.keys() - {"articles", "briefs", "translations"}:
        write_table(read_table(spark, root, TABLES[name]), new_root, TABLES[name])
