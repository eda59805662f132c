"""Answers that a stored table's folders and file footers give: counts without a column read, newest rows by folder."""

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators.lookups import newest
from newsloom.schemas import ARTICLES, TABLES, TRANSLATIONS, Table
from newsloom.sources.store import DAY_OF, folders_of, full_schema, read_table, staged

# Spark counts from Parquet footers only in its second reader, which takes over for what this list does not name.
_FIRST_READER_FOR = "spark.sql.sources.useV1SourceList"
_COUNT_IN_FOOTERS = "spark.sql.parquet.aggregatePushdown"


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    names = {"first_reader_for": _FIRST_READER_FOR, "count_in_footers": _COUNT_IN_FOOTERS}
    before = {names[k]: spark.conf.get(names[k]) for k in values}
    try:
        for k, value in values.items():
            spark.conf.set(names[k], value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def footer_frame(spark: SparkSession, root: str, table: Table) -> DataFrame:
    """``n_rows`` per folder of the table (``day`` and what else splits it); planned with footer counts switched on."""
    with _settings(spark, first_reader_for=""):
        rows = spark.read.schema(full_schema(table)).parquet(f"{root}/{table.name}")
    return rows.groupBy(*folders_of(table)).agg(F.count("*").alias("n_rows"))


def folder_counts(spark: SparkSession, root: str, table: Table) -> DataFrame:
    """``n_rows`` per folder, as a written table of as many rows as there are folders. Read are file footers alone."""
    counts = footer_frame(spark, root, table)
    with _settings(spark, count_in_footers="true"):
        return staged(counts)


def stored_health(spark: SparkSession, root: str) -> DataFrame:
    """``table_name, row_count`` of the six stored tables, an empty one included."""
    health = None
    for name, table in TABLES.items():
        counted = folder_counts(spark, root, table).agg(
            F.lit(name).alias("table_name"), F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("row_count")
        )
        health = counted if health is None else health.union(counted)
    return health


def stored_article_counts(spark: SparkSession, root: str) -> DataFrame:
    """``total, unique, duplicates`` of the stored articles, by the folders of the duplicate flag."""

    def total(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col("n_rows"))), F.lit(0)).cast("long")

    unique = ~F.col("is_duplicate")
    return folder_counts(spark, root, ARTICLES).agg(
        total(F.lit(True)).alias("total"),
        total(unique).alias("unique"),
        (total(F.lit(True)) - total(unique)).alias("duplicates"),
    )


def stored_translation_counts(spark: SparkSession, root: str) -> DataFrame:
    """``language, translations, total`` of the stored translations."""
    counts = folder_counts(spark, root, TRANSLATIONS)
    per_language = counts.groupBy("language").agg(F.sum("n_rows").alias("translations"))
    return per_language.withColumn("total", counts.agg(F.sum("n_rows")).scalar())


def first_day_needed(counts: DataFrame, limit: int) -> date | None:
    """The day from which on the folders hold ``limit`` rows, or the first day if they never do; one date for the driver."""
    days = counts.filter(F.col("day").isNotNull()).groupBy("day").agg(F.sum("n_rows").alias("_n"))
    # One row per day of the store's life, so one task orders them.
    upto = F.sum("_n").over(Window.orderBy(F.col("day").desc()))
    summed = days.withColumn("_upto", upto)
    enough = F.max(F.when(F.col("_upto") >= limit, F.col("day")))
    return summed.agg(F.coalesce(enough, F.min("day"))).first()[0]


def newest_stored(spark: SparkSession, root: str, table: Table, limit: int, **folder: str) -> DataFrame:
    """The ``limit`` newest rows of a table split by the day of the time it is read by, ties by id.

    ``folder`` names further folders to stay in, such as ``language="or"``. Footer counts tell how many days back to go; older
    days are neither listed as input nor opened. The result equals that of ``newest`` over the whole table, as a row's
    day never contradicts its time.
    """
    counts = folder_counts(spark, root, table)
    wanted = F.lit(True)
    for column, value in folder.items():
        wanted = wanted & (F.col(column) == F.lit(value))
    day = first_day_needed(counts.filter(wanted), limit)
    since = None if day is None else datetime.combine(day, time.min)
    return newest(read_table(spark, root, table, since=since).filter(wanted), DAY_OF[table.name], limit)
