"""The feed sources and where each one's articles are routed."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.reference_data import GERMAN_SOURCES, SOURCES
from newsloom.schemas import SOURCE_REGISTRY


def source_registry(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(SOURCES if rows is None else rows, SOURCE_REGISTRY.schema)


def active_sources(registry: DataFrame) -> DataFrame:
    return registry.filter("enabled")


def active_source_articles(registry: DataFrame, articles: DataFrame) -> DataFrame:
    """Enabled sources with the number of articles that carry their name.

    Counted before the join, which leaves one row per source name to match.
    """
    counts = articles.groupBy(F.col("source_name").alias("name")).agg(F.count("*").alias("articles"))
    return (
        active_sources(registry)
        .join(counts, "name", "left")
        .select(
            "name", "url", "priority", "expected_articles", F.coalesce("articles", F.lit(0)).alias("articles")
        )
    )


def source_language_route(articles: DataFrame) -> DataFrame:
    """Articles from German sources are transformed, all others summarised."""
    german = F.col("source_name").isin(GERMAN_SOURCES)
    return articles.withColumn("route", F.when(german, "transform").otherwise("summarize"))
