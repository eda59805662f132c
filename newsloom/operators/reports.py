"""Counts over the stored tables and over single runs."""

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import ntz
from newsloom.operators.keys import without
from newsloom.schemas import TABLES


def article_counts(articles: DataFrame) -> DataFrame:
    return articles.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("is_duplicate")).alias("unique"),
        (F.count("*") - F.count_if(~F.col("is_duplicate"))).alias("duplicates"),
    )


def articles_by_source(articles: DataFrame) -> DataFrame:
    return (
        articles.filter(~F.col("is_duplicate"))
        .groupBy("source_name")
        .agg(F.count("*").alias("articles"))
        .orderBy(F.col("articles").desc(), "source_name")
    )


def _with_total(counts: DataFrame, column: str) -> DataFrame:
    """Add the sum of a grouped count; it is taken from the groups, whose exchange is shared."""
    return counts.withColumn("total", counts.agg(F.sum(column)).scalar())


def brief_count(briefs: DataFrame) -> DataFrame:
    return briefs.agg(F.count("*").alias("briefs"))


def translations_by_language(translations: DataFrame) -> DataFrame:
    """Count per language with the overall total beside it."""
    per_language = translations.groupBy("language").agg(F.count("*").alias("translations"))
    return _with_total(per_language, "translations").orderBy(
        F.col("translations").desc(), "language"
    )


def table_health(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each stored table; a table that is not given counts as empty."""
    counts = [
        rows.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
        for name, rows in tables.items()
    ]
    missing = [name for name in TABLES if name not in tables]
    if missing:
        spark = next(iter(tables.values())).sparkSession
        counts.append(
            spark.createDataFrame([(name, 0) for name in missing], "table_name string, row_count long")
        )
    return reduce(DataFrame.unionByName, counts)


def store_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Declared layout of each table beside what its rows hold: rows and nulls per column.

    One aggregate per table; the few result cells are turned into rows afterwards.
    """
    parts = []
    for name, rows in tables.items():
        schema = TABLES[name].schema
        # Explode of the one aggregated row, so the size here is the number of columns.
        cells = [
            F.struct(
                F.lit(position).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.lit(field.nullable).alias("nullable"),
                F.count("*").alias("n_rows"),
                F.count_if(F.col(field.name).isNull()).alias("n_null"),
            )
            for position, field in enumerate(schema, start=1)
            if field.name in rows.columns
        ]
        profile = rows.agg(F.array(*cells).alias("cells"))
        parts.append(profile.select(F.lit(name).alias("table_name"), F.inline("cells")))
    return reduce(DataFrame.unionByName, parts)


def batch_outcomes(results: DataFrame, job: str = "job", ok: str = "success") -> DataFrame:
    return results.groupBy(job).agg(
        F.count("*").alias("requested"),
        F.count_if(ok).alias("successful"),
        F.count_if(~F.col(ok)).alias("failed"),
    )


def collected_per_source(articles: DataFrame) -> DataFrame:
    return _with_total(
        articles.groupBy("source_name").agg(F.count("*").alias("collected")), "collected"
    )


def source_coverage(registry_rows: list[tuple], articles: DataFrame) -> DataFrame:
    """Collected against expected articles per day and enabled source, sources with none included.

    Days come from the articles; each is paired with the registry, which is a handful of
    literals, so no join is needed to list the pairs.
    """
    enabled = [(name, expected) for name, _, _, expected, on in registry_rows if on]
    sources = F.array(
        *[
            F.struct(F.lit(name).alias("source_name"), F.lit(expected).alias("expected_articles"))
            for name, expected in enabled
        ]
    )
    day = F.to_date("published_at").alias("day")
    daily = articles.groupBy(day, "source_name").agg(F.count("*").alias("collected"))
    days = daily.select("day").distinct()
    pairs = days.select("day", F.inline(sources))
    return (
        pairs.join(daily, ["day", "source_name"], "left")
        .withColumn("collected", F.coalesce("collected", F.lit(0)))
        .withColumn("shortfall", F.greatest(F.col("expected_articles") - F.col("collected"), F.lit(0)))
    )


def api_usage(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.to_date("timestamp").alias("day"), "model_used", "operation").agg(
        F.count("*").alias("calls"),
        F.count_if(~F.col("success")).alias("failures"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    )


def processing_progress(
    articles: DataFrame, briefs: DataFrame, started_at: datetime | None = None
) -> DataFrame:
    """How far the articles have been turned into briefs.

    With ``started_at``, briefs are told apart as those from before and those of this run.
    """
    new = F.lit(False) if started_at is None else F.col("processed_at") >= ntz(started_at)
    made = briefs.agg(
        F.struct(
            F.count("*").alias("total_processed"),
            F.count_if(~new).alias("previously_processed"),
            F.count_if(new).alias("newly_processed"),
        )
    )
    open_articles = without(
        articles.select("id"), ["id"], briefs.select(F.col("article_id").alias("id"))
    ).agg(F.count("*"))
    return (
        articles.agg(F.count("*").alias("total_articles"))
        .withColumn("made", made.scalar())
        .withColumn("unprocessed", open_articles.scalar())
        .select(
            "total_articles",
            "made.previously_processed",
            "made.newly_processed",
            "made.total_processed",
            (F.col("total_articles") - F.col("made.total_processed")).alias("remaining"),
            "unprocessed",
        )
    )
