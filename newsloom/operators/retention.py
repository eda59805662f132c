"""What to keep after a clean-up. Callers write the kept rows to a new place."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.keys import attach
from newsloom.operators.lookups import before
from newsloom.reference_data import ARTICLE_RETENTION_DAYS, BRIEF_RETENTION_DAYS


def retain_articles(
    articles: DataFrame, as_of: datetime, days: int = ARTICLE_RETENTION_DAYS
) -> DataFrame:
    return articles.filter(~before("fetched_at", as_of, days))


def retain_briefs(briefs: DataFrame, as_of: datetime, days: int = BRIEF_RETENTION_DAYS) -> DataFrame:
    return briefs.filter(~before("processed_at", as_of, days))


def retain_translations(translations: DataFrame, kept_briefs: DataFrame) -> DataFrame:
    """Translations go with their brief."""
    kept = kept_briefs.select(F.col("id").alias("brief_id")).withColumn("_kept", F.lit(True))
    return attach(translations, kept, "brief_id", "id", how="inner").drop("_kept")


def cleanup_stats(
    articles: DataFrame,
    briefs: DataFrame,
    as_of: datetime,
    article_days: int = ARTICLE_RETENTION_DAYS,
    brief_days: int = BRIEF_RETENTION_DAYS,
) -> DataFrame:
    flags = articles.select(
        before("fetched_at", as_of, article_days).alias("old_article"), F.lit(False).alias("old_brief")
    ).unionByName(
        briefs.select(
            F.lit(False).alias("old_article"), before("processed_at", as_of, brief_days).alias("old_brief")
        )
    )
    return flags.agg(
        F.count_if("old_article").alias("articles_deleted"),
        F.count_if("old_brief").alias("briefs_deleted"),
    )
