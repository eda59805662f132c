"""Point lookups, newest-first reads and the joins between the stored tables."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import ntz
from newsloom.operators.keys import attach, deal, without
from newsloom.operators.selection import with_bodies
from newsloom.reference_data import BRIEF_FEED_SOURCE


def by_id(rows: DataFrame, row_id: str) -> DataFrame:
    return rows.filter(F.col("id") == F.lit(row_id))


def newest(rows: DataFrame, at: str, limit: int) -> DataFrame:
    """The ``limit`` newest rows, ties by id.

    A first pass over the time column alone finds the oldest time that still makes it. The
    second reads whole rows from that time on, which the scan can skip to by file
    statistics, so old texts stay on disk.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    last = rows.select(at).orderBy(F.col(at).desc()).limit(limit).agg(F.min(at)).scalar()
    return rows.filter(F.col(at) >= last).orderBy(F.col(at).desc(), F.col("id")).limit(limit)


def recent_articles(articles: DataFrame, limit: int = 100) -> DataFrame:
    return newest(articles.filter(~F.col("is_duplicate")), "published_at", limit)


def recent_briefs(briefs: DataFrame, limit: int = 50) -> DataFrame:
    return newest(briefs, "processed_at", limit)


def recent_translations(translations: DataFrame, language: str, limit: int = 50) -> DataFrame:
    return newest(translations.filter(F.col("language") == language), "translated_at", limit)


def brief_translations(translations: DataFrame, brief_id: str) -> DataFrame:
    return translations.filter(F.col("brief_id") == brief_id).orderBy(
        F.col("translated_at").desc(), F.col("id")
    )


def translations_for_briefs(brief_ids: DataFrame, translations: DataFrame) -> DataFrame:
    """Translations of the requested briefs by brief, newest first; one empty row where there are none.

    Flat rows, not one list per brief: a brief may own any share of the translations.
    """
    dealt = deal(translations, "id")
    wanted = brief_ids.select("brief_id").distinct()
    # A wanted brief stands in every cell that its translations are in, or once without a cell.
    cells = wanted.join(dealt.select("brief_id", "_cell").distinct(), "brief_id", "left")
    joined = cells.join(dealt, ["brief_id", "_cell"], "left").select(*translations.columns)
    return joined.orderBy("brief_id", F.col("translated_at").desc(), "id")


def translation_per_language(translations: DataFrame) -> DataFrame:
    """The oldest translation of each brief and language.

    Ranks up to one are cut before the shuffle, so a crowded pair sends one row per task.
    """
    order = Window.partitionBy("brief_id", "language").orderBy("translated_at", "id")
    return (
        translations.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def unprocessed_articles(articles: DataFrame, briefs: DataFrame) -> DataFrame:
    """Articles that no brief points to."""
    done = briefs.select(F.col("article_id").alias("id"))
    return without(articles, ["id"], done)


def untranslated_briefs(
    briefs: DataFrame, translations: DataFrame, language: str, limit: int | None = None
) -> DataFrame:
    """Briefs without a translation into ``language``, newest first; all of them by default."""
    done = translations.filter(F.col("language") == language).select(F.col("brief_id").alias("id"))
    if limit is None:
        return without(briefs, ["id"], done)
    open_ids = without(briefs.select("id", "processed_at"), ["id"], done)
    page = open_ids.orderBy(F.col("processed_at").desc(), "id").limit(limit).select("id")
    others = [c for c in briefs.columns if c != "id"]
    return with_bodies(page, briefs, others, limit).orderBy(F.col("processed_at").desc(), "id")


def brief_sources(briefs: DataFrame, articles: DataFrame) -> DataFrame:
    """Each brief with the name of the source its article came from."""
    named = articles.select(F.col("id").alias("article_id"), F.col("source_name"))
    return attach(briefs.select("id", "article_id"), named, "article_id", "id").select(
        "id", "article_id", F.coalesce("source_name", F.lit(BRIEF_FEED_SOURCE)).alias("source_name")
    )


def before(column: str, as_of: datetime, days: int) -> Column:
    """Strictly older than ``days`` days."""
    return F.col(column) < ntz(as_of) - F.make_dt_interval(F.lit(days))
