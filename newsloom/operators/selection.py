"""Scoring, filtering and ranking of articles."""

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import scoring
from newsloom.functions.once import settle
from newsloom.functions.text import age_hours
from newsloom.reference_data import MIN_QUALITY, TOP_STORIES


def score_articles(articles: DataFrame, as_of: datetime, keep: list[str] | None = None) -> DataFrame:
    """Quality components, quality and composite score per article.

    One map-only pass over the text. ``keep`` names the input columns to carry on; leave the
    body out of it so that whatever sorts or joins next moves only narrow rows.
    """
    keep = articles.columns if keep is None else keep
    needed = list(dict.fromkeys([*keep, "source_name", "published_at"]))
    read = settle(
        articles,
        needed,
        _text=scoring.search_text(F.col("title"), F.col("content")),
        _chars=F.length("content"),
        _hours=age_hours(F.col("published_at"), as_of),
    )
    points = {
        "relevance_points": scoring.relevance_points(F.col("_text")),
        "source_points": scoring.source_points(F.col("source_name")),
        "completeness_points": scoring.completeness_points(F.col("_chars")),
        "freshness_points": scoring.freshness_points(F.col("_hours")),
    }
    scored = settle(read, needed, **points).withColumn(
        "quality_score", sum(F.col(name) for name in points) / F.lit(100.0)
    )
    return scored.select(
        *keep,
        *points,
        "quality_score",
        scoring.composite_score(F.col("quality_score"), F.col("published_at"), as_of).alias(
            "composite_score"
        ),
    )


NARROW = ["id", "source_name", "published_at"]


def high_quality(scored: DataFrame, min_score: float = MIN_QUALITY) -> DataFrame:
    return scored.filter(F.col("quality_score") >= F.lit(min_score))


def top_stories(scored: DataFrame, count: int = TOP_STORIES) -> DataFrame:
    """Best ``count`` scored rows; equal scores go to the newer article, then to the lower id."""
    return scored.orderBy(
        F.col("composite_score").desc(), F.col("published_at").desc(), F.col("id")
    ).limit(count)


def diverse_top_stories(
    scored: DataFrame, count: int = TOP_STORIES, max_per_source: int | None = None
) -> DataFrame:
    """Same as ``top_stories`` unless a limit per source is given."""
    if max_per_source is not None:
        rank = F.row_number().over(
            Window.partitionBy("source_name").orderBy(
                F.col("composite_score").desc(), F.col("published_at").desc(), F.col("id")
            )
        )
        scored = (
            scored.withColumn("_rank", rank).filter(F.col("_rank") <= max_per_source).drop("_rank")
        )
    return top_stories(scored, count)


# A selection of up to this many narrow rows is broadcast; a larger one is left to the planner.
BROADCAST_ROWS = 10_000


def with_bodies(
    selected: DataFrame,
    articles: DataFrame,
    columns: list[str],
    at_most: int,
    within: str | None = None,
) -> DataFrame:
    """Bring title, text and so on back for the selected articles.

    ``at_most`` is the limit that ``selected`` was cut to and decides on the broadcast. With
    ``within``, a time in both frames, only articles between the selection's first and last
    time are read. Give it for a selection that is written out, as it is then read twice.
    """
    if within is not None:
        first, last = (selected.agg(edge(within)).scalar() for edge in (F.min, F.max))
        articles = articles.filter(F.col(within).between(first, last))
        selected = selected.drop(within)
    small = F.broadcast(selected) if at_most <= BROADCAST_ROWS else selected
    return articles.select("id", *columns).join(small, "id")


def quality_filter_stats(scored: DataFrame, min_score: float = MIN_QUALITY) -> DataFrame:
    kept = F.col("quality_score") >= F.lit(min_score)
    return scored.agg(
        F.count("*").alias("total"),
        F.count_if(kept).alias("high_quality"),
        F.count_if(~kept).alias("filtered_out"),
    ).withColumn("threshold", F.lit(float(min_score)))


def selection_stats(scored: DataFrame, count: int = TOP_STORIES) -> DataFrame:
    """Totals, best score and cut-off score of a selection; scores are 0 when there is none."""
    best = top_stories(scored, count).agg(
        F.struct(
            F.count("*").alias("selected"),
            F.coalesce(F.round(F.max("composite_score"), 2), F.lit(0.0)).alias("top_score"),
            F.coalesce(F.round(F.min("composite_score"), 2), F.lit(0.0)).alias("cutoff_score"),
        )
    )
    return scored.agg(F.count("*").alias("total_articles")).withColumn("best", best.scalar()).select(
        "total_articles",
        "best.selected",
        (F.col("total_articles") <= count).alias("selected_all"),
        "best.top_score",
        "best.cutoff_score",
    )
