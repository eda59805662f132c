"""The read path: recent briefs with their translations, or raw articles until there are briefs."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.once import settle
from newsloom.functions.text import excerpt, iso_utc, ntz, words
from newsloom.operators.lookups import (
    by_id,
    recent_articles,
    recent_briefs,
    translation_per_language,
)
from newsloom.reference_data import (
    BRIEF_FEED_SOURCE,
    RAW_FEED_CATEGORY,
    RAW_FEED_NOTE,
    SUMMARY_WORDS,
)

MAX_FEED = 100
_NO_TRANSLATIONS = "map<string,map<string,string>>"


def check_limit(limit: int) -> None:
    if not 1 <= limit <= MAX_FEED:
        raise ValueError(f"limit must be between 1 and {MAX_FEED}")


def _texts() -> Column:
    names = ["title", *SUMMARY_WORDS]
    return F.create_map(*[c for n in names for c in (F.lit(n), F.col(n))])


def article_excerpts(articles: DataFrame) -> DataFrame:
    """Stand-in summaries: the first words of each text."""
    split = words(F.col("content"), at_most=max(SUMMARY_WORDS.values()))
    cuts = {name: excerpt(F.col("_words"), n) for name, n in SUMMARY_WORDS.items()}
    return settle(settle(articles, _words=split), articles.columns, **cuts)


def _payload(page: DataFrame, source: Column, category: Column, at: str) -> DataFrame:
    return page.select(
        "id",
        source.alias("source"),
        category.alias("category"),
        iso_utc(F.col(at)).alias("publishedAt"),
        _texts().alias("english"),
        "translations",
    ).orderBy(F.col("publishedAt").desc(), "id")


def _with_translations(page: DataFrame, translations: DataFrame, language: str | None) -> DataFrame:
    """Add the map of translations by language. ``page`` has at most ``MAX_FEED`` rows."""
    if language is not None:
        translations = translations.filter(F.col("language") == language)
    ids = page.select(F.col("id").alias("brief_id"))
    wanted = translations.join(F.broadcast(ids), "brief_id", "left_semi")
    # One row per brief and language from here on, so a list has at most one item per language.
    maps = (
        translation_per_language(wanted)
        .select("brief_id", F.struct("language", _texts()).alias("_entry"))
        .groupBy(F.col("brief_id").alias("id"))
        .agg(F.map_from_entries(F.collect_list("_entry")).alias("translations"))
    )
    empty = F.create_map().cast(_NO_TRANSLATIONS)
    return page.join(maps, "id", "left").withColumn(
        "translations", F.coalesce("translations", empty)
    )


def brief_feed(
    briefs: DataFrame, translations: DataFrame, limit: int = 20, language: str | None = None
) -> DataFrame:
    check_limit(limit)
    page = recent_briefs(briefs, limit).filter(F.col("processed_at").isNotNull())
    page = _with_translations(page, translations, language)
    return _payload(page, F.lit(BRIEF_FEED_SOURCE), F.col("category"), "processed_at")


def raw_article_feed(articles: DataFrame, limit: int = 20) -> DataFrame:
    check_limit(limit)
    page = article_excerpts(recent_articles(articles, limit)).withColumn(
        "translations", F.create_map().cast(_NO_TRANSLATIONS)
    )
    return _payload(page, F.col("source_name"), F.lit(RAW_FEED_CATEGORY), "published_at")


def article_feed(
    articles: DataFrame,
    briefs: DataFrame,
    translations: DataFrame,
    limit: int = 20,
    language: str | None = None,
) -> DataFrame:
    """Briefs if there are any, else raw articles. Looks at one brief row to decide."""
    check_limit(limit)
    if briefs.isEmpty():
        return raw_article_feed(articles, limit).withColumn("note", F.lit(RAW_FEED_NOTE))
    feed = brief_feed(briefs, translations, limit, language)
    return feed.withColumn("note", F.lit(None).cast("string"))


def feed_metadata(feed: DataFrame, as_of: datetime) -> DataFrame:
    """Number of articles in the reply, its time, and a note if they are raw articles."""
    return feed.agg(
        F.count("*").alias("totalArticles"),
        iso_utc(ntz(as_of)).alias("lastUpdated"),
        F.max("note").alias("note"),
    )


def feed_envelope(feed: DataFrame, as_of: datetime) -> DataFrame:
    """The whole reply as one row: the articles, at most ``MAX_FEED`` of them, and the metadata."""
    item = F.struct("publishedAt", "id", "source", "category", "english", "translations")
    # Maps cannot be compared, so the list is put in order by its two leading fields alone.
    newest_first = F.array_sort(
        F.collect_list(item),
        lambda a, b: F.when(a["publishedAt"] > b["publishedAt"], -1)
        .when(a["publishedAt"] < b["publishedAt"], 1)
        .when(a["id"] < b["id"], -1)
        .when(a["id"] > b["id"], 1)
        .otherwise(0),
    )
    return feed.agg(
        newest_first.alias("articles"),
        F.struct(
            F.count("*").alias("totalArticles"),
            iso_utc(ntz(as_of)).alias("lastUpdated"),
            F.max("note").alias("note"),
        ).alias("metadata"),
    )


def write_feed(envelope: DataFrame, path: str) -> None:
    envelope.write.mode("overwrite").json(path)


def article_detail(
    briefs: DataFrame, translations: DataFrame, brief_id: str, language: str | None = None
) -> DataFrame:
    """One brief with all its translations; no row if the id is unknown."""
    page = _with_translations(by_id(briefs, brief_id), translations, language)
    return _payload(page, F.lit(BRIEF_FEED_SOURCE), F.col("category"), "processed_at")


def flat_feed(feed: DataFrame) -> DataFrame:
    """One row per article and translation, for comparing and for tabular sinks."""
    named = feed.select(
        "id",
        "source",
        "category",
        "publishedAt",
        *[F.col("english")[n].alias(n) for n in ("title", *SUMMARY_WORDS)],
        F.explode_outer("translations").alias("language", "_texts"),
    )
    texts = [F.col("_texts")[n].alias(f"translated_{n}") for n in ("title", *SUMMARY_WORDS)]
    return named.select(*[c for c in named.columns if c != "_texts"], *texts)
