"""Daily publications, and checks of what would be published."""

import unicodedata
from datetime import datetime
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.once import settle
from newsloom.functions.text import ntz, word_count
from newsloom.operators.keys import attach
from newsloom.reference_data import (
    LENGTH_TOLERANCE_WORDS,
    PROPER_NOUNS,
    SPORTS_TERMS,
    STORIES_PER_PUBLICATION,
    SUMMARY_WORDS,
    TECHNICAL_TERMS,
)


def daily_stories(
    translations: DataFrame, briefs: DataFrame, per_day: int = STORIES_PER_PUBLICATION
) -> DataFrame:
    """Best translations of each day and language with their position.

    The rank limit is applied before the shuffle as well, so each task sends at most
    ``per_day`` rows of a day and language.
    """
    scores = briefs.select(F.col("id").alias("brief_id"), "quality_score")
    narrow = translations.select(
        F.col("id").alias("translation_id"),
        "brief_id",
        "language",
        F.to_date("translated_at").alias("date"),
    )
    ranked = attach(narrow, scores, "brief_id", "translation_id", how="inner").withColumn(
        "position",
        F.row_number().over(
            Window.partitionBy("date", "language").orderBy(
                F.col("quality_score").desc(), "translation_id"
            )
        ),
    )
    publication = F.concat_ws("_", F.lit("pub"), F.col("date").cast("string"), "language")
    return ranked.filter(F.col("position") <= per_day).select(
        publication.alias("publication_id"), "translation_id", "position", "date", "language"
    )


def publications(stories: DataFrame, created_at: datetime) -> DataFrame:
    """One pending publication per day and language."""
    return stories.groupBy(F.col("publication_id").alias("id"), "date", "language").agg(
        F.lit("pending").alias("publish_status"),
        F.lit(None).cast("string").alias("telegram_message_id"),
        F.lit(None).cast("timestamp_ntz").alias("published_at"),
        F.lit(None).cast("string").alias("error_message"),
        ntz(created_at).alias("created_at"),
        F.count("*").alias("stories"),
    )


def summary_length_check(briefs: DataFrame, tolerance: int = LENGTH_TOLERANCE_WORDS) -> DataFrame:
    """Words of each summary and whether they are within the tolerance of the target."""
    counts = {f"words_{n}": word_count(F.col(name)) for name, n in SUMMARY_WORDS.items()}
    counted = settle(briefs, ["id"], **counts)
    return counted.withColumns(
        {f"ok_{n}": F.abs(F.col(f"words_{n}") - n) <= tolerance for n in SUMMARY_WORDS.values()}
    )


_TEXTS = ["title", *SUMMARY_WORDS]


def _all_text() -> Column:
    return F.concat_ws("\n", *_TEXTS)


# Runs of Latin letters (with their accents) and digits are words. Other scripts end a word, because they write
# their endings onto names.
_LATIN = r"\p{IsLatin}\p{N}\u0300-\u036F"
_PIECES = f"[{_LATIN}]+|[^{_LATIN}]+"


def _in_word(char: str) -> bool:
    latin = unicodedata.name(char, "").startswith("LATIN ") or "\u0300" <= char <= "\u036f"
    return latin or unicodedata.category(char).startswith("N")


def pieces(text: Column) -> Column:
    """A text cut into its words and what stands between them, which together are the text."""
    return F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))


def terms_among(parts: Column, terms: list[str]) -> Column:
    """Those of ``terms`` that stand as whole words in a text cut into ``pieces``; null for a null text.

    Each sequence of as many pieces as some term has is looked up in the set of the terms of that length, so the work
    grows with the text and the longest term and not with the number of terms. Case counts. A term begins and ends
    with a Latin letter or a digit; others are refused.
    """
    by_size: dict[int, list[str]] = {}
    for term in terms:
        if not (term and _in_word(term[0]) and _in_word(term[-1])):
            raise ValueError(f"{term!r} does not begin and end with a Latin letter or a digit")
        by_size.setdefault(sum(1 for _ in groupby(term, _in_word)), []).append(term)

    def found(size: int, wanted: list[str]) -> Column:
        if size == 1:
            return F.filter(parts, lambda x: x.isin(wanted))
        # Only where a term's first word stands is the rest of the sequence put together.
        first_words = sorted({"".join(next(groupby(term, _in_word))[1]) for term in wanted})
        places = F.when(F.size(parts) >= size, F.sequence(F.lit(1), F.size(parts) - (size - 1)))
        begun = F.filter(places, lambda i: F.get(parts, i - 1).isin(first_words))
        sequences = F.transform(begun, lambda i: F.array_join(F.slice(parts, i, F.lit(size)), ""))
        return F.coalesce(F.filter(sequences, lambda x: x.isin(wanted)), F.array().cast("array<string>"))

    if not by_size:
        return F.when(parts.isNotNull(), F.array().cast("array<string>"))
    all_found = F.concat(*[found(size, wanted) for size, wanted in sorted(by_size.items())])
    return F.when(parts.isNotNull(), F.array_distinct(all_found))


def glossary_retention(briefs: DataFrame, translations: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Glossary terms that a brief uses as whole words and its translation has lost.

    ``terms`` replaces the fixed glossary. Every brief and every translation is read once and reduced to its terms where
    it is; the join then moves ids and terms, and no texts.
    """
    terms = list(dict.fromkeys(PROPER_NOUNS + TECHNICAL_TERMS + SPORTS_TERMS if terms is None else terms))

    def reduced(rows: DataFrame, keep: list[str], name: str) -> DataFrame:
        cut = settle(rows.select(*keep, *_TEXTS), keep, _pieces=pieces(_all_text()))
        return settle(cut, keep, **{name: terms_among(F.col("_pieces"), terms)})

    used = reduced(briefs.withColumnRenamed("id", "brief_id"), ["brief_id"], "_terms").filter(F.size("_terms") > 0)
    kept = reduced(translations, ["id", "brief_id", "language"], "_kept")
    pairs = attach(kept, used, "brief_id", "id", how="inner")
    lost = F.array_except("_terms", "_kept")
    return pairs.select("brief_id", F.col("id").alias("translation_id"), "language", F.explode(lost).alias("term"))
