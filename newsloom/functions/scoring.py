"""Quality and ranking scores.

Quality is summed as whole hundredths and divided once, so that a score on the
threshold is decided the same way on every engine.
"""

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import age_hours
from newsloom.reference_data import SPAM_PHRASES, TOPIC_WORDS, TRUSTED_SOURCES


def search_text(title: Column, content: Column) -> Column:
    return F.lower(F.concat(title, F.lit(" "), content))


def _mentions(lowered: Column, phrases: list[str]) -> Column:
    return reduce(or_, (lowered.contains(phrase) for phrase in phrases))


def relevance_points(lowered: Column) -> Column:
    return (
        F.when(_mentions(lowered, SPAM_PHRASES), 8)
        .when(_mentions(lowered, TOPIC_WORDS), 36)
        .otherwise(24)
    )


def source_points(source_name: Column) -> Column:
    return F.when(source_name.isin(TRUSTED_SOURCES), 20).otherwise(10)


def completeness_points(chars: Column) -> Column:
    return F.when(chars > 500, 18).when(chars > 200, 14).when(chars > 50, 10).otherwise(6)


def freshness_points(hours: Column) -> Column:
    return (
        F.when(hours < 6, 20).when(hours < 12, 18).when(hours < 24, 16).when(hours < 48, 12).otherwise(8)
    )


def composite_score(quality: Column, published_at: Column, as_of: datetime) -> Column:
    """60 % quality, 30 % recency over a day, 10 % constant. A future date counts above full recency."""
    recency = F.greatest(F.lit(0.0), F.lit(1.0) - age_hours(published_at, as_of) / F.lit(24.0))
    return quality * F.lit(0.6) + recency * F.lit(0.3) + F.lit(0.1)
