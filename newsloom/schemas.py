"""The six stored tables: fixed schemas and the constraints their rows must meet."""

from dataclasses import dataclass, field

from pyspark.sql import types as T

from newsloom.reference_data import (
    LANGUAGES,
    OPERATIONS,
    PUBLISH_STATUSES,
    SOURCE_TYPES,
    STORIES_PER_PUBLICATION,
    SUMMARY_MAX_CHARS,
)

NTZ = T.TimestampNTZType()
TEXT = T.StringType()
MAX_URL_CHARS = 2083


@dataclass(frozen=True)
class Table:
    name: str
    key: tuple[str, ...]
    required: dict[str, T.DataType]
    optional: dict[str, T.DataType] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    max_chars: dict[str, int] = field(default_factory=dict)
    urls: tuple[str, ...] = ()
    # Columns whose values may stand together once only, besides the key.
    unique: tuple[tuple[str, ...], ...] = ()

    @property
    def schema(self) -> T.StructType:
        columns = [T.StructField(n, t, False) for n, t in self.required.items()]
        columns += [T.StructField(n, t, True) for n, t in self.optional.items()]
        return T.StructType(columns)

    @property
    def columns(self) -> list[str]:
        return [*self.required, *self.optional]


ARTICLES = Table(
    name="articles",
    key=("id",),
    required={
        "id": TEXT,
        "source_url": TEXT,
        "source_name": TEXT,
        "source_type": TEXT,
        "title": TEXT,
        "content": TEXT,
        "published_at": NTZ,
        "fetched_at": NTZ,
        "content_hash": TEXT,
    },
    optional={"is_duplicate": T.BooleanType(), "created_at": NTZ},
    enums={"source_type": SOURCE_TYPES},
    urls=("source_url",),
)

BRIEFS = Table(
    name="briefs",
    key=("id",),
    required={
        "id": TEXT,
        "article_id": TEXT,
        "title": TEXT,
        "summary_30": TEXT,
        "summary_111": TEXT,
        "summary_250": TEXT,
        "category": TEXT,
        "quality_score": T.DoubleType(),
        "model_used": TEXT,
        "processed_at": NTZ,
    },
    optional={"created_at": NTZ},
    ranges={"quality_score": (0, 1)},
    max_chars=SUMMARY_MAX_CHARS,
)

TRANSLATIONS = Table(
    name="translations",
    key=("id",),
    required={
        "id": TEXT,
        "brief_id": TEXT,
        "language": TEXT,
        "title": TEXT,
        "summary_30": TEXT,
        "summary_111": TEXT,
        "summary_250": TEXT,
        "model_used": TEXT,
        "translated_at": NTZ,
    },
    optional={"created_at": NTZ},
    enums={"language": list(LANGUAGES)},
)

PUBLICATIONS = Table(
    name="publications",
    key=("id",),
    required={"id": TEXT, "date": T.DateType(), "language": TEXT, "publish_status": TEXT},
    optional={
        "telegram_message_id": TEXT,
        "published_at": NTZ,
        "error_message": TEXT,
        "created_at": NTZ,
    },
    enums={"language": list(LANGUAGES), "publish_status": PUBLISH_STATUSES},
    unique=(("date", "language"),),
)

PUBLICATION_STORIES = Table(
    name="publication_stories",
    key=("publication_id", "translation_id"),
    required={"publication_id": TEXT, "translation_id": TEXT, "position": T.IntegerType()},
    ranges={"position": (1, STORIES_PER_PUBLICATION)},
)

API_LOGS = Table(
    name="api_logs",
    key=("id",),
    required={
        "id": TEXT,
        "timestamp": NTZ,
        "model_used": TEXT,
        "operation": TEXT,
        "success": T.BooleanType(),
    },
    optional={
        "input_tokens": T.IntegerType(),
        "output_tokens": T.IntegerType(),
        "cost_usd": T.DecimalType(18, 6),
        "latency_ms": T.IntegerType(),
        "error_message": TEXT,
        "created_at": NTZ,
    },
    enums={"operation": OPERATIONS},
)

TABLES = {
    t.name: t
    for t in (ARTICLES, BRIEFS, TRANSLATIONS, PUBLICATIONS, PUBLICATION_STORIES, API_LOGS)
}

# Registry rows are checked by the same rules; they are not stored with the six.
SOURCE_REGISTRY = Table(
    name="sources",
    key=("name",),
    required={
        "name": TEXT,
        "url": TEXT,
        "priority": T.IntegerType(),
        "expected_articles": T.IntegerType(),
    },
    optional={"enabled": T.BooleanType()},
    ranges={"priority": (1, 3), "expected_articles": (1, 2**31 - 1)},
    urls=("url",),
)
