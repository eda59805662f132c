import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from newsloom.schemas import ARTICLES, BRIEFS, TRANSLATIONS  # noqa: E402
from newsloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
AS_OF = datetime(2026, 7, 4, 12, 0, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    # A zone with daylight saving, so that anything that leans on the session's zone shows.
    session = local_session(
        "8",
        4,
        **{
            "spark.sql.session.timeZone": "America/New_York",
            "spark.checkpoint.dir": str(folder),
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
        },
    )
    yield session
    session.stop()


def article(n=0, **changes):
    row = {
        "id": f"a{n}",
        "source_url": f"https://example.com/{n}",
        "source_name": "Test Source",
        "source_type": "rss",
        "title": f"Article {n}",
        "content": f"Content {n}",
        "published_at": AS_OF,
        "fetched_at": AS_OF,
        "content_hash": f"hash{n}",
        "is_duplicate": False,
        "created_at": AS_OF,
    }
    return {**row, **changes}


def brief(n=0, **changes):
    row = {
        "id": f"brief_a{n}",
        "article_id": f"a{n}",
        "title": f"Title {n}",
        "summary_30": "short",
        "summary_111": "middle",
        "summary_250": "long",
        "category": "Science",
        "quality_score": 0.85,
        "model_used": "m",
        "processed_at": AS_OF,
        "created_at": AS_OF,
    }
    return {**row, **changes}


def translation(n=0, language="or", **changes):
    row = {
        "id": f"trans_brief_a{n}_{language}",
        "brief_id": f"brief_a{n}",
        "language": language,
        "title": "ଜଳବାୟୁ",
        "summary_30": "ସ",
        "summary_111": "ମ",
        "summary_250": "ଲ",
        "model_used": "m",
        "translated_at": AS_OF,
        "created_at": AS_OF,
    }
    return {**row, **changes}


def _nullable(table):
    schema = table.schema
    for field in schema:
        field.nullable = True
    return schema


def frame(spark, table, rows, extra=""):
    """Rows as a frame in table layout, with nulls allowed so that bad rows can be made."""
    schema = _nullable(table)
    names = [f.name for f in schema]
    for name, kind in (pair.split() for pair in extra.split(",") if pair):
        schema = schema.add(name, kind)
        names.append(name)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def articles(spark, rows, extra=""):
    return frame(spark, ARTICLES, rows, extra)


def briefs(spark, rows, extra=""):
    return frame(spark, BRIEFS, rows, extra)


def translations(spark, rows, extra=""):
    return frame(spark, TRANSLATIONS, rows, extra)


def values(df, *columns):
    return [tuple(row) if len(columns) != 1 else row[0] for row in df.select(*columns).collect()]
