import json
from datetime import timedelta

import pytest
from conftest import AS_OF, article, articles, brief, briefs, translation, translations, values

from newsloom.plans import article_feed as A


def hours(n):
    return AS_OF - timedelta(hours=n)


@pytest.fixture
def tables(spark):
    made = [brief(i, processed_at=hours(i), article_id="a0") for i in range(3)]
    rows = [
        translation(0, "or", id="new", title="new"),
        translation(0, "or", id="old", title="old", translated_at=hours(2)),
        translation(0, "hi", title="hi"),
        translation(2, "ta", title="ta"),
    ]
    return articles(spark, [article(0)]), briefs(spark, made), translations(spark, rows)


def test_feed_of_briefs(tables):
    rows = A.article_feed(*tables, limit=2).collect()
    assert [r["id"] for r in rows] == ["brief_a0", "brief_a1"]
    first = rows[0].asDict()
    assert first["source"] == "Global News" and first["category"] == "Science" and first["note"] is None
    assert first["publishedAt"] == "2026-07-04T12:00:00Z"
    assert first["english"] == {"title": "Title 0", "summary_30": "short", "summary_111": "middle", "summary_250": "long"}
    assert set(first["translations"]) == {"or", "hi"} and first["translations"]["or"]["title"] == "old"
    assert rows[1]["translations"] == {}


def test_language_filter_is_optional(tables):
    rows = A.article_feed(*tables, language="hi").collect()
    assert [set(r["translations"]) for r in rows] == [{"hi"}, set(), set()]


def test_raw_articles_stand_in_until_there_are_briefs(spark, tables):
    _, made, translated = tables
    text = " ".join(str(i) for i in range(31))
    arts = articles(spark, [article(0, content=text, source_name="BBC", published_at=hours(1)), article(1, content=""), article(2, is_duplicate=True)])
    rows = A.article_feed(arts, made.limit(0), translated).collect()
    assert [r["id"] for r in rows] == ["a1", "a0"]
    old = rows[1].asDict()
    assert (old["source"], old["category"], old["translations"]) == ("BBC", "world", {})
    assert old["english"]["summary_30"] == " ".join(str(i) for i in range(30)) + "..."
    assert old["english"]["summary_111"] == text and rows[0]["english"]["summary_30"] == ""
    assert old["note"].startswith("Displaying raw articles")
    assert A.article_feed(arts.limit(0), made.limit(0), translated).count() == 0


@pytest.mark.parametrize("limit", [0, 101, -1])
def test_limit_is_checked(tables, limit):
    with pytest.raises(ValueError):
        A.article_feed(*tables, limit=limit)


def test_detail(tables):
    _, made, translated = tables
    row = A.article_detail(made, translated, "brief_a0").first()
    assert set(row["translations"]) == {"or", "hi"}
    assert A.article_detail(made, translated, "missing").count() == 0


def test_envelope_is_one_json_document(tables, tmp_path):
    envelope = A.feed_envelope(A.article_feed(*tables), AS_OF)
    A.write_feed(envelope, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.json")
    reply = json.loads(part.read_text())
    assert [a["id"] for a in reply["articles"]] == ["brief_a0", "brief_a1", "brief_a2"]
    assert reply["articles"][0]["translations"]["or"]["title"] == "old"
    assert reply["metadata"] == {"totalArticles": 3, "lastUpdated": "2026-07-04T12:00:00Z"}


def test_metadata_and_flat_rows(tables):
    feed = A.article_feed(*tables)
    assert tuple(A.feed_metadata(feed, AS_OF).first()) == (3, "2026-07-04T12:00:00Z", None)
    assert sorted(values(A.flat_feed(feed), "id", "language"), key=str) == [
        ("brief_a0", "hi"), ("brief_a0", "or"), ("brief_a1", None), ("brief_a2", "ta"),
    ]
