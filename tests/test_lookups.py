from datetime import timedelta

import pytest
from conftest import AS_OF, article, articles, brief, briefs, translation, translations, values

from newsloom.operators import lookups as L
from newsloom.operators import reports as R
from newsloom.operators import validation as V
from newsloom.operators.retention import cleanup_stats, retain_articles, retain_briefs, retain_translations
from newsloom.schemas import ARTICLES, PUBLICATIONS, SOURCE_REGISTRY
from newsloom.sources.registry import source_registry
from newsloom.sources.store import write_table


def hours(n):
    return AS_OF - timedelta(hours=n)


def test_by_id(spark):
    df = articles(spark, [article(0), article(1)])
    assert values(L.by_id(df, "a1"), "title") == ["Article 1"]
    assert L.by_id(df, "nope").count() == 0


def test_recent_articles(spark):
    rows = [article(i, published_at=hours(100 - i)) for i in range(3)]
    rows += [article(9, published_at=hours(0), is_duplicate=True), article(4, published_at=hours(98)), article(3, published_at=hours(98))]
    df = articles(spark, rows)
    assert values(L.recent_articles(df, 2), "id") == ["a2", "a3"]
    assert values(L.recent_articles(df, 3), "id") == ["a2", "a3", "a4"]
    assert values(L.recent_articles(df), "id") == ["a2", "a3", "a4", "a1", "a0"]
    assert L.recent_articles(articles(spark, [])).count() == 0
    with pytest.raises(ValueError):
        L.recent_articles(df, -1)
    assert L.recent_articles(df, 0).count() == 0


def test_newest_reads_only_recent_files_of_a_stored_table(spark, tmp_path):
    rows = [article(i, published_at=hours(i), fetched_at=hours(i)) for i in range(48)]
    write_table(articles(spark, rows), str(tmp_path), ARTICLES)
    stored = spark.read.parquet(f"{tmp_path}/articles")
    df = L.recent_articles(stored, 2)
    assert values(df, "id") == ["a0", "a1"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert any("published_at" in s.split("DataFilters")[1] and "content" in s for s in scans)


def test_recent_translations_and_briefs(spark):
    rows = [translation(i, "or", translated_at=hours(i)) for i in range(3)] + [translation(9, "hi")]
    df = translations(spark, rows)
    assert values(L.recent_translations(df, "or", 2), "brief_id") == ["brief_a0", "brief_a1"]
    df = briefs(spark, [brief(i, processed_at=hours(-i)) for i in range(3)])
    assert values(L.recent_briefs(df, 2), "id") == ["brief_a2", "brief_a1"]


def test_brief_translations_newest_first(spark):
    rows = [translation(0, "or", translated_at=hours(5)), translation(0, "hi", translated_at=hours(1)), translation(1)]
    assert values(L.brief_translations(translations(spark, rows), "brief_a0"), "language") == ["hi", "or"]


def test_translations_for_briefs_has_every_requested_id(spark):
    rows = [translation(0, "or", translated_at=hours(5)), translation(0, "hi"), translation(1), translation(2)]
    rows += [translation(0, "or", id=f"x{i}", translated_at=hours(10 + i)) for i in range(40)]
    ids = spark.createDataFrame([("brief_a1",), ("brief_a0",), ("none",), ("none",)], "brief_id string")
    got = values(L.translations_for_briefs(ids, translations(spark, rows)), "brief_id", "id")
    want = ["trans_brief_a0_hi", "trans_brief_a0_or", *[f"x{i}" for i in range(40)]]
    assert got == [("brief_a0", i) for i in want] + [("brief_a1", "trans_brief_a1_or"), ("none", None)]
    assert L.translations_for_briefs(ids.limit(0), translations(spark, rows)).count() == 0


def test_oldest_translation_of_a_language_wins(spark):
    rows = [translation(0, "or", id="new"), translation(0, "or", id="old", translated_at=hours(3))]
    rows += [translation(0, "hi", id="b"), translation(0, "hi", id="a")]
    got = L.translation_per_language(translations(spark, rows))
    assert sorted(values(got, "language", "id")) == [("hi", "a"), ("or", "old")]


def test_unprocessed_and_untranslated(spark):
    arts = articles(spark, [article(i) for i in range(4)])
    made = briefs(spark, [brief(1, processed_at=hours(2)), brief(2, processed_at=hours(1)), brief(2, id="twice")])
    assert sorted(values(L.unprocessed_articles(arts, made), "id")) == ["a0", "a3"]
    done = translations(spark, [translation(1, "or"), translation(2, "hi")])
    assert sorted(values(L.untranslated_briefs(made, done, "or"), "id")) == ["brief_a2", "twice"]
    assert values(L.untranslated_briefs(made, done, "or", limit=1), "id") == ["twice"]


def test_unprocessed_joins_without_the_texts(spark, tmp_path):
    from newsloom.plans.editorial import select_stories

    write_table(articles(spark, [article(i) for i in range(4)]), str(tmp_path), ARTICLES)
    stored = spark.read.parquet(f"{tmp_path}/articles")
    df = select_stories(stored, AS_OF, briefs(spark, [brief(1)]), min_score=0.1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = plan[: plan.index("Generate")]
    assert "Join" in joins and "content" not in joins
    assert sorted(values(df, "id")) == ["a0", "a2", "a3"]


def test_brief_sources(spark):
    got = L.brief_sources(briefs(spark, [brief(0), brief(7)]), articles(spark, [article(0, source_name="BBC")]))
    assert dict(values(got, "id", "source_name")) == {"brief_a0": "BBC", "brief_a7": "Global News"}


def test_retention_is_strict_and_translations_follow(spark):
    day = timedelta(days=1)
    rows = [article(0, fetched_at=AS_OF - 7 * day), article(1, fetched_at=AS_OF - 7 * day - timedelta(microseconds=1))]
    arts = articles(spark, rows)
    made = briefs(spark, [brief(0, processed_at=AS_OF - 30 * day), brief(1, processed_at=AS_OF - 31 * day)])
    assert values(retain_articles(arts, AS_OF), "id") == ["a0"]
    kept = retain_briefs(made, AS_OF)
    assert values(kept, "id") == ["brief_a0"]
    assert values(retain_translations(translations(spark, [translation(0), translation(1)]), kept), "brief_id") == ["brief_a0"]
    assert tuple(cleanup_stats(arts, made, AS_OF).first()) == (1, 1)
    assert tuple(cleanup_stats(arts, made, AS_OF, 8, 40).first()) == (0, 0)


def test_counts(spark):
    rows = [article(i, source_name=s, is_duplicate=d) for i, (s, d) in enumerate([("A", False), ("A", False), ("B", False), ("B", True)])]
    df = articles(spark, rows)
    assert tuple(R.article_counts(df).first()) == (4, 3, 1)
    assert values(R.articles_by_source(df), "source_name", "articles") == [("A", 2), ("B", 1)]
    df = translations(spark, [translation(0), translation(1), translation(0, "hi")])
    assert values(R.translations_by_language(df), "language", "translations", "total") == [("or", 2, 3), ("hi", 1, 3)]
    assert R.translations_by_language(df.limit(0)).count() == 0


def test_health_of_an_empty_store(spark):
    health = R.table_health({"articles": articles(spark, [])})
    assert dict(values(health, "table_name", "row_count")) == dict.fromkeys(
        ["articles", "briefs", "translations", "publications", "publication_stories", "api_logs"], 0
    )


def test_progress(spark):
    arts = articles(spark, [article(i) for i in range(5)])
    made = briefs(spark, [brief(0, processed_at=hours(5)), brief(1)])
    got = R.processing_progress(arts, made, hours(1)).first().asDict()
    assert got == {
        "total_articles": 5, "previously_processed": 1, "newly_processed": 1, "total_processed": 2,
        "remaining": 3, "unprocessed": 3,
    }


def test_coverage_lists_sources_without_articles(spark):
    registry = [("A", "u", 1, 3, True), ("B", "u", 1, 2, True), ("off", "u", 1, 9, False)]
    rows = [article(0, source_name="A"), article(1, source_name="A"), article(2, source_name="A"), article(3, source_name="A")]
    got = R.source_coverage(registry, articles(spark, rows))
    assert sorted(values(got, "source_name", "collected", "shortfall")) == [("A", 4, 0), ("B", 0, 2)]


def test_orphans(spark):
    stories = spark.createDataFrame([("p", "trans_brief_a0_or", 1), ("q", "gone", 2)], "publication_id string, translation_id string, position int")
    pubs = spark.createDataFrame([("p",)], "id string")
    got = V.orphan_rows(
        articles(spark, [article(0)]),
        briefs(spark, [brief(0), brief(1)]),
        translations(spark, [translation(0), translation(5)]),
        pubs,
        stories,
    )
    assert sorted(values(got, "table_name", "parent_table", "parent_key")) == [
        ("briefs", "articles", "a1"),
        ("publication_stories", "publications", "q"),
        ("publication_stories", "translations", "gone"),
        ("translations", "briefs", "brief_a5"),
    ]


def test_constraints(spark):
    rows = [
        article(0),
        article(1, source_url="not-a-valid-url", title=None),
        article(2, source_type="fax"),
        article(3, source_url="ftp://x.y/z"),
        article(4, source_url="https://x.y/" + "p" * 2083),
    ]
    got = V.constraint_rejects({"articles": articles(spark, rows), "briefs": briefs(spark, [brief(0, quality_score=-0.1)])})
    assert dict(values(got, "row_key", "broken_rules")) == {
        "a1": "not_null:title,url:source_url",
        "a2": "enum:source_type",
        "a3": "url:source_url",
        "a4": "url:source_url",
        "brief_a0": "range:quality_score",
    }


def test_constraints_across_rows(spark):
    from datetime import date

    day = date(2026, 7, 4)
    rows = [("p3", day, "or", "sent"), ("p1", day, "or", "sent"), ("p2", day, "hi", "sent"), ("p4", day, None, "sent"), ("p5", day, None, "sent"),
            ("p2", date(2026, 7, 5), "hi", "sent")] + [(f"q{i:04}", date(2026, 1, 1), "bn", "sent") for i in range(1500)]
    frame = spark.createDataFrame(rows, "id string, date date, language string, publish_status string")
    got = values(V.unique_conflicts(frame, PUBLICATIONS), "row_key", "rule", "holder")
    late = [(f"q{i:04}", "unique:date+language", "q0000") for i in range(1, 1500)]
    assert sorted(got) == sorted([("p2", "primary_key", "p2"), ("p3", "unique:date+language", "p1"), *late])
    assert V.unique_conflicts(frame.limit(0), PUBLICATIONS).count() == 0
    bad = V.constraint_rejects({"publications": frame.filter("id < 'q'")})
    assert sorted(values(bad, "row_key", "broken_rules")) == [
        ("p2", "primary_key"), ("p3", "unique:date+language"), ("p4", "not_null:language"), ("p5", "not_null:language"),
    ]


def test_registry_constraints(spark):
    rows = [("ok", "https://a.b/c", 1, 30, True), ("bad", "https://a.b/c", 5, 0, True)]
    checked = V.check(source_registry(spark, rows), SOURCE_REGISTRY)
    assert dict(values(checked, "name", "broken_rules")) == {"ok": [], "bad": ["range:priority", "range:expected_articles"]}


def test_texts_are_fetched_within_the_times_of_the_selection(spark, tmp_path):
    from newsloom.operators.selection import with_bodies

    write_table(articles(spark, [article(i, published_at=hours(i)) for i in range(9)]), str(tmp_path), ARTICLES)
    stored = spark.read.parquet(f"{tmp_path}/articles")
    picked = stored.filter("id in ('a3', 'a5')").select("id", "published_at")
    df = with_bodies(picked, stored, ["content"], 2, within="published_at")
    assert sorted(values(df, "id", "content")) == [("a3", "Content 3"), ("a5", "Content 5")]
    scans = [s for s in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in s]
    assert any("content" in s and "published_at" in s.split("DataFilters")[1] for s in scans)
    assert with_bodies(picked.limit(0), stored, ["content"], 2, within="published_at").count() == 0
