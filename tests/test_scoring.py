import itertools
from datetime import timedelta

import pyarrow.parquet as pq
import pytest
from conftest import AS_OF, SF, article, articles, values
from pyspark.sql import functions as F

from newsloom.checks import samples
from newsloom.operators import selection as S
from newsloom.reference_data import SPAM_PHRASES, TOPIC_WORDS, TRUSTED_SOURCES


def plain_points(title, content, source, hours):
    text = f"{title} {content}".lower()
    relevance = 8 if any(p in text for p in SPAM_PHRASES) else 36 if any(t in text for t in TOPIC_WORDS) else 24
    trust = 20 if source in TRUSTED_SOURCES else 10
    size = next((p for limit, p in ((500, 18), (200, 14), (50, 10)) if len(content) > limit), 6)
    fresh = next((p for limit, p in ((6, 20), (12, 18), (24, 16), (48, 12)) if hours < limit), 8)
    return relevance + trust + size + fresh


def aged(n, hours, **changes):
    return article(n, published_at=AS_OF - timedelta(hours=hours), **changes)


def quality(spark, row):
    return S.score_articles(articles(spark, [row]), AS_OF).first()["quality_score"]


@pytest.mark.parametrize(
    "want,hours,changes",
    [
        (0.94, 1, {"source_name": "Tagesschau", "title": "News", "content": "Important climate policy " * 50}),
        (0.48, 48, {"source_name": "Unknown Blog", "title": "Random", "content": "Short content"}),
        (0.44, 2, {"source_name": "Spam Site", "title": "Click here now", "content": "x" * 48}),
        (0.70, 1, {"source_name": "Tagesschau", "title": "T", "content": "Test content here"}),
        (0.58, 50, {"source_name": "Tagesschau", "title": "T", "content": "Test content here"}),
        (0.32, 50, {"source_name": "Spam Site", "title": "Buy now", "content": "x"}),
    ],
)
def test_known_scores(spark, want, hours, changes):
    assert quality(spark, aged(0, hours, **changes)) == want


def test_spam_beats_topic_and_phrases_span_title_and_content(spark):
    rows = [
        article(0, title="Climate", content="click here"),
        article(1, title="click", content="here"),
        article(2, title="x", content="a trademark"),
        article(3, title="x", content="y", source_name="tagesschau"),
    ]
    got = {r["id"]: r for r in S.score_articles(articles(spark, rows), AS_OF).collect()}
    assert [got[f"a{i}"]["relevance_points"] for i in range(3)] == [8, 8, 36]
    assert got["a3"]["source_points"] == 10


def test_borders_are_strict(spark):
    rows = [aged(i, h) for i, h in enumerate((6, 12, 24, 48))]
    rows += [article(10 + i, content="x" * n) for i, n in enumerate((50, 51, 200, 201, 500, 501))]
    got = {r["id"]: r for r in S.score_articles(articles(spark, rows), AS_OF).collect()}
    assert [got[f"a{i}"]["freshness_points"] for i in range(4)] == [18, 16, 12, 8]
    assert [got[f"a{10 + i}"]["completeness_points"] for i in range(6)] == [6, 10, 10, 14, 14, 18]


def test_composite(spark):
    rows = [aged(0, 0, content="x" * 600, source_name="Reuters"), aged(1, 30), aged(2, -3)]
    got = {r["id"]: r for r in S.score_articles(articles(spark, rows), AS_OF).collect()}
    assert got["a0"]["quality_score"] == 0.82 and got["a0"]["composite_score"] == pytest.approx(0.892)
    assert got["a1"]["composite_score"] == pytest.approx(got["a1"]["quality_score"] * 0.6 + 0.1)
    assert got["a2"]["composite_score"] == pytest.approx(got["a2"]["quality_score"] * 0.6 + 1.125 * 0.3 + 0.1)


def test_scores_of_all_documents_equal_plain_python(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    rows = samples.documents(spark, SF).select("doc_id", "title", "source_name", "published_at", "content")
    texts = {d["doc_id"]: d["text"] for d in docs}
    scored = S.score_articles(rows, AS_OF, keep=["doc_id", "title", "source_name", "published_at"]).collect()
    assert len(scored) == len(docs)
    for r in scored:
        hours = (AS_OF - r["published_at"]).total_seconds() / 3600
        points = plain_points(r["title"], texts[r["doc_id"]], r["source_name"], hours)
        assert r["quality_score"] == points / 100
        want = points / 100 * 0.6 + max(0, 1 - hours / 24) * 0.3 + 0.1
        assert r["composite_score"] == pytest.approx(want, abs=1e-12)


def test_threshold_keeps_exactly_070(spark):
    rows = [aged(0, 1, source_name="Tagesschau", content="short"), aged(1, 50, source_name="Tagesschau", content="short")]
    kept = S.high_quality(S.score_articles(articles(spark, rows), AS_OF))
    assert values(kept, "id") == ["a0"]


def test_top_stories_order_ties_and_size(spark):
    rows = [aged(1, 20), aged(2, 1), aged(3, 10), aged(0, 1)]
    scored = S.score_articles(articles(spark, rows), AS_OF)
    assert values(S.top_stories(scored, 5), "id") == ["a0", "a2", "a3", "a1"]
    assert values(S.top_stories(scored, 2), "id") == ["a0", "a2"]
    assert values(S.diverse_top_stories(scored, 2), "id") == ["a0", "a2"]


def test_limit_per_source(spark):
    rows = [aged(i, i, source_name=s) for i, s in enumerate("AAAB")]
    scored = S.score_articles(articles(spark, rows), AS_OF)
    assert values(S.diverse_top_stories(scored, 4, max_per_source=2), "id") == ["a0", "a1", "a3"]


def test_selection_stats(spark):
    rows = [aged(i, i) for i in range(4)]
    scored = S.score_articles(articles(spark, rows), AS_OF)
    best = sorted((r["composite_score"] for r in scored.collect()), reverse=True)
    two, all_ = S.selection_stats(scored, 2).first(), S.selection_stats(scored, 9).first()
    assert (two.total_articles, two.selected, two.selected_all) == (4, 2, False)
    assert (two.top_score, two.cutoff_score) == (round(best[0], 2), round(best[1], 2))
    assert all_.selected_all and all_.cutoff_score == round(best[3], 2)
    none = S.selection_stats(scored.filter(F.lit(False)), 5).first()
    assert tuple(none) == (0, 0, True, 0.0, 0.0)


def test_filter_stats(spark):
    rows = [aged(0, 1, source_name="BBC", content="health " * 100), aged(1, 60)]
    stats = S.quality_filter_stats(S.score_articles(articles(spark, rows), AS_OF)).first()
    assert tuple(stats) == (2, 1, 1, 0.7)


def test_every_combination_of_points_is_exact():
    # The score is a whole number of hundredths, so dividing once gives the nearest double.
    for parts in itertools.product((8, 24, 36), (10, 20), (6, 10, 14, 18), (8, 12, 16, 18, 20)):
        assert sum(parts) / 100 == float(f"0.{sum(parts):02d}")
