"""Counts from footers, newest rows by folder, and look-ups that skip row groups, over written stores."""

from datetime import timedelta

import pytest
from conftest import AS_OF, article, articles, brief, briefs, translation, translations, values
from pyspark.sql import functions as F

from newsloom.operators.lookups import by_id, newest
from newsloom.operators.reports import article_counts, table_health, translations_by_language
from newsloom.schemas import ARTICLES, BRIEFS, TABLES, TRANSLATIONS
from newsloom.sources import footers
from newsloom.sources import store as S

DAY = timedelta(days=1)


def scan_of(rows):
    """The scan of a plan that has been run, without exchanges."""
    return rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """A hundred days of articles, briefs and translations, with times that repeat within a day."""
    root = str(tmp_path_factory.mktemp("store"))
    S.create_store(spark, root)
    made = [article(i, fetched_at=AS_OF - (i // 3) * DAY, is_duplicate=i % 4 == 0) for i in range(300)]
    S.write_table(articles(spark, made), root, ARTICLES)
    S.write_table(briefs(spark, [brief(i, processed_at=AS_OF - (i // 3) * DAY) for i in range(300)]), root, BRIEFS)
    told = [translation(i, ("or", "hi", "ta")[i % 3], translated_at=AS_OF - (i // 2) * DAY) for i in range(200)]
    S.write_table(translations(spark, told), root, TRANSLATIONS)
    return root


def test_counts_read_no_column(spark, store):
    for table, n in ((ARTICLES, 300), (BRIEFS, 300), (TRANSLATIONS, 200)):
        frame = footers.footer_frame(spark, store, table)
        with footers._settings(spark, count_in_footers="true"):
            plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "PushedAggregation: [COUNT(*)]" in plan
        counts = footers.folder_counts(spark, store, table)
        assert counts.agg(F.sum("n_rows")).first()[0] == n
        assert counts.columns == [*S.folders_of(table), "n_rows"]


def test_counts_equal_those_of_the_rows(spark, store):
    tables = {name: S.read_table(spark, store, t) for name, t in TABLES.items()}
    for got, want in (
        (footers.stored_health(spark, store), table_health(tables)),
        (footers.stored_article_counts(spark, store), article_counts(tables["articles"])),
        (footers.stored_translation_counts(spark, store), translations_by_language(tables["translations"])),
    ):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_empty_store_counts_nothing(spark, tmp_path):
    root = str(tmp_path)
    S.create_store(spark, root)
    assert set(values(footers.stored_health(spark, root), "row_count")) == {0}
    assert tuple(footers.stored_article_counts(spark, root).first()) == (0, 0, 0)
    assert footers.stored_translation_counts(spark, root).count() == 0
    assert footers.newest_stored(spark, root, BRIEFS, 5).count() == 0


@pytest.mark.parametrize("limit", [0, 1, 7, 1000])
def test_newest_by_folder_equals_newest_of_all(spark, store, limit):
    got = footers.newest_stored(spark, store, BRIEFS, limit)
    assert got.collect() == newest(S.read_table(spark, store, BRIEFS), "processed_at", limit).collect()
    got = footers.newest_stored(spark, store, TRANSLATIONS, limit, language="or")
    own = S.read_table(spark, store, TRANSLATIONS).filter("language = 'or'")
    assert got.collect() == newest(own, "translated_at", limit).collect()


def test_newest_opens_the_last_days_only(spark, store):
    # Three briefs a day: seven need three of the hundred days.
    counts = footers.folder_counts(spark, store, BRIEFS)
    day = (AS_OF - 2 * DAY).date()
    assert footers.first_day_needed(counts, 7) == day
    plan = footers.newest_stored(spark, store, BRIEFS, 7)._jdf.queryExecution().executedPlan().toString()
    scans = plan.split("PartitionFilters: [")[1:]
    assert scans and all("day" in scan.split("]")[0] for scan in scans)
    old = S.read_table(spark, store, BRIEFS, since=AS_OF - 2 * DAY)
    assert old.select("processed_at").distinct().count() == 3


def test_rows_keep_their_columns_and_settings_their_values(spark, store):
    rows = S.read_table(spark, store, ARTICLES)
    assert rows.columns == ARTICLES.columns
    assert rows.filter("is_duplicate").count() == 75
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_a_lookup_skips_row_groups(spark, tmp_path):
    """Two days whose ids overlap in range: file statistics cannot tell them apart, the filters can."""
    n = 60_000
    digest = F.sha2(F.col("id").cast("string"), 256)
    texts = {f: F.lit("x") for f in ("article_id", "title", "summary_30", "summary_111", "summary_250", "category", "model_used")}
    day = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.col("id") % 2)
    rows = spark.range(0, n, 1, 4).withColumns({**texts, "quality_score": F.lit(0.5), "processed_at": day, "created_at": day})
    S.write_table(rows.withColumn("id", digest), str(tmp_path), BRIEFS, bloom_ids=n)
    stored = S.read_table(spark, str(tmp_path), BRIEFS)
    ids = sorted(values(stored, "id"))
    absent = ids[n // 2][:-1] + ("0" if ids[n // 2][-1] != "0" else "1")
    for wanted, found in ((ids[n // 2], 1), (absent, 0)):
        hit = by_id(stored, wanted)
        assert len(hit.collect()) == found
        read = scan_of(hit).metrics().get("numOutputRows").get().value()
        # Of the two files, which both span all ids, one is opened for the id that is there and none for the other.
        assert read <= found * n / 2
