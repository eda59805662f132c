import random
from hashlib import sha256

import pytest
from conftest import AS_OF, article, articles, brief, briefs, translation, translations, values
from pyspark.sql import functions as F

from newsloom.operators.dedup import dedup_stats, known_duplicates, mark_duplicates, unique_articles
from newsloom.operators.keyed_append import accepted_rows, admit, append_stats
from newsloom.operators.keys import attach, without
from newsloom.schemas import ARTICLES, BRIEFS, PUBLICATION_STORIES, TRANSLATIONS
from newsloom.sources.key_index import history_indexes


def plain_marks(batch, stored):
    seen, out = set(), {}
    for seq, digest in sorted(batch):
        out[seq] = "store" if digest in stored else "batch" if digest in seen else None
        seen.add(digest)
    return out


@pytest.mark.parametrize("cells", [1, 3, 1024])
def test_marks_equal_a_plain_loop_with_a_third_of_rows_on_one_hash(spark, cells):
    rng = random.Random(cells)
    batch = [(i, "hot" if i % 3 == 0 else f"h{rng.randrange(120)}") for i in range(600)]
    rng.shuffle(batch)
    stored = {f"h{i}" for i in range(20)}
    df = spark.createDataFrame([(s, h, "x") for s, h in batch], "batch_seq long, content_hash string, content string")
    store = spark.createDataFrame([(h,) for h in stored for _ in range(3)], "content_hash string")
    marked = mark_duplicates(df.repartition(5), store, cells=cells)
    want = plain_marks(batch, stored)
    assert dict(values(marked, "batch_seq", "dup_reason")) == want
    assert dict(values(marked, "batch_seq", "is_duplicate")) == {s: r is not None for s, r in want.items()}
    known = known_duplicates(df, store, "batch_seq", cells=cells)
    assert dict(values(known, "batch_seq", "is_known")) == {s: h in stored for s, h in batch}
    stats = dedup_stats(marked).first()
    assert stats["unique"] + stats["duplicates"] == stats["total"] == 600
    assert unique_articles(marked).count() == stats["unique"] == len({h for _, h in batch} - stored)


def test_a_stored_hot_hash_marks_all_its_rows(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(100)], "batch_seq long, content_hash string")
    store = spark.createDataFrame([("hot",)] * 50, "content_hash string")
    assert set(values(mark_duplicates(df, store), "dup_reason")) == {"store"}
    assert values(mark_duplicates(df).filter("not is_duplicate"), "batch_seq") == [0]


def test_empty_contents_are_counted_apart(spark):
    rows = [(i, sha256(b"").hexdigest(), "") for i in range(4)] + [(9, "x", "text")]
    df = spark.createDataFrame(rows, "batch_seq long, content_hash string, content string")
    stats = dedup_stats(mark_duplicates(df)).first()
    assert (stats["duplicates"], stats["empty_duplicates"]) == (3, 3)


def test_attach_equals_a_join_and_keeps_null_keys(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b", "none", None])) for i in range(300)]
    left = spark.createDataFrame(rows, "n long, k string")
    facts = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3), ("unused", 4)], "k string, v long")
    for how in ("left", "inner"):
        got = values(attach(left, facts, "k", "n", how=how, cells=7), "n", "k", "v")
        want = [tuple(r) for r in left.join(facts, "k", how).select("n", "k", "v").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_without(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k long, v string")
    known = spark.createDataFrame([(1,), (1,), (3,)], "k long")
    assert sorted(values(without(left, ["k"], known), "v")) == ["y", "z"]


def test_bulk_append_of_new_rows(spark):
    batch = articles(spark, [article(i, seq=i) for i in range(5)], "seq long")
    fate = admit(batch, articles(spark, []), ARTICLES, "seq")
    assert tuple(append_stats(fate).first()) == (5, 5, 0)
    written = accepted_rows(fate.drop("created_at"), ARTICLES, AS_OF)
    assert written.columns == ARTICLES.columns and set(values(written, "created_at")) == {AS_OF}


def test_first_write_wins_in_store_and_in_batch(spark):
    stored = articles(spark, [article(0, title="old")])
    rows = [article(0, seq=0), article(1, seq=1, title="first"), article(1, seq=2, title="second")]
    fate = admit(articles(spark, rows, "seq long"), stored, ARTICLES, "seq")
    assert sorted(values(fate, "seq", "reject_reason")) == [(0, "id_exists"), (1, None), (2, "id_exists")]
    assert values(accepted_rows(fate, ARTICLES, AS_OF), "title") == ["first"]


def test_a_broken_row_does_not_block_a_later_good_one_with_its_id(spark):
    rows = [article(0, seq=0, source_type="fax"), article(0, seq=1)]
    fate = admit(articles(spark, rows, "seq long"), articles(spark, []), ARTICLES, "seq")
    assert sorted(values(fate, "seq", "accepted", "reject_reason")) == [
        (0, False, "constraint:enum:source_type"),
        (1, True, None),
    ]


def test_new_text_under_a_stored_id_is_refused(spark):
    fate = admit(
        articles(spark, [article(0, seq=0, content_hash="other")], "seq long"),
        articles(spark, [article(0)]),
        ARTICLES,
        "seq",
    )
    assert values(fate, "reject_reason") == ["id_exists"]


def test_one_of_two_rows_with_one_id_is_accepted(spark):
    rows = briefs(spark, [brief(0), brief(0, title="Other"), brief(1)])
    fate = admit(rows.withColumn("seq", F.monotonically_increasing_id()), briefs(spark, []), BRIEFS, "seq")
    assert sorted(values(fate, "id", "accepted")) == [("brief_a0", False), ("brief_a0", True), ("brief_a1", True)]
    with pytest.raises(ValueError):
        admit(rows, briefs(spark, []), BRIEFS, "id")


def test_blank_duplicates_are_counted_as_empty(spark):
    empty = sha256(b"").hexdigest()
    rows = [article(n, content=c, content_hash=empty) for n, c in enumerate(["", "  ", "\n"])] + [article(9)]
    marked = mark_duplicates(articles(spark, rows).withColumn("batch_seq", F.col("id")))
    assert dedup_stats(marked).first()["empty_duplicates"] == 2


def test_briefs_and_translations_append_by_the_same_rule(spark):
    rows = [brief(0), brief(1, quality_score=1.5), brief(2, summary_30="x" * 301), brief(3, title=None)]
    numbered = briefs(spark, rows).withColumn("seq", F.monotonically_increasing_id())
    fate = admit(numbered, briefs(spark, []), BRIEFS, "seq")
    assert dict(values(fate, "id", "reject_reason")) == {
        "brief_a0": None,
        "brief_a1": "constraint:range:quality_score",
        "brief_a2": "constraint:max_length:summary_30",
        "brief_a3": "constraint:not_null:title",
    }
    rows = [translation(0), translation(0, "xx"), translation(1, summary_250="x" * 5000)]
    numbered = translations(spark, rows).withColumn("seq", F.monotonically_increasing_id())
    fate = admit(numbered, translations(spark, []), TRANSLATIONS, "seq")
    assert sorted(values(fate, "id", "accepted")) == [
        ("trans_brief_a0_or", True),
        ("trans_brief_a0_xx", False),
        ("trans_brief_a1_or", True),
    ]


def test_composite_key(spark):
    rows = spark.createDataFrame(
        [("p", "t", 1, 0), ("p", "t", 2, 1), ("p", "u", 6, 2), ("p", "v", 5, 3)],
        "publication_id string, translation_id string, position int, seq long",
    )
    stored = rows.filter("seq = 3").drop("seq")
    fate = admit(rows, stored, PUBLICATION_STORIES, "seq")
    assert [r for _, r in sorted(values(fate, "seq", "reject_reason"))] == [
        None,
        "id_exists",
        "constraint:range:position",
        "id_exists",
    ]


def test_a_third_of_the_rows_under_one_id(spark):
    rows = [article(0 if i % 3 == 0 else i, seq=i) for i in range(90)]
    fate = admit(articles(spark, rows, "seq long"), articles(spark, []), ARTICLES, "seq")
    assert tuple(append_stats(fate).first()) == (90, 61, 29)
    assert values(fate.filter("accepted and id = 'a0'"), "seq") == [0]
    assert fate.filter(F.col("accepted") & (F.col("id") != "a0")).count() == 60


def test_an_index_answers_like_its_store_without_a_shuffle_of_it(spark, tmp_path):
    history = spark.range(3000).selectExpr("string(id) as id", "sha2(string(id % 2500), 256) as content_hash")
    hashes, ids = history_indexes(str(tmp_path), "history", buckets=4)
    for index in (hashes, ids):
        index.opened(spark)
        index.add(history)
        index.add(history)  # changes no answer
        assert index.known(spark).distinct().count() == (2500 if index is hashes else 3000)
    hashes.add(spark.createDataFrame([("n1", "new"), ("n2", None), ("n0", "new")], "id string, content_hash string"), batch=3)
    assert spark.table("history_content_hash").filter("batch = 3").collect()[0][:2] == ("new", "n0")
    assert hashes.known(spark, 3).distinct().count() == 2500 and hashes.known(spark).distinct().count() == 2501
    batch = spark.range(4000).selectExpr("id as batch_seq", "if(id % 3 = 0, 'hot', sha2(string(id), 256)) as content_hash")
    batch.write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    got = mark_duplicates(batch, hashes.known(spark))
    want = mark_duplicates(batch, history)
    assert sorted(got.collect()) == sorted(want.collect())
    # Another session would open the folder again.
    spark.sql("DROP TABLE history_content_hash")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mark_duplicates(batch, hashes.known(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = lines[scan].index("FileScan")
    above = []
    for line in reversed(lines[:scan]):
        at = next(i for i, c in enumerate(line) if c.isalpha())
        if at < depth:
            depth = at
            above.append(line.strip(" :+-"))
        if "Join" in line and at <= depth:
            break
    assert above and not any(line.startswith("Exchange") for line in above)
