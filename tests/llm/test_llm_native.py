"""Line dedup, line-first quality and mixing: SQL twins over odd rows, and their own promises."""

import hashlib
from collections import Counter

import duckdb
import pytest
from llm_cases import empty_frame, lower_ascii, odd_frame, words

from newsloom.llm import oracle
from newsloom.llm.line_dedup import drop_common_lines
from newsloom.llm.line_quality import line_first_quality
from newsloom.llm.mixing import mix, mixed_sizes, targets
from newsloom.llm.registered import op4_mix_sources, op5_line_quality, op9_line_dedup

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    odd_frame(spark).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize(
    "query, sql", [(op4_mix_sources, oracle.OP4), (op5_line_quality, oracle.OP5), (op9_line_dedup, oracle.OP9)]
)
def test_twin_over_odd_rows(spark, odd_dir, query, sql):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{odd_dir}/documents.parquet/*.parquet'")
    frame = query(spark, odd_dir)
    wanted = db.execute(f"select {', '.join(frame.columns)} from ({sql})").fetchall()
    assert Counter(map(tuple, frame.collect())) == Counter(wanted)


@pytest.mark.parametrize("operator", [drop_common_lines, line_first_quality, mix, mixed_sizes])
def test_empty_table_and_clashing_names(spark, operator):
    assert operator(empty_frame(spark)).count() == 0
    clash = odd_frame(spark, "n_lines,kept_text,kept,n_words,size,lot,copies,_fails,_drop,_row_a,n_dup_lines")
    plain = operator(odd_frame(spark))
    rows = [Counter(map(str, got.select(*plain.columns).collect())) for got in (plain, operator(clash))]
    assert rows[0] == rows[1] and rows[0]


def test_dropped_lines_against_plain_version(spark):
    texts = ["Shared  \nown %d\n shared\nrare" % i for i in range(12)] + ["x\nSHARED\n", None, "", "own 1"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda line: lower_ascii(line.strip(SPACE))
    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    for r in drop_common_lines(frame).collect():
        lines = (texts[r.doc_id] or "").split("\n")
        kept = [x for x in lines if not key(x) or count[key(x)] < 10]
        assert (r.kept_text, r.n_lines, r.n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))


def test_line_quality_judges_lines_then_documents(spark):
    good = "This sentence is long enough to stand for itself, and it ends well."
    more = "Another one says something else, so that nothing is repeated here."
    cases = {
        1: f"{good}\nHome | News | Sport | Weather | More |\n{more}",
        2: "one | two | three | four | five |\nsix | seven | eight | nine | ten | eleven |",
        3: "WE SELL!! CHEAP!! THINGS!! TODAY!! AND!! ALSO!! TOMORROW!! FOR!! LESS!! MONEY!!",
        4: f"{good}\nWe use cookies to make this site better.",
        5: "the same words come again and again " * 6,
        6: "a# b$ c% d& e* f| g# h$ i% j& k* l.",
    }
    frame = spark.createDataFrame([(i, t) for i, t in cases.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in line_first_quality(frame).collect()}
    assert {i: r.kept for i, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
    assert got[1].cleaned == f"{good}\n{more}" and got[4].cleaned == good and got[5].base_failed
    text = cases[5]
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    assert got[5].n_repeat_words == len(covered) and got[5].word_chars == sum(map(len, w))


def test_targets_fill_up_to_the_brim(spark):
    sizes = {"a": 1000, "b": 10, "c": 5, "d": 400, None: 20}
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r for r in targets(frame).collect()}
    assert {s: r.weight for s, r in got.items()} == {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    assert got["b"].target == 30 and got["c"].target == 15 and got[None].target == 60
    assert got["a"].target == got["d"].target == (1435 - 105) / 2


def test_mix_comes_near_its_targets_and_repeats_itself(spark):
    rows = [(i, "w " * (i * 7919 % 180 + 1), "en", f"s{min(i % 9, 4)}", 0) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixed_sizes(frame).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    for r in got:
        assert abs(taken[r.source] - r.target) <= 0.02 * r.target
    again = Counter(x.doc_id for x in mix(frame.repartition(7)).collect())
    assert again == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mix_of_few_large_texts_ends_near_its_targets(spark, tmp_path):
    """Sources of a dozen texts of very different sizes, one with an id that comes twice."""
    sizes = [4000, 2500, 1900, 700, 400, 260, 130, 60, 31, 17, 9, 4]
    rows = [(100 * s + i, "w " * n, "en", f"s{s}", 0) for s in range(6) for i, n in enumerate(sizes) if (s + i) % 7]
    rows += [(100, "w " * 90, "en", "s1", 0), (None, "w w", "en", "s2", 0), (None, None, "en", "s3", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got, taken = mixed_sizes(frame).collect(), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    for source in {r.source for r in got}:
        rows = [r for r in got if r.source == source]
        left, whole = rows[0].target - taken[source], int(rows[0].target // rows[0].source_size)
        assert abs(left) <= max(r.size for r in rows) / 2
        # None of the documents that are not taken once more would bring the source nearer to its target.
        assert all(abs(left - r.size) >= abs(left) for r in rows if r.copies == whole)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    wanted = db.execute(f"select {', '.join(columns)} from ({oracle.OP4})").fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(wanted)


def test_kept_digest_is_of_utf8(spark, odd_dir):
    got = {r.doc_id: r.kept_sha256 for r in op9_line_dedup(spark, odd_dir).collect()}
    assert got[8] == hashlib.sha256("Ärger über ÉTÉ\nund noch eine Zeile.\n\n".encode()).hexdigest()


def test_common_lines_are_met_either_way(spark):
    rows = [(i, f"line of all\n{i}\nline of {i % 30}\n\nline of all") for i in range(400)] + [(7, None), (None, "line of all")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sent, dealt = (drop_common_lines(frame, broadcast_rows=n) for n in (1_000_000, 0))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    try:
        spark.conf.set(threshold, "-1")  # Spark would send so small a table by itself
        met = Counter(map(tuple, dealt.collect()))
    finally:
        spark.conf.set(threshold, before)
    assert Counter(map(tuple, sent.collect())) == met
    assert {r.kept_text for r in dealt.filter("doc_id is null").collect()} == {""}
    assert {r.kept_text for r in dealt.filter("doc_id = 8").collect()} == {"8\n"}
