import hashlib
from datetime import datetime

import pytest
from conftest import AS_OF, values
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import text as T


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_whitespace_is_what_python_strips():
    assert set(T.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


SAMPLES = ["", "  ", "a", " a  b\tc\n", " x y　", "\x1c1\x1f2\x85", "É Ü ß", "a" * 50, "one two"]


def test_strip_hash_and_words_equal_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    got = values(df, "s", T.stripped(F.col("s")), T.content_hash(F.col("s")), T.words(F.col("s")), T.word_count(F.col("s")))
    for s, stripped, digest, words, count in got:
        assert stripped == s.strip()
        assert digest == hashlib.sha256(s.strip().lower().encode()).hexdigest()
        assert words == s.split() and count == len(s.split())


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n  abcé", max_size=30), min_size=1, max_size=20))
def test_excerpts_equal_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for n in (1, 3):
        words = T.words(F.col("s"), at_most=3)
        for s, got in values(df, "s", T.excerpt(words, n)):
            w = s.split()
            assert got == " ".join(w[:n]) + ("..." if len(w) > n else "")


@pytest.mark.parametrize("size,dots", [(30, False), (31, True)])
def test_excerpt_of_exactly_30_and_31_words(spark, size, dots):
    text = " ".join(f"w{i}" for i in range(size))
    got = one(spark, T.excerpt(T.words(F.lit(text), 250), 30))
    assert got.endswith("...") is dots and len(got.split()) == 30


@pytest.mark.parametrize(
    "moment",
    [datetime(2026, 7, 4, 12, 30), datetime(2026, 7, 4, 12, 30, 0, 120), datetime(2026, 3, 8, 2, 30), datetime(1999, 1, 1)],
)
def test_iso_and_id_equal_python(spark, moment):
    assert one(spark, T.iso(T.ntz(moment))) == moment.isoformat()
    assert one(spark, T.iso_utc(T.ntz(moment))) == moment.isoformat() + "Z"
    want = hashlib.sha256(f"https://x/1:{moment.isoformat()}".encode()).hexdigest()[:16]
    assert one(spark, T.article_id(F.lit("https://x/1"), T.ntz(moment))) == want


def test_same_content_in_other_case_and_padding_has_one_hash(spark):
    df = spark.createDataFrame([("Test Content",), ("test content",), ("  test content  ",)], "s string")
    hashes = set(values(df, T.content_hash(F.col("s"))))
    assert len(hashes) == 1 and len(hashes.pop()) == 64


def test_age_ignores_the_session_zone(spark):
    # 02:30 does not exist on this day in the session's zone.
    assert one(spark, T.age_hours(T.ntz(datetime(2026, 3, 8, 2, 30)), datetime(2026, 3, 8, 4, 0))) == 1.5
    assert one(spark, T.age_hours(T.ntz(datetime(2026, 7, 4, 15, 0)), AS_OF)) == -3.0
    assert one(spark, T.age_hours(T.ntz(datetime(2026, 7, 4, 11, 59, 59, 999999)), AS_OF)) == 1 / 3.6e9


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTPS://Ex.COM", "https://ex.com/"),
        ("http://a.b:80/x?Y=1", "http://a.b/x?Y=1"),
        ("https://A.b?q=1", "https://a.b/?q=1"),
        ("https://U:Pw@Ho.st:443/P", "https://U:Pw@ho.st/P"),
        ("https://a.b:8443/x", "https://a.b:8443/x"),
        ("nonsense", "nonsense"),
    ],
)
def test_normalized_url(spark, url, want):
    assert one(spark, T.normalized_url(F.lit(url))) == want
