from datetime import datetime

import pytest
from conftest import AS_OF, values
from pyspark.sql import functions as F

from newsloom.plans.ingest import collect_articles
from newsloom.reference_data import SOURCES
from newsloom.sources import feeds
from newsloom.sources.registry import active_sources, source_registry

ENTRY = (
    "title string, link string, content array<struct<value:string>>, summary string, description string, "
    "published timestamp_ntz, updated timestamp_ntz, source_name string"
)
NOON = datetime(2026, 7, 4, 12, 30)
TEN = datetime(2026, 7, 4, 10, 0)


def entries(spark, *changes):
    base = {
        "title": "T", "link": "https://e.com/1", "content": None, "summary": None, "description": None,
        "published": NOON, "updated": None, "source_name": "S",
    }
    return spark.createDataFrame([tuple({**base, **c}.values()) for c in changes], ENTRY)


@pytest.mark.parametrize(
    "changes,want",
    [
        ({}, NOON),
        ({"updated": TEN}, NOON),
        ({"published": None, "updated": TEN}, TEN),
        ({"published": None}, AS_OF),
    ],
)
def test_published_falls_back(spark, changes, want):
    assert values(feeds.normalized_articles(entries(spark, changes), AS_OF), "published_at") == [want]


@pytest.mark.parametrize(
    "changes,want",
    [
        ({"content": [("C",)], "summary": "S", "description": "D"}, "C"),
        ({"content": [("",)], "summary": "S"}, ""),
        ({"content": [], "summary": "S", "description": "D"}, "S"),
        ({"summary": "", "description": "D"}, "D"),
        ({"description": "D"}, "D"),
        ({}, ""),
    ],
)
def test_content_is_the_first_there_is(spark, changes, want):
    assert values(feeds.normalized_articles(entries(spark, changes), AS_OF), "content") == [want]


def test_valid_and_rejected_entries(spark):
    df = entries(spark, {}, {"link": None}, {"title": None}, {"link": "not-a-valid-url"}, {"title": ""})
    good = feeds.normalized_articles(df, AS_OF).collect()
    assert [r["title"] for r in good] == ["T", ""]
    row = good[0]
    assert (row["source_name"], row["source_type"], row["is_duplicate"]) == ("S", "rss", False)
    assert row["fetched_at"] == AS_OF and len(row["id"]) == 16 and len(row["content_hash"]) == 64
    reasons = sorted(values(feeds.rejected_entries(df, AS_OF), "reject_reason"))
    assert reasons == ["invalid_url", "missing_link", "missing_title"]


def test_id_uses_the_raw_link_and_the_store_the_normalised_one(spark):
    a, b = feeds.normalized_articles(entries(spark, {"link": "https://E.com"}, {"link": "https://e.com/"}), AS_OF).collect()
    assert a["source_url"] == b["source_url"] == "https://e.com/" and a["id"] != b["id"]


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
<title>Feed</title>
<item><title>A &amp; B</title><link>https://e.com/1</link><description><![CDATA[<p>hi</p>]]></description>
<pubDate>Sat, 04 Jul 2026 12:30:00 GMT</pubDate></item>
<item><title>C</title><link>https://e.com/2</link><description>short</description>
<content:encoded>full</content:encoded><pubDate>Sat, 4 Jul 2026 14:30:00 +0200</pubDate></item>
<item><link>https://e.com/3</link></item></channel></rss>"""
ONE_ITEM = "<rss><channel><item><title>Test Article</title><link>https://example.com/article</link></item></channel></rss>"
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title type="html">E1</title>
<link rel="self" href="https://e.com/self"/><link href="https://e.com/9"/>
<content type="html">Body &lt;b&gt;x&lt;/b&gt;</content><summary>S</summary><updated>2026-07-04T12:30:00Z</updated></entry>
<entry><title>E2</title><link rel="alternate" href="https://e.com/10"/><summary>only</summary>
<published>2026-07-04T14:30:00+02:00</published></entry></feed>"""


def payloads(spark, *texts):
    rows = [(f"s{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "source_name string, payload string")


def test_rss_and_atom_entries(spark):
    df = feeds.feed_entries(payloads(spark, RSS, ONE_ITEM, ATOM))
    articles = {r["title"]: r for r in feeds.normalized_articles(df, AS_OF).collect()}
    assert set(articles) == {"A & B", "C", "Test Article", "E1", "E2"}
    assert articles["A & B"]["content"] == "<p>hi</p>" and articles["C"]["content"] == "full"
    assert articles["E1"]["content"] == "Body <b>x</b>" and articles["E2"]["content"] == "only"
    assert articles["E1"]["source_url"] == "https://e.com/9"
    for title in ("A & B", "C", "E1", "E2"):
        assert articles[title]["published_at"] == NOON, title
    assert articles["Test Article"]["published_at"] == AS_OF
    assert values(df.filter("source_name = 's0'"), "position") == [0, 1, 2]
    assert values(feeds.rejected_entries(df, AS_OF), "reject_reason") == ["missing_title"]


def test_malformed_payloads_are_reported_and_cost_only_themselves(spark):
    texts = [RSS, "<rss><channel><item><title>cut", "junk", "", None, "<html><body>x</body></html>"]
    report = {r["source_name"]: r for r in feeds.feed_report(payloads(spark, *texts)).collect()}
    assert report["s0"]["entries"] == 3 and report["s0"]["parse_error"] is None
    assert [report[f"s{i}"]["entries"] for i in range(1, 6)] == [0] * 5
    assert report["s5"]["parse_error"] == "unknown_format"  # proper XML, but no feed
    assert [report[f"s{i}"]["parse_error"] for i in range(1, 5)] == ["malformed"] * 4
    assert feeds.feed_entries(payloads(spark, *texts)).count() == 3


def test_whole_entries_of_a_broken_payload_are_kept(spark):
    cut = RSS[: RSS.index("<item><link>https://e.com/3")] + "<item><title>lost"
    bare = ONE_ITEM.replace("Test Article", "R&D&nbsp;A &amp; B")
    cut_atom = ATOM[: ATOM.index("<entry><title>E2")]
    df = payloads(spark, cut, bare, cut_atom)
    titles = values(feeds.feed_entries(df), "title")
    assert sorted(titles) == ["A & B", "C", "E1", "R&D&nbsp;A & B"]
    report = values(feeds.feed_report(df), "entries", "parse_error")
    assert sorted(report) == [(1, "malformed"), (1, "malformed"), (2, "malformed")]


def test_cdata_of_a_broken_payload_is_left_alone(spark):
    body = "<![CDATA[AT&T & co </item> <b>x</b> &amp;]]>"
    sound = ONE_ITEM.replace("Test Article", body)
    cut = sound.replace("</channel></rss>", "<item><title>lost <![CDATA[ and")
    assert values(feeds.feed_entries(payloads(spark, sound)), "title") == ["AT&T & co </item> <b>x</b> &amp;"]
    assert values(feeds.feed_entries(payloads(spark, cut)), "title") == ["AT&T & co </item> <b>x</b> &amp;"]


def test_link_from_a_permanent_guid(spark):
    link = ONE_ITEM[ONE_ITEM.index("<link>") : ONE_ITEM.index("</link>") + 7]
    guids = ["<guid>https://e.com/g</guid>", '<guid isPermaLink="true">https://e.com/g</guid>', '<guid isPermaLink="false">https://e.com/g</guid>']
    df = feeds.feed_entries(payloads(spark, *[ONE_ITEM.replace(link, g) for g in guids]))
    assert sorted(values(df, "source_name", "link")) == [("s0", "https://e.com/g"), ("s1", "https://e.com/g"), ("s2", None)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Sat, 04 Jul 2026 12:30 GMT", NOON),
        ("04 Jul 26 12:30:00 GMT", NOON),
        ("4 Jul 2026 07:30:00 EST", NOON),
        ("4 Jul 2026 08:30:00 EDT", NOON),
        ("Sat, 04 Jul 2026 12:30:00 GMT", NOON),
        ("4 Jul 2026 12:30:00 +0000", NOON),
        ("Sat, 04 Jul 2026 05:30:00 PDT", NOON),
        ("2026-07-04T12:30:00Z", NOON),
        ("2026-07-04T14:30:00.500+02:00", NOON.replace(microsecond=500000)),
        ("2026-07-04T12:30:00", NOON),
        ("2026-07-04", datetime(2026, 7, 4)),
        ("Sun, 08 Mar 2026 02:30:00 GMT", datetime(2026, 3, 8, 2, 30)),
        ("yesterday", None),
        ("", None),
        (None, None),
    ],
)
def test_feed_times_are_utc_in_any_session_zone(spark, text, want):
    got = spark.range(1).select(feeds.feed_time(F.lit(text).cast("string")).alias("t")).first()[0]
    assert got == want


def test_disabled_sources_are_not_collected(spark):
    rows = [("s0", "https://a.b/x", 1, 5, True), ("s1", "https://a.b/y", 1, 5, False)]
    registry = source_registry(spark, rows)
    assert values(active_sources(registry), "name") == ["s0"]
    got = collect_articles(payloads(spark, ONE_ITEM, ONE_ITEM), registry, AS_OF)
    assert values(got, "source_name") == ["s0"]


def test_registry_has_five_enabled_sources_expecting_115_articles():
    assert len(SOURCES) == 5 and sum(row[3] for row in SOURCES) == 115 and all(row[4] for row in SOURCES)


RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel rdf:about="https://e.com/"><title>Old</title><items><rdf:Seq><rdf:li resource="https://e.com/1"/></rdf:Seq></items></channel>
<item rdf:about="https://e.com/1"><title>R1</title><link>https://e.com/1</link><description>text 1</description><dc:date>2026-07-04T12:30:00Z</dc:date></item>
<item rdf:about="https://e.com/2"><title>R2</title><link>https://e.com/2</link></item></rdf:RDF>"""
PREFIXED_RDF = RDF.replace("xmlns=", "xmlns:r=").replace("<channel", "<r:channel").replace("</channel", "</r:channel")
for _name in ("item", "title", "link", "description"):
    PREFIXED_RDF = PREFIXED_RDF.replace(f"<{_name} ", f"<r:{_name} ").replace(f"<{_name}>", f"<r:{_name}>").replace(f"</{_name}>", f"</r:{_name}>")
PREFIXED_ATOM = """<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>F</a:title><a:entry><a:title>P1</a:title>
<a:link href="https://e.com/p"/><a:content type="html"><![CDATA[<a:b>kept</a:b> & so]]></a:content><a:updated>2026-07-04T12:30:00Z</a:updated></a:entry></a:feed>"""
XHTML = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml">X <i>1</i></div></title>
<link href="https://e.com/x"/><content type="xhtml" xml:lang="en"><div xmlns="http://www.w3.org/1999/xhtml"><p class="a">One &amp; <b>two</b></p><br/>end</div></content>
<summary type='xhtml'><x:div xmlns:x="http://www.w3.org/1999/xhtml"><x:p>s</x:p></x:div></summary><updated>2026-07-04T12:30:00Z</updated></entry>
<entry><title>plain</title><link href="https://e.com/y"/><content type="xhtml"/><summary>only</summary></entry></feed>"""
RSS_WITH_ATOM_LINK = ONE_ITEM.replace("<rss>", '<rss xmlns:atom="http://www.w3.org/2005/Atom">').replace(
    "<item>", '<item><atom:link href="https://e.com/self" rel="self"/>'
)


def test_rss_1_prefixed_and_xhtml_feeds(spark):
    texts = [RDF, PREFIXED_RDF, PREFIXED_ATOM, XHTML, RSS_WITH_ATOM_LINK]
    df = feeds.feed_entries(payloads(spark, *texts))
    got = {(r["source_name"], r["title"]): r for r in feeds.normalized_articles(df, AS_OF).collect()}
    content = {k: r["content"] for k, r in got.items()}
    assert content == {
        ("s0", "R1"): "text 1", ("s0", "R2"): "", ("s1", "R1"): "text 1", ("s1", "R2"): "",
        ("s2", "P1"): "<a:b>kept</a:b> & so",
        ("s3", "X <i>1</i>"): '<p class="a">One &amp; <b>two</b></p><br/>end', ("s3", "plain"): "",
        ("s4", "Test Article"): "",
    }
    assert got["s0", "R1"]["published_at"] == got["s2", "P1"]["published_at"] == NOON
    assert got["s4", "Test Article"]["source_url"] == "https://example.com/article"
    assert [r["summary"] for r in df.filter("source_name = 's3'").orderBy("position").collect()] == ["<x:p>s</x:p>", "only"]
    assert set(values(feeds.feed_report(payloads(spark, *texts)), "parse_error")) == {None}


def test_one_large_file_is_read_by_several_tasks(spark, tmp_path):
    items = [
        f"<item><title>T{i} &amp; co</title><link>https://e.com/{i}</link><description><![CDATA[<p>text {i}</p>]]></description>"
        f"<pubDate>Sat, 04 Jul 2026 12:30:00 GMT</pubDate></item>" for i in range(3000)
    ]
    rss = f"<rss><channel>\n{'\n'.join(items)}</channel></rss>"
    cut = RSS[: RSS.index("<item><link>https://e.com/3")] + "<item><title>lost"
    for folder, name, text in (("rss", "big", rss), ("rss", "cut", cut), ("rss", "old", RDF), ("atom", "small", ATOM), ("atom", "x", XHTML)):
        (tmp_path / folder / f"source_name={name}").mkdir(parents=True)
        (tmp_path / folder / f"source_name={name}" / "feed.xml").write_text(text)
    settings = {"spark.sql.files.maxPartitionBytes": "100k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = feeds.feed_file_entries(spark, f"{tmp_path}/rss")
        assert rows.rdd.getNumPartitions() > 6
        got = rows.union(feeds.feed_file_entries(spark, f"{tmp_path}/atom", "atom")).drop("file").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    texts = [("big", rss), ("cut", cut), ("old", RDF), ("small", ATOM), ("x", XHTML)]
    want = feeds.feed_entries(spark.createDataFrame(texts, "source_name string, payload string")).drop("position").collect()
    whole = [r for r in got if r["title"] != "lost"]
    assert sorted(map(str, whole)) == sorted(map(str, want)) and len(got) - len(whole) <= 1
