"""The given tables mapped onto the news tables.

Every row of ``documents`` becomes an article, every labelled document has a brief, every
event is a line of the usage log. Times and titles are computed from the row number; all
else comes from the row itself.
"""

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import article_id, content_hash, ntz
from newsloom.operators.publication import daily_stories, publications
from newsloom.operators.validation import valid_rows
from newsloom.plans.article_feed import article_excerpts
from newsloom.reference_data import DEFAULT_CATEGORY, PLACEHOLDER_QUALITY, SOURCES, TITLE_CHARS
from newsloom.schemas import API_LOGS, ARTICLES, BRIEFS, TRANSLATIONS
from newsloom.sources.store import staged

AS_OF = datetime(2026, 7, 4, 12, 0, 0)
MODEL = "extract-1"
FEED_BLOCK = 5000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Deal an input of few splits to all cores before costly work on its texts.

    A Parquet file of one row group is one task however long its texts are. An input with
    a split per core or more, which is any large one, is returned as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def _minus(minutes: Column) -> Column:
    zero = F.lit(0)
    return ntz(AS_OF) - F.make_dt_interval(zero, zero, minutes.cast("int"))


def _source_name() -> Column:
    name = F.col("source")
    for number, (configured, *_) in enumerate(SOURCES):
        name = F.when(F.col("source") == f"src{number}", configured).otherwise(name)
    return name


def _title() -> Column:
    n = F.col("doc_id")
    head = (
        F.when(n % 77 == 0, "Click here: Climate policy")
        .when(n % 11 == 0, "Click here now")
        .when(n % 7 == 0, "Climate policy of Germany, NATO and World Bank")
        .otherwise("Story")
    )
    return F.concat(head, F.lit(" "), n.cast("string"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as articles, with ``doc_id`` and ``lang`` beside the table's columns."""
    n = F.col("doc_id")
    ahead = ntz(AS_OF) + F.make_dt_interval(F.lit(0), F.lit(3))
    base = spread(_read(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id",
        "lang",
        F.concat(F.lit("https://news.example.com/a/"), n.cast("string")).alias("source_url"),
        _source_name().alias("source_name"),
        F.lit("rss").alias("source_type"),
        _title().alias("title"),
        F.col("text").alias("content"),
        F.when(n % 29 == 0, ahead).otherwise(_minus(n * 37 % 4320)).alias("published_at"),
        _minus(n % 15 * 1440).alias("fetched_at"),
    )
    # Declared never null, which spares a second computation just to test for it.
    return base.withColumns(
        {
            "id": F.coalesce(article_id(F.col("source_url"), F.col("published_at")), F.lit("")),
            "content_hash": F.coalesce(content_hash(F.col("content")), F.lit("")),
            "created_at": F.col("fetched_at"),
        }
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as stored articles; of those with one hash, all but the first are flagged as duplicates.

    Texts are hashed in one pass, which leaves ids and hashes. Of those, only hashes that repeat are met again, and only
    the repeats are brought back, so that no text is shuffled.
    """
    rows = documents(spark, sf_dir)
    hashes = staged(rows.select("doc_id", "content_hash"))
    first = hashes.groupBy("content_hash").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    repeats = hashes.join(first, "content_hash").filter(F.col("doc_id") > F.col("_first")).select("doc_id")
    flagged = repeats.withColumn("_repeat", F.lit(True))
    joined = rows.join(flagged, "doc_id", "left")
    return joined.withColumn("is_duplicate", F.col("_repeat").isNotNull()).select(*ARTICLES.columns)


def candidate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry row for each source of the documents; the last digit of its count is its priority, which may be none."""
    counts = _read(spark, sf_dir, "documents").select(_source_name().alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return counts.select(
        "name",
        F.concat(F.lit("https://news.example.com/"), F.replace("name", F.lit(" "), F.lit("-"))).alias("url"),
        (F.col("n") % 5).cast("int").alias("priority"),
        F.col("n").cast("int").alias("expected_articles"),
    )


def stored_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored articles for queries that do not ask for the flag."""
    return documents(spark, sf_dir).select(*[c for c in ARTICLES.columns if c != "is_duplicate"])


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one collected batch, in document order."""
    rows = documents(spark, sf_dir).withColumn("batch_seq", F.col("doc_id"))
    return rows.withColumn("is_duplicate", F.lit(False)).select(*ARTICLES.columns, "batch_seq")


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was stored before the batch: the labelled documents, which the feeds deliver again."""
    labelled = _read(spark, sf_dir, "labels").select("doc_id").distinct()
    rows = documents(spark, sf_dir).join(labelled, "doc_id")
    # What is met with it are ids and hashes only.
    return rows.withColumn("is_duplicate", F.lit(False)).select(*ARTICLES.columns)


def labelled_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate brief per labelled document, with the labels and the language beside it.

    The excerpts together are about as long as a text, so nothing is gained by cutting
    them before the join; after it, only labelled documents are cut.
    """
    labels = _read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    n = F.col("doc_id")
    return article_excerpts(documents(spark, sf_dir).join(labels, "doc_id")).select(
        "doc_id",
        "lang",
        "quality",
        "toxic",
        F.length("content").alias("n_chars"),
        F.concat(F.lit("brief_"), "id").alias("id"),
        F.col("id").alias("article_id"),
        F.substring("title", 1, TITLE_CHARS).alias("title"),
        "summary_30",
        "summary_111",
        "summary_250",
        F.lit(DEFAULT_CATEGORY).alias("category"),
        F.lit(PLACEHOLDER_QUALITY).alias("quality_score"),
        F.lit(MODEL).alias("model_used"),
        _minus(n * 61 % 64800).alias("processed_at"),
    )


def valid_briefs(labelled: DataFrame) -> DataFrame:
    return valid_rows(labelled, BRIEFS)


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_briefs(labelled_briefs(spark, sf_dir)).select(*BRIEFS.required)


def translation_versions(labelled: DataFrame) -> DataFrame:
    """Odia for every brief, Hindi for the good ones, and a second, older Odia one for the others."""
    made = valid_briefs(labelled)
    good = F.col("quality") == 1

    def variant(language: str, suffix: str, minutes: int) -> Column:
        return F.struct(
            F.lit(language).alias("language"), F.lit(suffix).alias("suffix"), F.lit(minutes).alias("after")
        )

    variants = F.array_compact(
        F.array(
            variant("or", "", 60),
            F.when(good, variant("hi", "", 60)),
            F.when(~good, variant("or", "_v0", 30)),
        )
    )
    each = made.withColumn("_v", F.explode(variants)).select("*", "_v.*")
    tag = F.concat(F.lit("["), "language", F.lit("] "))
    after = F.make_dt_interval(F.lit(0), F.lit(0), F.col("after"))
    own_id = F.concat(F.lit("trans_"), "id", F.lit("_"), "language")
    return each.select(
        own_id.alias("own_id"),
        F.concat(own_id, "suffix").alias("id"),
        F.col("id").alias("brief_id"),
        "language",
        F.concat(tag, F.replace("title", F.lit("NATO"), F.lit("ନାଟୋ"))).alias("title"),
        *[F.concat(tag, n).alias(n) for n in ("summary_30", "summary_111", "summary_250")],
        F.lit(MODEL).alias("model_used"),
        (F.col("processed_at") + after).alias("translated_at"),
    )


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation_versions(labelled_briefs(spark, sf_dir)).select(*TRANSLATIONS.required)


class Stored:
    """The tables for queries that read some of them more than once.

    The candidate briefs are written out first; everything else is a projection of them or
    of a given table, or a small result of both.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.labelled = staged(labelled_briefs(spark, sf_dir))
        self.candidates = self.labelled.select(*BRIEFS.required)
        self.briefs = valid_briefs(self.labelled).select(*BRIEFS.required)
        self.versions = translation_versions(self.labelled)
        self.translations = self.versions.select(*TRANSLATIONS.required)
        self._given = (spark, sf_dir)
        self.api_logs = api_logs(spark, sf_dir)

    @cached_property
    def articles(self) -> DataFrame:
        """Made when asked for, because the duplicate flag takes a pass over all texts."""
        return articles(*self._given)

    def publish(self) -> None:
        """Make the daily publications as well; they are few rows per day and language."""
        self.stories = staged(daily_stories(self.translations, self.briefs))
        self.publications = publications(self.stories, AS_OF)

    def tables(self) -> dict[str, DataFrame]:
        self.publish()
        return {
            "articles": self.articles,
            "briefs": self.briefs,
            "translations": self.translations,
            "publications": self.publications,
            "publication_stories": self.stories,
            "api_logs": self.api_logs,
        }


def candidate_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines; sign-ups are no model call and break the rule for operations."""
    kind = F.col("event_type")
    tokens = F.get_json_object("props", "$.k").cast("int")
    operation = (
        F.when(kind.isin("view", "click", "error"), "summarize")
        .when(kind == "purchase", "translate")
        .otherwise(kind)
    )
    return _read(spark, sf_dir, "events").select(
        F.concat(F.lit("log_"), F.col("event_id").cast("string")).alias("id"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        F.when(kind.isin("view", "purchase"), "extract-1").otherwise("extract-2").alias("model_used"),
        operation.alias("operation"),
        (kind != "error").alias("success"),
        tokens.alias("input_tokens"),
        (tokens * 2).alias("output_tokens"),
        F.col("value").cast("decimal(18,6)").alias("cost_usd"),
        F.floor("value").cast("int").alias("latency_ms"),
        F.when(kind == "error", "failed").alias("error_message"),
    )


def api_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_rows(candidate_logs(spark, sf_dir), API_LOGS)


# --- feed payloads ---------------------------------------------------------------------


def _escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit(">"), F.lit("&gt;"))


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def feed_payloads(spark: SparkSession, sf_dir: str, faulty: bool = False) -> DataFrame:
    """The documents as feed files: RSS for English and German, Atom for French and Spanish.

    With ``faulty``, some entries have no link, some no title, and Spanish payloads lack their last tag.

    A payload covers one source and language within a block of document numbers, so it
    holds at most ``FEED_BLOCK`` entries whatever a source's share of the documents is.
    """
    title, content, url = _escaped(F.col("title")), _escaped(F.col("content")), F.col("source_url")
    at = F.col("published_at")
    rss_time = F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    atom_time = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = _cat("<title>", title, "</title>")
    link, links = _cat("<link>", url, "</link>"), _cat('<link rel="self" href="', url, '/atom"/><link rel="alternate" href="', url, '"/>')
    if faulty:
        head = F.when(F.col("doc_id") % 17 == 0, "").otherwise(head)
        link, links = (F.when(F.col("doc_id") % 13 == 0, "").otherwise(x) for x in (link, links))
    item = _cat("<item>", head, link, "<description>", content, "</description><pubDate>", rss_time, "</pubDate></item>")
    entry = _cat(
        "<entry>", head, links, '<content type="text">', content, "</content><published>", atom_time, "</published></entry>",
    )
    atom = F.col("lang").isin("fr", "es")
    block = F.floor(F.col("doc_id") / FEED_BLOCK)
    entries = documents(spark, sf_dir).select(
        "source_name",
        F.concat_ws("/", "source_name", "lang", block.cast("string")).alias("payload_id"),
        atom.alias("atom"),
        "doc_id",
        F.when(atom, entry).otherwise(item).alias("entry"),
    )
    joined = entries.groupBy("source_name", "payload_id", "atom").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))), lambda e: e["entry"]), ""
        ).alias("body")
    )
    end = F.when(F.col("payload_id").contains("/es/") & F.lit(faulty), "").otherwise("</feed>")
    payload = F.when(
        F.col("atom"), _cat('<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>', F.col("body"), end)
    ).otherwise(_cat('<rss version="2.0"><channel><title>feed</title>', F.col("body"), "</channel></rss>"))
    return joined.select("source_name", "payload_id", payload.alias("payload"))


def odd_feed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in the rarer forms of a feed: RSS 1.0 for English, Atom with a prefix for German, texts as elements for the others.

    Blocks bound a payload's entries as in ``feed_payloads``.
    """
    title, content, url = _escaped(F.col("title")), _escaped(F.col("content")), F.col("source_url")
    time = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    old = _cat(
        '<item rdf:about="', url, '"><title>', title, "</title><link>", url, "</link><description>", content,
        "</description><dc:date>", time, "</dc:date></item>",
    )
    prefixed = _cat(
        "<a:entry><a:title>", title, '</a:title><a:link href="', url, '"/><a:content type="text">', content,
        "</a:content><a:published>", time, "</a:published></a:entry>",
    )
    elements = _cat(
        "<entry><title>", title, '</title><link href="', url,
        '"/><content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>', content, "</p></div></content><published>",
        time, "</published></entry>",
    )
    form = F.when(F.col("lang") == "en", "rdf").when(F.col("lang") == "de", "prefixed").otherwise("elements")
    entry = F.when(form == "rdf", old).when(form == "prefixed", prefixed).otherwise(elements)
    block = F.floor(F.col("doc_id") / FEED_BLOCK).cast("string")
    rows = documents(spark, sf_dir).select(
        "source_name", form.alias("form"), block.alias("block"), F.struct("doc_id", entry.alias("entry")).alias("e")
    )
    joined = rows.groupBy("source_name", "form", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), "").alias("body")
    )
    heads = {
        "rdf": (
            '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" '
            'xmlns:dc="http://purl.org/dc/elements/1.1/"><channel rdf:about="x"><title>feed</title></channel>',
            "</rdf:RDF>",
        ),
        "prefixed": ('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>feed</a:title>', "</a:feed>"),
        "elements": ('<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>', "</feed>"),
    }
    payload = F.lit(None).cast("string")
    for name, (head, end) in heads.items():
        payload = F.when(F.col("form") == name, _cat(head, F.col("body"), end)).otherwise(payload)
    return joined.select("source_name", "form", payload.alias("payload"))


def payload_order() -> Column:
    return F.concat_ws("#", "payload_id", F.lpad(F.col("position").cast("string"), 9, "0"))


# --- model responses --------------------------------------------------------------------


def responses(labelled: DataFrame, fields: list[str], id_column: str) -> DataFrame:
    """A response per labelled document holding ``fields``, in all the shapes a model gives.

    The shape follows from the language, the labels and the length: bare, fenced, wrapped in
    prose, cut off, without an object, not JSON, with a field missing or not a string.
    """
    source = {f: F.col(_summary_for(f)) for f in fields}
    whole = F.to_json(F.struct(*[c.alias(f) for f, c in source.items()]))
    short = F.to_json(F.struct(*[source[f].alias(f) for f in fields[:-1]]))
    number = F.to_json(F.struct(F.lit(30).alias(fields[0]), *[source[f].alias(f) for f in fields[1:]]))
    lang, long = F.col("lang"), F.col("n_chars") > 3000
    shape = (
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "The request was declined.")
        .when(F.col("toxic") == 1, short)
        .when(F.col("quality") == 0, F.left(whole, F.length(whole) - 1))
        .when((lang == "fr") & long, _cat("{", F.col("summary_30"), "}"))
        .when((lang == "es") & long, number)
        .when(lang == "de", _cat("```json\n", whole, "\n```"))
        .when(lang == "fr", _cat("```", whole, "```\n"))
        .when(lang == "es", _cat("Here it is: ", whole, " Regards."))
        .otherwise(whole)
    )
    return labelled.select(F.col(id_column).alias("id"), shape.alias("response"))


def _summary_for(field: str) -> str:
    part = field.rsplit("_", 1)[-1]
    return part if part == "title" else f"summary_{part}"
