"""The registered queries: each takes (spark, sf_dir) and reads the given tables whole."""

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.checks import samples as S
from newsloom.checks import stub
from newsloom.functions.responses import SUMMARY_FIELDS, TRANSLATION_FIELDS, combined_fields
from newsloom.functions.text import stripped
from newsloom.operators import dedup, inference, lookups, publication, reports, retention, selection, validation
from newsloom.operators.keyed_append import admit
from newsloom.plans import article_feed as feed
from newsloom.plans import editorial
from newsloom.plans.ingest import articles_of, collect_articles, deliver, ingest, outcomes
from newsloom.reference_data import SOURCES, SUMMARY_WORDS, TOP_STORIES
from newsloom.schemas import API_LOGS, ARTICLES, BRIEFS, TABLES, TRANSLATIONS
from newsloom.sources import feeds, footers
from newsloom.sources import registry as sources
from newsloom.sources.key_index import history_indexes
from newsloom.sources.store import create_store, read_table, shared_folder, staged, write_table
from newsloom.streaming.incremental import (
    create_stream_store,
    ingest_stream,
    payload_files,
    stored_articles,
)

# The stand-in model travels with its functions, so workers need not be able to import it.
cloudpickle.register_pickle_by_value(stub)

_QUICK = {"attempts": 1, "wait_seconds": (0, 0)}

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTERED[fn.__name__] = fn
    return fn


# --- sources and stores ------------------------------------------------------------------


@query
def active_sources(spark, sf):
    return sources.active_source_articles(sources.source_registry(spark), S.stored_columns(spark, sf))


@query
def feed_entries(spark, sf):
    entries = feeds.feed_entries(S.feed_payloads(spark, sf))
    text = F.coalesce(F.get("content", F.lit(0))["value"], F.col("summary"))
    return entries.select(
        "source_name",
        "payload_id",
        "position",
        "title",
        "link",
        F.col("published").alias("published_at"),
        F.length(stripped(text)).alias("content_chars"),
    )


@query
def feed_report(spark, sf):
    report = feeds.feed_report(S.feed_payloads(spark, sf))
    return report.select("payload_id", "entries", F.col("parse_error").isNotNull().alias("malformed"))


@query
def feed_forms(spark, sf):
    """Entries of RSS 1.0, of Atom with a prefix, and of Atom whose texts are elements."""
    entries = feeds.feed_entries(S.odd_feed_payloads(spark, sf))
    text = F.coalesce(F.get("content", F.lit(0))["value"], F.col("summary"))
    return entries.select(
        "source_name", "form", "title", "link", F.col("published").alias("published_at"),
        F.length(stripped(text)).alias("content_chars"),
    )


@query
def feed_file_entries(spark, sf):
    """All payloads as files, one per source and dialect, read entry by entry."""
    root = shared_folder(spark)
    is_atom = F.col("payload").startswith("<feed")
    named = S.feed_payloads(spark, sf).select(F.when(is_atom, "atom").otherwise("rss").alias("dialect"), "source_name", "payload")
    named.write.partitionBy("dialect", "source_name").text(root)
    parts = [feeds.feed_file_entries(spark, f"{root}/dialect={d}", d) for d in ("rss", "atom")]
    entries = parts[0].union(parts[1])
    text = F.coalesce(F.get("content", F.lit(0))["value"], F.col("summary"))
    return entries.select(
        "source_name", "title", "link", F.col("published").alias("published_at"),
        F.sha2(F.lower(stripped(text)).cast("binary"), 256).alias("content_hash"),
    )


def _collected(spark, sf):
    registry = sources.source_registry(spark)
    return collect_articles(S.feed_payloads(spark, sf), registry, S.AS_OF)


@query
def normalized_articles(spark, sf):
    return _collected(spark, sf).select(
        "id",
        "source_url",
        "source_name",
        "source_type",
        "title",
        "published_at",
        "fetched_at",
        "content_hash",
        "is_duplicate",
    )


@query
def store_schemas(spark, sf):
    return reports.store_profile(S.Stored(spark, sf).tables())


@query
def append_articles(spark, sf):
    fate = admit(S.batch(spark, sf), S.store(spark, sf), ARTICLES, "batch_seq")
    return fate.select("id", "batch_seq", "accepted", "reject_reason")


@query
def append_briefs(spark, sf):
    """Briefs of bad texts come twice in the batch; the second one finds its id taken."""
    news = S.Stored(spark, sf)
    copies = F.sequence(F.lit(0), F.when(F.col("quality") == 0, 1).otherwise(0))
    incoming = news.labelled.withColumn("copy", F.explode(copies)).withColumn("seq", F.struct("id", "copy"))
    incoming = incoming.select(*BRIEFS.required, "copy", "seq")
    fate = admit(incoming, retention.retain_briefs(news.briefs, S.AS_OF), BRIEFS, "seq")
    return fate.select("id", "copy", "accepted", "reject_reason")


@query
def append_translations(spark, sf):
    """Both Odia versions come under one id, so the older one is written and the other refused."""
    order = F.concat_ws("/", F.col("translated_at").cast("string"), "own_id")
    news = S.Stored(spark, sf)
    incoming = news.versions.withColumns({"id": F.col("own_id"), "seq": order})
    stored = news.translations.filter(F.col("language") == "hi")
    fate = admit(incoming, stored, TRANSLATIONS, "seq")
    return fate.select("id", "translated_at", "accepted", "reject_reason")


def _first_id(rows: DataFrame) -> str:
    """The lowest id, so that a lookup has something to find at every scale."""
    return rows.agg(F.min("id")).first()[0]


@query
def article_by_id(spark, sf):
    rows = S.articles(spark, sf)
    return lookups.by_id(rows, _first_id(rows))


@query
def brief_by_id(spark, sf):
    rows = S.Stored(spark, sf).briefs
    return lookups.by_id(rows, _first_id(rows))


@query
def translation_by_id(spark, sf):
    rows = S.Stored(spark, sf).translations
    return lookups.by_id(rows, _first_id(rows))


@query
def retain_articles(spark, sf):
    return retention.retain_articles(S.stored_columns(spark, sf), S.AS_OF).select("id", "fetched_at")


@query
def retain_briefs(spark, sf):
    return retention.retain_briefs(S.briefs(spark, sf), S.AS_OF).select("id", "processed_at")


@query
def retain_translations(spark, sf):
    news = S.Stored(spark, sf)
    kept = retention.retain_briefs(news.briefs, S.AS_OF)
    return retention.retain_translations(news.translations, kept).select("id", "brief_id")


@query
def cleanup_all(spark, sf):
    return retention.cleanup_stats(S.stored_columns(spark, sf), S.briefs(spark, sf), S.AS_OF)


# --- projections and checks ------------------------------------------------------------


@query
def article_id(spark, sf):
    return S.stored_columns(spark, sf).select("source_url", "published_at", "id")


@query
def content_hash(spark, sf):
    return S.stored_columns(spark, sf).select("id", "content_hash")


@query
def constraint_rejects(spark, sf):
    """All six tables and the registry; days have six stories, and Hindi days come in a second edition."""
    news = S.Stored(spark, sf)
    news.publish()
    again = news.publications.filter("language = 'hi'").withColumn("id", F.concat("id", F.lit("_again")))
    return validation.constraint_rejects(
        {
            "articles": news.articles,
            "briefs": news.candidates,
            "translations": news.translations,
            "publications": news.publications.unionByName(again),
            "publication_stories": staged(publication.daily_stories(news.translations, news.briefs, 6)),
            "api_logs": S.candidate_logs(spark, sf),
            "sources": S.candidate_sources(spark, sf),
        }
    )


@query
def article_excerpts(spark, sf):
    return feed.article_excerpts(S.stored_columns(spark, sf)).select("id", *SUMMARY_WORDS)


@query
def source_language_route(spark, sf):
    return sources.source_language_route(S.stored_columns(spark, sf)).select("id", "source_name", "route")


def _scored(spark, sf):
    return selection.score_articles(S.stored_columns(spark, sf), S.AS_OF, keep=selection.NARROW)


def _stored_scored(spark, sf):
    rows = S.articles(spark, sf).filter(~F.col("is_duplicate"))
    return selection.score_articles(rows, S.AS_OF, keep=selection.NARROW)


@query
def quality_scores(spark, sf):
    return _scored(spark, sf).select(
        "id",
        "relevance_points",
        "source_points",
        "completeness_points",
        "freshness_points",
        "quality_score",
    )


@query
def high_quality_articles(spark, sf):
    return selection.high_quality(_scored(spark, sf)).select("id", "quality_score")


@query
def composite_scores(spark, sf):
    return _scored(spark, sf).select("id", F.round("composite_score", 9).alias("composite_score"))


# --- joins -----------------------------------------------------------------------------


@query
def known_duplicates(spark, sf):
    marked = dedup.known_duplicates(S.batch(spark, sf), S.store(spark, sf), "batch_seq")
    return marked.select("id", "content_hash", "is_known")


@query
def indexed_duplicates(spark, sf):
    """The batch against the index of stored hashes, which is made first and not shuffled."""
    root = shared_folder(spark)
    hashes, _ = history_indexes(root, root.rsplit("-", 1)[-1])
    hashes.opened(spark)
    hashes.add(S.store(spark, sf))
    batch = staged(S.batch(spark, sf).select("id", "batch_seq", "content_hash"))
    return dedup.mark_duplicates(batch, hashes.known(spark)).select("id", "batch_seq", "is_duplicate", "dup_reason")


@query
def unprocessed_articles(spark, sf):
    narrow = S.stored_columns(spark, sf).select("id", "published_at", "source_name")
    return lookups.unprocessed_articles(narrow, S.briefs(spark, sf))


@query
def untranslated_briefs(spark, sf):
    news = S.Stored(spark, sf)
    return lookups.untranslated_briefs(news.briefs, news.translations, "hi", limit=12).select("id", "title", "processed_at")


@query
def translations_for_briefs(spark, sf):
    """Asks for a brief of every stored article, most of which have none."""
    ids = S.store(spark, sf).select(F.concat(F.lit("brief_"), "id").alias("brief_id"))
    return lookups.translations_for_briefs(ids, S.Stored(spark, sf).translations).select(
        "brief_id", "id", "language", "title", "translated_at"
    )


@query
def orphan_rows(spark, sf):
    """After the articles were cleaned up alone, which takes the parents of many briefs away."""
    news = S.Stored(spark, sf)
    news.publish()
    return validation.orphan_rows(
        retention.retain_articles(news.articles, S.AS_OF),
        retention.retain_briefs(news.briefs, S.AS_OF),
        news.translations,
        news.publications,
        news.stories,
    )


@query
def brief_sources(spark, sf):
    news = S.Stored(spark, sf)
    return lookups.brief_sources(news.briefs, news.articles)


# --- counts and reports ----------------------------------------------------------------


@query
def article_counts(spark, sf):
    return reports.article_counts(S.articles(spark, sf))


@query
def articles_by_source(spark, sf):
    return reports.articles_by_source(S.articles(spark, sf))


@query
def brief_count(spark, sf):
    return reports.brief_count(S.briefs(spark, sf))


@query
def translations_by_language(spark, sf):
    return reports.translations_by_language(S.Stored(spark, sf).translations)


@query
def table_health(spark, sf):
    return reports.table_health(S.Stored(spark, sf).tables())


def _written_store(spark, sf, *names):
    """The store of the tables named, or of all; the others are made and stay empty."""
    root, made = shared_folder(spark), S.Stored(spark, sf)
    create_store(spark, root)
    rows = {name: getattr(made, name) for name in names} if names else made.tables()
    for name, table in rows.items():
        optional = [F.lit(None).alias(c) for c in TABLES[name].columns if c not in table.columns]
        write_table(table.select("*", *optional), root, TABLES[name])
    return root


@query
def stored_health(spark, sf):
    """Row counts of the written store, from file footers."""
    return footers.stored_health(spark, _written_store(spark, sf))


@query
def stored_article_counts(spark, sf):
    return footers.stored_article_counts(spark, _written_store(spark, sf, "articles"))


@query
def stored_translation_counts(spark, sf):
    return footers.stored_translation_counts(spark, _written_store(spark, sf, "translations"))


@query
def recent_stored_briefs(spark, sf):
    """The newest briefs, found by going back through the day folders."""
    rows = footers.newest_stored(spark, _written_store(spark, sf, "briefs"), BRIEFS, 50)
    return rows.select("id", "title", "summary_30", "processed_at")


@query
def recent_stored_translations(spark, sf):
    root = _written_store(spark, sf, "translations")
    rows = footers.newest_stored(spark, root, TRANSLATIONS, 50, language="or")
    return rows.select("id", "brief_id", "title", "translated_at")


@query
def stored_article_by_id(spark, sf):
    """One article, looked up in the written store, whose files are sorted by id and carry Bloom filters."""
    rows = read_table(spark, _written_store(spark, sf, "articles"), ARTICLES)
    return lookups.by_id(rows, _first_id(rows))


@query
def dedup_stats(spark, sf):
    return dedup.dedup_stats(dedup.mark_duplicates(S.batch(spark, sf), S.store(spark, sf)))


@query
def quality_filter_stats(spark, sf):
    return selection.quality_filter_stats(_stored_scored(spark, sf))


@query
def selection_stats(spark, sf):
    return selection.selection_stats(staged(selection.high_quality(_stored_scored(spark, sf))), 20)


def _parsed(labelled, fields, id_column="article_id"):
    return inference.parse_responses(S.responses(labelled, fields, id_column), fields)


@query
def batch_outcomes(spark, sf):
    labelled = S.Stored(spark, sf).labelled
    jobs = {
        "summarize": _parsed(labelled, SUMMARY_FIELDS),
        "translate": _parsed(labelled, TRANSLATION_FIELDS),
        "combined": _parsed(labelled, combined_fields()),
    }
    parts = [
        parsed.select(F.lit(job).alias("job"), F.col("reject_reason").isNull().alias("success"))
        for job, parsed in jobs.items()
    ]
    return reports.batch_outcomes(parts[0].union(parts[1]).union(parts[2]))


@query
def collected_per_source(spark, sf):
    return reports.collected_per_source(_collected(spark, sf))


@query
def source_coverage(spark, sf):
    return reports.source_coverage(SOURCES, S.stored_columns(spark, sf))


@query
def api_usage(spark, sf):
    usage = reports.api_usage(S.api_logs(spark, sf))
    return usage.withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query
def processing_progress(spark, sf):
    midway = S.AS_OF.replace(day=1)
    news = S.Stored(spark, sf)
    return reports.processing_progress(news.articles, news.briefs, midway)


# --- windows ---------------------------------------------------------------------------


@query
def mark_duplicates(spark, sf):
    marked = dedup.mark_duplicates(S.batch(spark, sf), S.store(spark, sf))
    return marked.select("id", "batch_seq", "is_duplicate", "dup_reason")


@query
def daily_publication(spark, sf):
    news = S.Stored(spark, sf)
    return publication.daily_stories(news.translations, news.briefs)


@query
def daily_publications(spark, sf):
    news = S.Stored(spark, sf)
    news.publish()
    return news.publications.select("id", "date", "language", "publish_status", "stories")


@query
def translation_per_language(spark, sf):
    return lookups.translation_per_language(S.translations(spark, sf)).select(
        "brief_id", "language", "id", "translated_at"
    )


# --- newest first and top n ------------------------------------------------------------


@query
def recent_articles(spark, sf):
    return lookups.recent_articles(S.articles(spark, sf)).select("id", "title", "content", "published_at")


@query
def recent_briefs(spark, sf):
    return lookups.recent_briefs(S.Stored(spark, sf).briefs).select("id", "title", "summary_30", "processed_at")


@query
def recent_translations(spark, sf):
    return lookups.recent_translations(S.Stored(spark, sf).translations, "or").select(
        "id", "brief_id", "title", "translated_at"
    )


@query
def brief_translations(spark, sf):
    rows = S.Stored(spark, sf).translations
    brief = rows.agg(F.min("brief_id")).first()[0]
    return lookups.brief_translations(rows, brief).select("id", "brief_id", "language", "translated_at")


@query
def top_stories(spark, sf):
    """Flagship: the best five stored articles with their texts."""
    articles = S.articles(spark, sf)
    best = staged(editorial.select_stories(articles, S.AS_OF))
    return selection.with_bodies(
        best, articles, ["published_at", "title", "content"], TOP_STORIES, within="published_at"
    ).select(
        "id",
        "title",
        "content",
        "source_name",
        "published_at",
        "quality_score",
        F.round("composite_score", 9).alias("composite_score"),
    )


@query
def diverse_top_stories(spark, sf):
    return selection.diverse_top_stories(_stored_scored(spark, sf), 20, max_per_source=2).select(
        "id", "source_name", F.round("composite_score", 9).alias("composite_score")
    )


# --- batch inference -------------------------------------------------------------------


def _digest(prompts: DataFrame) -> DataFrame:
    return prompts.withColumns(
        {"prompt_chars": F.length("prompt"), "prompt_hash": F.sha2("prompt", 256)}
    ).drop("prompt")


@query
def summary_prompts(spark, sf):
    return _digest(inference.summary_prompts(S.stored_columns(spark, sf)))


@query
def translation_prompts(spark, sf):
    return _digest(inference.translation_prompts(S.briefs(spark, sf), "hi"))


@query
def combined_prompts(spark, sf):
    return _digest(inference.combined_prompts(S.stored_columns(spark, sf), "or"))


@query
def complete_batch(spark, sf):
    prompts = inference.summary_prompts(S.stored_columns(spark, sf))
    answers = inference.complete_batch(prompts, stub.terse, attempts=2, wait_seconds=(0, 0))
    return answers.select(
        "id", "success", "error_message", "attempts", F.col("response").isNotNull().alias("answered")
    )


def _log_lines(logs: DataFrame) -> DataFrame:
    """Lines of the usage log; the time of a call, at the end of its id, differs from run to run."""
    about = F.regexp_replace("id", "_[0-9]+$", "")
    return logs.select(about.alias("about"), "timestamp", "model_used", "operation", "success", "error_message")


@query
def run_logs(spark, sf):
    """The usage log of a run in which some prompts fail, by outcome."""
    prompts = inference.summary_prompts(S.stored_columns(spark, sf))
    answers = inference.complete_batch(prompts, stub.terse, purpose="summarize", **_QUICK)
    return _log_lines(inference.as_api_logs(answers, "summarize", S.MODEL, S.AS_OF))


@query
def repeated_run_logs(spark, sf):
    """The usage log after three runs with one folder of answers: Hindi, Hindi again, Odia.

    What failed is asked again in the second run, what was answered is not; short briefs fail.
    """
    root, made = shared_folder(spark), S.Stored(spark, sf)
    kept = {"answers_path": f"{root}/answers", "logs_root": f"{root}/store", **_QUICK}
    untranslated = spark.createDataFrame([], TRANSLATIONS.schema)
    for language in ("hi", "hi", "or"):
        editorial.fill_missing_translations(
            made.briefs, untranslated, stub.translate_longer, S.AS_OF, S.MODEL, language, **kept
        )
    return _log_lines(read_table(spark, f"{root}/store", API_LOGS))


@query
def parsed_summaries(spark, sf):
    return _parsed(S.labelled_briefs(spark, sf), SUMMARY_FIELDS)


@query
def parsed_translations(spark, sf):
    return _parsed(S.labelled_briefs(spark, sf), TRANSLATION_FIELDS, "id")


@query
def parsed_combined(spark, sf):
    return _parsed(S.labelled_briefs(spark, sf), combined_fields())


@query
def briefs_from_summaries(spark, sf):
    parsed = _parsed(S.labelled_briefs(spark, sf), SUMMARY_FIELDS)
    return inference.briefs_from_summaries(parsed, S.MODEL, S.AS_OF)


@query
def translations_from_briefs(spark, sf):
    parsed = _parsed(S.labelled_briefs(spark, sf), TRANSLATION_FIELDS, "id")
    return inference.translations_from_briefs(parsed, "hi", S.MODEL, S.AS_OF)


def _pair(outputs: DataFrame) -> DataFrame:
    """Brief and translation side by side as plain columns."""
    texts = ["title", *SUMMARY_WORDS]
    return outputs.select(
        "brief.id",
        "brief.article_id",
        *[f"brief.{t}" for t in texts],
        "brief.quality_score",
        F.col("translation.id").alias("translation_id"),
        "translation.language",
        *[F.col(f"translation.{t}").alias(f"translated_{t}") for t in texts],
    )


@query
def combined_outputs(spark, sf):
    parsed = _parsed(S.labelled_briefs(spark, sf), combined_fields())
    return _pair(inference.combined_outputs(parsed, "or", S.MODEL, S.AS_OF))


@query
def combined_scored_briefs(spark, sf):
    """Briefs of combined answers with the quality of their articles as their score."""
    parsed = _parsed(S.labelled_briefs(spark, sf), combined_fields())
    scores = selection.score_articles(S.articles(spark, sf), S.AS_OF, keep=selection.NARROW)
    out = inference.combined_outputs(parsed, "or", S.MODEL, S.AS_OF, scores=scores)
    return inference.combined_briefs(out).select("id", "article_id", "quality_score")


@query
def summary_length_check(spark, sf):
    return publication.summary_length_check(S.briefs(spark, sf))


@query
def glossary_retention(spark, sf):
    news = S.Stored(spark, sf)
    return publication.glossary_retention(news.briefs, news.translations)


# --- whole jobs ------------------------------------------------------------------------


@query
def article_feed(spark, sf):
    news = S.Stored(spark, sf)
    page = feed.article_feed(news.articles, news.briefs, news.translations, limit=20)
    return feed.flat_feed(page)


@query
def raw_article_feed(spark, sf):
    """No brief is left in the table, so the feed falls back to the articles."""
    news = S.Stored(spark, sf)
    none_left = spark.createDataFrame([], news.briefs.schema)
    page = feed.article_feed(news.articles, none_left, news.translations, limit=100)
    return feed.flat_feed(page)


@query
def feed_metadata(spark, sf):
    news = S.Stored(spark, sf)
    page = feed.article_feed(news.articles, news.briefs, news.translations, limit=100)
    return feed.feed_metadata(page, S.AS_OF)


@query
def article_detail(spark, sf):
    news = S.Stored(spark, sf)
    return feed.flat_feed(
        feed.article_detail(news.briefs, news.translations, _first_id(news.briefs))
    )


def _ingested(spark, sf):
    registry = sources.source_registry(spark)
    collected = collect_articles(S.feed_payloads(spark, sf), registry, S.AS_OF)
    staging = f"{shared_folder(spark)}/collected"
    return ingest(collected.withColumn("batch_seq", S.payload_order()), S.store(spark, sf), staging)


@query
def ingest_batch(spark, sf):
    return _ingested(spark, sf).select(
        "id", "source_name", "content_hash", "is_duplicate", "accepted", "reject_reason"
    )


@query
def ingest_rejects(spark, sf):
    """What becomes of every entry and every faulty payload when some entries lack link or title and some payloads are cut off."""
    root, registry = shared_folder(spark), sources.source_registry(spark)
    delivered = deliver(S.feed_payloads(spark, sf, faulty=True), registry, S.AS_OF, f"{root}/delivered")
    articles = articles_of(delivered).withColumn("batch_seq", S.payload_order())
    fate = ingest(articles, S.store(spark, sf), None)
    return outcomes(delivered, fate, S.payload_order(), ["source_name", "payload_id", "position"])


@query
def editorial_run(spark, sf):
    """Two runs with one folder of answers; the second selects what the first has left."""
    articles, kept = S.articles(spark, sf), {"answers_path": f"{shared_folder(spark)}/answers", **_QUICK}
    done = S.briefs(spark, sf).select("article_id")
    first = editorial.combined_run(articles, done, stub.combined, S.AS_OF, S.MODEL, **kept)
    done = done.union(first.select("brief.article_id"))
    return _pair(editorial.combined_run(articles, done, stub.combined, S.AS_OF, S.MODEL, **kept))


@query
def summarise_then_translate(spark, sf):
    _, translated = editorial.summarise_then_translate(
        S.articles(spark, sf), stub.summarize_or_translate, S.AS_OF, S.MODEL, count=50, **_QUICK
    )
    return translated


@query
def fill_missing_translations(spark, sf):
    news = S.Stored(spark, sf)
    return editorial.fill_missing_translations(
        news.briefs, news.translations, stub.translate, S.AS_OF, S.MODEL, "hi", **_QUICK
    )


@query
def incremental_ingest(spark, sf):
    """All payloads arrive as files and go through the stream; returns what the store then holds."""
    root = shared_folder(spark)
    S.feed_payloads(spark, sf).select("source_name", F.col("payload").alias("value")).write.option(
        "maxRecordsPerFile", 1
    ).partitionBy("source_name").text(f"{root}/payloads")
    create_stream_store(spark, f"{root}/store", S.store(spark, sf))
    stream = ingest_stream(
        payload_files(spark, f"{root}/payloads"),
        f"{root}/store",
        f"{root}/progress",
        S.AS_OF,
        sources.source_registry(spark),
    )
    stream.awaitTermination()
    # Which of several equal texts is stored depends on the order the files arrive in.
    return stored_articles(spark, f"{root}/store").select("content_hash", "is_duplicate")
