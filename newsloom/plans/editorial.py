"""From stored articles to briefs and translations."""

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.inference import (
    as_api_logs,
    ask_once,
    briefs_from_summaries,
    combined_outputs,
    combined_prompts,
    complete_batch,
    parsed_combined,
    parsed_summaries,
    parsed_translations,
    summary_prompts,
    translation_prompts,
    translations_from_briefs,
)
from newsloom.operators.keyed_append import admit, append_stats
from newsloom.operators.lookups import recent_articles, unprocessed_articles, untranslated_briefs
from newsloom.operators.selection import (
    NARROW,
    high_quality,
    score_articles,
    top_stories,
    with_bodies,
)
from newsloom.reference_data import MIN_QUALITY, TOP_STORIES
from newsloom.schemas import API_LOGS, BRIEFS, TRANSLATIONS
from newsloom.sources.store import append_accepted, read_table, staged, write_table

_BODY = ["title", "content"]


def select_stories(
    articles: DataFrame,
    as_of: datetime,
    briefs: DataFrame | None = None,
    min_score: float = MIN_QUALITY,
    count: int = TOP_STORIES,
    newest: int | None = None,
) -> DataFrame:
    """The best ``count`` articles that are no duplicates and, with ``briefs``, have none yet.

    All articles are considered unless ``newest`` limits them to the most recent ones.

    The text is scored where it is read; filtering, joining and ranking then move only ids,
    times and scores.
    """
    unique = articles.filter(~F.col("is_duplicate"))
    if newest is not None:
        unique = recent_articles(articles, newest)
    scored = score_articles(unique, as_of, keep=NARROW)
    good = high_quality(scored, min_score)
    if briefs is not None:
        good = unprocessed_articles(good, briefs)
    return top_stories(good, count)


def _ask(
    prompts: DataFrame,
    fn: Callable[[str], str],
    operation: str,
    model: str,
    as_of: datetime,
    answers_path: str | None,
    logs_root: str | None,
    at_most: int | None,
    **options,
) -> DataFrame:
    """One row per prompt, failures included; with ``logs_root``, each call made is written to that store's usage log.

    A selection of at most ``at_most`` rows would stay strewn over the tasks of its scan, so it is dealt to
    a task per core at most, unless ``parallel_calls`` says otherwise.
    """
    if at_most is not None:
        cores = prompts.sparkSession.sparkContext.defaultParallelism
        options.setdefault("parallel_calls", max(1, min(at_most, cores)))
    purpose = f"{operation}/{model}"
    if answers_path is None:
        answers = calls = staged(complete_batch(prompts, fn, purpose=purpose, **options))
    else:
        latest, calls = ask_once(prompts, fn, answers_path, purpose, **options)
        answers = staged(latest)
    if logs_root is not None:
        append_logs(as_api_logs(calls, operation, model, as_of), logs_root, as_of)
    return answers


def append_logs(logs: DataFrame, root: str, as_of: datetime) -> None:
    """Append rows to the usage log; those whose id is there already, or which break a rule, are refused.

    A row's id is held against the rows from the day of ``as_of`` on, which is the time that new rows carry.
    """
    spark = logs.sparkSession
    # Appending nothing makes the folder exist for the first read.
    write_table(spark.createDataFrame([], API_LOGS.schema), root, API_LOGS)
    ordered = staged(logs.withColumn("_seq", F.monotonically_increasing_id()))
    fate = staged(admit(ordered, read_table(spark, root, API_LOGS, since=as_of), API_LOGS, "_seq"))
    append_accepted(fate, root, API_LOGS, as_of)


def _picked(selected: DataFrame) -> DataFrame:
    """Selected stories, written out, so that the articles are scored once for texts and scores."""
    return staged(selected.select("id", "published_at", "quality_score"))


def _with_texts(picked: DataFrame, articles: DataFrame, count: int) -> DataFrame:
    """Picked stories with their texts."""
    return with_bodies(picked.select("id", "published_at"), articles, ["source_name", *_BODY], count, within="published_at")


def combined_run(
    articles: DataFrame,
    briefs: DataFrame,
    fn: Callable[[str], str],
    as_of: datetime,
    model: str,
    language: str = "or",
    min_score: float = MIN_QUALITY,
    count: int = 20,
    answers_path: str | None = None,
    newest: int | None = None,
    logs_root: str | None = None,
    computed_score: bool = False,
    **options,
) -> DataFrame:
    """Select, ask once per article, and split each answer into a brief and a translation.

    The answers are written out before anything reads them. With ``answers_path`` they are
    kept there, and a later run with the same path asks only for what is missing. ``newest`` starts from
    the most recent articles only. With ``logs_root``, every call made goes to that store's usage log, as a
    summary, which is what such a call replaces. With ``computed_score``, a brief gets its article's quality instead of
    the placeholder.
    """
    picked = _picked(select_stories(articles, as_of, briefs, min_score, count, newest))
    stories = _with_texts(picked, articles, count)
    where = (answers_path, logs_root, count)
    answers = _ask(combined_prompts(stories, language), fn, "summarize", model, as_of, *where, **options)
    scores = picked if computed_score else None
    return combined_outputs(parsed_combined(answers.filter("success")), language, model, as_of, scores=scores)


def summarise_then_translate(
    articles: DataFrame,
    fn: Callable[[str], str],
    as_of: datetime,
    model: str,
    language: str = "or",
    min_score: float = MIN_QUALITY,
    count: int = TOP_STORIES,
    answers_path: str | None = None,
    newest: int | None = None,
    logs_root: str | None = None,
    computed_score: bool = False,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """The two-call way: briefs first, then a translation of each brief."""
    paths = (None, None) if answers_path is None else (f"{answers_path}/s", f"{answers_path}/t")
    picked = _picked(select_stories(articles, as_of, min_score=min_score, count=count, newest=newest))
    stories = _with_texts(picked, articles, count)
    where = (paths[0], logs_root, count)
    answers = _ask(summary_prompts(stories), fn, "summarize", model, as_of, *where, **options)
    scores = picked if computed_score else None
    briefs = briefs_from_summaries(parsed_summaries(answers.filter("success")), model, as_of, scores)
    where = (paths[1], logs_root, count)
    answers = _ask(translation_prompts(briefs, language), fn, "translate", model, as_of, *where, **options)
    translations = translations_from_briefs(
        parsed_translations(answers.filter("success")), language, model, as_of
    )
    return briefs, translations


def fill_missing_translations(
    briefs: DataFrame,
    translations: DataFrame,
    fn: Callable[[str], str],
    as_of: datetime,
    model: str,
    language: str = "or",
    limit: int | None = None,
    answers_path: str | None = None,
    logs_root: str | None = None,
    **options,
) -> DataFrame:
    """Translations for the briefs that lack one; all of them unless ``limit`` is given."""
    open_briefs = untranslated_briefs(briefs, translations, language, limit)
    where = (answers_path, logs_root, limit)
    answers = _ask(translation_prompts(open_briefs, language), fn, "translate", model, as_of, *where, **options)
    return translations_from_briefs(
        parsed_translations(answers.filter("success")), language, model, as_of
    )


def save_outputs(
    root: str, as_of: datetime, briefs: DataFrame | None = None, translations: DataFrame | None = None
) -> DataFrame:
    """Append new briefs and translations to the store; returns what was asked and what was written.

    Rows whose id is stored are refused, so a repeated run adds nothing; of several new rows with one id
    one is written.
    """
    stats = []
    for table, rows in ((BRIEFS, briefs), (TRANSLATIONS, translations)):
        if rows is not None:
            spark = rows.sparkSession
            # Decided in full before the append starts to change what it was decided on.
            # The order is written with the rows, so that both uses of it see the same.
            ordered = staged(rows.withColumn("_seq", F.monotonically_increasing_id()))
            fate = staged(admit(ordered, read_table(spark, root, table), table, "_seq"))
            append_accepted(fate, root, table, as_of)
            stats.append(append_stats(fate).withColumn("table_name", F.lit(table.name)))
    return reduce(DataFrame.unionByName, stats)
