"""Prompts out, responses in: the set-level steps around a caller-supplied function."""

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from sys import getsizeof

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import prompts as P
from newsloom.functions.batches import small_batches
from newsloom.functions.once import settle
from newsloom.functions.responses import (
    SUMMARY_FIELDS,
    TRANSLATION_FIELDS,
    combined_fields,
    outermost_braces,
    unfenced,
)
from newsloom.functions.text import ntz
from newsloom.operators.keys import without
from newsloom.operators.validation import broken_rules
from newsloom.reference_data import DEFAULT_CATEGORY, LANGUAGES, PLACEHOLDER_QUALITY, TITLE_CHARS
from newsloom.schemas import BRIEFS, TRANSLATIONS
from newsloom.sources.registry import source_language_route
from newsloom.sources.store import staged

# --- prompts ---------------------------------------------------------------------


def _by_route(transform: Column, summarize: Column) -> Column:
    return F.when(F.col("route") == "transform", transform).otherwise(summarize)


def summary_prompts(articles: DataFrame) -> DataFrame:
    prompt = _by_route(P.fill(P.TRANSFORM), P.fill(P.SUMMARIZE))
    return source_language_route(articles).select("id", "route", prompt.alias("prompt"))


def _language_name(language: str) -> str:
    if language not in LANGUAGES:
        raise ValueError(f"unknown language {language!r}")
    return f"{LANGUAGES[language]} ({language})"


def translation_prompts(briefs: DataFrame, language: str = "or") -> DataFrame:
    prompt = P.fill(P.TRANSLATE, language=F.lit(_language_name(language)))
    return briefs.select("id", prompt.alias("prompt"))


def combined_prompts(articles: DataFrame, language: str = "or") -> DataFrame:
    name = F.lit(_language_name(language))
    prompt = _by_route(
        P.fill(P.COMBINED_TRANSFORM, language=name), P.fill(P.COMBINED_SUMMARIZE, language=name)
    )
    return source_language_route(articles).select("id", "route", prompt.alias("prompt"))


# --- calls -----------------------------------------------------------------------

RESPONSE_SCHEMA = (
    "id string, response string, success boolean, error_message string, attempts int, latency_ms int"
)


# ``prompt_key`` stands for id, whole prompt and purpose; ``asked`` is when the call began, in nanoseconds.
ANSWER_SCHEMA = f"{RESPONSE_SCHEMA}, prompt_key string, asked long"
_ANSWER = [field.split()[0] for field in ANSWER_SCHEMA.split(", ")]
# Calls begun beyond the oldest that is still waited for, per call under way, so that a slow one keeps no other waiting.
CALLS_AHEAD = 64
# Answers leave a worker some megabytes at a time, as prompts enter it, however much longer than those they are.
FRAME_BYTES, FRAME_ROWS = 4 << 20, 10_000


def _prompt_key(purpose: str) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(purpose), F.col("id"), F.col("prompt")), 256)


def complete_batch(
    prompts: DataFrame,
    fn: Callable[[str], str],
    parallel_calls: int | None = None,
    attempts: int = 3,
    wait_seconds: tuple[float, float] = (2.0, 10.0),
    calls_per_task: int = 1,
    purpose: str = "",
) -> DataFrame:
    """Call ``fn`` once per prompt; a prompt that keeps failing costs its own row only.

    Each row is one call, with the key of its prompt under ``purpose`` and the time it was made.

    ``parallel_calls`` sets the number of tasks; without it the prompts stay in the tasks they are in.
    Each task has ``calls_per_task`` calls under way at a time. ``wait_seconds`` are the first and the
    longest pause between attempts, which double in between. A lost executor repeats the
    calls of its task, so tasks should be small; ``complete_once`` keeps finished ones. A worker holds a few
    megabytes of prompts and of answers at a time, whatever the size of its task.
    """
    first_wait, longest_wait = wait_seconds

    def answer(row_id: str, prompt: str, prompt_key: str) -> tuple:
        asked = time.time_ns()
        for attempt in range(1, attempts + 1):
            started = time.monotonic()
            try:
                text, error = fn(prompt), None
            except Exception as problem:
                text, error = None, f"{type(problem).__name__}: {problem}"
            latency = int((time.monotonic() - started) * 1000)
            if error is None or attempt == attempts:
                break
            time.sleep(min(longest_wait, first_wait * 2 ** (attempt - 1)))
        return row_id, text, error is None, error, attempt, latency, prompt_key, asked

    def answered(batches: Iterator[pd.DataFrame], callers: ThreadPoolExecutor) -> Iterator[tuple]:
        begun = deque()
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                begun.append(callers.submit(answer, *row))
                if len(begun) > most_begun:
                    yield begun.popleft().result()
        while begun:
            yield begun.popleft().result()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        callers = ThreadPoolExecutor(calls_per_task)
        try:
            rows, size = [], 0
            for row in answered(batches, callers):
                rows.append(row)
                size += getsizeof(row[1]) + getsizeof(row[3])
                if size >= FRAME_BYTES or len(rows) == FRAME_ROWS:
                    yield pd.DataFrame(rows, columns=names_in_order)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names_in_order)
        finally:
            callers.shutdown(cancel_futures=True)

    names_in_order, most_begun = _ANSWER, calls_per_task * CALLS_AHEAD
    small_batches(prompts)
    narrow = prompts.select("id", "prompt", _prompt_key(purpose).alias("prompt_key"))
    if parallel_calls is not None:
        narrow = narrow.repartition(parallel_calls)
    return narrow.mapInPandas(run, ANSWER_SCHEMA)


def complete_once(
    prompts: DataFrame, fn: Callable[[str], str], answers_path: str, purpose: str = "", **options
) -> DataFrame:
    """Like ``complete_batch`` but keeps the answers in ``answers_path``, a shared folder.

    An answer belongs to an id, its whole prompt and ``purpose`` (the model, say). What has a successful
    answer there is not asked again, so a repeated run pays only for what is missing; other runs
    may use the same folder. Returned is one row per prompt of this run, failures included: the newest success, or
    else the newest failure.
    """
    return ask_once(prompts, fn, answers_path, purpose, **options)[0]


def ask_once(
    prompts: DataFrame, fn: Callable[[str], str], answers_path: str, purpose: str = "", **options
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``complete_once``, and those of the calls that were made for them in this run."""
    spark = prompts.sparkSession
    asked = staged(prompts.select("id", "prompt", _prompt_key(purpose).alias("prompt_key")))
    # Appending nothing makes the folder exist for the first read.
    spark.createDataFrame([], ANSWER_SCHEMA).write.mode("append").parquet(answers_path)
    stored = spark.read.schema(ANSWER_SCHEMA).parquet(answers_path)
    open_prompts = without(asked, ["prompt_key"], stored.filter("success").select("prompt_key"))
    calls = staged(complete_batch(open_prompts.dropDuplicates(["prompt_key"]), fn, purpose=purpose, **options))
    calls.write.mode("append").parquet(answers_path)
    answered = spark.read.schema(ANSWER_SCHEMA).parquet(answers_path)
    keys = asked.select("prompt_key").distinct()
    latest = (
        answered.join(keys, "prompt_key")
        .groupBy("prompt_key")
        .agg(F.max_by(F.struct(*_ANSWER), F.struct("success", "asked")).alias("_a"))
    )
    return latest.select("_a.*"), calls


def run_counts(answers: DataFrame) -> DataFrame:
    """How many prompts of a run were asked, answered and failed."""
    return answers.agg(
        F.count("*").alias("requested"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def as_api_logs(calls: DataFrame, operation: str, model: str, at: datetime) -> DataFrame:
    """Calls in the layout of the usage log, one row each; token counts and cost are unknown here.

    The id holds what was asked about, the beginning of the prompt's key (which differs by language and model) and
    the time of the call, so that a prompt asked again gets a row of its own.
    """
    parts = [F.lit(operation), F.col("id"), F.left("prompt_key", F.lit(16)), F.col("asked").cast("string")]
    return calls.select(
        F.concat_ws("_", *parts).alias("id"),
        ntz(at).alias("timestamp"),
        F.lit(model).alias("model_used"),
        F.lit(operation).alias("operation"),
        "success",
        F.lit(None).cast("int").alias("input_tokens"),
        F.lit(None).cast("int").alias("output_tokens"),
        F.lit(None).cast("decimal(18,6)").alias("cost_usd"),
        "latency_ms",
        "error_message",
    )


# --- responses ---------------------------------------------------------------------


def parse_responses(responses: DataFrame, fields: list[str]) -> DataFrame:
    """Add the string ``fields`` of the JSON object in ``response``, or ``reject_reason``.

    The text is cleaned once, the object parsed once, and the outcome settled before
    anything filters on it.
    """
    rest = [c for c in responses.columns if c != "response"]
    text = F.col("_text")
    cleaned = settle(responses, rest, _text=unfenced(F.col("response")))
    flaw = (
        F.when(text.isNull(), "no_response")
        .when(~text.contains("{"), "no_opening_brace")
        .when(~text.contains("}"), "no_closing_brace")
    )
    located = settle(cleaned, rest, _flaw=flaw, _body=outermost_braces(text))
    # The parser stops after the first value, so "{..} and {..}" would pass. As the first of
    # two items it cannot: what follows the object has to be the second item and then the end.
    size = F.length("_body")
    framed = F.concat(F.lit("["), "_body", F.lit(","), size.cast("string"), F.lit("]"))
    parsed = settle(located, [*rest, "_flaw"], _size=size, _json=F.try_parse_json(framed))
    whole = (F.try_variant_get("_json", "$[1]", "int") == F.col("_size")) & F.try_variant_get(
        "_json", "$[2]", "variant"
    ).isNull()
    found = {f: F.try_variant_get("_json", f"$[0].{f}", "variant") for f in fields}
    is_string = {f: F.schema_of_variant(v) == "STRING" for f, v in found.items()}
    flaw = F.coalesce(F.col("_flaw"), F.when(~F.coalesce(whole, F.lit(False)), "invalid_json"))
    reason = F.when(flaw.isNotNull(), flaw)
    for f in fields:
        reason = reason.when(found[f].isNull(), f"missing:{f}")
    for f in fields:
        reason = reason.when(~is_string[f], f"not_string:{f}")
    values = {f: F.when(whole & is_string[f], F.try_variant_get("_json", f"$[0].{f}", "string")) for f in fields}
    return settle(parsed, rest, **values, reject_reason=reason)


def parsed_summaries(responses: DataFrame) -> DataFrame:
    return parse_responses(responses, SUMMARY_FIELDS)


def parsed_translations(responses: DataFrame) -> DataFrame:
    return parse_responses(responses, TRANSLATION_FIELDS)


def parsed_combined(responses: DataFrame, target: str = "target") -> DataFrame:
    return parse_responses(responses, combined_fields(target))


# --- rows for the stores -------------------------------------------------------------


def _with_quality(parsed: DataFrame, scores: DataFrame | None) -> tuple[DataFrame, Column]:
    """Parsed answers, and the column that holds each one's score: its article's, or else the placeholder."""
    if scores is None:
        return parsed, F.lit(PLACEHOLDER_QUALITY)
    met = parsed.join(scores.select("id", F.col("quality_score").alias("_quality")), "id", "left")
    return met, F.coalesce("_quality", F.lit(PLACEHOLDER_QUALITY))


def briefs_from_summaries(
    parsed: DataFrame, model: str, as_of: datetime, scores: DataFrame | None = None
) -> DataFrame:
    """Parsed summaries (``id`` is the article's) to briefs; over-long summaries are rejected.

    The score is the fixed placeholder unless ``scores`` (id, quality_score) is given.
    """
    good, quality = _with_quality(parsed.filter(F.col("reject_reason").isNull()), scores)
    briefs = good.select(
        F.concat(F.lit("brief_"), "id").alias("id"),
        F.col("id").alias("article_id"),
        F.substring("summary_30", 1, TITLE_CHARS).alias("title"),
        *SUMMARY_FIELDS,
        F.lit(DEFAULT_CATEGORY).alias("category"),
        quality.alias("quality_score"),
        F.lit(model).alias("model_used"),
        ntz(as_of).alias("processed_at"),
    )
    return briefs.filter(F.size(broken_rules(BRIEFS)) == 0)


def _translation_id(brief_id: Column, language: str) -> Column:
    return F.concat(F.lit("trans_"), brief_id, F.lit(f"_{language}"))


def translations_from_briefs(
    parsed: DataFrame, language: str, model: str, as_of: datetime
) -> DataFrame:
    """Parsed translations (``id`` is the brief's) to translation rows."""
    rows = parsed.filter(F.col("reject_reason").isNull()).select(
        _translation_id(F.col("id"), language).alias("id"),
        F.col("id").alias("brief_id"),
        F.lit(language).alias("language"),
        *TRANSLATION_FIELDS,
        F.lit(model).alias("model_used"),
        ntz(as_of).alias("translated_at"),
    )
    return rows.filter(F.size(broken_rules(TRANSLATIONS)) == 0)


def combined_outputs(
    parsed: DataFrame,
    language: str,
    model: str,
    as_of: datetime,
    target: str = "target",
    scores: DataFrame | None = None,
) -> DataFrame:
    """One row per accepted response with a ``brief`` and a ``translation`` struct: both or neither.

    The score is the fixed placeholder unless ``scores`` (id, quality_score; one row per article) is given.
    """
    at = ntz(as_of)
    accepted, quality = _with_quality(parsed.filter(F.col("reject_reason").isNull()), scores)
    brief_id = F.concat(F.lit("brief_"), F.col("id"))
    brief = F.struct(
        brief_id.alias("id"),
        F.col("id").alias("article_id"),
        F.col("english_title").alias("title"),
        *[F.col(f"english_{n}").alias(f"summary_{n}") for n in ("30", "111", "250")],
        F.lit(DEFAULT_CATEGORY).alias("category"),
        quality.alias("quality_score"),
        F.lit(model).alias("model_used"),
        at.alias("processed_at"),
    )
    translation = F.struct(
        _translation_id(brief_id, language).alias("id"),
        brief_id.alias("brief_id"),
        F.lit(language).alias("language"),
        F.col(f"{target}_title").alias("title"),
        *[F.col(f"{target}_{n}").alias(f"summary_{n}") for n in ("30", "111", "250")],
        F.lit(model).alias("model_used"),
        at.alias("translated_at"),
    )
    pairs = accepted.select(brief.alias("brief"), translation.alias("translation"))
    briefs_ok = F.size(broken_rules(BRIEFS)) == 0
    return (
        pairs.select("brief.*", "translation")
        .filter(briefs_ok)
        .select(F.struct(*BRIEFS.required).alias("brief"), "translation")
    )


def combined_briefs(outputs: DataFrame) -> DataFrame:
    return outputs.select("brief.*")


def combined_translations(outputs: DataFrame) -> DataFrame:
    return outputs.select("translation.*")
