"""Feed payloads to stored articles."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.dedup import mark_duplicates
from newsloom.operators.keyed_append import constraint_reason, decide
from newsloom.operators.validation import check
from newsloom.schemas import ARTICLES
from newsloom.sources.feeds import feed_entries, feed_rows, normalize_entries, normalized_articles
from newsloom.sources.store import append_accepted, staged


def collect_articles(payloads: DataFrame, registry: DataFrame, as_of: datetime) -> DataFrame:
    """Articles of all payloads whose source is enabled. Unknown sources are collected too.

    The registry is a configuration list of a few rows; the disabled ones are what is joined.
    """
    return normalized_articles(feed_entries(_enabled(payloads, registry)), as_of)


def _enabled(payloads: DataFrame, registry: DataFrame | None) -> DataFrame:
    if registry is None:
        return payloads
    disabled = registry.filter("not enabled").select(registry["name"].alias("source_name"))
    return payloads.join(disabled, "source_name", "left_anti")


def deliver(payloads: DataFrame, registry: DataFrame | None, as_of: datetime, staging: str) -> DataFrame:
    """Everything that payloads of enabled sources hold, parsed once and written to ``staging``, a shared folder.

    ``outcome`` says what a row is, and is the folder it lies in: an article that was ``collected``, an entry that cannot
    become one (``entry_rejected``), or a payload with a fault (``payload_error``, beside the entries found in it).
    ``reject_reason`` says why. The columns of the payload are kept.
    """
    rows = normalize_entries(feed_rows(_enabled(payloads, registry)), as_of)
    outcome = (
        F.when(F.col("parse_error").isNotNull(), "payload_error")
        .when(F.col("reject_reason").isNotNull(), "entry_rejected")
        .otherwise("collected")
    )
    reason = F.coalesce("parse_error", "reject_reason")
    told = rows.withColumns({"outcome": outcome, "reject_reason": reason}).drop("parse_error")
    told.write.mode("overwrite").partitionBy("outcome").parquet(staging)
    return told.sparkSession.read.schema(told.schema).parquet(staging)


def articles_of(delivered: DataFrame) -> DataFrame:
    """The collected articles of a written delivery, for ``ingest``."""
    return delivered.filter("outcome = 'collected'").drop("outcome", "reject_reason")


def outcomes(delivered: DataFrame, fate: DataFrame, seq: Column, about: list[str]) -> DataFrame:
    """What became of every entry and every faulty payload: ``about``, ``outcome`` and ``reject_reason``.

    A collected article is ``accepted``, a ``duplicate`` or ``refused``, as its ``fate`` from ``ingest`` says, where ``seq``
    is the order in which it was given. No text is read.
    """
    others = delivered.filter("outcome <> 'collected'").select(*about, "outcome", "reject_reason")
    fell = F.when(F.col("accepted"), "accepted").when(F.col("is_duplicate"), "duplicate").otherwise("refused")
    decided = fate.select(F.col("batch_seq").alias("_seq"), fell.alias("outcome"), "reject_reason")
    asked = articles_of(delivered).select(*about, seq.alias("_seq"))
    return asked.join(decided, "_seq").drop("_seq").unionByName(others)


def outcome_counts(rows: DataFrame) -> DataFrame:
    """Rows of each source by outcome and reason."""
    return rows.groupBy("source_name", "outcome", "reject_reason").agg(F.count("*").alias("n"))


def ingest(
    articles: DataFrame,
    store: DataFrame | None,
    staging: str | None,
    seq: str = "batch_seq",
    hashes: DataFrame | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Collected articles with the fate of each: a duplicate, refused by the store, or accepted.

    The parsed articles are written to ``staging``, a shared folder, and read from there:
    feeds are parsed once, and the steps that decide read ids and hashes without the texts.
    Only the last join moves whole articles. With ``staging`` None, the articles are read from a written table already,
    as those of ``deliver`` are.

    With ``hashes`` and ``ids``, the keys in the store's indexes, the store itself is not looked at, and the history is not shuffled.
    """
    collected = articles if staging is None else staged(articles, staging)
    hashes, ids = store if hashes is None else hashes, store if ids is None else ids
    narrow = check(collected, ARTICLES).select(seq, "id", "content_hash", "broken_rules")
    marked = mark_duplicates(narrow, hashes, seq)
    fresh = decide(marked.filter(~F.col("is_duplicate")), ids, ARTICLES, seq)
    fate = marked.join(fresh.withColumn("_fresh", F.lit(True)), seq, "left").select(
        seq,
        "is_duplicate",
        F.when(F.col("is_duplicate"), F.concat(F.lit("duplicate:"), "dup_reason"))
        .when(F.size("broken_rules") > 0, constraint_reason())
        .when(F.col("_fresh").isNull(), F.lit("id_exists"))
        .alias("reject_reason"),
    )
    bodies = collected.drop("is_duplicate")
    return bodies.join(fate, seq).withColumn("accepted", F.col("reject_reason").isNull())


def save_ingested(fate: DataFrame, root: str, as_of: datetime) -> DataFrame:
    """Append the accepted articles to the store; returns the counts of the run."""
    decided = staged(fate)
    append_accepted(decided, root, ARTICLES, as_of)
    return ingest_stats(decided)


def ingest_stats(fate: DataFrame) -> DataFrame:
    return fate.agg(
        F.count("*").alias("collected"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count_if("accepted").alias("inserted"),
        F.count_if(~F.col("accepted") & ~F.col("is_duplicate")).alias("refused"),
    )
