"""From raw documents to placed training data, in five stages.

Every stage takes the columns of ``documents`` in any order and passes on those it is given. Nulls, empty and very long
texts and repeated rows are borne: what has no letter goes with the language stage, a row without an id is no copy of
any other and holds no benchmark item, rows that share an id go or stay together, a null source is a source. An empty table stays empty.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.decontamination import without_leaks
from newsloom.llm.frames import of_ids
from newsloom.llm.language_id import UNKNOWN, identify, train
from newsloom.llm.mixing import mix
from newsloom.llm.near_dedup import near_duplicates
from newsloom.llm.sharding import place
from newsloom.sources.store import staged


# Below this no machine has decided: the family or some pair of languages is as good as a guess.
LEAST_SCORE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; what has no letter, or scores below ``LEAST_SCORE``, goes."""
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return identify(docs, train(docs)).filter(known).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8), the one with the smallest id."""
    groups = near_duplicates(docs.select("doc_id", "text"))
    return of_ids(docs, staged(groups.filter(~F.col("kept")).select("doc_id").distinct()), "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold half of a benchmark item or more."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard and the slot they are placed in."""
    return place(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

# Machines, signatures and tilings are not expressible in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
