"""The registered queries of this subpackage and their SQL twins."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import compression_quality, language_id, main_text, oracle
from newsloom.llm.collocations import collocations
from newsloom.llm.decontamination import leaks
from newsloom.llm.line_dedup import drop_common_lines
from newsloom.llm.line_quality import line_first_quality
from newsloom.llm.mixing import mixed_sizes
from newsloom.llm.near_dedup import near_duplicates
from newsloom.llm.ranked_search import rank
from newsloom.llm.sharding import place
from newsloom.llm.text import learnable
from newsloom.llm.token_counts import token_counts
from newsloom.llm.vector_search import nearest

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = compression_quality.train(docs, _read(spark, sf_dir, "labels"))
    held_out = ~learnable(F.col("doc_id"), compression_quality.FOLDS, compression_quality.HELD_OUT)
    scored = compression_quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and the shard of each document."""
    return place(_read(spark, sf_dir, "documents").select("doc_id"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each document, counted in flat token files made of the documents."""
    return token_counts(_read(spark, sf_dir, "documents"), VOCABULARY)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix by source weight takes."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed_sizes(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document under the line-first rules."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return line_first_quality(docs).select("doc_id", *counts, "base_failed", "n_lost_words", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of each document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs))
    held_out = ~learnable(F.col("doc_id"), language_id.FOLDS, language_id.HELD_OUT)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item of which the document holds half or more."""
    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document under four-word shingles at 0.8, and whether it stays."""
    return near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the lines that ten documents share."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.col("kept_text").cast("binary"), 256)
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    pages = _read(spark, sf_dir, "pages")
    return main_text.extract(pages, main_text.train(pages)).select("page_id", "url", "text", "n_chars")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return rank(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of each language that hold together best."""
    return collocations(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_compression_quality": op1_compression_quality,
    "op2_shard_placement": op2_shard_placement,
    "op3_token_counts": op3_token_counts,
    "op4_mix_sources": op4_mix_sources,
    "op5_line_quality": op5_line_quality,
    "op6_language_id": op6_language_id,
    "op7_benchmark_leaks": op7_benchmark_leaks,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_line_dedup": op9_line_dedup,
    "op10_main_text": op10_main_text,
    "op11_ranked_search": op11_ranked_search,
    "op12_nearest_vectors": op12_nearest_vectors,
    "op13_collocations": op13_collocations,
}
ORACLE = {
    "op4_mix_sources": oracle.OP4,
    "op5_line_quality": oracle.OP5,
    "op9_line_dedup": oracle.OP9,
    "op11_ranked_search": oracle.OP11,
    "op12_nearest_vectors": oracle.OP12,
    "op13_collocations": oracle.OP13,
}
