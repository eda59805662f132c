"""The ingest job as a stream over arriving payload files."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators.keyed_append import accepted_rows
from newsloom.plans.ingest import articles_of, deliver, ingest, outcomes
from newsloom.schemas import ARTICLES
from newsloom.sources.key_index import KeyIndex

# <payload_dir>/source_name=<name>/<file>: the folder says whose feed a file is.
_FILE_SCHEMA = "value string, source_name string"


def payload_files(spark: SparkSession, payload_dir: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text").schema(_FILE_SCHEMA).option("wholetext", "true")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(payload_dir).select(
        "source_name", F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload")
    )


def ingest_stream(
    payloads: DataFrame,
    store_dir: str,
    checkpoint_dir: str,
    as_of: datetime,
    registry: DataFrame | None = None,
    indexes: tuple[KeyIndex, KeyIndex] | None = None,
    outcomes_dir: str | None = None,
) -> StreamingQuery:
    """Run the ingest job on each micro-batch against everything stored before it.

    Each batch owns one folder of the store and overwrites it, and reads only the folders of
    earlier batches, so a batch that is run again after a failure gives the same store.
    Duplicates are found over all history, however old, because the store is the state. With a
    ``registry``, sources that it disables are left out, as in the batch job.

    With ``indexes`` (see ``history_indexes``) a batch asks them instead of the store: what it costs goes with its own rows, and the
    history is neither listed nor shuffled. They are brought up to date with what was stored before the first batch by
    ``index_store``, and by each batch after it has written its articles.

    With ``outcomes_dir``, what became of every entry and every faulty payload is written there, a folder per batch, which a
    repeated batch overwrites.
    """
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in ARTICLES.schema)}, batch long"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if indexes is None:
            store, hashes, ids = spark.read.schema(schema).parquet(store_dir).filter(F.col("batch") < batch_id), None, None
        else:
            store, (hashes, ids) = None, (index.known(spark, batch_id) for index in indexes)
        order = F.concat_ws("#", "file", F.lpad(F.col("position").cast("string"), 9, "0"))
        delivered = deliver(batch, registry, as_of, f"{checkpoint_dir}-staged/batch={batch_id}")
        fate = ingest(articles_of(delivered).withColumn("batch_seq", order), store, None, hashes=hashes, ids=ids)
        if outcomes_dir is not None:
            told = outcomes(delivered, fate, order, ["source_name", "file", "position", "id", "source_url"])
            told.write.mode("overwrite").parquet(f"{outcomes_dir}/batch={batch_id}")
        rows = accepted_rows(fate, ARTICLES, as_of)
        folder = f"{store_dir}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(folder)
        written = spark.read.schema(ARTICLES.schema).parquet(folder)
        for index in indexes or ():
            index.add(written, batch_id)

    return (
        payloads.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def create_stream_store(spark: SparkSession, store_dir: str, stored: DataFrame | None = None) -> None:
    """Start a stream's store, with earlier articles as the folder before its first batch."""
    rows = spark.createDataFrame([], ARTICLES.schema) if stored is None else stored
    rows.select(*ARTICLES.columns).write.mode("overwrite").parquet(f"{store_dir}/batch=-1")


def index_store(spark: SparkSession, store_dir: str, indexes: tuple[KeyIndex, KeyIndex]) -> None:
    """Make the indexes of a store that no batch has written to yet."""
    rows = spark.read.schema(ARTICLES.schema).parquet(f"{store_dir}/batch=-1")
    for index in indexes:
        index.opened(spark)
        index.add(rows)


def stored_articles(spark: SparkSession, store_dir: str) -> DataFrame:
    return spark.read.schema(ARTICLES.schema).parquet(store_dir)
