"""How many bytes of text go to a Python worker at a time."""

from pyspark.sql import DataFrame

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(rows: DataFrame) -> None:
    """Send texts to Python workers some megabytes at a time, unless the session says otherwise.

    A batch is held several times over on its way (rows, Arrow on both sides, what is made of it), and at the
    default of 64 MB that is most of a small executor's memory beyond its heap.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, "4m")
