"""Append to a table with a primary key: the first row written wins, nothing is updated."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import ntz
from newsloom.operators.keys import without
from newsloom.operators.validation import check
from newsloom.schemas import Table


def decide(checked: DataFrame, stored: DataFrame, table: Table, seq: str) -> DataFrame:
    """``seq`` of the rows to write. ``checked`` needs the key, ``seq`` and ``broken_rules`` only.

    The winners come from a combined minimum per key, so rows that share one key are never
    brought together.
    """
    keys = list(table.key)
    valid = checked.filter(F.size("broken_rules") == 0)
    first = valid.groupBy(*keys).agg(F.min(seq).alias("_seq"))
    return without(first, keys, stored).select(F.col("_seq").alias(seq))


def admit(incoming: DataFrame, stored: DataFrame, table: Table, seq: str) -> DataFrame:
    """Add ``accepted`` and ``reject_reason`` to every incoming row.

    A row is rejected if it breaks a constraint, if its key is stored, or if an earlier
    valid row of the batch has the key. ``seq`` is the unique order of the batch; the
    verdicts are matched back on it. A part of the key is no such order: of two rows with one key
    both would be taken for the first.
    """
    if seq in table.key:
        raise ValueError(f"{seq} is part of the key; rows with one key need an order of their own")
    checked = check(incoming, table)
    fresh = decide(checked, stored, table, seq).withColumn("_fresh", F.lit(True))
    reason = F.when(F.size("broken_rules") > 0, constraint_reason()).when(
        F.col("_fresh").isNull(), F.lit("id_exists")
    )
    return (
        checked.join(fresh, seq, "left")
        .withColumn("reject_reason", reason)
        .withColumn("accepted", F.col("reject_reason").isNull())
        .select(*incoming.columns, "accepted", "reject_reason")
    )


def constraint_reason() -> Column:
    return F.concat(F.lit("constraint:"), F.array_join("broken_rules", ","))


def accepted_rows(admitted: DataFrame, table: Table, written_at: datetime) -> DataFrame:
    """The rows to write, in table layout; ``created_at`` and ``is_duplicate`` get their defaults."""
    rows = admitted.filter("accepted")
    defaults = {"created_at": ntz(written_at), "is_duplicate": F.lit(False)}
    columns = []
    for field in table.schema:
        if field.name in rows.columns:
            value = F.col(field.name)
            if field.name in defaults:
                value = F.coalesce(value, defaults[field.name])
        else:
            value = defaults.get(field.name, F.lit(None))
        columns.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*columns)


def append_stats(admitted: DataFrame) -> DataFrame:
    return admitted.agg(
        F.count("*").alias("requested"),
        F.count_if("accepted").alias("inserted"),
        F.count_if(~F.col("accepted")).alias("rejected"),
    )
