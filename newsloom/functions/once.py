"""Computing a costly column once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(rows: DataFrame, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """Add ``columns`` so that they are computed once per row.

    A filter on a projected column is moved below the projection, and the column's
    expression is then evaluated once for each mention in the filter and again in the
    projection. That is free for arithmetic but not for lower-casing, splitting or parsing
    a whole text. A generator of one row is a boundary that filters do not cross, and it
    still runs inside generated code.
    """
    keep = rows.columns if keep is None else keep
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select(*keep, F.inline(F.array(values)))
