"""Column expressions over whole texts, all of them built-in functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words of a text: runs of anything but space, tab, line feed, VT, FF and CR."""
    text = trimmed(F.coalesce(text, F.lit("")))
    none = F.array().cast("array<string>")
    return F.when(F.length(text) > 0, F.split(text, "[\\x20\\x09-\\x0D]+")).otherwise(none)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def learnable(doc_id: Column, folds: int, held_out: int) -> Column:
    """Whether a labelled row may be learned from; rows without an id never are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != held_out, F.lit(False))
