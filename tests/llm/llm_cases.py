"""Rows that every operator has to bear, and plain versions of shared definitions."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} and{i}." for i in range(30_000))


def lower_ascii(text):
    return "".join(c.lower() if c < "\x80" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    return [
        (1, "The quick brown fox jumps over the lazy dog again.", "en", "a", 10),
        (1, "The quick brown fox jumps over the lazy dog again.", "en", "a", 10),
        (2, "The quick brown fox jumps over the lazy dog again.", "en", "b", 10),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t\x0b ", "en", None, 5),
        (None, "A text without an id, which is short.", "en", "a", 3),
        (None, None, None, None, None),
        (6, LONG, "en", "c", len(LONG)),
        (7, "12345 67890 !!! ???", "de", "a", 1),
        (8, "Ärger über ÉTÉ\nund noch eine Zeile.\n\n", "de", "b", 1),
        (-9, "Négative ids are ids.", "fr", "Z", 1),
    ]


def odd_frame(spark, extra=""):
    rows = odd_rows()
    names = [n for n in extra.split(",") if n]
    schema = SCHEMA + "".join(f", {n} string" for n in names)
    return spark.createDataFrame([(*r, *["old"] * len(names)) for r in rows], schema)


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)
