"""Model responses: free text around one JSON object whose fields must be strings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import stripped

SUMMARY_FIELDS = ["summary_30", "summary_111", "summary_250"]
TRANSLATION_FIELDS = ["title", *SUMMARY_FIELDS]


def combined_fields(target: str = "target") -> list[str]:
    """Field names of a combined response; ``target`` is the prefix of the translated half."""
    return [f"{side}_{part}" for side in ("english", target) for part in ("title", "30", "111", "250")]


def unfenced(response: Column) -> Column:
    """Without surrounding white space and Markdown code fence."""
    opened = F.regexp_replace(stripped(response), r"\A```(?:json)?", "")
    return stripped(F.regexp_replace(opened, r"```\z", ""))


def outermost_braces(text: Column) -> Column:
    """From the first opening to the last closing brace, empty if they are not in that order."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)
