"""Text and time expressions."""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped or split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def ntz(moment: datetime | Column) -> Column:
    """A zone-less timestamp literal; plain ``lit(datetime)`` would take the session's zone."""
    if isinstance(moment, Column):
        return moment
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def stripped(text: Column) -> Column:
    # btrim looks at both ends only, where a regular expression would walk the whole body.
    return F.btrim(text, F.lit(WHITESPACE))


def content_hash(content: Column) -> Column:
    return F.sha2(F.lower(stripped(content)), 256)


def iso(ts: Column) -> Column:
    """ISO 8601 with microseconds only where there are any.

    Goes through the string cast, which needs no time zone, so a session zone with
    daylight saving cannot move the value.
    """
    plain = F.translate(ts.cast("string"), " ", "T")
    return F.when(F.length(plain) > 19, F.rpad(plain, 26, "0")).otherwise(plain)


def iso_utc(ts: Column) -> Column:
    return F.concat(iso(ts), F.lit("Z"))


def article_id(url: Column, published_at: Column) -> Column:
    return F.substring(F.sha2(F.concat(url, F.lit(":"), iso(published_at)), 256), 1, 16)


def age_hours(published_at: Column, as_of: datetime | Column) -> Column:
    """Hours between two zone-less times. ``timestampdiff`` would go through the session's zone."""
    seconds = (ntz(as_of) - published_at).cast("interval second").cast("decimal(18,6)")
    return (seconds * 1_000_000).cast("long") / F.lit(3.6e9)


def words(text: Column, at_most: int | None = None) -> Column:
    """Split on white space. With ``at_most``, the item after that many words holds the rest."""
    body = stripped(text)
    limit = -1 if at_most is None else at_most + 1
    no_words = F.array().cast("array<string>")
    return F.when(body == "", no_words).otherwise(F.split(body, WHITESPACE_RUN, limit))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def excerpt(split_words: Column, n: int) -> Column:
    """First ``n`` words joined by single spaces, with an ellipsis only if more follow."""
    head = F.array_join(F.slice(split_words, 1, n), " ")
    return F.when(F.size(split_words) > n, F.concat(head, F.lit("..."))).otherwise(head)


def normalized_url(url: Column) -> Column:
    """Lower-case scheme and host, drop the scheme's own port, give a bare host a path of ``/``."""
    url = stripped(url)
    parts = r"(?i)^(https?)://([^/?#]*@)?([^/?#@]*)(.*)$"
    scheme = F.lower(F.regexp_extract(url, parts, 1))
    login = F.regexp_extract(url, parts, 2)
    host = F.lower(F.regexp_extract(url, parts, 3))
    rest = F.regexp_extract(url, parts, 4)
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(
        F.regexp_replace(host, ":80$", "")
    )
    slash = F.when(rest.startswith("/"), F.lit("")).otherwise(F.lit("/"))
    whole = F.concat(scheme, F.lit("://"), login, host, slash, rest)
    return F.when(url.rlike(parts), whole).otherwise(url)
