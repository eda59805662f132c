"""Feed payloads (RSS and Atom) to entries, and entries to articles."""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.once import settle
from newsloom.functions.text import article_id, content_hash, normalized_url, ntz
from newsloom.operators.validation import WEB_URL
from newsloom.schemas import MAX_URL_CHARS

# Both dialects in one schema: RSS keeps its items under <channel>, Atom has <entry> at the top.
# A payload is parsed once and fills whichever half it has.
_RSS_ITEM = (
    "struct<title:string,link:string,description:string,`content:encoded`:array<string>,"
    "guid:struct<_VALUE:string,_isPermaLink:string>,pubDate:string,`dc:date`:string,updated:string>"
)
_ATOM_TEXT = "struct<_VALUE:string,_type:string>"
_ATOM_ENTRY = (
    f"struct<title:{_ATOM_TEXT},link:array<struct<_href:string,_rel:string>>,"
    f"content:array<{_ATOM_TEXT}>,summary:{_ATOM_TEXT},published:string,updated:string>"
)
# The zone names of RFC 822, which know no daylight saving of their own.
MAIL_ZONES = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
    "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
# RSS 1.0 has its items beside the channel.
_FEED = f"channel struct<item:array<{_RSS_ITEM}>>, item array<{_RSS_ITEM}>, entry array<{_ATOM_ENTRY}>, _corrupt_record string"
_ROOT = r"<([\w.\-]+:)?(rss|feed|RDF)[\s>]"


def feed_time(text: Column) -> Column:
    """RFC 822 or ISO 8601 text to a zone-less UTC timestamp, null if it is neither."""
    no_weekday = F.regexp_replace(F.trim(text), r"^[A-Za-z]+,\s*", "")
    # RFC 822 to one form: four digits of the year, seconds, and the zone as an offset.
    mail = F.regexp_replace(no_weekday, r"^(\d{1,2} [A-Za-z]{3}) ([0-6]\d) ", "$1 20$2 ")
    mail = F.regexp_replace(mail, r"^(\d{1,2} [A-Za-z]{3}) ([7-9]\d) ", "$1 19$2 ")
    mail = F.regexp_replace(mail, r"( \d\d:\d\d)(?= |$)", "$1:00")
    for name, offset in MAIL_ZONES.items():
        mail = F.regexp_replace(mail, rf" {name}$", f" {offset}")
    instant = F.coalesce(
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx")),
        F.try_to_timestamp(F.when(no_weekday.rlike(r"^\d{4}-\d\d-\d\d"), _with_zone(no_weekday))),
    )
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_micros(instant) / F.lit(1_000_000))


def _with_zone(iso_text: Column) -> Column:
    """ISO text without a zone is UTC, whatever the session's zone is."""
    timed = F.when(F.length(iso_text) == 10, F.concat(iso_text, F.lit("T00:00:00"))).otherwise(iso_text)
    return F.when(timed.rlike(r"(Z|[+-]\d\d:?\d\d)$"), timed).otherwise(F.concat(timed, F.lit("Z")))


def _outside_cdata(text: Column, change: Callable[[Column], Column]) -> Column:
    """``text`` with ``change`` made everywhere but inside CDATA sections."""

    def part(piece: Column, place: Column) -> Column:
        after = F.instr(piece, "]]>") + 2
        rest = F.concat(piece.substr(F.lit(1), after), change(piece.substr(after + 1, F.length(piece))))
        return F.when(place == 0, change(piece)).when(after == 2, piece).otherwise(rest)

    return F.array_join(F.transform(F.split(text, r"<!\[CDATA\["), part), "<![CDATA[")


def _without_prefix(payload: Column) -> Column:
    """A feed whose elements carry a prefix (``atom:feed``, or RSS 1.0 bound to one), without it.

    The prefix of the root element counts for Atom and the one bound to the RSS 1.0 namespace for RDF; prefixes that
    other feeds declare for single elements stay, so that ``atom:link`` does not become a ``link``.
    """
    bound = r"""xmlns:([A-Za-z_][\w.\-]*)\s*=\s*["']http://purl\.org/rss/1\.0/["']"""
    atom = F.regexp_extract(payload, r"<([A-Za-z_][\w.\-]*):feed[\s>]", 1)
    rdf = F.when(payload.rlike(r"<([\w.\-]+:)?RDF[\s>]"), F.regexp_extract(payload, bound, 1)).otherwise("")
    prefix = F.when(atom != "", atom).otherwise(rdf)
    tag = F.concat(F.lit("<(/?)"), F.replace(prefix, F.lit("."), F.lit("\\.")), F.lit(":"))
    return F.when(prefix != "", _outside_cdata(payload, lambda t: F.regexp_replace(t, tag, F.lit("<$1")))).otherwise(payload)


def _markup_as_text(payload: Column) -> Column:
    """Atom texts of type xhtml, whose content is elements, with their markup as text and without the ``div`` around it."""
    opening = r"""<(?:content|summary|title)\s[^>]*type\s*=\s*["']xhtml["'][^>]*(?<!/)>"""
    div = r"(?s)^\s*<(?:[\w.\-]+:)?div(?:\s[^>]*)?>(.*)</(?:[\w.\-]+:)?div>\s*$"

    def part(piece: Column, place: Column) -> Column:
        start = F.regexp_extract(piece, "^[^>]*>", 0)
        name = F.regexp_extract(piece, r"^<(\w+)", 1)
        end = F.instr(piece, F.concat(F.lit("</"), name, F.lit(">")))
        inside = piece.substr(F.length(start) + 1, end - F.length(start) - 1)
        inside = F.regexp_replace(inside, div, "$1")
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            inside = F.replace(inside, F.lit(sign), F.lit(entity))
        whole = F.concat(start, inside, piece.substr(end, F.length(piece)))
        return F.when((place == 0) | (end == 0), piece).otherwise(whole)

    parts = F.split(payload, f"(?={opening})")
    return F.when(payload.rlike(opening), F.array_join(F.transform(parts, part), "")).otherwise(payload)


def _whole_entries(payload: Column) -> Column:
    """The complete items and entries of a broken payload in a frame of their own.

    Covers the usual faults: a payload that was cut off, and bare ampersands or HTML
    entities, which become plain text.
    """

    def repaired(text: Column) -> Column:
        return F.regexp_replace(text, r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)", "&amp;")

    def as_text(part: Column, place: Column) -> Column:
        """What stands after the beginning of a CDATA section: its text, escaped as a whole, and the rest."""
        end = F.instr(part, "]]>")
        inside = part.substr(F.lit(1), end - 1)
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            inside = F.replace(inside, F.lit(sign), F.lit(name))
        rest = repaired(part.substr(end + 3, F.length(part)))
        return F.when(place == 0, repaired(part)).when(end == 0, F.lit("")).otherwise(F.concat(inside, rest))

    # Neither an ampersand nor the end of an entry counts inside a CDATA section.
    escaped = F.array_join(F.transform(F.split(payload, r"<!\[CDATA\["), as_text), "")

    def all_of(tag: str) -> Column:
        found = F.regexp_extract_all(escaped, F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), F.lit(0))
        return F.array_join(found, "")

    return F.concat(
        F.lit("<feed><channel>"), all_of("item"), F.lit("</channel>"), all_of("entry"), F.lit("</feed>")
    )


def parse_feeds(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Add the parsed ``entries`` array and ``parse_error`` to each payload row.

    RSS 2.0, RSS 1.0 and Atom are read, Atom and RSS 1.0 also with a prefix, and Atom texts made of elements with their
    markup. A payload that is no proper XML is reported and gives the entries that are whole.
    """
    original, payload = payload, "_payload"
    kept = payloads.columns
    payloads = settle(payloads, _payload=_markup_as_text(_without_prefix(F.col(original))))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    first = settle(payloads, _first=F.from_xml(payload, _FEED, options))
    broken = F.col("_first").isNull() | F.col("_first._corrupt_record").isNotNull()
    again = F.when(broken, F.from_xml(_whole_entries(F.col(payload)), _FEED, options))
    parsed = settle(
        first, [*kept, payload], _broken=broken, _feed=F.when(broken, again).otherwise(F.col("_first"))
    )

    items = F.coalesce(F.col("_feed.channel.item"), F.col("_feed.item"))
    entries = F.coalesce(F.transform(items, _rss_entry), F.transform(F.col("_feed.entry"), _atom_entry))
    return parsed.select(
        *kept,
        entries.alias("entries"),
        F.when(F.col("_broken"), F.lit("malformed"))
        .when(~F.rlike(payload, F.lit(_ROOT)), F.lit("unknown_format"))
        .alias("parse_error"),
    )


def _rss_entry(item: Column) -> Column:
    content = F.transform(item["content:encoded"], lambda v: F.struct(v.alias("value")))
    # A guid is a link unless it says that it is none.
    is_link = F.coalesce(F.lower(item["guid"]["_isPermaLink"]), F.lit("true")) == "true"
    permanent = F.when(is_link & F.rlike(item["guid"]["_VALUE"], F.lit("^https?://")), item["guid"]["_VALUE"])
    return F.struct(
        item["title"].alias("title"),
        F.coalesce(item["link"], permanent).alias("link"),
        content.alias("content"),
        item["description"].alias("summary"),
        F.coalesce(feed_time(item["pubDate"]), feed_time(item["dc:date"])).alias("published"),
        feed_time(item["updated"]).alias("updated"),
    )


def _atom_entry(entry: Column) -> Column:
    content = F.transform(entry["content"], lambda v: F.struct(v["_VALUE"].alias("value")))
    link = F.filter(entry["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    return F.struct(
        entry["title"]["_VALUE"].alias("title"),
        F.get(link, F.lit(0))["_href"].alias("link"),
        content.alias("content"),
        entry["summary"]["_VALUE"].alias("summary"),
        feed_time(entry["published"]).alias("published"),
        feed_time(entry["updated"]).alias("updated"),
    )


def feed_file_entries(spark: SparkSession, path: str, dialect: str = "rss") -> DataFrame:
    """The entries of feed files of any size: ``source_name``, ``file`` and the columns of an entry.

    Files lie under ``path``/source_name=<name> and are all RSS (2.0 or 1.0), or all Atom with ``dialect="atom"``. They are read as text whose
    lines end with an entry's end tag, so that one huge file is cut into splits for many tasks, an entry is never cut,
    and no task holds more of a file than an entry. Each entry is then read like a payload of its own.

    Unlike a payload, a file is not judged as a whole: an entry that is no proper XML costs itself, and what stands between
    entries is not looked at. Entries have no order, an end tag within a CDATA section ends the entry, and elements with a
    prefix are for ``feed_entries``, which sees their declaration.
    """
    tag, frame = {"rss": ("item", "rss><channel"), "atom": ("entry", "feed")}[dialect]
    rows = spark.read.schema("value string, source_name string").option("lineSep", f"</{tag}>").text(path)
    begun = F.regexp_extract("value", rf"(?s)<{tag}[\s>].*", 0)
    ends = "></".join(reversed(frame.split("><")))
    found = settle(rows, ["source_name"], file=F.col("_metadata.file_path"), _entry=begun).filter(F.col("_entry") != "")
    payload = F.concat(F.lit(f"<{frame}>"), "_entry", F.lit(f"</{tag}></{ends}>"))
    return feed_entries(found.select("source_name", "file", payload.alias("payload"))).drop("position")


def feed_entries(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per entry with its position in the payload."""
    kept = [c for c in payloads.columns if c != payload]
    parsed = parse_feeds(payloads, payload)
    return parsed.select(*kept, F.posexplode("entries").alias("position", "entry")).select(
        *kept, "position", "entry.*"
    )


def feed_rows(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """What ``feed_entries`` gives, and a row without position and entry for each payload that has a ``parse_error``.

    Payloads are parsed once for both. ``parse_error`` is null in the rows of entries.
    """
    kept = [c for c in payloads.columns if c != payload]
    parsed = parse_feeds(payloads, payload)
    entry_type = parsed.schema["entries"].dataType.elementType

    def row(position: Column, entry: Column, error: Column) -> Column:
        return F.struct(position.cast("int").alias("position"), entry.alias("entry"), error.alias("parse_error"))

    nothing = F.lit(None)
    entries = F.transform("entries", lambda e, i: row(i, e, nothing.cast("string")))
    fault = F.when(F.col("parse_error").isNotNull(), F.array(row(nothing, nothing.cast(entry_type), F.col("parse_error"))))
    none = F.array().cast(f"array<struct<position:int,entry:{entry_type.simpleString()},parse_error:string>>")
    rows = F.concat(F.coalesce(entries, none), F.coalesce(fault, none))
    return parsed.select(*kept, F.inline(rows)).select(*kept, "position", "parse_error", "entry.*")


def feed_report(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Entries and parse errors per payload; a malformed payload without any stays visible."""
    kept = [c for c in payloads.columns if c != payload]
    entries = F.coalesce(F.size("entries"), F.lit(0))
    return parse_feeds(payloads, payload).select(
        *kept, F.when(F.col("entries").isNull(), 0).otherwise(entries).alias("entries"), "parse_error"
    )


def published_at(as_of: datetime) -> Column:
    return F.coalesce("published", "updated", ntz(as_of))


def entry_content() -> Column:
    """Content if the entry has any, even an empty one; else summary; else nothing."""
    return F.when(F.size("content") > 0, F.coalesce(F.col("content")[0]["value"], F.lit(""))).otherwise(
        F.coalesce(F.col("summary"), F.lit(""))
    )


def normalize_entries(entries: DataFrame, as_of: datetime) -> DataFrame:
    """Entries to articles, with ``reject_reason`` set where an entry cannot become one.

    The id is taken from the link as it came; the stored address is the normalised one.
    """
    link, title = F.col("link"), F.col("title")
    reason = (
        F.when(link.isNull(), "missing_link")
        .when(title.isNull(), "missing_title")
        .when(~link.rlike(WEB_URL) | (F.length(link) > MAX_URL_CHARS), "invalid_url")
    )
    own = {"title", "link", "content", "summary", "description", "published", "updated"}
    carried = [c for c in entries.columns if c not in own]
    if "description" in entries.columns:
        entries = entries.withColumn(
            "summary", F.coalesce(F.nullif("summary", F.lit("")), F.col("description"))
        )
    filled = entries.withColumns(
        {"_published": published_at(as_of), "_content": entry_content(), "reject_reason": reason}
    )
    return filled.select(
        *carried,
        article_id(link, F.col("_published")).alias("id"),
        normalized_url(link).alias("source_url"),
        F.lit("rss").alias("source_type"),
        "title",
        F.col("_content").alias("content"),
        F.col("_published").alias("published_at"),
        ntz(as_of).alias("fetched_at"),
        content_hash(F.col("_content")).alias("content_hash"),
        F.lit(False).alias("is_duplicate"),
        "reject_reason",
    )


def normalized_articles(entries: DataFrame, as_of: datetime) -> DataFrame:
    return normalize_entries(entries, as_of).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_entries(entries: DataFrame, as_of: datetime) -> DataFrame:
    return normalize_entries(entries, as_of).filter(F.col("reject_reason").isNotNull())
