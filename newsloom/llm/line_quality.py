"""Quality rules, line first: failing lines go, then documents that lost too much with them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.once import settle
from newsloom.llm.frames import cleared
from newsloom.llm.text import WORD, trimmed, words

SYMBOLS = "[#*$%&|<>]"
GAP = "[\\x20\\x09-\\x0D]"
SENTENCE_END = "[.!?…][\"'”’»)\\]]*(" + GAP + "|\\z)"
SEPARATOR = "(\\A|" + GAP + ")[|>»•·/]+(" + GAP + "|\\z)"
SHOUT = "!!|\\?\\?"
LOWER = "[a-zß-öø-ÿ]"
CAPITAL = "[A-ZÀ-ÖØ-Þ]"
BOILERPLATE = (
    "(?i)cookie|javascript|all rights reserved|licensed under|terms of (use|service)|privacy policy"
    "|subscribe|newsletter|sign up|log in"
)
MARKS = "[#*$%&|<>»•·/!?]"
MIN_SEPARATORS = 3
MIN_SHOUTS = 2
MIN_CAPITALS = 10
SYMBOL_SHARE = 10
BOILERPLATE_CHARS = 300
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST_PERCENT = 50
WINDOW = 5
MADE = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_lost_words cleaned kept "
    "_w _l _h _p2 _g _s _p _fails"
).split()


def line_fails(line: Column) -> Column:
    """Whether a line (trimmed, not empty) is to be removed.

    Punctuation: no sentence ends in it, symbols are a tenth of it, or it shouts.
    Navigation: three or more separators stand between its words.
    Boilerplate: a line of at most ``BOILERPLATE_CHARS`` with a phrase of site furniture.
    """
    marked = F.rlike(line, F.lit(MARKS))  # one look spares most lines the counts
    no_sentence = ~F.rlike(line, F.lit(SENTENCE_END))
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) * SYMBOL_SHARE > F.length(line)
    shouts = F.regexp_count(line, F.lit(SHOUT)) >= MIN_SHOUTS
    capitals = ~F.rlike(line, F.lit(LOWER)) & (F.regexp_count(line, F.lit(CAPITAL)) >= MIN_CAPITALS)
    navigation = F.regexp_count(line, F.lit(SEPARATOR)) >= MIN_SEPARATORS
    boilerplate = (F.length(line) <= BOILERPLATE_CHARS) & F.rlike(line, F.lit(BOILERPLATE))
    return no_sentence | capitals | (marked & (symbols | shouts | navigation)) | boilerplate


def _from(array: str, start: int) -> Column:
    return F.slice(array, F.lit(start + 1), F.greatest(F.size(array) - start, F.lit(0)))


def with_text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the five counts of a text: words, their characters, symbols, repeated lines and words.

    ``n_repeat_words`` counts the words that lie in a window of five words which the text
    has twice or more. Windows are compared by 64-bit hashes within one text. Texts
    without a repeated window, which are most, are done after a look at the distinct hashes;
    only the others have their windows sorted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    symbols = F.when(F.rlike(text, F.lit(SYMBOLS)), F.regexp_count(text, F.lit(SYMBOLS))).otherwise(0)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(trimmed(x)) > 0)
    # Each step computes what the next one mentions more than once.
    counted = settle(
        docs,
        None,
        _w=words(text),
        _l=lines,
        n_symbols=symbols.cast("long"),
    )
    counted = settle(
        counted,
        [*docs.columns, "n_symbols", "_l"],
        n_words=F.size("_w").cast("long"),
        word_chars=F.length(F.array_join("_w", "")).cast("long"),
        n_dup_lines=(F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        _h=F.transform("_w", lambda x: F.xxhash64(x)),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    # Hashes of five words from those of two: (1 2)(3 4) 5. Whole arrays are paired, which spares index lookups.
    pair = F.zip_with("_h", _from("_h", 1), lambda a, b: F.xxhash64(a, b))
    counted = settle(counted, [*docs.columns, *counts, "_l", "_h"], _p2=pair)
    four = F.zip_with("_p2", _from("_p2", 2), lambda a, b: F.xxhash64(a, b))
    five = F.zip_with(four, _from("_h", 4), lambda a, b: F.xxhash64(a, b))
    # Pairing goes on to the longer array's end; what has no fifth word is no window.
    n_windows = F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))
    counted = settle(counted, [*docs.columns, *counts, "_l"], _g=F.slice(five, F.lit(1), n_windows))
    placed = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    any_twice = F.size(F.array_distinct("_g")) < F.size("_g")
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    counted = settle(
        counted, [*docs.columns, *counts, "_l"], _s=F.when(any_twice, placed).otherwise(nothing)
    )

    def beside(k: Column, x: Column) -> Column:
        return F.coalesce(F.get("_s", k)["h"] == x["h"], F.lit(False))

    twice = F.filter("_s", lambda x, k: beside(k - 1, x) | beside(k + 1, x))
    counted = settle(
        counted, [*docs.columns, *counts, "_l"], _p=F.sort_array(F.transform(twice, lambda x: x["i"]))
    )
    spans = F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(spans, F.lit(0), lambda a, x: a + x).cast("long")
    return counted.select(*docs.columns, *counts, total.alias("n_repeat_words"), "_l")


def line_first_quality(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``n_lost_words``, ``cleaned`` and ``kept``.

    ``cleaned`` is the text of the lines that pass. A document is kept if it passes the base
    test (ten words, at most a fifth of them repeated) and lost at most half of its
    words with its failing lines.

    * A null or empty text has no word, fails the base test and is not kept; ``cleaned`` is empty.
    * Rows are judged one by one: equal rows give equal results, an empty table an empty one.
    * Other columns are passed through, but for those with a name made here, which are replaced or dropped.
    """
    docs = cleared(docs, *MADE)
    counted = with_text_counts(docs)
    result = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = settle(counted, [*docs.columns, *result, "_l"], _fails=F.transform("_l", lambda x: line_fails(trimmed(x))))
    good = F.filter("_l", lambda x, i: ~F.get("_fails", i))
    bad = F.filter("_l", lambda x, i: F.get("_fails", i))
    few = F.col("n_words") < MIN_WORDS
    repeated = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    judged = judged.select(
        *docs.columns,
        *result,
        (few | repeated).alias("base_failed"),
        F.regexp_count(F.array_join(bad, "\n"), F.lit(WORD)).cast("long").alias("n_lost_words"),
        F.array_join(good, "\n").alias("cleaned"),
    )
    kept = ~F.col("base_failed") & (F.col("n_lost_words") * 100 <= F.col("n_words") * MAX_LOST_PERCENT)
    return judged.withColumn("kept", kept)
