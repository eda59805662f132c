"""Mixing sources to target weights by capped water-filling."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.frames import cleared
from newsloom.llm.text import WORD
from newsloom.sources.store import staged

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"
DIGITS = 3
LEVELS = 4
PASSES = 2
FILLS = 4
_BORDERS = [(f"_most{n}", f"_to{n}") for n in range(PASSES)]
MADE = ["size", "lot", "source_size", "target", "copies", "taken", "_source", "_whole", "_extra", "_copy"]
MADE += [name for border in _BORDERS for name in border]


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, counted from 0 in code-point order, null last.

    Ranges of names are sorted side by side; a row's place is its place in its range after
    the sizes of the ranges before, of which there are as many as partitions.
    """
    ordered = sources.repartitionByRange(F.col("source").asc_nulls_last())
    ordered = ordered.sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = staged(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.selectExpr("_part", "sum(_n) over (order by _part) - _n as _before")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("_part", part).join(before, "_part")
    return joined.select(*sources.columns, (F.col("_before") + within).alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``source, source_size, weight, target``, for rows of ``source, size``.

    Sources weigh ``weights`` in turn, in code-point order with null last, and share the sum of
    all sizes. A source stops at ``max_epochs`` times its size. Each round pours what
    is left at one level per unit of weight, clamps the sources which that lifts above their
    brim, and takes their brims and weights out; it ends when a round clamps no more. The
    driver holds only the sums of a round.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(totals)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    poured = staged(ranked.select("source", "source_size", weight.alias("weight")))
    brim = F.col("source_size") * max_epochs
    whole, total_weight = poured.agg(F.sum("source_size"), F.sum("weight")).first()
    level, clamped = (whole or 0) / (total_weight or 1), -1
    while True:
        over = F.col("weight") * F.lit(level) > brim
        n, brims, used = poured.filter(over).agg(F.count("*"), F.sum(brim), F.sum("weight")).first()
        if n == clamped or n == 0:
            break
        clamped = n
        rest = total_weight - used
        if rest == 0:
            break
        level = (whole - brims) / rest
    target = F.when(over, brim.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return poured.withColumn("target", target)


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with ``size``, its words, and ``lot``, its place in its source's random order.

    The lot is the md5 of seed and id, or of seed and text where the id is null.
    """
    ticket = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    return docs.withColumns({"size": text_size(F.col("text")), "lot": F.md5(F.concat(F.lit(f"{seed}:"), ticket))})


def _same_source(rows: DataFrame, facts: DataFrame) -> DataFrame:
    facts = facts.withColumnRenamed("source", "_source")
    return rows.join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _border(lots: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` (``source, _left, _from`` and more) with ``_to``: how far in the order of lots the words left go.

    Looked at are rows after ``_from`` that have at most ``_left`` words; those up to ``_to`` have so many together.
    Rows with one lot are taken together.

    The border is found by digits of the lot: words per first digits, then, within the digits
    where the border lies, per next digits, and so on. Only what shares all the digits of a border
    is ordered in one task.
    """
    in_source = Window.partitionBy("source").orderBy("_part")
    facts = ["source", "_left", "_from"]
    at = state.select(*facts, F.lit(0).cast("long").alias("_before"), F.lit("").alias("_cut"))

    def inside() -> DataFrame:
        fits = (F.col("lot") > F.col("_from")) & (F.col("size") <= F.col("_left"))
        return _same_source(lots, at).filter(fits & F.col("lot").startswith(F.col("_cut")))

    for level in range(LEVELS):
        at = staged(at)
        part = F.substring("lot", 1 + DIGITS * level, DIGITS)
        words = inside().groupBy("source", part.alias("_part")).agg(
            F.sum("size").alias("_words"), *[F.first(c).alias(c) for c in [*facts[1:], "_before", "_cut"]]
        )
        upto = words.withColumn("_upto", F.col("_before") + F.sum("_words").over(in_source))
        past = upto.filter(F.col("_upto") > F.col("_left"))
        place = F.struct("_part", (F.col("_upto") - F.col("_words")).alias("before"))
        at = past.groupBy(*facts, F.col("_cut").alias("_so_far")).agg(F.min_by(place, "_part").alias("_at"))
        at = at.select(*facts, F.col("_at.before").alias("_before"), F.concat("_so_far", "_at._part").alias("_cut"))
    at = staged(at)
    last = inside().groupBy("source", F.col("lot").alias("_part")).agg(
        F.sum("size").alias("_words"), F.first("_before").alias("_before"), F.first("_left").alias("_left")
    )
    upto = F.col("_before") + F.sum("_words").over(in_source)
    fitting = last.withColumn("_upto", upto).filter(F.col("_upto") <= F.col("_left"))
    ends = fitting.groupBy(F.col("source").alias("_source")).agg(F.max("_part").alias("_end"))
    found = at.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left")
    found = found.select(F.col("source").alias("_source"), F.coalesce("_end", "_cut").alias("_to"))
    # Where no border was found, all rows looked at fit. Lots are hexadecimal, so all come before a tilde.
    beyond = F.when(F.col("_left") > 0, F.lit("~")).otherwise(F.col("_from"))
    met = state.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return met.withColumn("_to", F.coalesce("_to", beyond))


def _between(after: Column, upto: str, most: str) -> Column:
    return (F.col("lot") > after) & (F.col("lot") <= F.col(upto)) & (F.col("size") <= F.col(most))


def _chosen() -> Column:
    """Whether a row beside its source's plan is taken once more for the fraction."""
    after, chosen = F.lit(""), F.array_contains("_extra", F.col("lot"))
    for most, upto in _BORDERS:
        chosen = chosen | _between(after, upto, most)
        after = F.col(upto)
    return chosen


def plan_mix(
    lots: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """One row per source for rows of ``source, size, lot``: its target, whole passes and what is taken once more.

    A source is taken whole as often as its target holds it. Of the fraction left over, documents are
    taken in the order of lots as long as the next one that fits into the fraction still fits into what is left of it, and
    from there on, once more, those that fit into what is left. What then remains is less than a document's words: it is filled
    with the largest documents that fit, three times, and at last with the one that comes closest to
    it, if the words are nearer to the target with it than without.

    So a source of many documents ends at its target or next to it; one of few large texts as near as these steps come.
    """
    filled = targets(lots.select("source", "size"), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = filled.select("source", "source_size", "target", whole.cast("long").alias("_whole"))
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    state = staged(state.withColumns({"_left": rest, "_from": F.lit("")}))
    for most, upto in _BORDERS:
        state = staged(_border(lots, state))
        inside = _same_source(lots, state).filter(_between(F.col("_from"), "_to", "_left"))
        words = inside.groupBy(F.col("source").alias("_source")).agg(F.sum("size").alias("_words"))
        state = state.join(words, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        state = state.withColumnsRenamed({"_left": most, "_to": upto})
        left = F.col(most) - F.coalesce("_words", F.lit(0))
        state = staged(state.withColumns({"_left": left, "_from": F.col(upto)}).drop("_words"))
    state = state.drop("_from").withColumn("_extra", F.array().cast("array<string>"))
    for fill in range(FILLS):
        state = staged(state)
        closest = fill == FILLS - 1
        # What is closest to the words left without being twice as many is nearer to them than nothing.
        fits = F.col("size") < 2 * F.col("_left") if closest else F.col("size") <= F.col("_left")
        rows = _same_source(lots, state).filter((F.col("size") > 0) & fits & ~_chosen())
        units = rows.groupBy("source", "lot").agg(F.sum("size").alias("size"), F.first("_left").alias("_left"))
        rank = -F.abs(F.col("size") - F.col("_left")) if closest else F.col("size")
        best = units.filter(fits).groupBy(F.col("source").alias("_source")).agg(
            F.max(F.struct(rank.alias("rank"), "lot", "size")).alias("_best")
        )
        state = state.join(best, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        more = F.when(F.col("_best").isNotNull(), F.array("_best.lot")).otherwise(F.array().cast("array<string>"))
        state = state.withColumns(
            {"_extra": F.concat("_extra", more), "_left": F.col("_left") - F.coalesce("_best.size", F.lit(0))}
        ).drop("_best")
    return staged(state.drop("_left"))


def with_copies(lots: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's ``source_size`` and ``target`` and with ``copies``, how often the mix takes them."""
    made = ["_whole", "_extra", *[name for border in _BORDERS for name in border]]
    return _same_source(lots, plan).withColumn("copies", F.col("_whole") + _chosen().cast("long")).drop(*made)


def mix(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as the mix takes it.

    * A null text has size 0 and takes no words; a source without words has target 0 and goes.
    * A null source is a source. Equal rows have one lot and are taken together.
    * Other columns are passed through, but for those with a name made here, which are dropped.
    * An empty table gives an empty table.
    """
    docs = cleared(docs, *MADE)
    lots = staged(sized(docs, seed).select("source", "size", "lot"))
    taken = with_copies(sized(docs, seed), plan_mix(lots, **shares))
    repeated = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return taken.select(*docs.columns, repeated.alias("_copy")).drop("_copy")


def mixed_sizes(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row; texts are read once."""
    docs = cleared(docs, *MADE)
    lots = staged(sized(docs, seed).select("doc_id", "source", "size", "lot"))
    taken = with_copies(lots, plan_mix(lots, **shares)).drop("lot")
    return taken.withColumn("taken", F.col("copies") * F.col("size"))
