"""Constraint checks as columns, and the rows that fail them."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.keys import attach
from newsloom.schemas import MAX_URL_CHARS, SOURCE_REGISTRY, TABLES, Table

WEB_URL = r"(?i)^https?://([^/?#\s]*@)?[^/?#@\s:]+(:\d+)?([/?#]\S*)?$"


def broken_rules(table: Table) -> Column:
    """Array of the names of the rules a row breaks; empty for a good row."""
    checks: list[tuple[str, Column]] = []
    for name in table.required:
        checks.append((f"not_null:{name}", F.col(name).isNull()))
    for name, allowed in table.enums.items():
        checks.append((f"enum:{name}", ~F.col(name).isin(allowed)))
    for name, (low, high) in table.ranges.items():
        checks.append((f"range:{name}", ~F.col(name).between(low, high)))
    for name, limit in table.max_chars.items():
        checks.append((f"max_length:{name}", F.length(name) > limit))
    for name in table.urls:
        bad = ~F.col(name).rlike(WEB_URL) | (F.length(name) > MAX_URL_CHARS)
        checks.append((f"url:{name}", bad))
    return F.array_compact(F.array(*[F.when(failed, F.lit(rule)) for rule, failed in checks]))


def check(rows: DataFrame, table: Table) -> DataFrame:
    return rows.withColumn("broken_rules", broken_rules(table))


def valid_rows(rows: DataFrame, table: Table) -> DataFrame:
    return check(rows, table).filter(F.size("broken_rules") == 0).drop("broken_rules")


def unique_conflicts(rows: DataFrame, table: Table) -> DataFrame:
    """Rows that cannot be kept beside others: ``row_key, rule, holder`` per broken rule of the whole table.

    Of rows that are equal in the columns of a UNIQUE rule the one with the smallest key holds the place; rows with a null in
    them are never in conflict. A key that occurs more than once is named once, as its own holder. One value may be in any share of the
    rows: firsts are combined before the shuffle, and rows meet them dealt out.
    """
    row_key = F.concat_ws("/", *table.key)
    keys = rows.groupBy(*table.key).agg(F.count("*").alias("_n")).filter("_n > 1")
    parts = [keys.select(row_key.alias("row_key"), F.lit("primary_key").alias("rule"), row_key.alias("holder"))]
    for columns in table.unique:
        named = rows.dropna(subset=list(columns)).select(F.struct(*columns).alias("_value"), row_key.alias("row_key"))
        first = named.groupBy("_value").agg(F.min("row_key").alias("holder"), F.count("*").alias("_n"))
        met = attach(named, first.filter("_n > 1").drop("_n"), "_value", "row_key", how="inner")
        rule = F.lit(f"unique:{'+'.join(columns)}").alias("rule")
        parts.append(met.filter(F.col("row_key") > F.col("holder")).select("row_key", rule, "holder"))
    return reduce(DataFrame.unionByName, parts)


def constraint_rejects(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per rejected row and kind of rule: table, key, rules broken by the row itself, or the rule it breaks beside others."""
    parts = []
    for name, rows in tables.items():
        table = {**TABLES, SOURCE_REGISTRY.name: SOURCE_REGISTRY}[name]
        parts.append(unique_conflicts(rows, table).select(F.lit(name).alias("table_name"), "row_key", F.col("rule").alias("broken_rules")))
        failed = check(rows, table).filter(F.size("broken_rules") > 0)
        parts.append(
            failed.select(
                F.lit(name).alias("table_name"),
                F.concat_ws("/", *table.key).alias("row_key"),
                F.array_join("broken_rules", ",").alias("broken_rules"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _missing_parent(
    child: DataFrame, child_name: str, row_id: Column, link: str, parent: DataFrame, parent_name: str
) -> DataFrame:
    rows = child.filter(F.col(link).isNotNull()).select(
        row_id.alias("row_key"), F.col(link).alias("parent_key")
    )
    parents = parent.select(F.col("id").alias("parent_key")).distinct().withColumn("_found", F.lit(True))
    marked = attach(rows, parents, "parent_key", "row_key")
    return marked.filter(F.col("_found").isNull()).select(
        F.lit(child_name).alias("table_name"),
        F.lit(parent_name).alias("parent_table"),
        "row_key",
        "parent_key",
    )


def orphan_rows(
    articles: DataFrame,
    briefs: DataFrame,
    translations: DataFrame,
    publications: DataFrame,
    stories: DataFrame,
) -> DataFrame:
    """Rows whose foreign key points nowhere. A parent may own any share of the children."""
    own = F.col("id")
    story = F.concat_ws("/", "publication_id", "translation_id")
    parts = [
        _missing_parent(briefs, "briefs", own, "article_id", articles, "articles"),
        _missing_parent(translations, "translations", own, "brief_id", briefs, "briefs"),
        _missing_parent(stories, "publication_stories", story, "publication_id", publications, "publications"),
        _missing_parent(stories, "publication_stories", story, "translation_id", translations, "translations"),
    ]
    return reduce(DataFrame.unionByName, parts)
