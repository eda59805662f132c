"""The same queries in SQL for DuckDB, written from the rules and not from the Spark plans."""

from newsloom.checks.samples import AS_OF, FEED_BLOCK, MODEL
from newsloom.functions import prompts as P
from newsloom.functions.responses import SUMMARY_FIELDS, TRANSLATION_FIELDS, combined_fields
from newsloom.functions.text import WHITESPACE
from newsloom.reference_data import (
    GERMAN_SOURCES,
    LANGUAGES,
    PROPER_NOUNS,
    SOURCES,
    SPAM_PHRASES,
    SPORTS_TERMS,
    SUMMARY_MAX_CHARS,
    SUMMARY_WORDS,
    TECHNICAL_TERMS,
    TOPIC_WORDS,
    TRUSTED_SOURCES,
)
from newsloom.schemas import TABLES

NOW = f"TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}'"
TEXTS = ["title", *SUMMARY_WORDS]


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def one_of(values: list[str]) -> str:
    return "(" + ", ".join(map(text, values)) + ")"


def trimmed(x: str) -> str:
    return f"trim({x}, {text(WHITESPACE)})"


def words(x: str) -> str:
    blank = r"'[\s\x0B\x1C-\x1F\x{85}\p{Z}]+'"
    return f"list_filter(regexp_split_to_array({trimmed(x)}, {blank}), lambda w: w <> '')"


def excerpt(n: int, x: str = "words") -> str:
    return f"array_to_string({x}[1:{n}], ' ') || CASE WHEN len({x}) > {n} THEN '...' ELSE '' END"


def mentions(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(p)})" for p in phrases) + ")"


def iso_z(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S') || 'Z'"


def caps(prefix: str = "summary_") -> str:
    return " AND ".join(f"length({prefix}{n.split('_')[1]}) <= {c}" for n, c in SUMMARY_MAX_CHARS.items())


def filled(template: str, **values: str) -> str:
    return " || ".join(values.get(t, t) if slot else text(t) for slot, t in P.pieces(template))


# --- the news tables over the given tables ------------------------------------------------

_SOURCE_NAMES = " ".join(f"WHEN 'src{i}' THEN {text(row[0])}" for i, row in enumerate(SOURCES))

CTES = {
    "docs": f"""
        SELECT doc_id, lang, 'https://news.example.com/a/' || doc_id AS source_url,
               CASE source {_SOURCE_NAMES} ELSE source END AS source_name, 'rss' AS source_type,
               CASE WHEN doc_id % 77 = 0 THEN 'Click here: Climate policy'
                    WHEN doc_id % 11 = 0 THEN 'Click here now'
                    WHEN doc_id % 7 = 0 THEN 'Climate policy of Germany, NATO and World Bank'
                    ELSE 'Story' END || ' ' || doc_id AS title,
               text AS content,
               CASE WHEN doc_id % 29 = 0 THEN {NOW} + INTERVAL 3 HOUR
                    ELSE {NOW} - to_minutes(doc_id * 37 % 4320) END AS published_at,
               {NOW} - to_minutes(doc_id % 15 * 1440) AS fetched_at
        FROM documents""",
    "hashed": f"""
        SELECT *, substr(sha256(source_url || ':' || strftime(published_at, '%Y-%m-%dT%H:%M:%S')), 1, 16) AS id,
               sha256(lower({trimmed('content')})) AS content_hash, fetched_at AS created_at
        FROM docs""",
    "articles": """
        SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) > 1 AS is_duplicate FROM hashed""",
    "store": "SELECT * REPLACE (false AS is_duplicate) FROM articles WHERE doc_id IN (SELECT doc_id FROM labels)",
    "cut": f"SELECT *, {words('content')} AS words FROM articles",
    "excerpts": "SELECT *, " + ", ".join(f"{excerpt(n)} AS {c}" for c, n in SUMMARY_WORDS.items()) + " FROM cut",
    "labelled": f"""
        SELECT doc_id, lang, length(content) AS n_chars, 'brief_' || e.id AS id, e.id AS article_id,
               substr(title, 1, 100) AS title, summary_30, summary_111, summary_250,
               'General' AS category, CAST(0.8 AS DOUBLE) AS quality_score, {text(MODEL)} AS model_used,
               {NOW} - to_minutes(doc_id * 61 % 64800) AS processed_at, quality, toxic
        FROM excerpts e JOIN labels USING (doc_id)""",
    "briefs": f"SELECT * FROM labelled WHERE {caps()}",
    "versions": """
        SELECT b.*, v.language, v.suffix, v.after
        FROM briefs b JOIN (VALUES ('or', '', 60, 0, 1), ('hi', '', 60, 1, 1), ('or', '_v0', 30, 0, 0))
             v(language, suffix, after, low, high) ON b.quality BETWEEN v.low AND v.high""",
    "translations": f"""
        SELECT 'trans_' || id || '_' || language AS own_id, 'trans_' || id || '_' || language || suffix AS id,
               id AS brief_id, language, '[' || language || '] ' || replace(title, 'NATO', 'ନାଟୋ') AS title,
               {", ".join(f"'[' || language || '] ' || {c} AS {c}" for c in SUMMARY_WORDS)},
               model_used, processed_at + to_minutes(after) AS translated_at
        FROM versions""",
    "ranked": """
        SELECT t.id AS translation_id, t.language, CAST(translated_at AS DATE) AS date,
               CAST(row_number() OVER (PARTITION BY CAST(translated_at AS DATE), t.language
                                       ORDER BY quality_score DESC, t.id) AS INTEGER) AS position
        FROM translations t JOIN briefs b ON b.id = t.brief_id""",
    "publication_stories": """
        SELECT 'pub_' || date || '_' || language AS publication_id, translation_id, position, date, language
        FROM ranked WHERE position <= 5""",
    "publications": f"""
        SELECT publication_id AS id, date, language, 'pending' AS publish_status,
               NULL AS telegram_message_id, NULL AS published_at, NULL AS error_message,
               {NOW} AS created_at, count(*) AS stories
        FROM publication_stories GROUP BY ALL""",
    "logs": """
        SELECT 'log_' || event_id AS id, ts AS timestamp,
               CASE WHEN event_type IN ('view', 'purchase') THEN 'extract-1' ELSE 'extract-2' END AS model_used,
               CASE WHEN event_type IN ('view', 'click', 'error') THEN 'summarize'
                    WHEN event_type = 'purchase' THEN 'translate' ELSE event_type END AS operation,
               event_type <> 'error' AS success, CAST(json_extract(props, '$.k') AS INTEGER) AS input_tokens,
               2 * CAST(json_extract(props, '$.k') AS INTEGER) AS output_tokens,
               CAST(value AS DECIMAL(18, 6)) AS cost_usd, CAST(floor(value) AS INTEGER) AS latency_ms,
               CASE WHEN event_type = 'error' THEN 'failed' END AS error_message
        FROM events""",
    "api_logs": "SELECT * FROM logs WHERE operation IN ('summarize', 'translate')",
    "searched": f"""
        SELECT *, lower(title || ' ' || content) AS body, length(content) AS chars,
               date_diff('microsecond', published_at, {NOW}) / 3.6e9 AS hours
        FROM articles""",
    "points": f"""
        SELECT *, CASE WHEN {mentions('body', SPAM_PHRASES)} THEN 8
                       WHEN {mentions('body', TOPIC_WORDS)} THEN 36 ELSE 24 END AS relevance_points,
               CASE WHEN source_name IN {one_of(TRUSTED_SOURCES)} THEN 20 ELSE 10 END AS source_points,
               CASE WHEN chars > 500 THEN 18 WHEN chars > 200 THEN 14 WHEN chars > 50 THEN 10 ELSE 6 END
                   AS completeness_points,
               CASE WHEN hours < 6 THEN 20 WHEN hours < 12 THEN 18 WHEN hours < 24 THEN 16
                    WHEN hours < 48 THEN 12 ELSE 8 END AS freshness_points
        FROM searched""",
    "quality": """
        SELECT *, (relevance_points + source_points + completeness_points + freshness_points)
                  / CAST(100 AS DOUBLE) AS quality_points
        FROM points""",
    "scored": """
        SELECT * EXCLUDE (quality_points), quality_points AS quality_score,
               quality_points * CAST(0.6 AS DOUBLE)
               + greatest(CAST(0 AS DOUBLE), 1 - hours / 24) * CAST(0.3 AS DOUBLE)
               + CAST(0.1 AS DOUBLE) AS composite_score
        FROM quality""",
    "good": "SELECT * FROM scored WHERE NOT is_duplicate AND quality_score >= 0.7",
    "marked": """
        SELECT *, CASE WHEN content_hash IN (SELECT content_hash FROM store) THEN 'store'
                       WHEN row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) > 1 THEN 'batch'
                  END AS dup_reason
        FROM articles""",
    "delivered": f"""
        SELECT *, source_name || '/' || lang || '/' || (doc_id // {FEED_BLOCK}) AS payload_id,
               CAST(row_number() OVER (PARTITION BY source_name, lang, doc_id // {FEED_BLOCK}
                                       ORDER BY doc_id) - 1 AS INTEGER) AS position
        FROM articles""",
    "arrived": """
        SELECT *, row_number() OVER (PARTITION BY content_hash
                                     ORDER BY payload_id || '#' || lpad(CAST(position AS VARCHAR), 9, '0')) AS copy
        FROM delivered""",
    "oldest": """
        SELECT * FROM translations
        QUALIFY row_number() OVER (PARTITION BY brief_id, language ORDER BY translated_at, id) = 1""",
}


def sql(body: str, *extra: tuple[str, str]) -> str:
    """``body`` behind the table definitions it needs."""
    known = {**CTES, **dict(extra)}
    needed: list[str] = []

    def need(fragment: str) -> None:
        for name in known:
            if name not in needed and name in _names(fragment):
                need(known[name])
                needed.append(name)

    need(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({known[name]})" for name in needed) + "\n" + body


def _names(fragment: str) -> set[str]:
    tokens = fragment.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return {after for before, after in zip(tokens, tokens[1:]) if before.upper() in ("FROM", "JOIN")}


# --- model responses ------------------------------------------------------------------------


def _value(field: str) -> str:
    part = field.rsplit("_", 1)[-1]
    return part if part == "title" else f"summary_{part}"


def _object(fields: list[str], first: str | None = None) -> str:
    values = [first if first and i == 0 else _value(f) for i, f in enumerate(fields)]
    pairs = ", ".join(f"{text(f)}, {v}" for f, v in zip(fields, values))
    return f"CAST(json_object({pairs}) AS VARCHAR)"


def parsed_ctes(fields: list[str], id_column: str, name: str = "parsed") -> list[tuple[str, str]]:
    """Responses in every shape, then the reading rules step by step; the last one is ``name``."""
    whole = _object(fields)
    shaped = f"""
        SELECT {id_column} AS id, CASE
            WHEN quality = 0 AND toxic = 1 THEN 'The request was declined.'
            WHEN toxic = 1 THEN {_object(fields[:-1])}
            WHEN quality = 0 THEN left({whole}, length({whole}) - 1)
            WHEN lang = 'fr' AND n_chars > 3000 THEN '{{' || summary_30 || '}}'
            WHEN lang = 'es' AND n_chars > 3000 THEN {_object(fields, "30")}
            WHEN lang = 'de' THEN '```json' || chr(10) || {whole} || chr(10) || '```'
            WHEN lang = 'fr' THEN '```' || {whole} || '```' || chr(10)
            WHEN lang = 'es' THEN 'Here it is: ' || {whole} || ' Regards.'
            ELSE {whole} END AS response
        FROM labelled"""
    bare = trimmed("response")
    opened = f"""
        SELECT id, CASE WHEN starts_with({bare}, '```json') THEN substr({bare}, 8)
                        WHEN starts_with({bare}, '```') THEN substr({bare}, 4) ELSE {bare} END AS t
        FROM {name}_shaped"""
    closed = f"""
        SELECT id, {trimmed("CASE WHEN ends_with(t, '```') THEN left(t, length(t) - 3) ELSE t END")} AS t
        FROM {name}_opened"""
    found = rf"""
        SELECT id, t, TRY_CAST(regexp_extract(t, '\{{.*\}}', 0, 's') AS JSON) AS j FROM {name}_closed"""
    kinds = {f: f"json_type(j, '$.{f}')" for f in fields}
    reason = "\n".join(
        ["WHEN NOT contains(t, '{') THEN 'no_opening_brace'", "WHEN NOT contains(t, '}') THEN 'no_closing_brace'"]
        + ["WHEN j IS NULL THEN 'invalid_json'"]
        + [f"WHEN {k} IS NULL THEN 'missing:{f}'" for f, k in kinds.items()]
        + [f"WHEN {k} <> 'VARCHAR' THEN 'not_string:{f}'" for f, k in kinds.items()]
    )
    values = ", ".join(
        f"CASE WHEN {k} = 'VARCHAR' THEN json_extract_string(j, '$.{f}') END AS {f}" for f, k in kinds.items()
    )
    done = f"SELECT id, {values}, CASE {reason} END AS reject_reason FROM {name}_found"
    return [
        (f"{name}_shaped", shaped),
        (f"{name}_opened", opened),
        (f"{name}_closed", closed),
        (f"{name}_found", found),
        (name, done),
    ]


def _outcomes() -> str:
    extra, parts = [], []
    jobs = (("summarize", SUMMARY_FIELDS), ("translate", TRANSLATION_FIELDS), ("combined", combined_fields()))
    for job, fields in jobs:
        extra += parsed_ctes(fields, "article_id", f"parsed_{job}")
        parts.append(
            f"SELECT {text(job)} AS job, count(*) AS requested, count(*) FILTER (reject_reason IS NULL) AS successful, "
            f"count(*) FILTER (reject_reason IS NOT NULL) AS failed FROM parsed_{job}"
        )
    return sql(" UNION ALL ".join(parts), *extra)


# --- larger pieces --------------------------------------------------------------------------


def _profile() -> str:
    absent = {"briefs": {"created_at"}, "translations": {"created_at"}, "api_logs": {"created_at"}}
    parts = []
    for name, table in TABLES.items():
        for position, f in enumerate(table.schema, start=1):
            if f.name not in absent.get(name, ()):
                parts.append(
                    f"SELECT '{name}' AS table_name, {position} AS position, '{f.name}' AS column_name, "
                    f"'{f.dataType.simpleString()}' AS data_type, {f.nullable} AS nullable, count(*) AS n_rows, "
                    f'count(*) - count("{f.name}") AS n_null FROM {name}'
                )
    return sql("\nUNION ALL ".join(parts))


def _health() -> str:
    return sql(
        " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLES)
    )


def _orphans() -> str:
    articles = f"SELECT * FROM articles WHERE fetched_at >= {NOW} - INTERVAL 7 DAY"
    briefs = f"SELECT * FROM briefs WHERE processed_at >= {NOW} - INTERVAL 30 DAY"
    links = [
        ("briefs", "id", "article_id", "kept_briefs", "kept_articles", "articles"),
        ("translations", "id", "brief_id", "translations", "kept_briefs", "briefs"),
        ("publication_stories", "publication_id || '/' || translation_id", "publication_id",
         "publication_stories", "publications", "publications"),
        ("publication_stories", "publication_id || '/' || translation_id", "translation_id",
         "publication_stories", "translations", "translations"),
    ]
    parts = [
        f"SELECT '{child}' AS table_name, '{parent}' AS parent_table, {key} AS row_key, {link} AS parent_key "
        f"FROM {rows} WHERE {link} NOT IN (SELECT id FROM {parents})"
        for child, key, link, rows, parents, parent in links
    ]
    return sql(" UNION ALL ".join(parts), ("kept_articles", articles), ("kept_briefs", briefs))


def _rejects() -> str:
    long = ", ".join(f"CASE WHEN length({c}) > {n} THEN 'max_length:{c}' END" for c, n in SUMMARY_MAX_CHARS.items())
    return sql(f"""
        SELECT 'briefs' AS table_name, id AS row_key, concat_ws(',', {long}) AS broken_rules
        FROM labelled WHERE NOT ({caps()})
        UNION ALL
        SELECT 'articles', id, 'enum:source_type' FROM articles WHERE source_type NOT IN ('rss', 'api')
        UNION ALL
        SELECT 'translations', id, 'enum:language' FROM translations WHERE language NOT IN {one_of(list(LANGUAGES))}
        UNION ALL
        SELECT 'api_logs', id, 'enum:operation' FROM logs WHERE operation NOT IN ('summarize', 'translate')
        UNION ALL
        SELECT 'publications', id || '_again', 'unique:date+language' FROM publications WHERE language = 'hi'
        UNION ALL
        SELECT 'publication_stories', 'pub_' || date || '_' || language || '/' || translation_id, 'range:position'
        FROM ranked WHERE position = 6
        UNION ALL
        SELECT 'sources', source_name, 'range:priority'
        FROM (SELECT source_name, count(*) AS n FROM docs GROUP BY source_name) WHERE n % 5 NOT BETWEEN 1 AND 3""")


def _glossary() -> str:
    terms = list(dict.fromkeys(PROPER_NOUNS + TECHNICAL_TERMS + SPORTS_TERMS))
    whole = "concat_ws(chr(10), {0}.title, {0}.summary_30, {0}.summary_111, {0}.summary_250)"
    outside = r"[^\p{Latin}\p{N}\x{300}-\x{36F}]"
    values = ", ".join(f"({text(t)}, {text(f'(^|{outside}){t}($|{outside})')})" for t in terms)
    return sql(f"""
        SELECT t.brief_id, t.id AS translation_id, t.language, g.term
        FROM translations t JOIN briefs b ON b.id = t.brief_id
             JOIN (VALUES {values}) g(term, pattern) ON regexp_matches({whole.format('b')}, g.pattern)
        WHERE NOT regexp_matches({whole.format('t')}, g.pattern)""")


def _flat_feed(page: str, source: str, category: str, at: str) -> str:
    return f"""
        SELECT p.id, {source} AS source, {category} AS category, {iso_z(at)} AS "publishedAt",
               {", ".join(f"p.{c}" for c in TEXTS)}, o.language,
               {", ".join(f"o.{c} AS translated_{c}" for c in TEXTS)}
        FROM {page} p LEFT JOIN oldest o ON o.brief_id = p.id"""


_RANK = "ORDER BY composite_score DESC, published_at DESC, id"
_MODEL_PAIR = "'or' AS language, CAST(0.8 AS DOUBLE) AS quality_score"
_ROUTE = f"CASE WHEN source_name IN {one_of(GERMAN_SOURCES)} THEN 'transform' ELSE 'summarize' END"


def _either(transform: str, summarize: str, **values: str) -> str:
    return f"CASE WHEN {_ROUTE} = 'transform' THEN {filled(transform, **values)} ELSE {filled(summarize, **values)} END"


def _key(purpose: str) -> str:
    return f"substr(sha256(concat_ws(chr(10), {text(purpose)}, id, prompt)), 1, 16)"


def _routed(transform: str, summarize: str, **values: str) -> str:
    prompt = _either(transform, summarize, **values)
    return sql(f"""
        SELECT id, route, CAST(length(prompt) AS INTEGER) AS prompt_chars, sha256(prompt) AS prompt_hash
        FROM (SELECT id, {_ROUTE} AS route, {prompt} AS prompt FROM articles)""")


def _language(code: str) -> str:
    return text(f"{LANGUAGES[code]} ({code})")


_ARTICLE_COLUMNS = ", ".join(TABLES["articles"].columns)
_BRIEF_COLUMNS = ", ".join(TABLES["briefs"].required)
_TRANSLATION_COLUMNS = ", ".join(TABLES["translations"].required)
_OPEN_20 = f"SELECT * FROM good WHERE id NOT IN (SELECT article_id FROM briefs) {_RANK} LIMIT 20"

_ESCAPED = "replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

ORACLE = {
    "active_sources": sql(
        "SELECT s.name, s.url, s.priority, s.expected_articles, count(a.id) AS articles FROM (VALUES "
        + ", ".join(f"({text(n)}, {text(u)}, {p}, {e}, {on})" for n, u, p, e, on in SOURCES)
        + ") s(name, url, priority, expected_articles, enabled) LEFT JOIN articles a ON a.source_name = s.name "
        "WHERE s.enabled GROUP BY ALL"
    ),
    "feed_entries": sql(
        "SELECT source_name, payload_id, position, title, source_url AS link, published_at, "
        f"CAST(length({trimmed('content')}) AS INTEGER) AS content_chars FROM delivered"
    ),
    "feed_report": sql(
        "SELECT payload_id, CAST(count(*) AS INTEGER) AS entries, false AS malformed FROM delivered GROUP BY payload_id"
    ),
    "feed_forms": sql(
        "SELECT source_name, CASE lang WHEN 'en' THEN 'rdf' WHEN 'de' THEN 'prefixed' ELSE 'elements' END AS form, title, "
        "source_url AS link, published_at, CAST(CASE WHEN lang IN ('en', 'de') "
        f"THEN length({trimmed('content')}) ELSE length('<p>' || {_ESCAPED} || '</p>') END AS INTEGER) AS content_chars FROM docs"
    ),
    "feed_file_entries": sql("SELECT source_name, title, source_url AS link, published_at, content_hash FROM articles"),
    "indexed_duplicates": sql(
        "SELECT id, doc_id AS batch_seq, dup_reason IS NOT NULL AS is_duplicate, dup_reason FROM marked"
    ),
    "normalized_articles": sql(
        f"SELECT id, source_url, source_name, source_type, title, published_at, {NOW} AS fetched_at, content_hash, "
        "false AS is_duplicate FROM articles"
    ),
    "store_schemas": _profile(),
    "append_articles": sql("""
        SELECT id, doc_id AS batch_seq, id NOT IN (SELECT id FROM store) AS accepted,
               CASE WHEN id IN (SELECT id FROM store) THEN 'id_exists' END AS reject_reason
        FROM articles"""),
    "append_briefs": sql(
        f"""
        SELECT id, copy, reason IS NULL AS accepted, reason AS reject_reason FROM (
            SELECT id, copy, CASE WHEN NOT ({caps()}) THEN 'constraint:' || concat_ws(',', """
        + ", ".join(f"CASE WHEN length({c}) > {n} THEN 'max_length:{c}' END" for c, n in SUMMARY_MAX_CHARS.items())
        + f""") WHEN copy > 0 OR id IN (SELECT id FROM briefs WHERE processed_at >= {NOW} - INTERVAL 30 DAY) THEN 'id_exists' END
                AS reason FROM labelled, (VALUES (0), (1)) twice(copy) WHERE copy = 0 OR quality = 0)"""
    ),
    "append_translations": sql("""
        SELECT id, translated_at, reason IS NULL AS accepted, reason AS reject_reason FROM (
            SELECT own_id AS id, translated_at, CASE WHEN language = 'hi'
                OR row_number() OVER (PARTITION BY own_id ORDER BY translated_at) > 1 THEN 'id_exists' END AS reason
            FROM translations)"""),
    "article_by_id": sql(f"SELECT {_ARTICLE_COLUMNS} FROM articles WHERE id = (SELECT min(id) FROM articles)"),
    "brief_by_id": sql(f"SELECT {_BRIEF_COLUMNS} FROM briefs WHERE id = (SELECT min(id) FROM briefs)"),
    "translation_by_id": sql(
        f"SELECT {_TRANSLATION_COLUMNS} FROM translations WHERE id = (SELECT min(id) FROM translations)"
    ),
    "retain_articles": sql(f"SELECT id, fetched_at FROM articles WHERE NOT fetched_at < {NOW} - INTERVAL 7 DAY"),
    "retain_briefs": sql(f"SELECT id, processed_at FROM briefs WHERE NOT processed_at < {NOW} - INTERVAL 30 DAY"),
    "retain_translations": sql(
        "SELECT id, brief_id FROM translations WHERE brief_id IN "
        f"(SELECT id FROM briefs WHERE NOT processed_at < {NOW} - INTERVAL 30 DAY)"
    ),
    "cleanup_all": sql(
        f"SELECT (SELECT count(*) FROM articles WHERE fetched_at < {NOW} - INTERVAL 7 DAY) AS articles_deleted, "
        f"(SELECT count(*) FROM briefs WHERE processed_at < {NOW} - INTERVAL 30 DAY) AS briefs_deleted"
    ),
    "article_id": sql("SELECT source_url, published_at, id FROM articles"),
    "content_hash": sql("SELECT id, content_hash FROM articles"),
    "constraint_rejects": _rejects(),
    "article_excerpts": sql("SELECT id, summary_30, summary_111, summary_250 FROM excerpts"),
    "source_language_route": sql(f"SELECT id, source_name, {_ROUTE} AS route FROM articles"),
    "quality_scores": sql(
        "SELECT id, relevance_points, source_points, completeness_points, freshness_points, quality_score FROM scored"
    ),
    "high_quality_articles": sql("SELECT id, quality_score FROM scored WHERE quality_score >= 0.7"),
    "composite_scores": sql("SELECT id, round(composite_score, 9) AS composite_score FROM scored"),
    "known_duplicates": sql(
        "SELECT id, content_hash, content_hash IN (SELECT content_hash FROM store) AS is_known FROM articles"
    ),
    "unprocessed_articles": sql(
        "SELECT id, published_at, source_name FROM articles WHERE id NOT IN (SELECT article_id FROM briefs)"
    ),
    "untranslated_briefs": sql(
        "SELECT id, title, processed_at FROM briefs WHERE id NOT IN "
        "(SELECT brief_id FROM translations WHERE language = 'hi') ORDER BY processed_at DESC, id LIMIT 12"
    ),
    "translations_for_briefs": sql("""
        SELECT w.brief_id, t.id, t.language, t.title, t.translated_at
        FROM (SELECT DISTINCT 'brief_' || id AS brief_id FROM store) w
             LEFT JOIN translations t ON t.brief_id = w.brief_id"""),
    "orphan_rows": _orphans(),
    "brief_sources": sql(
        "SELECT b.id, b.article_id, coalesce(a.source_name, 'Global News') AS source_name "
        "FROM briefs b LEFT JOIN articles a ON a.id = b.article_id"
    ),
    "article_counts": sql(
        'SELECT count(*) AS total, count(*) FILTER (NOT is_duplicate) AS "unique", '
        "count(*) FILTER (is_duplicate) AS duplicates FROM articles"
    ),
    "articles_by_source": sql(
        "SELECT source_name, count(*) AS articles FROM articles WHERE NOT is_duplicate GROUP BY source_name"
    ),
    "brief_count": sql("SELECT count(*) AS briefs FROM briefs"),
    "translations_by_language": sql(
        "SELECT language, count(*) AS translations, (SELECT count(*) FROM translations) AS total "
        "FROM translations GROUP BY language"
    ),
    "table_health": _health(),
    "dedup_stats": sql("""
        SELECT count(*) AS total, count(*) FILTER (dup_reason IS NULL) AS "unique", count(dup_reason) AS duplicates,
               count(*) FILTER (dup_reason = 'store') AS store_duplicates,
               count(*) FILTER (dup_reason = 'batch') AS batch_duplicates,
               count(*) FILTER (dup_reason IS NOT NULL AND content_hash = sha256('')) AS empty_duplicates
        FROM marked"""),
    "quality_filter_stats": sql("""
        SELECT count(*) AS total, count(*) FILTER (quality_score >= 0.7) AS high_quality,
               count(*) FILTER (quality_score < 0.7) AS filtered_out, CAST(0.7 AS DOUBLE) AS threshold
        FROM scored WHERE NOT is_duplicate"""),
    "selection_stats": sql(
        f"""
        SELECT (SELECT count(*) FROM good) AS total_articles, count(*) AS selected,
               (SELECT count(*) FROM good) <= 20 AS selected_all,
               coalesce(round(max(composite_score), 2), 0) AS top_score,
               coalesce(round(min(composite_score), 2), 0) AS cutoff_score
        FROM best""",
        ("best", f"SELECT * FROM good {_RANK} LIMIT 20"),
    ),
    "batch_outcomes": _outcomes(),
    "collected_per_source": sql(
        "SELECT source_name, count(*) AS collected, (SELECT count(*) FROM articles) AS total "
        "FROM articles GROUP BY source_name"
    ),
    "source_coverage": sql(
        "SELECT d.day, s.source_name, s.expected_articles, count(a.id) AS collected, "
        "greatest(s.expected_articles - count(a.id), 0) AS shortfall "
        "FROM (SELECT DISTINCT CAST(published_at AS DATE) AS day FROM articles) d CROSS JOIN (VALUES "
        + ", ".join(f"({text(n)}, {e})" for n, _, _, e, on in SOURCES if on)
        + ") s(source_name, expected_articles) LEFT JOIN articles a "
        "ON a.source_name = s.source_name AND CAST(a.published_at AS DATE) = d.day "
        "GROUP BY d.day, s.source_name, s.expected_articles"
    ),
    "api_usage": sql("""
        SELECT CAST(timestamp AS DATE) AS day, model_used, operation, count(*) AS calls,
               count(*) FILTER (NOT success) AS failures, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
               CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd,
               avg(latency_ms) AS avg_latency_ms, max(latency_ms) AS max_latency_ms
        FROM api_logs GROUP BY ALL"""),
    "processing_progress": sql("""
        SELECT (SELECT count(*) FROM articles) AS total_articles,
               count(*) FILTER (processed_at < TIMESTAMP '2026-07-01 12:00:00') AS previously_processed,
               count(*) FILTER (processed_at >= TIMESTAMP '2026-07-01 12:00:00') AS newly_processed,
               count(*) AS total_processed, (SELECT count(*) FROM articles) - count(*) AS remaining,
               (SELECT count(*) FROM articles WHERE id NOT IN (SELECT article_id FROM briefs)) AS unprocessed
        FROM briefs"""),
    "mark_duplicates": sql(
        "SELECT id, doc_id AS batch_seq, dup_reason IS NOT NULL AS is_duplicate, dup_reason FROM marked"
    ),
    "daily_publication": sql(
        "SELECT publication_id, translation_id, position, date, language FROM publication_stories"
    ),
    "daily_publications": sql("SELECT id, date, language, publish_status, stories FROM publications"),
    "translation_per_language": sql("SELECT brief_id, language, id, translated_at FROM oldest"),
    "recent_articles": sql(
        "SELECT id, title, content, published_at FROM articles WHERE NOT is_duplicate "
        "ORDER BY published_at DESC, id LIMIT 100"
    ),
    "recent_briefs": sql(
        "SELECT id, title, summary_30, processed_at FROM briefs ORDER BY processed_at DESC, id LIMIT 50"
    ),
    "recent_translations": sql(
        "SELECT id, brief_id, title, translated_at FROM translations WHERE language = 'or' "
        "ORDER BY translated_at DESC, id LIMIT 50"
    ),
    "brief_translations": sql(
        "SELECT id, brief_id, language, translated_at FROM translations "
        "WHERE brief_id = (SELECT min(brief_id) FROM translations)"
    ),
    "top_stories": sql(f"""
        SELECT id, title, content, source_name, published_at, quality_score,
               round(composite_score, 9) AS composite_score
        FROM good {_RANK} LIMIT 5"""),
    "diverse_top_stories": sql(
        f"""
        SELECT id, source_name, round(composite_score, 9) AS composite_score FROM (
            SELECT *, row_number() OVER (PARTITION BY source_name {_RANK}) AS n FROM scored WHERE NOT is_duplicate)
        WHERE n <= 2 {_RANK} LIMIT 20"""
    ),
    "summary_prompts": _routed(P.TRANSFORM, P.SUMMARIZE),
    "translation_prompts": sql(f"""
        SELECT id, CAST(length(prompt) AS INTEGER) AS prompt_chars, sha256(prompt) AS prompt_hash
        FROM (SELECT id, {filled(P.TRANSLATE, language=_language('hi'))} AS prompt FROM briefs)"""),
    "combined_prompts": _routed(P.COMBINED_TRANSFORM, P.COMBINED_SUMMARIZE, language=_language("or")),
    "complete_batch": sql("""
        SELECT id, len(words) >= 10 AS success,
               CASE WHEN len(words) = 0 THEN 'ValueError: empty text'
                    WHEN len(words) < 10 THEN 'ValueError: text too short' END AS error_message,
               CASE WHEN len(words) >= 10 THEN 1 ELSE 2 END AS attempts, len(words) >= 10 AS answered
        FROM cut"""),
    "run_logs": sql(f"""
        SELECT 'summarize_' || id || '_' || {_key('summarize')} AS about, {NOW} AS timestamp, {text(MODEL)} AS model_used,
               'summarize' AS operation, len(words) >= 10 AS success,
               CASE WHEN len(words) = 0 THEN 'ValueError: empty text'
                    WHEN len(words) < 10 THEN 'ValueError: text too short' END AS error_message
        FROM (SELECT id, words, {_either(P.TRANSFORM, P.SUMMARIZE)} AS prompt FROM cut)"""),
    "repeated_run_logs": sql(f"""
        SELECT 'translate_' || id || '_' || {_key('translate/' + MODEL)} AS about, {NOW} AS timestamp,
               {text(MODEL)} AS model_used, 'translate' AS operation, success,
               CASE WHEN NOT success THEN 'ValueError: text too short' END AS error_message
        FROM (SELECT id, {filled(P.TRANSLATE, language="language")} AS prompt, run, len({words('summary_30')}) >= 30 AS success
              FROM briefs, (VALUES (1, {_language('hi')}), (2, {_language('hi')}), (3, {_language('or')})) r(run, language))
        WHERE run <> 2 OR NOT success"""),
    "parsed_summaries": sql("SELECT * FROM parsed", *parsed_ctes(SUMMARY_FIELDS, "article_id")),
    "parsed_translations": sql("SELECT * FROM parsed", *parsed_ctes(TRANSLATION_FIELDS, "id")),
    "parsed_combined": sql("SELECT * FROM parsed", *parsed_ctes(combined_fields(), "article_id")),
    "briefs_from_summaries": sql(
        f"""
        SELECT 'brief_' || id AS id, id AS article_id, substr(summary_30, 1, 100) AS title, summary_30, summary_111,
               summary_250, 'General' AS category, CAST(0.8 AS DOUBLE) AS quality_score,
               {text(MODEL)} AS model_used, {NOW} AS processed_at
        FROM parsed WHERE reject_reason IS NULL AND {caps()}""",
        *parsed_ctes(SUMMARY_FIELDS, "article_id"),
    ),
    "translations_from_briefs": sql(
        f"""
        SELECT 'trans_' || id || '_hi' AS id, id AS brief_id, 'hi' AS language, title, summary_30, summary_111,
               summary_250, {text(MODEL)} AS model_used, {NOW} AS translated_at
        FROM parsed WHERE reject_reason IS NULL""",
        *parsed_ctes(TRANSLATION_FIELDS, "id"),
    ),
    "combined_outputs": sql(
        f"""
        SELECT 'brief_' || id AS id, id AS article_id, english_title AS title, english_30 AS summary_30,
               english_111 AS summary_111, english_250 AS summary_250, 'trans_brief_' || id || '_or' AS translation_id,
               {_MODEL_PAIR}, target_title AS translated_title, target_30 AS translated_summary_30,
               target_111 AS translated_summary_111, target_250 AS translated_summary_250
        FROM parsed WHERE reject_reason IS NULL AND {caps("english_")}""",
        *parsed_ctes(combined_fields(), "article_id"),
    ),
    "combined_scored_briefs": sql(
        f"""
        SELECT 'brief_' || p.id AS id, p.id AS article_id, s.quality_score
        FROM parsed p JOIN scored s ON s.id = p.id WHERE p.reject_reason IS NULL AND {caps("p.english_")}""",
        *parsed_ctes(combined_fields(), "article_id"),
    ),
    "summary_length_check": sql(
        "SELECT id, "
        + ", ".join(f"CAST(len({words(c)}) AS INTEGER) AS words_{n}, abs(len({words(c)}) - {n}) <= 5 AS ok_{n}" for c, n in SUMMARY_WORDS.items())
        + " FROM briefs"
    ),
    "glossary_retention": _glossary(),
    "article_feed": sql(
        _flat_feed("page", "'Global News'", "category", "processed_at"),
        ("page", "SELECT * FROM briefs ORDER BY processed_at DESC, id LIMIT 20"),
    ),
    "raw_article_feed": sql(
        f"""
        SELECT id, source_name AS source, 'world' AS category, {iso_z('published_at')} AS "publishedAt",
               {", ".join(TEXTS)}, CAST(NULL AS VARCHAR) AS language, {", ".join(f"CAST(NULL AS VARCHAR) AS translated_{c}" for c in TEXTS)}
        FROM excerpts WHERE NOT is_duplicate ORDER BY published_at DESC, id LIMIT 100"""
    ),
    "feed_metadata": sql(
        f'SELECT least(count(*), 100) AS "totalArticles", {iso_z(NOW)} AS "lastUpdated", CAST(NULL AS VARCHAR) AS note FROM briefs'
    ),
    "article_detail": sql(
        _flat_feed("page", "'Global News'", "category", "processed_at"),
        ("page", "SELECT * FROM briefs WHERE id = (SELECT min(id) FROM briefs)"),
    ),
    "ingest_batch": sql("""
        SELECT id, source_name, content_hash, reason IS NOT NULL AS is_duplicate, reason IS NULL AS accepted,
               reason AS reject_reason
        FROM (SELECT *, CASE WHEN content_hash IN (SELECT content_hash FROM store) THEN 'duplicate:store'
                             WHEN copy > 1 THEN 'duplicate:batch' END AS reason FROM arrived)"""),
    "ingest_rejects": sql(
        """
        SELECT source_name, payload_id, position,
               CASE WHEN flaw IS NOT NULL THEN 'entry_rejected' WHEN reason IS NULL THEN 'accepted' ELSE 'duplicate' END AS outcome,
               coalesce(flaw, reason) AS reject_reason
        FROM (SELECT *, CASE WHEN content_hash IN (SELECT content_hash FROM store) THEN 'duplicate:store'
                             WHEN copy > 1 THEN 'duplicate:batch' END AS reason FROM sound)
        UNION ALL
        SELECT DISTINCT source_name, payload_id, NULL, 'payload_error', 'malformed' FROM delivered WHERE lang = 'es'""",
        (
            "flawed",
            "SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'missing_link' WHEN doc_id % 17 = 0 THEN 'missing_title' END AS flaw FROM delivered",
        ),
        (
            "sound",
            """SELECT *, row_number() OVER (PARTITION BY content_hash, flaw IS NULL
                   ORDER BY payload_id || '#' || lpad(CAST(position AS VARCHAR), 9, '0')) AS copy FROM flawed""",
        ),
    ),
    "editorial_run": sql(
        f"""
        SELECT 'brief_' || id AS id, id AS article_id, {", ".join(TEXTS)}, {_MODEL_PAIR},
               'trans_brief_' || id || '_or' AS translation_id,
               {", ".join(f"'~' || {c} AS translated_{c}" for c in TEXTS)}
        FROM excerpts WHERE id IN (SELECT id FROM chosen) AND {caps()}""",
        ("first", _OPEN_20),
        ("done", f"SELECT id FROM excerpts WHERE id IN (SELECT id FROM first) AND {caps()}"),
        (
            "chosen",
            "SELECT * FROM good WHERE id NOT IN (SELECT article_id FROM briefs) AND id NOT IN (SELECT id FROM done) "
            f"{_RANK} LIMIT 20",
        ),
    ),
    "summarise_then_translate": sql(
        f"""
        SELECT 'trans_brief_' || id || '_or' AS id, 'brief_' || id AS brief_id, 'or' AS language,
               '~' || substr(summary_30, 1, 100) AS title, {", ".join(f"'~' || {c} AS {c}" for c in SUMMARY_WORDS)},
               {text(MODEL)} AS model_used, {NOW} AS translated_at
        FROM excerpts WHERE id IN (SELECT id FROM chosen) AND {caps()}""",
        ("chosen", f"SELECT * FROM good {_RANK} LIMIT 50"),
    ),
    "fill_missing_translations": sql(f"""
        SELECT 'trans_' || id || '_hi' AS id, id AS brief_id, 'hi' AS language,
               {", ".join(f"'~' || {c} AS {c}" for c in TEXTS)}, {text(MODEL)} AS model_used, {NOW} AS translated_at
        FROM briefs WHERE id NOT IN (SELECT brief_id FROM translations WHERE language = 'hi')"""),
    "incremental_ingest": sql("""
        SELECT content_hash, is_duplicate FROM store
        UNION ALL
        SELECT DISTINCT content_hash, false FROM articles WHERE content_hash NOT IN (SELECT content_hash FROM store)"""),
}

# What is read through the written store's folders and footers equals what the tables themselves give.
ORACLE |= {
    "stored_health": ORACLE["table_health"],
    "stored_article_counts": ORACLE["article_counts"],
    "stored_translation_counts": ORACLE["translations_by_language"],
    "recent_stored_briefs": ORACLE["recent_briefs"],
    "recent_stored_translations": ORACLE["recent_translations"],
    "stored_article_by_id": ORACLE["article_by_id"],
}
