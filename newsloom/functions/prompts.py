"""Prompt text. Templates are plain strings; ``[[name]]`` slots are filled by column concatenation."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_JSON_ONLY = "Answer with one JSON object and nothing else: no code fence, no comment.\n"

_SUMMARY_FIELDS = '{"summary_30": "...", "summary_111": "...", "summary_250": "..."}'

_LENGTHS = (
    "Write three texts in English:\n"
    "- summary_30: one full sentence of 30 words that says what happened\n"
    "- summary_111: 111 words on what happened, who is involved and why it matters\n"
    "- summary_250: 250 words with background, consequences and what comes next\n"
)

SUMMARIZE = (
    "You edit a daily news digest. Summarise the article below in a neutral tone and keep to the facts.\n"
    + _LENGTHS
    + _JSON_ONLY
    + _SUMMARY_FIELDS
    + "\n<title>[[title]]</title>\n<content>[[content]]</content>"
)

TRANSFORM = (
    "You edit a daily news digest. The article below is in German and your readers are abroad. "
    "Retell it in English, do not translate word by word: explain offices, parties and places, "
    "and say why it matters outside Germany.\n"
    + _LENGTHS
    + _JSON_ONLY
    + _SUMMARY_FIELDS
    + "\n<title>[[title]]</title>\n<content>[[content]]</content>"
)

GLOSSARY_RULES = (
    "Names of countries, companies and people, and acronyms such as NATO, GDP or CEO, stay in English. "
    "Titles of office and common nouns are translated. Prefer natural phrasing over literal wording.\n"
)

TRANSLATE = (
    "Translate this news brief from English into [[language]] for a general reader, in a neutral tone.\n"
    + GLOSSARY_RULES
    + _JSON_ONLY
    + '{"title": "...", "summary_30": "...", "summary_111": "...", "summary_250": "..."}\n'
    "<title>[[title]]</title>\n<summary_30>[[summary_30]]</summary_30>\n"
    "<summary_111>[[summary_111]]</summary_111>\n<summary_250>[[summary_250]]</summary_250>"
)

_COMBINED_TASK = (
    "Second, translate your texts into [[language]].\n"
    + GLOSSARY_RULES
    + _JSON_ONLY
    + '{"english_title": "...", "english_30": "...", "english_111": "...", "english_250": "...", '
    '"target_title": "...", "target_30": "...", "target_111": "...", "target_250": "..."}\n'
    "<source>[[source_name]]</source>\n<title>[[title]]</title>\n<content>[[content]]</content>"
)

COMBINED_SUMMARIZE = (
    "You edit and translate a daily news digest. First, give the English article below a title of about "
    "ten words and summarise it in 30, 111 and 250 words, neutral and factual.\n" + _COMBINED_TASK
)

COMBINED_TRANSFORM = (
    "You edit and translate a daily news digest. First, retell the German article below in English for "
    "readers abroad, with a title of about ten words and texts of 30, 111 and 250 words; explain offices, "
    "parties and places instead of translating word by word.\n" + _COMBINED_TASK
)


def pieces(template: str) -> list[tuple[bool, str]]:
    """The template as (is_slot, text) in order."""
    split = re.split(r"\[\[(\w+)\]\]", template)
    return [(i % 2 == 1, part) for i, part in enumerate(split) if part]


def fill(template: str, **values: Column) -> Column:
    parts = [
        (values[text] if text in values else F.col(text)) if is_slot else F.lit(text) for is_slot, text in pieces(template)
    ]
    return F.concat(*parts)
