import json
import time

import pandas as pd
import pytest
from conftest import AS_OF, article, articles, brief, briefs, translation, translations, values
from pyspark.sql import functions as F

from newsloom.checks import stub
from newsloom.functions.batches import BATCH_BYTES
from newsloom.functions.responses import SUMMARY_FIELDS, combined_fields
from newsloom.operators import inference as I
from newsloom.operators import publication as P
from newsloom.operators.reports import batch_outcomes
from newsloom.plans import editorial

TEXTS = {"summary_30": "a", "summary_111": "b", "summary_250": "c"}
GOOD = json.dumps(TEXTS)
QUICK = {"attempts": 1, "wait_seconds": (0, 0)}


def responses(spark, *texts):
    return spark.createDataFrame([(f"a{i}", t) for i, t in enumerate(texts)], "id string, response string")


@pytest.mark.parametrize(
    "text,reason",
    [
        (GOOD, None),
        (f"```json\n{GOOD}\n```", None),
        (f"  ```{GOOD}```  ", None),
        (f"Sure, here: {GOOD} Bye.", None),
        (GOOD[:-1] + ', "more": {"x": 1}}', None),
        ('{"summary_30": "}{", "summary_111": "b", "summary_250": ""}', None),
        (GOOD[:-1], "no_closing_brace"),
        (GOOD[1:], "no_opening_brace"),
        ("} no {", "invalid_json"),
        ("", "no_opening_brace"),
        ("{nope}", "invalid_json"),
        (f"{GOOD} and {GOOD}", "invalid_json"),
        ('{"summary_30": "a", "summary_111": "b"}', "missing:summary_250"),
        ('{"summary_30": 1, "summary_111": "b", "summary_250": "c"}', "not_string:summary_30"),
        ('{"summary_30": "a", "summary_111": null, "summary_250": "c"}', "not_string:summary_111"),
        ('{"summary_30": "a", "summary_111": ["b"], "summary_250": "c"}', "not_string:summary_111"),
        (None, "no_response"),
    ],
)
def test_reading_a_response(spark, text, reason):
    row = I.parsed_summaries(responses(spark, text)).first()
    assert row["reject_reason"] == reason
    if reason is None and text != '{"summary_30": "}{", "summary_111": "b", "summary_250": ""}':
        assert {f: row[f] for f in SUMMARY_FIELDS} == TEXTS


def test_translated_and_combined_fields(spark):
    fields = {f: f.upper() for f in combined_fields()}
    row = I.parsed_combined(responses(spark, json.dumps(fields))).first()
    assert {f: row[f] for f in fields} == fields
    odia = {f: "x" for f in combined_fields("odia")}
    assert I.parsed_combined(responses(spark, json.dumps(odia)), "odia").first()["reject_reason"] is None
    assert I.parsed_translations(responses(spark, GOOD)).first()["reject_reason"] == "missing:title"


def test_prompts_hold_the_article_and_follow_the_source(spark):
    rows = [article(0, source_name="Tagesschau", content="Inhalt"), article(1, source_name="BBC", content='C "q" {x} [[y]]')]
    got = {r["id"]: r for r in I.summary_prompts(articles(spark, rows)).collect()}
    assert got["a0"]["route"] == "transform" and "German" in got["a0"]["prompt"]
    assert got["a1"]["route"] == "summarize" and 'C "q" {x} [[y]]' in got["a1"]["prompt"]
    for field in SUMMARY_FIELDS:
        assert f'"{field}"' in got["a0"]["prompt"]
    prompt = I.combined_prompts(articles(spark, rows), "ta").filter("id = 'a0'").first()["prompt"]
    assert "Tamil (ta)" in prompt and all(f'"{f}"' in prompt for f in combined_fields())
    prompt = I.translation_prompts(briefs(spark, [brief(0)]), "hi").first()["prompt"]
    assert "Hindi (hi)" in prompt and "<summary_250>long</summary_250>" in prompt
    with pytest.raises(ValueError):
        I.translation_prompts(briefs(spark, [brief(0)]), "xx")


def prompts(spark, *texts):
    return spark.createDataFrame([(f"a{i}", t) for i, t in enumerate(texts)], "id string, prompt string")


def test_failures_cost_their_own_row_only(spark):
    def fn(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return prompt.upper()

    got = I.complete_batch(prompts(spark, "x", "bad", "y"), fn, parallel_calls=2, attempts=3, wait_seconds=(0, 0))
    rows = {r["id"]: r for r in got.collect()}
    assert (rows["a0"]["response"], rows["a0"]["success"], rows["a0"]["attempts"]) == ("X", True, 1)
    assert (rows["a1"]["response"], rows["a1"]["error_message"], rows["a1"]["attempts"]) == (None, "RuntimeError: no", 3)
    assert rows["a2"]["latency_ms"] >= 0
    assert I.complete_batch(prompts(spark, "x", "y", "z"), fn, parallel_calls=2).rdd.getNumPartitions() == 2
    logs = I.as_api_logs(got, "summarize", "m", AS_OF)
    ids = [i.split("_") for i, _ in values(logs, "id", "success")]
    assert [(kind, subject, len(key)) for kind, subject, key, _ in ids] == [("summarize", f"a{i}", 16) for i in range(3)]
    assert all(asked.isdigit() for *_, asked in ids)
    assert [ok for _, ok in values(logs, "id", "success")] == [True, False, True]
    assert tuple(batch_outcomes(logs, "operation").first()) == ("summarize", 3, 2, 1)


def test_a_call_is_retried(spark, tmp_path):
    marker = str(tmp_path / "seen")

    def fn(prompt):
        with open(marker, "a+") as f:
            f.seek(0)
            tries = len(f.read())
            f.write("x")
        if tries < 2:
            raise RuntimeError("again")
        return "ok"

    row = I.complete_batch(prompts(spark, "x"), fn, attempts=3, wait_seconds=(0, 0)).first()
    assert (row["response"], row["attempts"]) == ("ok", 3)


def test_answers_are_kept_and_not_asked_again(spark, tmp_path):
    asked, path = str(tmp_path / "asked"), str(tmp_path / "answers")

    def fn(prompt):
        with open(asked, "a") as f:
            f.write(prompt)
        if prompt == "b":
            raise RuntimeError("no")
        return prompt * 2

    first = I.complete_once(prompts(spark, "a", "b"), fn, path, **QUICK)
    assert sorted(values(first, "id", "response", "success")) == [("a0", "aa", True), ("a1", None, False)]
    assert tuple(I.run_counts(first).first()) == (2, 1, 1)
    again = I.complete_once(prompts(spark, "a", "c"), lambda p: fn(p), path, **QUICK)
    assert sorted(values(again, "id", "response")) == [("a0", "aa"), ("a1", "cc")]
    assert sorted(open(asked).read()) == ["a", "b", "c"]


def test_answers_belong_to_their_prompt_and_purpose(spark, tmp_path):
    path = str(tmp_path / "answers")
    one = I.complete_once(prompts(spark, "a"), lambda p: f"1{p}", path, "hi", **QUICK)
    assert values(one, "response") == ["1a"]
    other = I.complete_once(prompts(spark, "a"), lambda p: f"2{p}", path, "ta", **QUICK)
    assert values(other, "response") == ["2a"]
    changed = I.complete_once(prompts(spark, "b"), lambda p: f"3{p}", path, "hi", **QUICK)
    assert values(changed, "id", "response") == [("a0", "3b")]
    again = I.complete_once(prompts(spark, "a", "b"), lambda p: f"4{p}", path, "hi", **QUICK)
    assert sorted(values(again, "id", "response")) == [("a0", "1a"), ("a1", "4b")]


def test_calls_of_a_task_run_side_by_side(spark):
    def fn(prompt):
        time.sleep(0.3)
        return prompt

    started = time.monotonic()
    answers = I.complete_batch(prompts(spark, *"abcdefghij"), fn, parallel_calls=1, calls_per_task=10, **QUICK)
    assert sorted(values(answers, "response")) == list("abcdefghij")
    assert time.monotonic() - started < 2.5


def test_a_task_holds_few_answers_at_a_time(spark):
    class Answer(str):
        held = 0

        def __del__(self):
            Answer.held -= 1

    def fn(prompt):
        Answer.held += 1
        return Answer(f"{Answer.held} {prompt} " + "x" * 100_000)

    answers = I.complete_batch(prompts(spark, *map(str, range(1000))), fn, parallel_calls=1, **QUICK)
    said = [(i, *r.split()) for i, r in values(answers.withColumn("response", F.left("response", F.lit(20))), "id", "response")]
    assert sorted(i for i, *_ in said) == sorted(f"a{prompt}" for _, _, prompt, *_ in said) == sorted(f"a{n}" for n in range(1000))
    assert all(i == f"a{prompt}" for i, _, prompt, *_ in said)
    assert max(int(held) for _, held, *_ in said) < 300


@pytest.mark.parametrize("wanted,most", [(None, 5_000_000), ("1m", 2_000_000)])
def test_prompts_reach_a_worker_some_megabytes_at_a_time(spark, wanted, most):
    own = spark.newSession()
    if wanted:
        own.conf.set(BATCH_BYTES, wanted)
    long = F.concat(F.col("id"), F.lit(" "), F.repeat(F.lit("x"), F.lit(100_000)))
    asked = own.range(0, 300, 1, 1).select(F.concat(F.lit("a"), "id").alias("id")).withColumn("prompt", long)

    def chars(batches):
        for batch in batches:
            yield pd.DataFrame({"chars": [batch["prompt"].str.len().sum()]})

    answers = I.complete_batch(asked, lambda p: p.split()[0], calls_per_task=8, **QUICK)
    assert values(answers, "id", "response") == [(f"a{n}", f"a{n}") for n in range(300)]
    read = values(asked.mapInPandas(chars, "chars long"), "chars")
    assert sum(read) > 30_000_000 and max(read) < most


def test_briefs_and_translations_from_parsed(spark):
    long = json.dumps({**TEXTS, "summary_30": "x" * 301})
    title = json.dumps({**TEXTS, "summary_30": "y" * 200})
    parsed = I.parsed_summaries(responses(spark, GOOD, long, "{", title))
    made = {r["id"]: r for r in I.briefs_from_summaries(parsed, "m", AS_OF).collect()}
    assert set(made) == {"brief_a0", "brief_a3"} and len(made["brief_a3"]["title"]) == 100
    row = made["brief_a0"]
    assert (row["article_id"], row["title"], row["category"], row["quality_score"]) == ("a0", "a", "General", 0.8)
    scores = spark.createDataFrame([("a0", 0.94)], "id string, quality_score double")
    made = I.briefs_from_summaries(parsed, "m", AS_OF, scores)
    assert dict(values(made, "id", "quality_score")) == {"brief_a0": 0.94, "brief_a3": 0.8}
    text = json.dumps({**TEXTS, "title": "t"})
    rows = I.translations_from_briefs(I.parsed_translations(responses(spark, text, GOOD)), "or", "m", AS_OF).collect()
    assert [(r["id"], r["brief_id"], r["language"], r["title"]) for r in rows] == [("trans_a0_or", "a0", "or", "t")]


def test_combined_gives_both_or_neither(spark):
    good = {f: f for f in combined_fields()}
    long = {**good, "english_250": "x" * 2501}
    long_target = {**good, "target_250": "x" * 5000}
    cut = json.dumps(good)[:-5]
    parsed = I.parsed_combined(responses(spark, json.dumps(good), json.dumps(long), cut, json.dumps(long_target)))
    out = I.combined_outputs(parsed, "or", "m", AS_OF)
    made, translated = I.combined_briefs(out), I.combined_translations(out)
    assert values(made, "id") == ["brief_a0", "brief_a3"]
    assert values(translated, "id") == ["trans_brief_a0_or", "trans_brief_a3_or"]
    assert values(made, "title", "summary_30")[0] == ("english_title", "english_30")
    assert values(translated, "brief_id", "title", "summary_250")[0] == ("brief_a0", "target_title", "target_250")
    assert set(values(made, "quality_score")) == {0.8}
    scores = spark.createDataFrame([("a0", 0.94), ("a7", 0.1)], "id string, quality_score double")
    scored = I.combined_briefs(I.combined_outputs(parsed, "or", "m", AS_OF, scores=scores))
    assert dict(values(scored, "id", "quality_score")) == {"brief_a0": 0.94, "brief_a3": 0.8}


def test_runs_end_to_end(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [article(i, source_name="BBC", title=f"Health {i}", content=words * 3) for i in range(4)]
    arts = articles(spark, [*rows, article(9, is_duplicate=True, content=words)])
    out = editorial.combined_run(
        arts, briefs(spark, [brief(0)]), stub.combined, AS_OF, "m", count=2, answers_path=str(tmp_path / "x"), **QUICK
    )
    made = I.combined_briefs(out).collect()
    assert [b["article_id"] for b in made] == ["a1", "a2"] and len(made[0]["summary_30"].split()) == 30

    made, translated = editorial.summarise_then_translate(
        arts, stub.summarize_or_translate, AS_OF, "m", language="hi", answers_path=str(tmp_path / "y"), **QUICK
    )
    assert made.count() == 4
    assert set(values(translated, "id")) == {f"trans_brief_a{i}_hi" for i in range(4)}
    stored = translations(spark, [translation(0)])
    done = editorial.fill_missing_translations(
        briefs(spark, [brief(i) for i in range(3)]), stored, stub.translate, AS_OF, "m", limit=1, **QUICK
    )
    assert values(done, "id", "title") == [("trans_brief_a1_or", "~Title 1")]


def test_length_check(spark):
    def words(n):
        return " ".join(["w"] * n)

    rows = [brief(0, summary_30=words(25), summary_111=words(116), summary_250=words(250)), brief(1, summary_30=words(36), summary_111="", summary_250=words(244))]
    got = {r["id"]: r for r in P.summary_length_check(briefs(spark, rows)).collect()}
    assert all(got["brief_a0"][f"ok_{n}"] for n in (30, 111, 250))
    assert not any(got["brief_a1"][f"ok_{n}"] for n in (30, 111, 250)) and got["brief_a1"]["words_111"] == 0


def test_glossary(spark):
    made = briefs(spark, [brief(0, title="NATO and the World Bank", summary_30="Tesla"), brief(1, title="plain")])
    rows = [translation(0, title="NATO", summary_30="ଟେସଲା", summary_111="World Bank"), translation(1)]
    got = P.glossary_retention(made, translations(spark, rows))
    assert values(got, "brief_id", "language", "term") == [("brief_a0", "or", "Tesla")]


def test_glossary_terms_are_whole_words(spark):
    text = "UNO und KAI, der EU-Rat. NATOର COVID-19\nWorld  Bank World Bank (AI)"
    wanted = ["UN", "AI", "EU", "NATO", "COVID-19", "World Bank", "Bank World", "EU-Rat. NATO", "lost"]
    row = spark.createDataFrame([(text,), ("",), ("UN",), (None,)], "t string")
    got = [sorted(v) if v is not None else None for (v,) in row.select(P.terms_among(P.pieces(row.t), wanted)).collect()]
    assert got == [["AI", "Bank World", "COVID-19", "EU", "EU-Rat. NATO", "NATO", "World Bank"], [], ["UN"], None]
    made, lost = briefs(spark, [brief(0, title="UNO")]), translations(spark, [translation(0)])
    assert P.glossary_retention(made, lost).count() == 0
    many = [f"term{n} of {n}" for n in range(10_000)]
    made = briefs(spark, [brief(0, summary_250="about term77 of 77 and term78 of 7")])
    assert values(P.glossary_retention(made, lost, many), "term") == ["term77 of 77"]
    with pytest.raises(ValueError):
        P.glossary_retention(made, lost, ["ନାଟୋ"])


def test_daily_publication(spark):
    made = briefs(spark, [brief(i, quality_score=i / 10) for i in range(8)])
    rows = [translation(i) for i in range(8)] + [translation(0, "hi")]
    got = P.daily_stories(translations(spark, rows), made)
    assert sorted(values(got.filter("language = 'or'"), "position", "translation_id")) == [
        (p, f"trans_brief_a{8 - p}_or") for p in range(1, 6)
    ]
    pubs = P.publications(got, AS_OF)
    assert sorted(values(pubs, "id", "publish_status", "stories")) == [
        ("pub_2026-07-04_hi", "pending", 1),
        ("pub_2026-07-04_or", "pending", 5),
    ]
    assert got.filter(F.col("position") > 5).count() == 0
