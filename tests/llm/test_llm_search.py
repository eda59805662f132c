"""Ranked search, nearest vectors and collocations against brute force, with odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from llm_cases import empty_frame, lower_ascii, odd_frame, odd_rows
from pyspark.sql import functions as F

from newsloom.llm import bytewords, collocations, double_array, ranked_search, vector_search
from newsloom.llm.registered import op11_ranked_search, op12_nearest_vectors, op13_collocations

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- ranked search ---------------------------------------------------------------------


def plain_ranks(docs, items, k):
    found = [(d, Counter(TERM.findall(lower_ascii(t or "")))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    rows, words = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall(lower_ascii(text or "")))
        scores = []
        for d, c in found:
            m = 25 + 75 * sum(c.values()) * rows // words
            score = sum(
                n * math.floor(1000 * math.log((2 * rows + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, n in asked.items() if c[t]
            )
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, n + 1, d, -s) for n, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def ranked(frame):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()), key=str)


def test_ranks_of_the_given_items(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ranked(op11_ranked_search(spark, SF)) == plain_ranks(docs, items, 10)


@pytest.mark.parametrize("limits", [(5, 3, 40), (1_000_000, 32_768, 2_000_000)])
def test_ranks_with_ties_repeats_and_nulls_in_small_segments(spark, monkeypatch, limits):
    for name, value in zip(("SEGMENT_POSTINGS", "SEGMENT_ROWS", "CELLS_AT_ONCE"), limits, strict=True):
        monkeypatch.setattr(ranked_search, name, value)
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(names, rng.integers(1, 40), p=np.arange(30, 0, -1) / 465)) for _ in range(120)]
    docs = [(r[0], r[1]) for r in odd_rows()] + [(n % 70, t) for n, t in enumerate(texts)] + [(999, texts[0])] * 15
    items = [(1, " ".join(names[:9])), (1, " ".join(names[:9])), (None, "w29 W29 w0"), (3, None), (4, "..."), (5, "fox Dog übel")]
    got = ranked_search.rank(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
        k=7,
        block_words=12,
    )
    assert ranked(got) == plain_ranks(docs, items, 7)


def test_ranks_of_empty_tables_and_with_clashing_columns(spark):
    items = spark.createDataFrame([(1, "fox", 5)], "item_id long, text string, doc_id int")
    assert ranked_search.rank(empty_frame(spark), items).count() == 0
    assert ranked_search.rank(odd_frame(spark), items.limit(0)).count() == 0
    plain = ranked(ranked_search.rank(odd_frame(spark), items))
    assert len(plain) == 3 and ranked(ranked_search.rank(odd_frame(spark, "score,rank,n,item_id"), items)) == plain


# --- nearest vectors -------------------------------------------------------------------


def plain_nearest(rows, asked, k):
    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and usable(v)})
    out = set()
    for q, v in {(i, tuple(v)) for i, v in asked if i is not None and usable(v)}:
        found = []
        for i, w in rows:
            if i != q and len(w) == len(v):
                dot = square = other = 0.0
                for x, y in zip(v, w, strict=True):
                    dot, square, other = dot + x * y, square + x * x, other + y * y
                found.append((-max(-1.0, min(1.0, dot / math.sqrt(square * other))), i))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(set(found))[:k])}
    return sorted(out)


def listed(frame):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in frame.collect())


def test_nearest_of_the_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = listed(op12_nearest_vectors(spark, SF))
    assert got == plain_nearest(rows, [r for r in rows if r[0] % 50 == 0], 5) and got


@pytest.mark.parametrize("block_bytes", [100, 1 << 20])
def test_nearest_with_copies_near_copies_and_useless_vectors(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(vector_search, "TILE_ROWS", 37)
    monkeypatch.setattr(vector_search, "TILE_QUERIES", 4)
    monkeypatch.setattr(vector_search, "PAIRS_AT_ONCE", 10)
    rng = np.random.default_rng(8)
    some = rng.normal(size=(150, 6))
    near = some[0] + 1e-9 * rng.normal(size=(60, 6))
    rows = [(n, v) for n, v in enumerate([*some.tolist(), *near.tolist(), *[some[1].tolist()] * 80, *(some[1:4] * 7).tolist()])]
    nan, inf = float("nan"), float("inf")
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [nan] * 6), (304, [inf] + [1.0] * 5), (305, [None] + [1.0] * 5)]
    rows += [(306, [1.0, 2.0]), (307, [2.0, 1.0]), (None, [1.0] * 6), (7, rows[7][1]), (308, [1e-200] * 6), (-3, rows[9][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    asked = [r for r in rows if r[0] is None or r[0] % 10 == 0 or r[0] in (7, 155, 306, 305)]
    queries = spark.createDataFrame(asked, "vec_id long, embedding array<double>")
    got = listed(vector_search.nearest(frame, queries, 4, block_bytes))
    assert got == plain_nearest([r for r in rows if r[0] != 308], asked, 4)
    assert vector_search.nearest(frame.limit(0), queries).count() == vector_search.nearest(frame, queries.limit(0)).count() == 0


def test_bounds_hold_also_in_many_dimensions():
    rng = np.random.default_rng(9)
    for size in (3, 64, 2500):
        x, y = (vector_search.Quantised(rng.normal(size=(40, size)) * 10.0 ** rng.integers(-3, 4)) for _ in "xy")
        estimate, off = vector_search._bounds(x.tile(0, 40), y.tile(0, 40))
        pairs = np.indices((40, 40)).reshape(2, -1)
        true = x.cosine(pairs[0], y, pairs[1]).reshape(40, 40)
        assert (np.abs(true - estimate) <= off).all() and off.max() < 0.1


# --- collocations ----------------------------------------------------------------------


def plain_collocations(rows, longest, least, inside, first):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_ascii(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), a in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= inside * f[lang, w[i : i + k]]:
                    covered.add((lang, w[i : i + k]))
    out = []
    for (lang, w), a in often.items():
        if (lang, w) not in covered:
            cuts = [(f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, (left, right) = min(((2_000_000 * a // (x + y), (x, y)) for x, y in cuts), key=lambda c: c[0])
            out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    place, done = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= first:
            done.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return done


def found(frame):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def test_collocations_of_the_given_documents(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = found(op13_collocations(spark, SF))
    assert got == plain_collocations(rows, 4, 30, 80, 2000) and got


@pytest.mark.parametrize("block_phrases,keys", [(40, 5), (200_000, 1_000_000)])
def test_collocations_of_odd_rows_in_small_blocks(spark, monkeypatch, block_phrases, keys):
    monkeypatch.setattr(collocations, "KEYS_AT_ONCE", keys)
    monkeypatch.setattr(bytewords, "CHUNK_BYTES", 200)
    rng = np.random.default_rng(10)
    words = ["the", "The", "of", "ÉTÉ", "new", "york", "times", "a", "x-1", " z"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]
    rows = [("".join(x for w, g in zip(rng.choice(words, 60), rng.choice(gaps, 60), strict=True) for x in (w, g)),
             ["en", None, "und", "Ü"][rng.integers(4)]) for _ in range(80)]
    rows += [("new york times", "en")] * 20 + [(r[1], r[2]) for r in odd_rows()]
    frame = spark.createDataFrame([(*r, "old") for r in rows], "text string, lang string, phrase string").repartition(3)
    for longest, first in ((4, 50), (2, 1000)) if keys > 5 else ((5, 7),):
        got = collocations.collocations(frame, longest=longest, least=4, first=first, block_phrases=block_phrases)
        assert found(got) == plain_collocations(rows, longest, 4, 80, first)
    assert collocations.collocations(empty_frame(spark)).count() == 0
    assert collocations.collocations(odd_frame(spark).limit(3)).count() == 0


def test_collocations_read_the_texts_as_often_for_many_phrases_as_for_few(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rng = np.random.default_rng(12)
    rows = [(" ".join(rng.choice(["a", "b", "c", "d", "e"], 50)), "en") for _ in range(40)]
    frame = spark.createDataFrame(rows, "text string, lang string").withColumn("text", seen("text"))
    got = found(collocations.collocations(frame, longest=3, least=4, block_phrases=10))
    assert got == plain_collocations(rows, 3, 4, 80, 2000) and len(got) > 50
    assert read.value == 3 * len(rows)


def test_trie_holds_its_sequences_and_no_others():
    rng = np.random.default_rng(11)
    held = {tuple(int(x) for x in rng.zipf(1.4, rng.integers(1, 5)) % 60) for _ in range(800)}
    rows = np.full((len(held), 5), double_array.NONE)
    for i, s in enumerate(sorted(held)):
        rows[i, : len(s)] = s
    trie = double_array.build(rows)
    number = {s: i for i, s in enumerate(sorted(held))}
    for s in [*held, *(tuple(int(x) for x in rng.zipf(1.4, rng.integers(1, 6)) % 60) for _ in range(2000))]:
        state, alive = np.array([double_array.ROOT]), True
        for w in s:
            go, state = trie.step(state, np.array([w]))
            if not go[0]:
                alive = False
                break
        assert (int(trie.accepts[state[0]]) if alive else -1) == number.get(s, -1)
