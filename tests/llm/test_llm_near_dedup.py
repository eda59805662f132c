"""Near-duplicates and their parts against plain versions."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_cases import empty_frame, lower_ascii, odd_frame, words

from newsloom.llm import bytewords, superminhash
from newsloom.llm.components import components
from newsloom.llm.near_dedup import near_duplicates


def plain_components(rows, shingle, percent=80):
    """Every pair compared on whole sets; the smallest id that is reachable."""
    sets = {}
    for i, text in rows:
        w = [lower_ascii(x) for x in words(text)]
        found = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
        sets.setdefault(i, found)
    ids = sorted(sets)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_words_of_bytes():
    rng = random.Random(1)
    texts = ["Hello  World\n\tÉtre x", "", None, " ", "ABC abc", "ß\x0bÄ  x"]
    texts += ["".join(rng.choice("ab \né") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    found = bytewords.words_of(pa.array(texts).slice(1))
    seen = {}
    for i, text in enumerate(texts[1:]):
        hashes = found.hashes[found.offsets[i] : found.offsets[i + 1]].tolist()
        assert len(hashes) == len(words(text))
        for word, h in zip(words(text), hashes, strict=True):
            assert seen.setdefault(lower_ascii(word), h) == h
    assert len(set(seen.values())) == len(seen)


def test_windows_do_not_cross_texts():
    texts = ["a b c d e", "a b", "", "c d e f"]
    hashes, _, offsets = bytewords.windows(bytewords.words_of(pa.array(texts)), 4, whole_if_shorter=True)
    assert np.diff(offsets).tolist() == [2, 1, 0, 1] and len(set(hashes.tolist())) == 4
    assert np.diff(bytewords.windows(bytewords.words_of(pa.array(texts)), 4)[2]).tolist() == [2, 0, 0, 1]


def test_signatures_equal_one_element_at_a_time():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 5, 0, 40, 300)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = superminhash.signatures(np.concatenate(sets), offsets, 32)
    for s, row in zip(sets, got, strict=True):
        held = [0xFFFFFFFF] * 32
        for x in s:
            order = list(range(32))
            for step in range(32):
                place, offer = superminhash._draw(np.array([x]), step, 32)
                k = int(place[0])
                order[step], order[k] = order[k], order[step]
                held[order[step]] = min(held[order[step]], int(offer[0]))
        assert row.tolist() == held


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    gaps = []
    for _ in range(40):
        x = rng.integers(0, 1 << 63, 900).astype(np.uint64)
        a, b = superminhash.signatures(np.concatenate([x[:800], x[100:]]), np.array([0, 800, 1600]), 160)
        gaps.append((a == b).mean() - 700 / 900)
    assert abs(np.mean(gaps)) < 0.015 and np.std(gaps) < 0.04


def test_components_of_a_path_a_star_and_a_ring(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    ring = [(300 + i, 300 + (i + 1) % 9) for i in range(9)]
    got = {r.node: r.label for r in components(spark.createDataFrame(path + star + ring, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for _, i in star) and got[308] == 300


def test_groups_against_all_pairs(spark):
    """Exact copies, chains, a family of near copies of one text with links missing within it, and strangers."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"new{rng.randint(0, 10**6)}"
        rows.append((rng.randint(0, 10**9), " ".join(w)))
    chain = [f"c{k}" for k in range(120)]
    rows += [(1000 + k, " ".join(chain[4 * k : 4 * k + 60])) for k in range(14)]
    rows += [(2000 + k, "exactly the same text in some documents of the table") for k in range(30)]
    rows += [(3000 + k, " ".join(f"s{k}_{j}" for j in range(20))) for k in range(40)]
    rows += [(4000, ""), (4001, None), (4002, "one"), (4003, "ONE"), (4004, "one two"), (4005, "two one")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    plain = plain_components(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    got = near_duplicates(odd_frame(spark, "kept,component_id,bands"), 4).collect()
    assert len(got) == 12 and Counter(r.component_id for r in got)[1] == 3
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert near_duplicates(empty_frame(spark)).count() == 0
