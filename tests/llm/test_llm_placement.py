"""Sharding, token counts, decontamination and the pipeline against plain versions."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from conftest import SF
from llm_cases import empty_frame, odd_frame, odd_rows

from newsloom.llm.bytewords import NOT_ALNUM, words_of
from newsloom.llm.decontamination import leaks, without_leaks
from newsloom.llm.registered import VOCABULARY, op2_shard_placement, op3_token_counts
from newsloom.llm.sharding import lookup_table, place, write_shards
from newsloom.llm.string_tiling import tiles
from newsloom.llm.token_counts import PATTERN, read_ranks, read_token_files, scan, token_counts


def test_table_shares_are_equal_and_most_slots_stay():
    names = [f"s{i}" for i in range(10)]
    full = lookup_table(names, 1009)
    assert set(Counter(full.tolist()).values()) <= {100, 101}
    fewer = lookup_table(names[:-1], 1009)
    stayed = full != sorted(names).index("s9")
    assert (full[stayed] == fewer[stayed]).mean() > 0.75
    with pytest.raises(ValueError):
        lookup_table(names, 1000)


def plain_table(names, slots):
    from newsloom.llm.sharding import _number

    prefer = []
    for x in names:
        offset, skip = _number(x, "offset") % slots, _number(x, "skip") % (slots - 1) + 1
        prefer.append([(offset + j * skip) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i in range(len(names)):
            if len(owner) < slots:
                owner[next(s for s in prefer[i] if s not in owner)] = i
    return [owner[s] for s in range(slots)]


def test_placement_against_plain_version(spark, tmp_path):
    import hashlib

    names = [f"s{i}" for i in range(7)]
    owner = plain_table(names, 101)
    assert lookup_table(names, 101).tolist() == owner
    got = place(odd_frame(spark, "slot,shard"), names, 101)
    for r in got.collect():
        slot = int(hashlib.md5(str(r.doc_id if r.doc_id is not None else "").encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, names[owner[slot]])
    assert got.count() == 12 and place(empty_frame(spark)).count() == 0
    write_shards(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    whole = op2_shard_placement(spark, SF)
    assert whole.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=read_ranks(VOCABULARY), special_tokens={})


def test_counts_equal_encoding_each_text(spark, coder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wanted = {r.doc_id: len(coder.encode_ordinary(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in op3_token_counts(spark, SF).collect()} == wanted


def test_counts_of_odd_rows_over_small_blocks(spark, coder):
    wanted = Counter((r[0], len(coder.encode_ordinary(r[1] or ""))) for r in odd_rows())
    got = token_counts(odd_frame(spark, "file,block"), VOCABULARY, block_tokens=64).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == wanted
    assert token_counts(empty_frame(spark), VOCABULARY).count() == 0


def test_scan_of_flat_files_against_one_pass(spark, tmp_path):
    rng = np.random.default_rng(5)
    wanted = []
    for name in "ab":
        ids = rng.choice(np.array([7, 1, 2, 3], "<u2"), 5000 if name == "a" else 777, p=[0.02, 0.4, 0.3, 0.28])
        ids.tofile(tmp_path / f"{name}.bin")
        stops = [*np.flatnonzero(ids == 7).tolist()]
        start = 0
        for n, stop in enumerate([*stops, *([len(ids)] if ids[-1] != 7 else [])]):
            wanted.append((name, n, start, stop - start, n < len(stops)))
            start = stop + 1
    for size in (3, 50, 100_000):
        blocks = read_token_files(spark, str(tmp_path / "*.bin"), block_tokens=size)
        got = [(r.file[-5], r.ordinal, r.start, r.n_tokens, r.complete) for r in scan(blocks, 7).collect()]
        assert sorted(got) == sorted(wanted)


def plain_tiles(text, pattern, least):
    """Greedy string tiling as first described: all places compared, again and again."""
    free_a, free_b, found = [True] * len(text), [True] * len(pattern), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(pattern)):
            for i in range(len(text)):
                k = 0
                while (
                    i + k < len(text) and j + k < len(pattern)
                    and free_a[i + k] and free_b[j + k] and text[i + k] == pattern[j + k]
                ):
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return found
        free_a[i : i + k] = free_b[j : j + k] = [False] * k
        found += k


def test_tiles_cover_what_plain_tiling_covers():
    rng = np.random.default_rng(6)
    for _ in range(1500):
        pattern = rng.integers(1, 30, rng.integers(5, 25)).astype(np.uint64)
        parts = np.array_split(pattern, rng.integers(1, 4))
        rng.shuffle(parts)
        noise = [rng.integers(1, 30, rng.integers(0, 8)).astype(np.uint64) for _ in parts]
        text = np.concatenate([x for pair in zip(parts, noise, strict=True) for x in pair])
        got = tiles(text, pattern, 3)
        for i, j, k in got:
            assert (text[i : i + k] == pattern[j : j + k]).all() and k >= 3
        assert len({i + n for i, _, k in got for n in range(k)}) == sum(k for *_, k in got)
        assert sum(k for *_, k in got) == plain_tiles(text.tolist(), pattern.tolist(), 3)


def test_leaks_of_whole_reordered_and_partial_items(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    texts = {
        1: f"before it. {item.upper()}! after it",
        2: " ".join([*w[10:], "and", *w[:10]]),
        3: " ".join(w[:8]),
        4: " ".join(f"{x} no" for x in w),
        5: None,
        6: "",
        7: "x " * 20_000 + ", ".join(w),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "too short"), (13, item)], "item_id long, text string")
    for block in (1, 1000):
        got = leaks(docs, bench, block_words=block)
        assert sorted((r.doc_id, r.item_id, r.coverage) for r in got.collect()) == [
            (i, n, 1.0) for i in (1, 2, 7) for n in (10, 13)
        ]
    assert {r.doc_id for r in without_leaks(docs, bench).collect()} == {3, 4, 5, 6}
    assert leaks(docs, bench.limit(0)).count() == leaks(docs.limit(0), bench).count() == 0
    assert leaks(odd_frame(spark, "item_id"), bench).count() == 0


def test_leaks_of_the_given_documents_against_every_pair(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    found = {(r.doc_id, r.item_id) for r in leaks(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))).collect()}
    of = lambda text: words_of(pa.array([text]), NOT_ALNUM).hashes.tolist()
    items = {b.item_id: of(b.text) for b in bench}
    for d in docs:
        w = of(d.text)
        windows = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for n, b in items.items():
            seeded = {i + k for i in range(len(b) - 4) if tuple(b[i : i + 5]) in windows for k in range(5)}
            if len(seeded) < 0.5 * len(b):
                assert (d.doc_id, n) not in found
            elif len(seeded) == len(b) and any(w[i : i + len(b)] == b for i in range(len(w))):
                assert (d.doc_id, n) in found


def test_pipeline_bears_odd_rows_and_an_empty_table(spark, tmp_path):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, docs in (("odd", odd_frame(spark)), ("empty", empty_frame(spark))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    lettered = {r[0] for r in odd_rows() if r[1] and any(c.isalpha() for c in r[1])}
    assert rows and {r.doc_id for r in rows} <= lettered - {2}
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_pipeline_keeps_its_promises(spark):
    from newsloom.llm.mixing import mixed_sizes
    from newsloom.sources.store import staged

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(staged(stage(spark, seen[-1], SF)))
    assert all(df.columns == columns for df in seen[:-1])
    known, alone, clean, mixed, placed = ({r.doc_id for r in df.select("doc_id").collect()} for df in seen[1:])
    assert known >= alone >= clean >= mixed == placed
    leaked = {r.doc_id for r in leaks(seen[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert alone - clean == leaked
    copies = Counter({r.doc_id: r.copies for r in mixed_sizes(seen[3]).collect() if r.copies})
    final = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in final.select("doc_id").collect()) == copies
    assert final.columns == [*columns, "slot", "shard"]
