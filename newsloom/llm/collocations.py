"""Phrase collocations: candidates level by level, exact counts by double-array tries."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.bytewords import Words, mixed, pieces, windows, words_of
from newsloom.llm.double_array import NONE, ROOT, build
from newsloom.llm.frames import small_batches
from newsloom.operators.keys import attach
from newsloom.sources.store import staged

LONGEST = 4
LEAST = 30
INSIDE_PERCENT = 80
FIRST = 2000
UNKNOWN = "und"
BLOCK_PHRASES = 200_000
# One bit per hash of a frequent phrase, in a table that is as large for any input.
TABLE_BITS = 27
PACK_BITS = 16
# Keys that a task holds before it gives them out; windows, which are wider, are a quarter of it.
KEYS_AT_ONCE = 1 << 22
# Words of the texts for one bucket of keys, and keys or windows that are sent at a time.
BUCKET_WORDS = 1_000_000
# Buckets for one partition of a shuffle, so that partitions are about even.
BUCKETS = 8
SENT_AT_ONCE = 1 << 17
LONGEST_PATH = 16

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BREAK = _PIECE_END.copy()
_BREAK[[32, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Pieces:
    """The words of some texts by piece, and the language of each."""

    def __init__(self, batch: pa.RecordBatch):
        words = words_of(batch.column("text"), _BREAK)
        ends = np.r_[0, np.cumsum(_PIECE_END[words.data])]
        parted = np.flatnonzero(ends[words.starts[1:]] != ends[words.ends[:-1]]) + 1
        starts = np.unique(np.r_[parted, words.offsets])
        self.text = words.text_of_word()
        self.words = Words(words.hashes, words.starts, words.ends, starts, words.data)
        coded = pc.fill_null(batch.column("lang").cast(pa.string()), UNKNOWN).dictionary_encode()
        self.langs, self.lang = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.seed = np.array([_number(lang) for lang in self.langs], np.uint64)

    def phrases(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all phrases of ``size`` words and the word that each begins with."""
        total, at, _ = windows(self.words, size)
        return mixed(total ^ self.seed[self.lang[self.text[at]]]), at

    def may(self, size: int, table: np.ndarray) -> np.ndarray:
        """Whether a phrase of ``size`` words that may be frequent begins with each word, and False behind the last."""
        may = np.zeros(len(self.text) + 1, bool)
        keys, at = self.phrases(size)
        may[at] = _in_table(table, keys)
        return may

    def within(self, size: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The phrases of ``size`` words both of whose parts of one word less may be frequent."""
        may = self.may(size - 1, table)
        keys, at = self.phrases(size)
        both = may[at] & may[at + 1]
        return keys[both], at[both]

    def reach(self, longest: int, table: np.ndarray) -> np.ndarray:
        """The size of the longest phrase from each word on that may be frequent; less than 2 is none."""
        size = np.ones(len(self.text), np.int64)
        may = self.may(1, table) if longest == 2 else None
        for k in range(2, longest):
            may = self.may(k, table)
            size[may[:-1] & (size == k - 1)] = k
        left = np.repeat(self.words.offsets[1:], np.diff(self.words.offsets)) - np.arange(len(size))
        size[may[:-1] & may[1:] & (left >= longest)] = longest
        return size

    def joined(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases of ``size`` words from the words ``at`` on, joined by single spaces, A-Z in lower case."""
        words = (at[:, None] + np.arange(size)).ravel()
        starts, sizes = self.words.starts[words], self.words.ends[words] - self.words.starts[words]
        # Each word is written behind a space, and the first space of a phrase is left out.
        room = sizes + 1
        room[::size] -= 1
        begin = np.cumsum(room) - sizes
        out = np.full(int(room.sum()), 32, np.uint8)
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(begin, sizes) + within] = _LOWER[self.words.data[np.repeat(starts, sizes) + within]]
        offsets = np.r_[0, np.cumsum(room.reshape(-1, size).sum(axis=1))].astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(out))


def _number(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Pieces]:
    for piece in pieces(batches):
        yield Pieces(piece)


def _runs(*ordered: np.ndarray) -> np.ndarray:
    """Where rows begin that differ in some column from the row before."""
    n = len(ordered[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for column in ordered:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _hashed(columns: np.ndarray) -> np.ndarray:
    total = np.zeros(columns.shape[1], np.uint64)
    for column in columns:
        total = mixed(total + column)
    return total


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of hashes, in the order of these."""
    return (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _dealt(bucket: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows that stand in the order of their buckets, as one row of bytes for each bucket."""
    for at in range(0, len(bucket), SENT_AT_ONCE):
        part = bucket[at : at + SENT_AT_ONCE]
        first = _runs(part)
        packed = {name: _packed(column[at : at + SENT_AT_ONCE], first) for name, column in columns.items()}
        yield _rows(bucket=pa.array(part[first].astype(np.int64)), **packed)


def _packed(column: np.ndarray, first: np.ndarray) -> pa.Array:
    """The bytes of the rows from each place of ``first`` to the next."""
    held = np.ascontiguousarray(column)
    offsets = (np.r_[first, len(held)] * (held.nbytes // max(len(held), 1))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(held)])


def _gathered(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), kind)


_DEALT = pa.schema(
    [("bucket", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("seed", pa.int64())]
    + [(name, pa.binary()) for name in ("keys", "counts", "windows", "hashes")]
    + [("words", pa.string()), ("key", pa.int64()), ("hash", pa.int64()), ("word", pa.string())]
)
_DEALT_SCHEMA = (
    "bucket long, lang string, n long, seed long, keys binary, counts binary, windows binary, hashes binary, "
    "words string, key long, hash long, word string"
)


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _DEALT], schema=_DEALT)


class Tally:
    """Keys of a task, given out with their numbers when they are many, a row for each bucket of keys."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(keys)
        self.held += len(keys)
        if self.held >= KEYS_AT_ONCE:
            yield from self.given_out()

    def given_out(self) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([*self.parts, np.empty(0, np.uint64)])
        self.__init__(self.buckets)
        keys.sort()
        first = _runs(keys)
        counts = np.diff(np.r_[first, len(keys)]).astype(np.uint32)
        keys = keys[first]
        yield from _dealt(_bucket(keys, self.buckets), keys=keys, counts=counts)


def _level(size: int, table, buckets: int):
    """Counts by key of phrases of ``size`` words both of whose parts of one word less may be frequent.

    ``table`` has the bits of these parts. For single words, every word is counted, and the words of each language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, total = Tally(buckets), {}
        for piece in _pieces(batches):
            if size == 1:
                langs = np.bincount(piece.lang[piece.text], minlength=len(piece.langs))
                for lang, n in zip(piece.langs, langs.tolist(), strict=True):
                    total[lang] = total.get(lang, 0) + n
            keys, _ = piece.phrases(1) if size == 1 else piece.within(size, table.value)
            yield from tally.add(keys)
        yield from tally.given_out()
        places = pa.array([_number(lang) % buckets for lang in total], pa.int64())
        yield _rows(bucket=places, lang=pa.array(total, pa.string()), n=pa.array(total.values(), pa.int64()))

    return count


def _frequent(least: int):
    """The keys of a bucket that occur ``least`` times or more, and the languages that were counted with them."""

    def summed(rows: pa.Table) -> pa.Table:
        keys, counts = _gathered(rows["keys"], np.uint64), _gathered(rows["counts"], np.uint32)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = _runs(keys)
        counts = np.add.reduceat(counts, first) if len(first) else counts
        often = counts >= least
        langs = rows.filter(pc.is_valid(rows["lang"])).select(["lang", "n"])
        found = pa.table({"key": keys[first][often].view(np.int64), "f": counts[often]})
        return pa.concat_tables([found, langs], promote_options="default").select(["key", "f", "lang", "n"])

    return summed


def _new(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand first that are not ``known``, and what is known with them; that starts anew when it is much."""
    new, first = np.unique(keys, return_index=True)
    fresh = ~_among(known, new)
    held = np.sort(np.r_[known, new[fresh]]) if len(known) < KEYS_AT_ONCE // 4 else new
    return first[fresh], held


def _among(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(keys), bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def _in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _table(keys: DataFrame) -> np.ndarray:
    """The bits of ``key``, packed in tasks; 16 MB come to the driver, whatever the number of keys."""
    place = F.shiftrightunsigned("key", 64 - TABLE_BITS)
    bits = keys.select(place.alias("bit")).distinct()
    pack = F.shiftright("bit", PACK_BITS)

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << PACK_BITS, np.uint8)
        held[rows["bit"].to_numpy() & ((1 << PACK_BITS) - 1)] = 1
        return pd.DataFrame({"pack": [key[0]], "bits": [np.packbits(held, bitorder="little").tobytes()]})

    made = bits.withColumn("pack", pack).groupBy("pack").applyInPandas(packed, "pack long, bits binary")
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    step = 1 << (PACK_BITS - 3)
    for row in made.collect():
        table[row["pack"] * step : (row["pack"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    return table


# A window is a column of numbers: how often it occurs, the language, the number of its words, their hashes, 0 behind the last.
_F, _LANG, _SIZE, _WORDS = 0, 1, 2, 3


def _summed(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal windows as one, with their number, behind their hashes, by which they are ordered.

    Windows of one hash are equal only if all their words are.
    """
    hashes = _hashed(windows[_LANG:])
    order = np.argsort(hashes)
    hashes, windows = hashes[order], windows[:, order]
    first = _runs(hashes, *windows[_LANG:])
    out = windows[:, first]
    out[_F] = np.add.reduceat(windows[_F], first) if len(first) else out[_F]
    return hashes[first], out


def _windows(longest: int, table, buckets: int):
    """The longest phrase from each word on that may be frequent, and each word of these once per task.

    Equal ones of a task are summed, and dealt out by all their words, so that a common beginning goes to many buckets.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, most = np.empty((_WORDS + longest, 0), np.uint64), np.empty(0, np.uint64), KEYS_AT_ONCE // 4
        parts, waiting = [held], 0
        spelled, langs = [], {}
        for piece in _pieces(batches):
            size = piece.reach(longest, table.value)
            at = np.flatnonzero(size > 1)
            size = size[at]
            windows = np.zeros((_WORDS + longest, len(at)), np.uint64)
            windows[_F], windows[_LANG], windows[_SIZE] = 1, piece.seed[piece.lang[piece.text[at]]], size
            inside = np.zeros(len(piece.text), bool)
            for k in range(longest):
                has = size > k
                windows[_WORDS + k, has] = piece.words.hashes[at[has] + k]
                inside[at[has] + k] = True
            keys, _ = piece.phrases(1)
            word = np.flatnonzero(inside)
            first, known = _new(known, keys[word])
            word = word[first]
            spelled.append((piece.seed[piece.lang[piece.text[word]]], keys[word], piece.words.hashes[word], piece.joined(word, 1)))
            langs |= dict(zip(piece.seed.tolist(), piece.langs, strict=True))
            if sum(len(x[0]) for x in spelled) >= most:
                yield _spelled(spelled, langs, buckets)
                spelled = []
            parts.append(windows)
            waiting += len(at)
            if waiting >= most:
                hashes, held = _summed(np.concatenate(parts, axis=1))
                if len(hashes) >= most // 2:
                    yield from _dealt(_bucket(hashes, buckets), windows=held.T)
                    held = held[:, :0]
                parts, waiting = [held], held.shape[1]
        hashes, held = _summed(np.concatenate(parts, axis=1))
        yield from _dealt(_bucket(hashes, buckets), windows=held.T)
        if spelled:
            yield _spelled(spelled, langs, buckets)

    return found


def _spelled(parts: list[tuple], langs: dict[int, str], buckets: int) -> pa.RecordBatch:
    """Words with their keys and hashes, a row for each bucket and language; words are parted by spaces, which none holds."""
    seed, key, word_hash = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:3])
    bucket = _bucket(key, buckets)
    order = np.lexsort((seed, bucket))
    seed, bucket = seed[order], bucket[order]
    first = _runs(bucket, seed)
    words = pa.concat_arrays([x[3] for x in parts]).take(pa.array(order))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(seed)].astype(np.int32)), words)
    return _rows(
        bucket=pa.array(bucket[first].astype(np.int64)), seed=pa.array(seed[first].view(np.int64)), words=pc.binary_join(lists, " "),
        lang=pa.array([langs[x] for x in seed[first].tolist()], pa.string()), keys=_packed(key[order], first), hashes=_packed(word_hash[order], first),
    )


def _words(rows: pa.Table) -> pa.Table:
    """The different words of what ``_spelled`` has made, a row each."""
    rows = rows.filter(pc.is_valid(rows["words"]))
    lists = pc.split_pattern(rows["words"], " ")
    row = pc.list_parent_indices(lists)
    words = pa.table(
        {
            "lang": rows["lang"].take(row), "seed": rows["seed"].take(row), "word": pc.list_flatten(lists),
            "key": _gathered(rows["keys"], np.int64), "hash": _gathered(rows["hashes"], np.int64),
        }
    )
    return words.group_by(words.column_names).aggregate([])


def _met(longest: int, least: int, blocks: int):
    """The windows of a bucket summed over all tasks, and dealt out anew in blocks by the language and the first two words.

    One of ``longest`` words that is too rare to be a candidate goes on without its last word.
    """

    def met(rows: pa.Table) -> pa.Table:
        _, windows = _summed(_gathered(rows["windows"], np.uint64).reshape(-1, _WORDS + longest).T)
        rare = (windows[_SIZE] == longest) & (windows[_F] < least)
        windows[_SIZE, rare] = longest - 1
        windows[-1, rare] = 0
        _, windows = _summed(windows[:, windows[_SIZE] > 1])
        block = _hashed(windows[[_LANG, _WORDS, _WORDS + 1]]) % np.uint64(blocks)
        order = np.argsort(block, kind="stable")
        dealt = [pa.Table.from_batches([x]) for x in _dealt(block[order], windows=windows[:, order].T)]
        words = _words(rows)
        bucket = pa.array((words["key"].to_numpy().view(np.uint64) % np.uint64(blocks)).astype(np.int64))
        words = words.append_column("bucket", bucket)
        return pa.concat_tables([_DEALT.empty_table(), *dealt, words], promote_options="default")

    return met


_COUNTED_SCHEMA = "seed long, hashes array<long>, f long, lang string, key long, hash long, word string"


def _counted(longest: int, least: int):
    """The phrases of a block with their numbers, and its words."""

    def counted(rows: pa.Table) -> pa.Table:
        words = rows.filter(pc.is_valid(rows["word"])).select(["lang", "seed", "key", "hash", "word"])
        _, windows = _summed(_gathered(rows["windows"], np.uint64).reshape(-1, _WORDS + longest).T)
        phrases, counts = _by_trie(windows, least)
        size = (phrases["word"] != NONE).sum(axis=1)
        offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
        hashes = phrases["hash"][phrases["word"] != NONE].view(np.int64)
        found = {"seed": phrases["lang"].view(np.int64), "hashes": pa.ListArray.from_arrays(offsets, hashes), "f": counts}
        names = ["seed", "hashes", "f", "lang", "key", "hash", "word"]
        return pa.concat_tables([pa.table(found), words], promote_options="default").select(names)

    return counted


def _by_trie(windows: np.ndarray, least: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The phrases of two words and more that windows begin with ``least`` times or more.

    Sums by hash, which can only be too much, tell which phrases go into the trie. Then all windows step through it at
    once, a word a step, and add their numbers to the states that end a phrase.
    """
    f, langs, hashes = windows[_F].astype(np.int64), windows[_LANG], windows[_WORDS:]
    candidates = [np.empty((0, 1 + len(hashes)), np.uint64)]
    sizes = [np.empty(0, np.int64)]
    for k in range(2, len(hashes) + 1):
        has = np.flatnonzero(windows[_SIZE] >= k)
        part = windows[_LANG : _WORDS + k, has]
        part[_SIZE - _LANG] = k
        key = _hashed(part)
        order = np.argsort(key)
        key, part = key[order], part[:, order]
        first = _runs(key)
        if not len(first):
            continue
        often = np.repeat(np.add.reduceat(f[has[order]], first) >= least, np.diff(np.r_[first, len(key)]))
        first = _runs(key, *part)
        first = first[often[first]]
        one = np.zeros((len(first), 1 + len(hashes)), np.uint64)
        one[:, 0], one[:, 1 : 1 + k] = part[0, first], part[_WORDS - _LANG :, first].T
        one = np.unique(one, axis=0)
        candidates.append(one)
        sizes.append(np.full(len(one), k))
    held, size = np.concatenate(candidates), np.concatenate(sizes)
    inside = np.arange(len(hashes)) < size[:, None]
    lang_of, word_of = np.unique(held[:, 0]), np.unique(held[:, 1:][inside])
    word = np.where(inside, np.searchsorted(word_of, held[:, 1:]), NONE)
    counts = np.zeros(len(held), np.int64)
    if len(held):
        trie = build(np.c_[np.searchsorted(lang_of, held[:, 0]), word])
        at = np.arange(len(f))
        go, state = trie.step(np.full(len(at), ROOT), _placed(lang_of, langs))
        at = at[go]
        for k in range(len(hashes)):
            inner = windows[_SIZE, at] > k
            at, state = at[inner], state[inner]
            go, state = trie.step(state, _placed(word_of, hashes[k, at]))
            at = at[go]
            ended = trie.accepts[state]
            np.add.at(counts, ended[ended != NONE], f[at[ended != NONE]])
    often = counts >= least
    return {"lang": held[often, 0], "hash": held[often, 1:], "word": word[often]}, counts[often]


def _placed(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of keys in ``ordered``, NONE for others."""
    return np.where(_among(ordered, keys), np.searchsorted(ordered, keys), NONE)


def _occurrences(texts: DataFrame, longest: int, least: int, block_phrases: int) -> tuple[DataFrame, DataFrame]:
    """``lang, n``, and ``lang, phrase, k, f`` of the frequent phrases of 2 to ``longest`` words and of their words."""
    spark = texts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, table, bits = BUCKETS * partitions, None, np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    held = 0
    for size in range(1, longest):
        level = texts.mapInArrow(_level(size, table, buckets), _DEALT_SCHEMA).select("bucket", "keys", "counts", "lang", "n")
        level = staged(level.groupBy("bucket").applyInArrow(_frequent(least), "key long, f long, lang string, n long"))
        if table is not None:
            table.destroy()
        frequent = level.filter(F.col("key").isNotNull()).select("key", "f")
        if size == 1:
            words = frequent
            sizes = staged(level.filter(F.col("key").isNull()).groupBy("lang").agg(F.sum("n").alias("n")))
            buckets = max(buckets, (sizes.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS)
        else:
            held += frequent.count()
        bits |= _table(frequent)
        table = spark.sparkContext.broadcast(bits)
    blocks = max(buckets, held // block_phrases + 1)
    windows = texts.mapInArrow(_windows(longest, table, buckets), _DEALT_SCHEMA)
    windows = windows.select("bucket", "windows", "lang", "seed", "keys", "hashes", "words")
    windows = windows.groupBy("bucket").applyInArrow(_met(longest, least, blocks), _DEALT_SCHEMA)
    windows = windows.select("bucket", "windows", "lang", "seed", "key", "hash", "word")
    found = windows.groupBy("bucket").applyInArrow(_counted(longest, least), _COUNTED_SCHEMA)
    found = staged(found)
    table.destroy()
    # Within a language a word's key is a bijection of its hash, so the first level has counted the words.
    spelled = found.filter(F.col("word").isNotNull()).select("seed", "lang", "key", "hash", "word")
    spelled = staged(spelled.join(words, "key").select("seed", "lang", "hash", "word", "f"))
    parts = found.filter(F.col("hashes").isNotNull()).select("seed", "hashes", "f", F.posexplode("hashes").alias("at", "hash"))
    parts = parts.join(spelled.drop("f"), ["seed", "hash"]).groupBy("lang", "seed", "hashes", "f")
    phrases = parts.agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    phrases = phrases.select("lang", F.array_join("words.word", " ").alias("phrase"), F.size("hashes").alias("k"), "f")
    return sizes, phrases.union(spelled.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "f"))


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    inside_percent: int = INSIDE_PERCENT,
    first: int = FIRST,
    block_phrases: int = BLOCK_PHRASES,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of 2 to ``longest`` words that hold together, by language.

    Texts (``text, lang``) are cut into pieces at ``.,;:!?`` and line ends, A-Z in lower case, and pieces into words at
    spaces and tabs. A candidate occurs ``least`` times or more (``a``). Cut after some word, with ``l`` and ``r``
    occurrences of its two parts, it scores ``2000000 * a div (l + r)``; its weakest cut counts. It is dropped if it stands in a longer candidate
    that has at least ``inside_percent`` of its occurrences.

    * Candidates are found level by level: a phrase is counted, by a 64-bit hash, only where both its parts of one word
      less may be frequent, which a table of 2**27 bits tells, the same size for any input. Sums are made in the tasks before
      they are shuffled, a row of bytes for each bucket of keys.
    * The last pass takes from each word on the longest phrase that may be frequent, as the hashes of its words, and sums equal
      ones in the task and then in buckets by all their words. Those then go to blocks by their first two words, each with a
      double-array trie of about ``block_phrases`` phrases at most: all step through it at once, one word a step, and their
      numbers are added to the states that end a phrase.
      So the texts are read ``longest`` times, however many phrases there are.
    * A null text is empty; a null language is ``und``, like that language itself.
    * Every row counts, repeated rows too; ids are not looked at, nor are columns besides ``text`` and ``lang``.
    * Equal scores go by ``a``, then by the phrase's bytes. An empty table gives an empty table.
    """
    if not 2 <= longest < LONGEST_PATH:
        raise ValueError(f"longest must be from 2 to {LONGEST_PATH - 1}")
    small_batches(docs)
    texts = docs.select("text", F.col("lang").cast("string"))
    sizes, counts = _occurrences(texts, longest, least, block_phrases)
    counts = staged(counts)
    if counts.filter("k > 1").isEmpty():
        schema = "lang string, rank int, phrase string, a long, l long, r long, n long, score long"
        return docs.sparkSession.createDataFrame([], schema)
    scored = _scored(counts).join(_covered(counts, inside_percent), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(counts: DataFrame) -> DataFrame:
    """Each candidate with its weakest cut. A part may belong to many candidates, so cuts are dealt out."""
    words = F.split("phrase", " ")
    cuts = counts.filter("k > 1").select("lang", "phrase", "f", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = staged(
        cuts.select(
            "lang", "phrase", F.col("f").alias("a"), "cut",
            F.struct("lang", F.array_join(F.slice(words, 1, F.col("cut")), " ").alias("phrase")).alias("left"),
            F.struct("lang", F.array_join(F.slice(words, F.col("cut") + 1, F.col("k")), " ").alias("phrase")).alias("right"),
            F.xxhash64("lang", "phrase", "cut").alias("row"),
        )
    )
    of = counts.select(F.struct("lang", "phrase").alias("part"), "f")
    lefts = of.select(F.col("part").alias("left"), F.col("f").alias("l"))
    rights = of.select(F.col("part").alias("right"), F.col("f").alias("r"))
    met = attach(attach(cuts, lefts, "left", "row"), rights, "right", "row")
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)")
    met = met.withColumn("score", score.cast("long"))
    weakest = F.min(F.struct("score", "cut", "l", "r")).alias("w")
    return met.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "w.score", "w.l", "w.r")


def _covered(counts: DataFrame, percent: int) -> DataFrame:
    """Candidates that stand in a longer one with nearly as many occurrences."""
    words = F.split("phrase", " ")
    longer = counts.filter("k > 2").select("lang", "k", "f", words.alias("words"))
    longer = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inner = longer.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase"), "f")
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    met = counts.filter("k > 1").join(most, ["lang", "phrase"])
    return met.filter(F.col("most") * 100 >= F.col("f") * percent).select("lang", "phrase")
