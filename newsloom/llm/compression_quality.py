"""Quality scores from how well dictionaries of good and of bad text compress a document."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.bytewords import pieces
from newsloom.llm.frames import bounded, cleared, small_batches
from newsloom.llm.sampling import bounded_sample
from newsloom.llm.text import learnable

FOLDS, HELD_OUT = 5, 0
PER_LABEL = 1500
DICTIONARY_TEXT = 4 << 20
DICTIONARY_BYTES = 256 << 10
LEVEL = 3
THRESHOLD = 0.3
# Bytes by which short texts are drawn towards "no difference".
DAMPING = 48
# Differences of more than about 1 / STEEP count alike.
STEEP = 30


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of ``DICTIONARY_BYTES``; of too few texts to be trained on, their own bytes."""
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, texts, k=128, d=8).as_bytes()
    except zstd.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstd.ZstdCompressor:
    options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    settings = zstd.ZstdCompressionParameters.from_level(LEVEL, format=zstd.FORMAT_ZSTD1_MAGICLESS, **options)
    content = zstd.ZstdCompressionDict(dictionary)
    content.precompute_compress(compression_params=settings)
    return zstd.ZstdCompressor(dict_data=content, compression_params=settings)


class Sizes:
    """Compressed sizes of texts with the dictionaries of good and of bad text."""

    def __init__(self, dictionaries: dict[int, bytes]):
        self.good, self.bad = (_compressor(dictionaries[label]) for label in (1, 0))

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text: 1, the normalised difference of both sizes, the share left by the better one, its square.

        The difference tells good from bad wording; a text that repeats itself is small with either
        dictionary, which the share left shows.
        """
        sizes = [(len(t), len(self.good.compress(t)), len(self.bad.compress(t))) for t in texts]
        raw, good, bad = np.array(sizes, float).reshape(-1, 3).T
        difference = (bad - good) / (bad + good + DAMPING)
        left = np.log((np.minimum(good, bad) + DAMPING) / (raw + 2 * DAMPING))
        return np.stack([np.ones(len(raw)), np.tanh(STEEP * difference), left, left * left], axis=1)


def _calibrated(x: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights of a logistic curve from features to the chance of label 1, by Newton's method.

    Steps are halved until the loss falls; a ridge on the features, taken as multiples of their deviations,
    keeps the curve finite where the labels are parted without error.
    """
    scale = np.r_[1.0, x[:, 1:].std(axis=0) + 1e-9]
    middle = np.r_[0.0, x[:, 1:].mean(axis=0)]
    z = (x - middle) / scale
    hold = ridge * np.r_[0.0, np.ones(x.shape[1] - 1)]

    def loss(w: np.ndarray) -> float:
        return weight @ (np.logaddexp(0, z @ w) - label * (z @ w)) + (hold * w * w).sum() / 2

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (label - p)) - hold * w
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(hold + 1e-9)
        step = np.linalg.solve(bend, slope)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-10:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-6:
            break
    w = w / scale
    return np.r_[w[0] - w[1:] @ middle[1:], w[1:]]


def train(
    docs: DataFrame,
    labels: DataFrame,
    per_label: int = PER_LABEL,
    dictionary_text: int = DICTIONARY_TEXT,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
) -> tuple[dict[int, bytes], list[float]] | None:
    """Dictionaries and calibration from at most ``per_label`` labelled documents of each quality.

    Two thirds of them, up to ``dictionary_text`` bytes in hash order, make the dictionaries, one task per label; the others
    are compressed with both, and the curve is fitted to their sizes, weighted to the
    labels' shares among all labelled rows. Rows of the held-out fold, without a label, or with both labels are not used.
    ``None`` if a label has no document to learn from.
    """
    small_batches(docs)
    known = labels.filter(F.col("quality").isin(0, 1) & learnable(F.col("doc_id"), folds, held_out))
    one = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    one = one.filter(F.col("quality") == F.col("_most")).drop("_most")
    counts = {r["quality"]: r["n"] for r in one.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = bounded_sample(one, "quality", per_label)
    texts = docs.select("doc_id", "text").join(bounded(chosen), "doc_id").filter(F.length("text") > 0)
    texts = texts.withColumns(
        {"lot": F.xxhash64(F.lit("dictionary"), "doc_id"), "for_curve": F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0}
    )

    def dictionary(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        room, taken = dictionary_text, []
        for text in rows.sort_values(["lot", "doc_id", "text"])["text"]:
            taken.append(text.encode("utf-8", "replace"))
            room -= len(taken[-1])
            if room < 0:
                break
        return pd.DataFrame({"quality": [key[0]], "content": [_dictionary(taken)]})

    made = texts.filter(~F.col("for_curve")).groupBy("quality").applyInPandas(dictionary, "quality int, content binary")
    dictionaries = {r["quality"]: bytes(r["content"]) for r in made.collect()}
    if set(dictionaries) != {0, 1}:
        return None

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Sizes(dictionaries)
        for batch in pieces(batches):
            x = compressors.features([t.as_buffer().to_pybytes() for t in batch.column("text")])
            kept = [batch.column("doc_id"), batch.column("quality").cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"]
            )

    measured = texts.filter("for_curve").select("doc_id", "quality", "text")
    rows = measured.mapInArrow(sizes, "doc_id long, quality int, x array<double>").orderBy("doc_id").collect()
    label = np.array([r["quality"] for r in rows], float)
    if len(set(label)) < 2:
        return None
    share = {q: counts[q] / (label == q).sum() for q in (0, 1)}
    weight = np.where(label == 1, share[1], share[0])
    weight *= len(label) / weight.sum()
    return dictionaries, _calibrated(np.array([r["x"] for r in rows]), label, weight).tolist()


def score(docs: DataFrame, model: tuple[dict[int, bytes], list[float]] | None) -> DataFrame:
    """``docs`` with ``score``, the chance of label 1, and ``predicted``, 1 from ``THRESHOLD`` on.

    * A null text is scored like an empty one; both get what the curve says of no bytes.
    * Without a model every score is 0.5. Equal texts get equal scores.
    * Other columns are passed through, but for any named ``score`` or ``predicted``, which are replaced.
    * An empty table gives an empty table.
    """
    small_batches(docs)
    docs = cleared(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        compressors = Sizes(learned[0]) if learned else None
        for batch in pieces(batches):
            value = np.full(batch.num_rows, 0.5)
            if learned:
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
                x = compressors.features(texts)
                value = 1 / (1 + np.exp(-np.clip(x @ np.array(learned[1]), -30, 30)))
            arrays = [*batch.columns, pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "score", "predicted"])

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, *added]))
