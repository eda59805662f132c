"""Language identification: the family first, then the languages within it by pairs."""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm import svm
from newsloom.llm.bytewords import pieces
from newsloom.llm.frames import cleared, of_ids, small_batches
from newsloom.llm.sampling import bounded_sample
from newsloom.llm.text import learnable

UNKNOWN = "und"
PER_LANGUAGE = 400
SLOTS = 4096
FOLDS, HELD_OUT = 4, 2
STEEP = 3.0
# Languages not listed are a family of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi mr ne bn as or pa gu sa ur",
    "dravidian": "ta te kn ml",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "malayic": "id ms jv su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


_LETTER = np.array([chr(c).isalpha() for c in range(0x300)])


def features(text: str) -> np.ndarray:
    """Shares of hashed letters, pairs and triples of a whole text, as roots, so that frequent ones do not rule.

    Case is folded; what is no letter is a gap, and gaps are one long.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[np.minimum(points, 0x2FF)] | (points >= 0x300)
    points = np.where(letter, points, 32).astype(np.uint32)
    points = points[letter | np.r_[True, letter[:-1]]]
    total = np.zeros(SLOTS, np.float32)
    for n in (1, 2, 3):
        if len(points) < n:
            break
        hashed = np.full(len(points) - n + 1, n, np.uint32)
        for k in range(n):
            hashed = (hashed + points[k : len(points) - n + 1 + k]) * np.uint32(0x9E3779B1)
            hashed ^= hashed >> np.uint32(15)
        counts = np.bincount(hashed % SLOTS, minlength=SLOTS)
        total += np.sqrt(counts / len(hashed), dtype=np.float32)
    return total / np.sqrt(total @ total)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, folds: int = FOLDS, held_out: int = HELD_OUT) -> dict:
    """Machines learned from at most ``per_language`` documents of each language outside the held-out fold.

    ``{"family": {family: weights}, "pair": {(x, y): weights}, "langs": [...]}``. A family's machine parts it from all
    others; a pair's machine parts two languages of a family. Each is trained in a task of its own, of at
    most ``per_language`` rows per language; the weights are all that comes to the driver. Rows that share an id and a
    language are drawn, or left, together.
    """
    small_batches(docs)
    usable = docs.filter(
        F.col("lang").isNotNull() & learnable(F.col("doc_id"), folds, held_out) & F.rlike("text", F.lit("\\p{L}"))
    )
    chosen = bounded_sample(usable.select("doc_id", "lang"), "lang", per_language)
    langs = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    families = sorted({family_of(x) for x in langs})
    pairs = [(x, y) for x, y in combinations(langs, 2) if family_of(x) == family_of(y)]

    def roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))
            for doc, lang, text in zip(*columns, strict=True):
                if not has_letter(text):
                    continue
                packed = features(text).tobytes()
                if len(families) > 1:
                    rows += [("family", f, "", 1.0 if family_of(lang) == f else -1.0, doc, packed) for f in families]
                rows += [("pair", x, y, 1.0 if lang == x else -1.0, doc, packed) for x, y in pairs if lang in (x, y)]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["kind", "x", "y", "sign", "doc_id", "row"])

    def machine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "sign"])
        x = np.frombuffer(b"".join(rows["row"]), np.float32).reshape(len(rows), SLOTS)
        weights = svm.train(x, rows["sign"].to_numpy())
        return pd.DataFrame({"kind": [key[0]], "x": [key[1]], "y": [key[2]], "weights": [weights.tolist()]})

    texts = of_ids(usable.select("doc_id", "lang", "text"), chosen.select("doc_id"))
    rows = texts.mapInArrow(roles, "kind string, x string, y string, sign double, doc_id long, row binary")
    made = rows.groupBy("kind", "x", "y").applyInPandas(machine, "kind string, x string, y string, weights array<double>")
    model = {"family": {}, "pair": {}, "langs": langs}
    for r in made.collect():
        model[r["kind"]][r["x"] if r["kind"] == "family" else (r["x"], r["y"])] = r["weights"]
    return model


def _choose(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language of each row of ``x`` and how sure that is: the chances of the family and of its weakest pair."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    chance = lambda margin: 1 / (1 + np.exp(-STEEP * margin))
    families = sorted({family_of(lang) for lang in model["langs"]})
    if model["family"]:
        margins = np.stack([x @ np.asarray(model["family"][f]) for f in families], axis=1)
        best, sure = margins.argmax(axis=1), chance(margins.max(axis=1))
    else:
        best, sure = np.zeros(len(x), int), np.ones(len(x))
    out = np.empty(len(x), object)
    for f, family in enumerate(families):
        mine = np.flatnonzero(best == f)
        langs = [lang for lang in model["langs"] if family_of(lang) == family]
        votes = np.zeros((len(mine), len(langs)))
        sums = np.zeros((len(mine), len(langs)))
        weakest = np.full((len(mine), len(langs)), np.inf)
        for (a, b), weights in model["pair"].items():
            if a in langs:
                i, j = langs.index(a), langs.index(b)
                margin = x[mine] @ np.asarray(weights)
                votes[:, i] += margin > 0
                votes[:, j] += margin <= 0
                sums[:, i] += margin
                sums[:, j] -= margin
                weakest[:, i] = np.minimum(weakest[:, i], margin)
                weakest[:, j] = np.minimum(weakest[:, j], -margin)
        # Most votes; of equals, the largest sum of margins.
        won = (votes + chance(sums) / 2).argmax(axis=1)
        out[mine] = np.array(langs, object)[won]
        if len(langs) > 1:
            sure[mine] *= chance(weakest[np.arange(len(mine)), won])
    return out.tolist(), sure


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from the whole text alone.

    * A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing could be learned.
    * Equal texts get equal answers. Other columns are passed through, but for any named ``lang_pred`` or ``score``, which are replaced.
    * An empty table gives an empty table.
    """
    small_batches(docs)
    docs = cleared(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            known = [i for i, text in enumerate(texts) if shared.value["langs"] and has_letter(text)]
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                found, sure = _choose(shared.value, np.stack([features(texts[i]) for i in known]))
                for i, lang in zip(known, found, strict=True):
                    langs[i] = lang
                scores[known] = sure
            arrays = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *added])
    return docs.mapInArrow(predict, schema)
