"""Main text of HTML pages by a conditional random field over their leaf blocks."""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm import crf
from newsloom.llm.bytewords import pieces
from newsloom.llm.frames import bounded, cleared, small_batches
from newsloom.llm.html_blocks import FURNITURE_MARKS, MAIN, Block, leaf_blocks
from newsloom.llm.sampling import bounded_sample

SIZE = 1 << 13
TRAINING_PAGES = 300
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog button".split())
# Labelled layouts: label, elements from outside in, class words, kind of text; pages are parted by blank lines.
LAYOUTS = """
0 header.div site,logo short
0 header.nav.ul.li menu menu
0 header.nav.ul.li menu menu
1 main.article.h1 - short
1 main.article.p content text
1 main.article.p content text
1 main.article.h2 content short
1 main.article.p content text
0 main.article.aside.p related text
0 aside.p sidebar text
0 section.div.p comments,comment text
0 section.div.p comments,comment text
0 footer.p footer legal

0 div.ul.li menu menu
0 div.ul.li menu menu
0 div.p cookie,notice text
1 div.h1 content,post short
1 div.p content,post text
1 div.p content,post text
1 div.ul.li content,post text
1 div.ul.li content,post text
1 div.p content,post text
0 div.p advert text
1 div.p content,post text
0 div.form.label subscribe short
0 div.form.p newsletter text
0 div.h3 comments short
0 div.ul.li.p comments,comment text
0 div.ul.li.p comments,comment text
0 div.p footer legal

0 nav.ul.li - menu
0 nav.ul.li - menu
0 div ad text
1 article.h1 - short
1 article.blockquote.p - text
1 article.p - text
1 article.table.tr.td - short
1 article.table.tr.td - short
1 article.p - text
0 article.div.p share short
0 article.div.p ad text
1 article.p - text
0 article.section.p comments text
0 footer - legal

0 header.p - short
0 div.p breadcrumb menu
1 section.h1 entry short
1 section.p entry text
1 section.p entry text
1 section.p entry text
0 aside.h3 - short
0 aside.ul.li - menu
0 aside.p - text
0 form.p search short
0 div.p notice,alert text
0 footer.div.p - legal

0 nav.ul.li - menu
1 article.header.h1 - short
1 article.p - text
0 article.aside.p - text
1 article.p - text
0 article.nav.ul.li toc menu
0 article.aside.h3 - short
0 article.aside.p - text
1 article.h2 - short
1 article.p - text
0 article.form.p - text
1 article.p - text
0 article.div.p promo text
0 article.footer.p - text
0 article.div.div.p comments,comment text
0 footer.p - legal
""".strip()


def _bucket(n: int) -> int:
    return min(n.bit_length(), 12)


def _hashed(name: str) -> int:
    return zlib.crc32(name.encode()) % SIZE


class Features:
    """Feature numbers of blocks; what depends on the elements around them is kept for the next block."""

    def __init__(self):
        self.known: dict[tuple, list[int]] = {}

    def of(self, block: Block) -> list[int]:
        around = self.known.get((block.tags, block.marks))
        if around is None:
            names = {f"in:{t}" for t in block.tags} | {f"mark:{m}" for m in block.marks}
            names |= {f"last:{block.tags[-1] if block.tags else ''}", "any"}
            if FURNITURE_TAGS & set(block.tags):
                names.add("furniture")
            if FURNITURE_MARKS & set(block.marks):
                names.add("furniture mark")
            around = self.known[(block.tags, block.marks)] = sorted({_hashed(x) for x in names})
        text = block.text
        n_words = text.count(" ") + 1
        own = {
            _hashed(f"words:{_bucket(n_words)}"),
            _hashed(f"linked:{4 * block.linked // len(text)}"),
            _hashed("ends" if text[-1] in ".!?…\"”»" else "no end"),
            _hashed(f"stops:{_bucket(text.count('. ') + text.count(', '))}"),
        }
        if "©" in text:
            own.add(_hashed("sign"))
        return around + [x for x in own if x not in around]


def weak_labels(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that says itself what its main part is, by an article or main element; else ``None``."""
    if not any(MAIN & set(b.tags) for b in blocks):
        return None
    out = []
    for b in blocks:
        inside = MAIN & set(b.tags)
        within = b.tags[min(b.tags.index(t) for t in inside) :] if inside else ()
        furniture = FURNITURE_TAGS & set(within) or FURNITURE_MARKS & set(b.marks)
        out.append(int(bool(inside) and not furniture))
    return out


def _layout_pages(texts: list[str]) -> list[tuple[list[Block], list[int]]]:
    """The layouts several times over, with texts of given pages in their blocks."""
    texts = texts or ["A line of text that stands here, long enough to be one. It has another sentence."]
    pages, at = [], 0
    for _ in range(30):
        for layout in LAYOUTS.split("\n\n"):
            blocks, labels = [], []
            for line in layout.splitlines():
                label, tags, marks, kind = line.split()
                text = texts[at % len(texts)]
                at += 1
                words = text.split()
                text = {"menu": words[0], "short": " ".join(words[:5]), "legal": "© " + " ".join(words[:8])}.get(kind, text)
                found = () if marks == "-" else tuple(marks.split(","))
                linked = len(text) if kind == "menu" else 0
                blocks.append(Block(text, ("html", "body", *tags.split(".")), found, linked))
                labels.append(int(label))
            pages.append((blocks, labels))
    return pages


def learn(pages: list[str]) -> np.ndarray:
    """Weights learned from the pages that label themselves and from the labelled layouts.

    Each such page is learned a second time without its article and main elements, so that the words around
    and in the other blocks are learned as well.
    """
    labelled, texts = [], []
    for page in pages:
        blocks = leaf_blocks(page)
        labels = weak_labels(blocks)
        if labels:
            labelled.append((blocks, labels))
            bare = [Block(b.text, tuple(t for t in b.tags if t not in MAIN), b.marks, b.linked) for b in blocks]
            labelled.append((bare, labels))
            texts += [b.text for b, label in zip(blocks, labels, strict=True) if label and b.text.count(" ") > 5]
    features = Features()
    labelled += _layout_pages(texts)
    return crf.train([([features.of(b) for b in blocks], labels) for blocks, labels in labelled], SIZE).packed()


def train(pages: DataFrame, most: int = TRAINING_PAGES) -> list[float]:
    """Weights from at most ``most`` pages, drawn by hash and learned in one task; only they come to the driver."""
    rows = pages.select(F.col("page_id").alias("doc_id"), "html").filter(F.length("html") > 0)
    chosen = bounded_sample(rows.select("doc_id", F.lit("page").alias("kind")), "kind", most)

    def fit(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        pages = sample.sort_values(["doc_id", "html"])["html"].tolist()
        return pd.DataFrame({"weights": [learn(pages).tolist()]})

    sample = rows.join(bounded(chosen), "doc_id")
    fitted = sample.groupBy("kind").applyInPandas(fit, "weights array<double>").collect()
    return fitted[0]["weights"] if fitted else learn([]).tolist()


def extract(pages: DataFrame, weights: list[float]) -> DataFrame:
    """``pages`` with ``text``, the blocks that the field labels as main text, parted by empty lines, and ``n_chars``.

    * A null or empty page, and one without main text, has an empty text.
    * Pages are read one by one, whole: equal pages give equal texts, an empty table an empty one.
    * Other columns are passed through, but for any named ``text`` or ``n_chars``, which are replaced.
    """
    small_batches(pages)
    pages = cleared(pages, "text", "n_chars")
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, features = crf.Field.unpacked(np.array(shared.value)), Features()
        for batch in pieces(batches, "html"):
            texts = []
            for page in batch.column("html").to_pylist():
                blocks = leaf_blocks(page)
                labels = field.viterbi([features.of(b) for b in blocks])
                texts.append("\n\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label))
            arrays = [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "text", "n_chars"])

    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return pages.mapInArrow(read, T.StructType([*pages.schema.fields, *added]))
