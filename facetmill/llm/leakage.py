"""Evaluation passages inside a corpus (problem 7).

A passage leaks if a document holds ``span`` consecutive words of an item. Items are short and documents long, so
both are cut by size before they are compared: every run of ``span`` words is one set of five-word shingles, and
two equal runs have containment and Jaccard similarity 1, whatever the length of the texts around them. Each set
gets a MinHash band of three rows; equal runs always fall into one bucket, so the search loses nothing. Beside its
bucket each run carries a 128-bit hash of its words, by which a candidate is verified, so that the corpus is read
once and no text is shuffled. A whole batch of texts is cut into words and hashed at once in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetmill.llm import batch as b
from facetmill.llm.canonical import consistent, is_canonical, spellings

SHINGLE = 5
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
APOSTROPHES = "'’‘ʼ`´＇‛"
APOSTROPHE = re.compile(f"[{APOSTROPHES}]")
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and decimal digits in lower case, apostrophes dropped, in the text's consistent form.

    Raised digits, fractions and other numerals that are no decimal digits part words; the final sigma is a sigma.
    """
    text = APOSTROPHE.sub("", consistent(text)).lower().replace("ς", "σ")
    if not text.isascii():
        text = "".join(c if c.isascii() or c.isalpha() or c.isdecimal() or c in "\n " else "" if 0x300 <= ord(c) <= 0x36F else " " for c in text)
    return WORD.findall(text)


def _words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every word of the texts (already in their consistent form), and the text it stands in."""
    points, starts = b.code_points(texts)
    keep = ~(np.isin(points, np.array([ord(c) for c in APOSTROPHES], np.uint32)) | ((points >= 0x300) & (points <= 0x36F)))
    starts = np.concatenate(([0], np.cumsum(keep)))[starts]
    points = points[keep]
    inside = (b.flags(points) & (b.LETTER | b.DIGIT)) > 0
    first, last = b.runs(inside)
    one, two = b.run_hashes(b.lower(points), first, last, SEEDS[:2])
    return one, two, np.searchsorted(starts, first, "right") - 1


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` neighbours, put together from runs of powers of two."""
    size = max(len(h) - n + 1, 0)
    out, done, block, width = np.zeros(size, np.uint64), 0, h, 1
    while True:
        if n & width:
            out = b.mix(out * np.uint64(0x9FB21C651E98DF25) + block[done : done + size])
            done += width
        if 2 * width > n:
            return out
        block = b.mix(block[:-width] * np.uint64(0x9FB21C651E98DF25) + block[width:]) if len(block) > width else block[:0]
        width *= 2


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each run of ``n`` neighbours."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def word_runs(texts: Sequence[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every run of ``span`` words: the text it stands in, its MinHash bucket, and 128 bits of hash of its words."""
    one, two, text = _words(texts)
    size = max(len(one) - span + 1, 0)
    if not size:
        return np.zeros(0, np.int64), *[np.zeros(0, np.int64)] * 3
    inside = text[:size] == text[span - 1 :]
    width = min(SHINGLE, span)
    shingles, key = _rolled(one, width), np.zeros(size, np.uint64)
    for seed in SEEDS:
        key = b.mix(key * np.uint64(0x9E3779B97F4A7C15) + _least(b.mix(shingles ^ np.uint64(seed)), span - width + 1))
    return (text[:size][inside], *[x[inside].view(np.int64) for x in (key, _rolled(one, span), _rolled(two, span))])


def _runs(df: DataFrame, span: int) -> DataFrame:
    """fm_key, fm_b, fm_h, fm_g of every run of the texts of ``df`` (fm_key, fm_text, fm_plain)."""
    import pyarrow as pa

    table = spellings()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys = rows.column(0)
            texts = [t if plain else consistent(t, table) for t, plain in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)]
            for start, part in b.parts(texts):
                text, *hashes = word_runs(part, span)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(text + start)), *map(pa.array, hashes)], names)

    names = ["fm_key", "fm_b", "fm_h", "fm_g"]
    schema = T.StructType([df.schema["fm_key"], *[T.StructField(n, T.LongType()) for n in names[1:]]])
    return df.select("fm_key", "fm_text", "fm_plain").mapInArrow(cut, schema)


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    t: Column = F.col("fm_text")
    return df.select(F.col(key).alias("fm_key"), F.col(text).alias("fm_text")).filter("fm_text is not null").withColumn("fm_plain", is_canonical(t))


def leaked_items(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, span: int = 12) -> DataFrame:
    """(doc, item, shared_runs, item_runs): documents that hold at least ``span`` consecutive words of an item.

    shared_runs counts the item's distinct runs of ``span`` words found in the document, item_runs all it has.
    Null and shorter texts leak nothing; repeated rows count once; every item is reported for every document,
    however many documents hold it. Output columns: ``doc_key``, ``item_key``, shared_runs, item_runs. The
    runs of the items are broadcast only if the planner finds them small; else the runs of the documents are
    shuffled, 32 bytes each.
    """
    of_docs = _runs(_texts(docs, doc_key, doc_text), span).withColumnRenamed("fm_key", "fm_doc")
    of_items = _runs(_texts(items, item_key, item_text), span).withColumnRenamed("fm_key", "fm_item").distinct()
    sizes = of_items.groupBy("fm_item").agg(F.countDistinct("fm_h", "fm_g").alias("item_runs"))
    a, i = of_docs.alias("a"), of_items.alias("i")
    same_run = (F.col("a.fm_h") == F.col("i.fm_h")) & (F.col("a.fm_g") == F.col("i.fm_g"))
    shared = a.join(i, F.col("a.fm_b") == F.col("i.fm_b")).filter(same_run).select("fm_doc", "fm_item", "a.fm_h", "a.fm_g").distinct()
    found = shared.groupBy("fm_doc", "fm_item").agg(F.count(F.lit(1)).alias("shared_runs"))
    return found.join(sizes, "fm_item").select(F.col("fm_doc").alias(doc_key), F.col("fm_item").alias(item_key), "shared_runs", "item_runs")
