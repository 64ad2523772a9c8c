"""Oversized texts cut at natural boundaries (problem 2).

Lexical-cohesion segmentation: the words of the sentences on either side of each sentence gap are compared as
two blocks; a gap whose similarity lies deep below the peaks around it is a topic boundary. Within each window
that the size limit leaves, the deepest valley is the cut, and the next piece starts the stated overlap before
it. Only texts above their limit cross into Python, as Arrow batches, and only cut positions come back; the
pieces are substrings taken in the JVM.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTENCE_END = re.compile(r"\n+|(?<=[.!?;:。！？])[\"'”’)\]]*\s+")
WORD = re.compile(r"\w+")
BLOCK = 3


def _similarities(words: list[list[int]]) -> np.ndarray:
    """Cosine similarity of the BLOCK sentences before and after each of the gaps between sentences.

    Products of blocks are sums of products of sentences at most 2 BLOCK - 1 apart; each of these is a sum over the
    words that both hold, found by sorted search. Exact, with memory in proportion to the text.
    """
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    flat = np.fromiter((w for ws in words for w in ws), np.int64, int(sizes.sum()))
    keys, counts = np.unique(flat * n + np.repeat(np.arange(n), sizes), return_counts=True)  # word, then sentence
    place = keys % n if len(keys) else keys
    near = np.zeros((2 * BLOCK, n))  # near[d, i]: the product of sentences i and i + d
    for d in range(min(2 * BLOCK, n)):
        at = np.searchsorted(keys, keys + d)
        both = (at < len(keys)) & (place + d < n)
        both[both] = keys[at[both]] == keys[both] + d
        near[d] = np.bincount(place[both], counts[both] * counts[at[both]], minlength=n)
    gap = np.arange(1, n)  # before sentence number gap
    across, left, right = (np.zeros(max(n - 1, 0)) for _ in range(3))
    for i in range(1, BLOCK + 1):
        for j in range(BLOCK):  # sentences gap - i and gap + j
            ok = (gap - i >= 0) & (gap + j < n)
            across[ok] += near[i + j][(gap - i)[ok]]
    for i in range(BLOCK):
        for d in range(BLOCK - i):
            times = 2 if d else 1
            ok = gap - 1 - i - d >= 0
            left[ok] += times * near[d][(gap - 1 - i - d)[ok]]
            ok = gap + i + d < n
            right[ok] += times * near[d][(gap + i)[ok]]
    norm = np.sqrt(left * right)
    return np.where(norm > 0, across / np.maximum(norm, 1e-9), 0.0)


def _depths(sim: np.ndarray) -> np.ndarray:
    """How far each gap lies below the nearest peak on its left and on its right."""
    n = len(sim)
    left, right = sim.copy(), sim.copy()
    for i in range(1, n):
        if left[i - 1] >= sim[i]:
            left[i] = left[i - 1]
    for i in range(n - 2, -1, -1):
        if right[i + 1] >= sim[i]:
            right[i] = right[i + 1]
    return left + right - 2 * sim


def _hard_cut(text: str, low: int, high: int) -> int:
    """The last word boundary in (low, high], else ``high`` moved back so as not to part a letter from its marks."""
    import unicodedata

    for i in range(high, low, -1):
        if text[i - 1].isspace() and not (i < len(text) and text[i].isspace()):
            return i
    i = high
    while i > low + 1 and i < len(text) and (unicodedata.combining(text[i]) or text[i] in "‍︎️" or text[i - 1] == "‍"):
        i -= 1
    return i if not (i < len(text) and unicodedata.combining(text[i])) else high


def cut_points(text: str, limit: int, overlap: int, fill: float = 0.5) -> list[int]:
    """Ends of the pieces of ``text``: each piece has at most ``limit`` characters with its overlap.

    The first piece may be ``limit`` long, later ones hold ``limit - overlap`` new characters at most. A cut is
    the deepest valley whose place fills at least ``fill`` of the window (the latest of equals); without one,
    the last sentence end in the window, else the last word boundary, else the window's end.
    """
    if limit < 1:
        return [len(text)]
    overlap = min(max(overlap, 0), limit // 2)
    ends = [m.end() for m in SENTENCE_END.finditer(text) if 0 < m.end() < len(text)]
    starts = [0, *ends]
    ids: dict[str, int] = {}
    low = text.lower() if len(text.lower()) == len(text) else text
    words = [[ids.setdefault(w, len(ids)) for w in WORD.findall(low, a, b)] for a, b in zip(starts, [*ends, len(text)], strict=True)]
    depth = _depths(_similarities(words))
    gaps = np.asarray(ends, np.int64)
    cuts, at = [], 0
    while True:
        window = limit if not cuts else limit - overlap
        if len(text) - at <= window:
            cuts.append(len(text))
            return cuts
        a, b = np.searchsorted(gaps, at + max(1, int(window * fill)), "left"), np.searchsorted(gaps, at + window, "right")
        if b > a:
            best = depth[a:b]
            at = int(gaps[a + len(best) - 1 - int(np.argmax(best[::-1]))])
        else:
            first = np.searchsorted(gaps, at, "right")
            at = int(gaps[b - 1]) if b > first else _hard_cut(text, at, at + window)
        cuts.append(at)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _cut_points(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else cut_points(t, int(m), int(o)) for t, m, o in zip(text, limit, overlap, strict=True)], dtype=object)


_cuts = _cut_points.asNondeterministic()  # so that no filter on the cuts is pushed below them, which would cut twice


def split_oversized(df: DataFrame, limits: DataFrame, keep: list[str], text: str, kind: str, limit: str = "max_chars", overlap: str = "overlap_chars") -> DataFrame:
    """Ordered pieces within the limit: ``keep``, n_pieces, piece_no (0-based), piece_start, piece_end, piece.

    ``limits`` has one row per kind; sizes are code points. Consecutive pieces share exactly the overlap (at
    most half the limit), so the pieces rebuild the text. A text within its limit, empty, or of a kind without
    a limit (null included) is one piece; a null text is one piece that is null. A null overlap counts as 0.
    Of several limits of a kind the least counts. Repeated rows give repeated pieces. Columns beyond those named are ignored, whatever their names.
    """
    bound = limits.select(F.col(kind).alias("fm_kind"), F.struct(F.col(limit).cast("int").alias("fm_limit"), F.greatest(F.coalesce(F.col(overlap).cast("int"), F.lit(0)), F.lit(0)).alias("fm_overlap")).alias("fm_l"))
    bound = bound.groupBy("fm_kind").agg(F.min(F.when(F.col("fm_l.fm_limit").isNotNull(), F.col("fm_l"))).alias("fm_l")).select("fm_kind", "fm_l.*")
    rows = df.select(*[F.col(c).alias(f"fm_k{i}") for i, c in enumerate(keep)], F.col(text).alias("fm_text"), F.col(kind).alias("fm_kind")).join(bound, "fm_kind", "left")
    size = F.char_length("fm_text")
    over = (F.col("fm_limit") >= 1) & (size > F.col("fm_limit"))
    cut = rows.withColumn("fm_cuts", _cuts(F.when(over, F.col("fm_text")), F.when(over, F.col("fm_limit")).otherwise(0), F.when(over, F.col("fm_overlap")).otherwise(0)))
    cut = cut.withColumn("fm_cuts", F.coalesce("fm_cuts", F.array(F.coalesce(size, F.lit(0)))))
    return _pieces(cut, keep)


def _pieces(cut: DataFrame, keep: list[str]) -> DataFrame:
    back = F.least(F.coalesce("fm_overlap", F.lit(0)), F.floor(F.coalesce("fm_limit", F.lit(0)) / 2)).cast("int")
    each = cut.withColumn("fm_back", back).select("*", F.size("fm_cuts").alias("n_pieces"), F.posexplode("fm_cuts").alias("piece_no", "piece_end"))
    start: Column = F.when(F.col("piece_no") == 0, F.lit(0)).otherwise(F.expr("fm_cuts[piece_no - 1] - fm_back"))
    each = each.withColumn("piece_start", F.greatest(F.lit(0), start))
    return each.select(*[F.col(f"fm_k{i}").alias(c) for i, c in enumerate(keep)], "n_pieces", "piece_no", "piece_start", "piece_end", F.expr("substring(fm_text, piece_start + 1, piece_end - piece_start)").alias("piece"))
