"""Text functions over Columns."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The three dialects of numeric tokens, years, item headings, dashes, and the footnote mark after a number.
NUM_TOKEN = r"\(?\$?\d[\d,]*\.?\d*\)?"
NUM_TOKEN_PERCENT = r"\(?\$?\d[\d,]*\.?\d*\)?%?"
NUM_SIGNED = r"\(?-?\$?\d[\d,]*(?:\.\d+)?\)?"
YEAR_ONLY = r"^(?:19|20)\d{2}$"
YEAR_WORD = r"\b(?:19|20)\d{2}\b"
ITEM = r"(?i)^\s*item\s+(\d{1,2}[a-c]?)\s*[.:–—-]"
ITEM_WORD = r"(?i)^\s*item\s*$"
ITEM_REST = r"(?i)^\s*(\d{1,2}[a-c]?)\s*[.:–—-]\s*\S"
DASHES = "‐‑‒–—―−"
FOOTNOTE_MARK = r"(?<=[\d)])\s*\(\d\)$|\s*(\([a-z]\)|\*+|\[\d+\])$"
# What is taken out of a line of Markdown, in this order, and what takes its place; a rule under a table's head.
MARKDOWN = ((r"^\s*#+\s*", ""), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"\|", " "), (r"\*\*|__", ""))
MARKDOWN_COMMENT, MARKDOWN_RULE = r"<!--.*?-->", r"^\s*\|?[\s:|-]+\|?\s*$"

#: White space of any kind, as it is stripped from the ends of texts and cells.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.btrim(text, F.lit(WHITE))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, so that long chains do not multiply when plans are collapsed."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Non-empty runs between white space (an empty text has none)."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def numeric_tokens(text: Column, pattern: str = NUM_TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def last_year(text: Column) -> Column:
    """The last four-digit year in a text, as int; null if none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(YEAR_WORD), F.lit(0)), F.lit(-1)).cast("int")


def simple_normal(text: Column) -> Column:
    """The normal form without compatibility mapping: dashes, quotes, dollar spacing, lower case, white space; punctuation stays."""
    t = F.translate(text, DASHES + "‘’“”", "-" * len(DASHES) + "''\"\"")
    t = F.lower(F.replace(t, F.lit("$"), F.lit(" $ ")))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normal_text(text: Column) -> Column:
    """The full normal form. Only text outside ASCII is sent to Python for its compatibility mapping."""
    odd = text.rlike(r"[^\x00-\x7f]")
    return simple_normal(F.when(odd, _nfkc(F.when(odd, text))).otherwise(text))


def label_normal(label: Column, normal=normal_text) -> Column:
    """Normal form of a row label: colons at its end and then one trailing footnote mark such as (1) dropped."""
    return F.regexp_replace(F.trim(F.regexp_replace(normal(label), r":+$", "")), r"\s*\(\d\)$", "")


def letters_only(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "[^a-z]", "")


def typography_normal(text: Column) -> Column:
    """Typographic dashes and quotes as plain ones, marks such as ® dropped."""
    return F.translate(text, "–—‘’“”®™©", "--''\"\"")


def light_normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def markdown_to_text(md: Column) -> Column:
    """Readable text of Markdown, line by line: comments, images and pipes become spaces, table rules go, links keep their text."""

    def readable(line: Column) -> Column:
        for pattern, instead in MARKDOWN:
            line = F.regexp_replace(line, pattern, instead)
        return line

    lines = F.transform(F.split(md, "\n", -1), lambda line: F.regexp_replace(line, MARKDOWN_COMMENT, " "))
    return F.array_join(F.transform(F.filter(lines, lambda line: ~line.rlike(MARKDOWN_RULE)), readable), "\n")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def ends_in_number(label: Column) -> Column:
    return label.rlike(r"\d[\d,]*\)?$")


def title_line(line: Column, title: Column, extra: int = 15) -> Column:
    """The line starts with the title and goes on for at most ``extra`` characters."""
    s = F.upper(strip(line))
    return s.startswith(title) & (F.char_length(s) - F.char_length(title) <= extra)


def footer(text: Column, has_table: Column, pattern: str, most: int = 80) -> Column:
    """No table, one line, at most ``most`` characters, and the pattern is found in it."""
    s = strip(text)
    return ~has_table & ~s.contains("\n") & (F.char_length(s) <= most) & s.rlike(pattern)


def without_lines(text: Column, pattern: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~strip(x).rlike(pattern)), "\n")


def escape_cell(cell: Column) -> Column:
    """A table cell for Markdown: pipes escaped, line breaks as spaces."""
    return F.regexp_replace(F.replace(cell, F.lit("|"), F.lit("\\|")), "\n", " ")


def snippet(text: Column, needle: Column, width: int = 80) -> Column:
    """The first occurrence with ``width`` characters on each side; dots lead only if text was cut before, and always trail."""
    at = F.instr(F.lower(text), F.lower(needle))
    start = F.greatest(at - 1 - width, F.lit(0))
    stop = F.least(at - 1 + F.char_length(needle) + width, F.char_length(text))
    return F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, stop - start), F.lit("..."))


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences, whatever their length and number of symbols.

    The longer one stands in the bits of an integer, one step per symbol of the other updates a whole column: the
    places where the column rises (``up``) and falls (``down``), with the carry of an addition running along matches.
    """
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    often = {x: _bits(p) for x, p in sorted(places.items(), key=lambda e: -len(e[1]))[:512]}  # the rest anew each time, for memory
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = every, 0, len(a)
    for x in b:
        same = often.get(x)
        if same is None:
            same = _bits(places[x]) if x in places else 0
        level = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (every & ~(level | up)), up & level
        distance += 1 if rise & top else -1 if fall & top else 0
        rise, fall = (rise << 1) | 1, fall << 1
        up, down = (fall | ~(level | rise)) & every, rise & level & every
    return distance


def _bits(places: Sequence[int]) -> int:
    out = bytearray(places[-1] // 8 + 1)
    for i in places:
        out[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(out, "little")


@F.arrow_udf(T.LongType())
def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance of two word arrays of any size."""
    return _distance(reference, hypothesis)


def char_distance(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance of two texts over code points."""
    return _distance(reference, hypothesis)


def error_rate(distance: Column, size: Column, other: Column) -> Column:
    """distance / size; of an empty reference 0 if the other is empty too, else 1."""
    return F.when(size > 0, distance / size).when(other == 0, 0.0).otherwise(1.0)


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    a, b = words(reference), words(hypothesis)
    return error_rate(word_distance(a, b), F.size(a), F.size(b))


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    return error_rate(char_distance(reference, hypothesis), F.char_length(reference), F.char_length(hypothesis))


def match_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratcliff/Obershelp similarity of two texts; null if it is surely below ``least``.

    Twice the characters the texts have in common, in any order, over those of both is never less than the
    similarity, and is found out first.
    """

    @F.arrow_udf(T.DoubleType())
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        counts = {x: Counter(x) for x in {*left.to_pylist(), *right.to_pylist()} if x is not None}

        def ratio(x: str | None, y: str | None) -> float | None:
            if x is None or y is None:
                return None
            p, q = counts[x], counts[y]
            most = 2 * sum(min(n, q[c]) for c, n in p.items() if c in q)
            return SequenceMatcher(None, x, y).ratio() if most >= least * (len(x) + len(y)) else None

        return pa.array(map(ratio, left.to_pylist(), right.to_pylist()), pa.float64())

    return run(a, b)


def canonical_json(entries: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
