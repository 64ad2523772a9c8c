"""The texts of an Arrow batch as one array of code points, so that numpy works on all of them at once.

Texts are joined by a line feed, which belongs to none of them. Arrays hold a few million characters at most:
``parts`` cuts a batch between texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

LETTER, DIGIT, MARK, WHITE, UPPER, LOWER_CASE, FOREIGN = (1 << i for i in range(7))
PART = 2_000_000


def parts(texts: Sequence[str], size: int = PART) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) of about ``size`` characters; a longer text is a part of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield start, list(texts[start:i])
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, list(texts[start:])


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts, each followed by a line feed, and where each text starts (one more for the end)."""
    joined = "\n".join(texts) + "\n"
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts


#: Scripts whose words the function words of Latin script say nothing about.
OTHER_SCRIPTS = ("GREEK", "CYRILLIC", "ARABIC", "HEBREW", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "THAI", "DEVANAGARI")


def _flags_of(c: str) -> int:
    category = unicodedata.category(c)
    out = LETTER if category[0] == "L" else DIGIT if category == "Nd" else MARK if category[0] == "M" else WHITE if category[0] == "Z" or c.isspace() else 0
    out |= UPPER if category == "Lu" else LOWER_CASE if category == "Ll" else 0
    return out | (FOREIGN if out & LETTER and unicodedata.name(c, "").startswith(OTHER_SCRIPTS) else 0)


def _lower_of(c: str) -> int:
    return 0x3C3 if c == "ς" else ord(c.lower()[0])


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    plane = [chr(i) for i in range(0x10000)]
    return np.array([_flags_of(c) for c in plane], np.uint8), np.array([_lower_of(c) for c in plane], np.uint32)


def _beyond(points: np.ndarray, of, dtype) -> np.ndarray:
    seen, where = np.unique(points, return_inverse=True)
    return np.array([of(chr(x)) for x in seen], dtype)[where]


def flags(points: np.ndarray) -> np.ndarray:
    """What each character is, as a sum of the constants above."""
    out = _tables()[0][np.minimum(points, 0xFFFF)]
    far = points > 0xFFFF
    if far.any():
        out[far] = _beyond(points[far], _flags_of, np.uint8)
    return out


def lower(points: np.ndarray) -> np.ndarray:
    """Each character in lower case by itself; a final sigma counts as any sigma."""
    out = _tables()[1][np.minimum(points, 0xFFFF)]
    far = points > 0xFFFF
    if far.any():
        out[far] = _beyond(points[far], _lower_of, np.uint32)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which each bit of the input moves about half of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: Sequence[int]) -> list[np.ndarray]:
    """For each seed a 64-bit hash of the characters of every run: a polynomial in an odd base over mixed code points."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in seeds]
    size = ends - starts
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    value = mix(points[np.repeat(starts, size) + at].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    first = np.cumsum(size) - size
    out = []
    for seed in seeds:
        power = np.cumprod(np.full(int(size.max()), seed | 1, np.uint64))
        out.append(mix(np.add.reduceat(value * power[at], first) ^ mix(size.astype(np.uint64))))
    return out
