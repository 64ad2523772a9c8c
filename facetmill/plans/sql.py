"""Pieces of DuckDB SQL that the checks of several queries share."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from facetmill.functions import text

#: White space of any kind as a class of the pattern language, and as the set of characters that ``strip`` removes.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
COLLAPSED = r"[\s\x0b\x85\p{Z}]"


def stripped(sql: str) -> str:
    """``sql`` with every ``strip(x)`` spelled out: outer white space of any kind removed."""
    while (m := re.search(r"\bstrip\(", sql)) is not None:
        depth, at = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        sql = f"{sql[: m.start()]}trim({sql[m.end() : at - 1]}, '{text.WHITE}'){sql[at:]}"
    return sql


@cache
def _compatible() -> str:
    """A map literal of every character with a compatibility decomposition."""
    pairs = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, range(0x80, 0x20000)) if not 0xD800 <= ord(c) < 0xE000]
    odd = [(c, d) for c, d in pairs if d != unicodedata.normalize("NFD", c)]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"MAP([{','.join(quoted(c) for c, _ in odd)}],[{','.join(quoted(d) for _, d in odd)}])"


def nfkc(x: str) -> str:
    """The compatibility form of a text."""
    return f"nfc_normalize(array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN c < chr(128) THEN c ELSE coalesce({_compatible()}[c], c) END), ''))"


def normal(x: str) -> str:
    """As text.normal_text."""
    plain = f"translate({nfkc(x)}, '{text.DASHES}‘’“”', '{'-' * len(text.DASHES)}''''\"\"')"
    return f"trim(regexp_replace(lower(replace({plain}, '$', ' $ ')), '{COLLAPSED}+', ' ', 'g'))"


def label_normal(x: str) -> str:
    """As text.label_normal."""
    return rf"regexp_replace(strip(regexp_replace({normal(x)}, ':+$', '')), '\s*\(\d\)$', '')"


def distance(a: str, b: str) -> str:
    """Levenshtein distance over code points: DuckDB's counts bytes, so each distinct character of the pair becomes one byte; null beyond 127 of them."""
    known = f"list_distinct(string_split(concat({a}, {b}), ''))"
    bytes_ = "".join(map(chr, range(1, 128))).replace("'", "''")
    coded = lambda x: f"translate({x}, array_to_string({known}, ''), '{bytes_}')"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN length({a}) + length({b}) WHEN len({known}) < 128 THEN levenshtein({coded(a)}, {coded(b)}) END"


def word_distances(pairs: str) -> str:
    """CTEs that end in ``distances`` (id, d): the word distance of each row (id, a, b: lists of words) of ``pairs``.

    One step per word of the shorter list renews a row of the table of distances; the running minimum of a window does
    what the inner loop of a plain model does.
    """
    return f"""turned AS (SELECT id, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS a, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS b FROM {pairs}), bw AS (SELECT id, unnest(b) AS w, generate_subscripts(b, 1) AS j FROM turned),
    steps(id, i, j, d) AS (SELECT id, CAST(0 AS BIGINT), CAST(unnest(range(len(b) + 1)) AS BIGINT), CAST(unnest(range(len(b) + 1)) AS BIGINT) FROM turned
      UNION ALL SELECT id, i, j, CAST(j + min(t - j) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING) AS BIGINT) FROM (
        SELECT s.id, s.i + 1 AS i, s.j, CASE WHEN s.j = 0 THEN s.i + 1 ELSE least(s.d + 1, lag(s.d) OVER (PARTITION BY s.id ORDER BY s.j) + CASE WHEN p.a[s.i + 1] = bw.w THEN 0 ELSE 1 END) END AS t
        FROM steps s JOIN turned p ON p.id = s.id AND s.i < len(p.a) LEFT JOIN bw ON bw.id = s.id AND bw.j = s.j)),
    distances AS (SELECT s.id, s.d FROM steps s JOIN turned p ON p.id = s.id AND s.i = len(p.a) AND s.j = len(p.b))"""
