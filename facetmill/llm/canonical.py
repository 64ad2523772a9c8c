"""One consistent form for text that looks the same in different characters (problem 1).

Each token's letters get their resolved script sets: the scripts in which the letter, or a letter that looks
like it, is written. The sets are intersected over the token. A token written in several scripts is respelled in
the script that remains; a token that could be spelled wholly in more than one script (a whole-script confusable)
takes the script of the tokens around it that leave no choice, and Latin where there are none. What remains is
normalized: compatibility forms a reader cannot tell apart (full-width, ligatures, font variants), combining
marks, invisible characters, white space and hyphens. Raised digits, letter case and accents stay as they are.

Only text with characters outside ASCII crosses into Python, in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetmill.sources.checkpoint import settled

# Letters of the four commonest scripts that are printed alike, one group a row: Latin, Greek, Cyrillic,
# Armenian, "." where a script has no such letter. They go before the public data below, which adds other scripts.
ALIKE = """
A Α А .
B Β В .
C Ϲ С .
D . . .
E Ε Е .
G . Ԍ .
H Η Н .
I Ι І .
J Ϳ Ј .
K Κ К .
M Μ М .
N Ν . .
O Ο О Օ
P Ρ Р .
Q . Ԛ .
S . Ѕ Տ
T Τ Т .
U . . Ս
V . Ѵ .
W . Ԝ .
X Χ Х .
Y Υ Ү .
Z Ζ . .
a . а .
c ϲ с .
d . ԁ .
e . е .
g . . ց
h . һ հ
i . і .
j ϳ ј .
l . ӏ .
n . . ո
o ο о օ
p . р .
q . ԛ զ
s . ѕ .
u . . ս
v ν ѵ .
w . ԝ .
x . х .
y . у .
. Γ Г .
. Π П .
. Φ Ф .
. κ к .
"""
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN")
# Latin letters beyond ASCII printed like one of ASCII; capitals the public data leave out; letters the
# public data put with an ASCII letter though a reader of print can tell them apart.
TWINS = {"ɑ": "a", "ɡ": "g", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s"}
ADDED = {"Ⲁ": "A"}
TOLD_APART = "αγικρσυϜϺгУүҽѡ"

# Characters printed alike outside letters.
HYPHENS = "‐‑﹣˗⁃"
DASHES = "‒−"
QUOTES = {"ʼ": "’", "ʹ": "′", ";": ";", "·": "·", "․": ".", "⁄": "/", "∕": "/", "∶": ":", "ː": ":", "ǃ": "!", "❘": "|", "∣": "|", "⁎": "*", "∗": "*"}

# Compatibility mappings whose two sides look the same in print.
SAME_IN_PRINT = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")


# Scripts that are written together, under the name of what they make up.
JOINT = {"CJK": ("JAPANESE", "KOREAN", "HANB"), "HIRAGANA": ("JAPANESE",), "KATAKANA": ("JAPANESE",), "KATAKANA-HIRAGANA": ("HIRAGANA", "KATAKANA", "JAPANESE"), "HANGUL": ("KOREAN",), "BOPOMOFO": ("HANB",)}

Spellings = dict[str, dict[str, str]]


def _script_of(ch: str) -> str:
    return unicodedata.name(ch, "").split(" ", 1)[0]


def public_confusables() -> dict[str, str]:
    """The public Unicode confusables, character to prototype, from the ICU library that comes with Spark.

    Layout of the file: the ICU data header (its size first), then eight offsets and counts of big-endian tables: keys
    (24 bits of code point, 8 of length - 1), values (a UTF-16 unit, or where the text starts), texts.
    """
    import os
    import struct
    import zipfile
    from pathlib import Path

    import pyspark

    homes = [Path(pyspark.__file__).parent / "jars", Path(os.environ.get("SPARK_HOME", "/nowhere")) / "jars"]
    jar = next((j for h in homes if h.is_dir() for j in sorted(h.glob("icu4j-*.jar"))), None)
    if jar is None:
        raise FileNotFoundError("no icu4j jar beside Spark: its confusables data are needed")
    with zipfile.ZipFile(jar) as z:
        data = z.read(next(n for n in z.namelist() if n.endswith("/confusables.cfu")))
    data = data[struct.unpack_from(">H", data)[0] :]
    keys_at, n_keys, values_at, n_values, texts_at, n_texts = struct.unpack_from(">6i", data, 12)
    keys, values = struct.unpack_from(f">{n_keys}I", data, keys_at), struct.unpack_from(f">{n_values}H", data, values_at)
    texts = data[texts_at : texts_at + 2 * n_texts].decode("utf-16-be", "surrogatepass")
    return {chr(k & 0xFFFFFF): chr(v) if k < 1 << 24 else texts[v : v + (k >> 24) + 1] for k, v in zip(keys, values, strict=True)}


@cache
def spellings() -> Spellings:
    """Each letter that looks like one of another script, with the letter of each such script (its own included).

    Groups are the rows of ALIKE. The public data add, to the group of the ASCII letter they name, the letters of
    further scripts; they do not tell I from l, so there the letter's own case decides. Built once, on the driver.
    """
    table: Spellings = {}
    for row in ALIKE.strip().splitlines():
        group = {s: c for s, c in zip(SCRIPTS, row.split(), strict=True) if c != "."}
        table.update(dict.fromkeys(group.values(), group))
    more = [(c, "I" if to == "l" and unicodedata.category(c) != "Ll" else to) for c, to in sorted(public_confusables().items()) if len(to) == 1 and to.isascii() and to.isalpha()] + list(ADDED.items())
    for c, to in more:
        category = unicodedata.category(c)
        other_case = (category == "Lu" and to.islower()) or (category == "Ll" and to.isupper())
        if c in table or c in TOLD_APART or category[0] != "L" or other_case or unicodedata.decomposition(c) or _script_of(c) in ("LATIN", "ARABIC"):
            continue
        group = table[to] if to in table else table.setdefault(to, {"LATIN": to})
        own = group.setdefault(_script_of(c), c)
        table[c] = group if own == c else {**group, _script_of(c): c}
    for c, to in TWINS.items():
        table[c] = table[to] if to in table else {"LATIN": to}
    return table


_plain: dict[str, str] = {}


def _plain_form(ch: str, table: Spellings) -> str:
    """The printed-alike plain form of one character: '' if invisible, ' ' for white space within a line."""
    known = _plain.get(ch)
    if known is not None:
        return known
    category = unicodedata.category(ch)
    out = ch
    if ch == "\n" or ch in table:
        out = ch
    elif ch in "\u0085  \x0b\x0c\r":
        out = "\n"
    elif category == "Zs" or ch in "\t ":
        out = " "
    elif category in ("Cf", "Cc") or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef" or ch in "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ":
        out = ""
    elif ch in HYPHENS:
        out = "-"
    elif ch in DASHES:
        out = "–"
    elif ch in QUOTES:
        out = QUOTES[ch]
    else:
        mapping = unicodedata.decomposition(ch)
        if mapping.startswith(SAME_IN_PRINT):
            to = "".join(chr(int(x, 16)) for x in mapping.split()[1:])
            if not to.startswith(" ") or len(to) == 1:
                out = "".join(_plain_form(c, table) for c in to)
    if len(_plain) < 200_000:
        _plain[ch] = out
    return out


TOKEN = re.compile(r"[^\W\d_][̀-ͯ]*(?:[^\W\d_][̀-ͯ]*)*")
OTHER = re.compile(r"[^\x00-\x7f]")


_reach: dict[str, frozenset[str]] = {}
_choices: dict[str, frozenset[str]] = {}


def _scripts_of(ch: str, table: Spellings) -> frozenset[str]:
    """The scripts in which a letter, or one that looks like it, is written, with those they are written together with."""
    known = _reach.get(ch)
    if known is None:
        own = table.get(ch) or (_script_of(ch),)
        known = _reach[ch] = frozenset(s for x in own for s in (x, *JOINT.get(x, ())))
    return known


def resolved_scripts(token: str, table: Spellings) -> frozenset[str]:
    """The scripts in which the whole token can be spelled, look-alike letters included; kept for the next text that has the token."""
    known = _choices.get(token)
    if known is not None:
        return known
    left: frozenset[str] | None = None
    for c in token:
        if unicodedata.combining(c):
            continue
        left = _scripts_of(c, table) if left is None else left & _scripts_of(c, table)
        if not left:
            break
    if len(_choices) > 200_000:
        _choices.clear()
    out = _choices[token] = left or frozenset()
    return out


@cache
def _sure(scripts: Iterable[str]) -> str | None:
    """The script that is surely meant: the only one, or the only one of the four commonest."""
    common = [s for s in SCRIPTS if s in scripts]
    return common[0] if len(common) == 1 else next(iter(scripts)) if len(scripts) == 1 else None


def _respell(token: str, script: str, table: Spellings) -> str:
    return "".join(table[c].get(script, c) if c in table else c for c in token)


def _best_effort(token: str, table: Spellings) -> str:
    """A token that no one script can spell: each look-alike in the script of the most unambiguous letters, Latin on a tie."""
    count = Counter(s for c in token if not unicodedata.combining(c) for s in [_sure(frozenset(table.get(c) or (_script_of(c),)))] if s)
    order = [s for s, _ in sorted(count.items(), key=lambda x: (-x[1], x[0] != "LATIN", x[0]))]
    out = []
    for c in token:
        own = table.get(c)
        if own:
            c = next((own[s] for s in [*order, *SCRIPTS] if s in own), c)
        out.append(c)
    return "".join(out)


@cache
def _first(scripts: Iterable[str]) -> str:
    return min(scripts, key=lambda s: (SCRIPTS.index(s) if s in SCRIPTS else len(SCRIPTS), s))


def consistent(text: str, table: Spellings | None = None) -> str:
    """``text`` in its one consistent form; texts that look the same come out equal."""
    if not text.isascii():
        table = table or spellings()
        text = unicodedata.normalize("NFD", text)
        text = "".join(c if " " <= c < "\x7f" else _plain_form(c, table) for c in text)
        if not text.isascii():
            text = unicodedata.normalize("NFD", text)
            fixed = Counter()
            for token in TOKEN.findall(text):
                sure = _sure(resolved_scripts(token, table))
                if sure and len(token) > 1:  # a lone letter may be a symbol
                    fixed[sure] += 1
            around = max(fixed, key=lambda s: (fixed[s], s == "LATIN", s), default="LATIN")

            def spell(match: re.Match) -> str:
                token = match.group(0)
                scripts = resolved_scripts(token, table)
                if not scripts:
                    return _best_effort(token, table)
                return _respell(token, around if around in scripts else _first(scripts), table)

            text = unicodedata.normalize("NFC", TOKEN.sub(spell, text))
    else:
        text = re.sub(r"[\x0b\x0c\r\x1c-\x1e]", "\n", text).replace("\t", " ")
        text = re.sub(r"[\x00-\x08\x0e-\x1f\x7f]", "", text)
    text = re.sub(r" {2,}", " ", text)
    text = re.sub(r" *\n *", "\n", text)
    return text.strip(" \n")


def _consistent(text: Column) -> Column:
    table = spellings()  # read on the driver, sent with the function

    @F.pandas_udf(T.StringType())
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: consistent(t, table), na_action="ignore")

    return run(text)


# Greek small letters without a look-alike in the table above, which stand alone as symbols in Latin text.
LONE = "βγδεζηθλμξπστφχψω"
# Characters outside ASCII that are their own form wherever they stand: composed Latin letters, dashes and marks.
OWN = "À-ÖØ-öø-ıĴ-ľŁ-ňŊ-ž–—•€£¢¥§©®°±×÷¹²³«»¡¿“”‘’"
FOREIGN = rf"[^{OWN}{LONE}]"
NOT_ALONE = r"[β-ω](?:(?=[\p{L}\p{M}])|(?<=[\p{L}\p{M}][β-ω]))"
CONTROL = r"[\x00-\x09\x0b-\x1f\x7f]"


def is_canonical(text: Column) -> Column:
    """True where a text is surely its own consistent form; cheap byte tests come before the patterns."""
    spaced = text.contains("  ") | text.contains(" \n") | text.contains("\n ") | text.startswith(" ") | text.startswith("\n") | text.endswith(" ") | text.endswith("\n")
    beyond = F.regexp_replace(text, r"[\x00-\x7f]+", "")  # mostly a few characters
    other = (F.octet_length(text) != F.char_length(text)) & (beyond.rlike(FOREIGN) | (beyond.rlike("[β-ω]") & text.rlike(NOT_ALONE)))
    return ~(spaced | text.rlike(CONTROL) | other)


def canonical(text: Column) -> Column:
    """The consistent form of a text column; null stays null, blank text becomes empty.

    Text of characters that are their own form, without outer or doubled white space, is its own form and is not
    sent to Python.
    """
    plain = is_canonical(text)
    return F.when(plain, text).otherwise(_consistent(F.when(~plain, text)))


def same_look(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of rows of ``df`` whose texts look the same without being stored in the same characters: key_a < key_b.

    Rows whose text is stored in its consistent form meet only rows that are not: each pair has at least one of
    the latter, so only these are joined against all rows, by a 128-bit hash of the form. Null text pairs with
    nothing; repeated rows count once; every pair comes out, however many rows share a text.
    """
    rows = settled(_hashed(df, key, text))  # 40 bytes a row, read by both sides of the join
    odd = rows.filter("fm_own <> fm_form")
    a, b = odd.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.fm_form") == F.col("b.fm_form")) & (F.col("a.fm_own") != F.col("b.fm_own")) & (F.col("a.fm_key") != F.col("b.fm_key")))
    return pairs.select(F.least("a.fm_key", "b.fm_key").alias("key_a"), F.greatest("a.fm_key", "b.fm_key").alias("key_b")).distinct()


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, rows, spellings) of the rows whose text looks like one stored in other characters.

    class_id is the least key of the class; copies are counted, not paired. Null texts are in no class, repeated rows
    count once. One shuffle by the hash of the form counts, a second one joins the classes back.
    """
    rows = settled(_hashed(df, key, text).distinct())
    classes = rows.groupBy("fm_form").agg(F.min("fm_key").alias("class_id"), F.countDistinct("fm_key").alias("rows"), F.countDistinct("fm_own").alias("spellings")).filter("spellings > 1")
    return rows.join(classes, "fm_form").select(F.col("fm_key").alias(key), "class_id", "rows", "spellings").distinct()


def _hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    digest = lambda c: F.unhex(F.md5(c.cast("binary")))
    forms = df.select(F.col(key).alias("fm_key"), F.col(text).alias("fm_text")).filter("fm_text is not null").withColumn("fm_form", canonical(F.col("fm_text")))
    return forms.select("fm_key", digest(F.col("fm_text")).alias("fm_own"), digest(F.col("fm_form")).alias("fm_form"))


def same_look_as(df: DataFrame, key: str, text: str, clean: DataFrame, clean_key: str, clean_text: str) -> DataFrame:
    """(key_a, key_b): rows of ``df`` and of ``clean`` that look the same without being stored in the same characters.

    The distinct texts of ``df`` are matched, so a label that a third of all rows carry is normalized and joined once.
    """
    a = df.select(F.col(key).alias("key_a"), F.col(text).alias("fm_text")).filter("fm_text is not null").distinct()
    b = clean.select(F.col(clean_key).alias("key_b"), F.col(clean_text).alias("fm_clean")).filter("fm_clean is not null").distinct().withColumn("fm_form", canonical(F.col("fm_clean")))
    texts = a.select("fm_text").distinct().withColumn("fm_form", canonical(F.col("fm_text")))
    hits = texts.join(b, "fm_form").filter("fm_text <> fm_clean").select("fm_text", "key_b")
    return a.join(hits, "fm_text").select("key_a", "key_b").distinct()
