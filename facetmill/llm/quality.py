"""Per-document text statistics and the kind of each document (problem 9).

The plain statistics are Column expressions. The kinds are learned in two steps, both ordered rule lists induced by
incremental reduced-error pruning: each rule is grown on two thirds of the remaining examples by information gain,
pruned on the last third, and kept while it is right more often than not there.

1. A text is cut into units (lines, and sentences within lines), each measured by plain counts and shares. The unit
   rules are induced on the units of labelled documents, every unit standing for the kind of its document: entries,
   rows and blobs are what the units of the other kinds have and those of prose have not.
2. The document rules are induced on the shares of a document's characters that its units of each kind hold.

Both lists are exported as SQL CASE expressions, which Spark applies natively to every unit and every document. The
measures of the units come from one Arrow pass, in which numpy works on all texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetmill.llm import batch as b

# Function words of Latin-script languages that prose does not do without.
COMMON = """the of and to a in for is was on that by with as at from or an be are were which will its their this has have had not we our
it der die das und den dem des ein eine einen im von zu mit auf für ist wurde wurden hatte bei aus nach um wegen le la les des du de et un une en
dans est sur par pour aux au ses son leur a été el los las del y que se por con una su al sobre il lo gli di che per sono non nel della o os
do da em uma het een van met op zijn och att som""".split()

STATISTICS = ("n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "share_common", "share_punctuated", "n_lines", "mean_line_length")

#: What a unit is measured by; all but ``longest`` (characters without white space) and ``words`` are shares or 0 and 1.
MEASURES = ("words", "figures", "common", "ended", "marked", "longest", "symbols", "odd", "garbled", "glyphs", "distinct", "repeated", "foreign", "capital", "unbroken")

# Sets of characters.
FIGURE_START, FIGURE_BODY, DASHES = "(-−–$€£", "0123456789.,", "-–—"
ODD = "{}\\^~<>@#_=+¤¬§`[]"
GARBLED = "ÃÂÅâ€™¸¤¬¦¨¯¢" + "".join(map(chr, range(0x80, 0xA0)))
BULLETS = "-*•·>◦▪–—+"
SENTENCE_END = ".!?…。！？"
ROMAN = "ivxlcIVXLC"
UNBROKEN = 28

def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _ascii(s: Column) -> Column:
    return F.octet_length(s) == F.char_length(s)


def _tokens(s: Column) -> Column:
    """Lower-case runs of letters, marks and digits; ASCII text takes the cheaper pattern."""
    low = F.lower(s)
    return F.filter(F.when(_ascii(s), F.split(low, "[^a-z0-9]+")).otherwise(F.split(low, r"[^\p{L}\p{M}\p{Nd}]+")), lambda w: w != "")


def statistics(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the plain statistics of its text (replacing columns of these names).

    n_words (runs of letters and digits), mean_word_length, symbol_ratio (characters that are no letter, digit or
    white space), digit_ratio, upper_ratio (of letters), share_common (of words), n_lines (non-blank),
    share_punctuated (lines that end in punctuation), mean_line_length. A null text counts as empty; of an empty
    text every count and ratio is 0. Repeated rows stay repeated.
    """
    base = df.drop(*STATISTICS)
    t = F.coalesce(F.col(text), F.lit(""))
    work = base.withColumn("fm_words", _tokens(t)).withColumn("fm_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"(?U)\S")))
    words, lines, n = F.col("fm_words"), F.col("fm_lines"), F.char_length(t)
    ascii_only = _ascii(t)

    def size(pattern: str, plain: str) -> Column:
        return F.char_length(F.when(ascii_only, F.regexp_replace(t, plain, "")).otherwise(F.regexp_replace(t, pattern, "")))

    return work.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.size(words).cast("bigint").alias("n_words"),
        _ratio(F.char_length(F.array_join(words, "")), F.size(words)).alias("mean_word_length"),
        _ratio(size(r"[\p{L}\p{M}\p{Nd}\s ]+", r"[A-Za-z0-9\s]+"), n).alias("symbol_ratio"),
        _ratio(size(r"[^\p{Nd}]+", "[^0-9]+"), n).alias("digit_ratio"),
        _ratio(size(r"[^\p{Lu}]+", "[^A-Z]+"), size(r"[^\p{L}]+", "[^A-Za-z]+")).alias("upper_ratio"),
        _ratio(F.size(F.filter(words, lambda w: w.isin(*dict.fromkeys(COMMON)))), F.size(words)).alias("share_common"),
        _ratio(F.size(F.filter(lines, lambda x: x.rlike(r"[.!?:;…。！？][\"'”’)\]]*\s*$"))), F.size(lines)).alias("share_punctuated"),
        F.size(lines).cast("bigint").alias("n_lines"),
        _ratio(F.char_length(F.array_join(lines, "")), F.size(lines)).alias("mean_line_length"),
    )


def _set(chars: str) -> np.ndarray:
    out = np.zeros(0x10000, bool)
    out[[ord(c) for c in chars]] = True
    return out


def _units(points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units without outer white space: lines, cut after . ! or ? and a space unless a short number or initial precedes."""
    solid = (kinds & b.WHITE) == 0
    ended = np.isin(points, [33, 46, 63])
    after_word = ((kinds & b.LOWER_CASE) > 0) | (points == 37) | (points == 41)
    after_number = (points >= 48) & (points <= 57)
    cut = np.zeros(len(points), bool)
    cut[4:] = (points[4:] == 32) & ended[3:-1] & (after_word[2:-2] | (after_number[2:-2] & solid[1:-3] & solid[:-4]))
    starts, ends = b.runs(~(cut | (points == 10)))
    places = np.flatnonzero(solid)
    first, last = np.searchsorted(places, starts), np.searchsorted(places, ends)
    some = last > first
    return places[first[some]], places[last[some] - 1] + 1


def _within(starts: np.ndarray, ends: np.ndarray, unit_starts: np.ndarray, unit_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs that lie in a unit, and which."""
    unit = np.searchsorted(unit_starts, starts, "right") - 1
    inside = unit >= 0
    inside[inside] = ends[inside] <= unit_ends[unit[inside]]
    return starts[inside], ends[inside], unit[inside]


def _marked(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Units that open with a bullet, or with a number, letter or Roman numeral before ``.`` or ``)``, and white space."""

    def at(k: int) -> np.ndarray:
        return np.where(starts + k < ends, np.minimum(points[np.minimum(starts + k, len(points) - 1)], 0xFFFF), 10)

    head = [at(k) for k in range(8)]
    blank = [np.isin(x, [9, 32, 160]) for x in head]
    closed = [np.isin(x, [41, 46]) for x in head]
    digit, roman, letter = ([f(x) for x in head] for f in (lambda x: (x >= 48) & (x <= 57), lambda x: _set(ROMAN)[x], lambda x: ((x | 32) >= 97) & ((x | 32) <= 122)))
    out = _set(BULLETS)[head[0]] & blank[1]
    for bracket in (0, 1):
        opened = (head[0] == 40) == bool(bracket)
        for size in range(1, 6):
            body = slice(bracket, bracket + size)
            name = np.all(roman[body], axis=0) | (np.all(digit[body], axis=0) & (size <= 3)) | (letter[bracket] & (size == 1))
            if bracket + size + 1 < len(head):
                out |= opened & name & closed[bracket + size] & blank[bracket + size + 1]
    return out


def measure_units(texts: Sequence[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The text each unit stands in, and its size (``chars``) and MEASURES."""
    points, text_starts = b.code_points(texts)
    kinds, low = b.flags(points), np.minimum(points, 0xFFFF)
    starts, ends = _units(points, kinds)
    n, size = len(starts), (ends - starts).astype(float)

    def count(flag: np.ndarray, first: np.ndarray = starts, last: np.ndarray = ends) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return sums[last] - sums[first]

    def per_unit(unit: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(unit, weights, minlength=n).astype(float)

    white, named = (kinds & b.WHITE) > 0, (kinds & (b.LETTER | b.DIGIT | b.MARK)) > 0
    first, last, unit = _within(*b.runs(named), starts, ends)
    (word,) = b.run_hashes(b.lower(points), first, last, [SEED])
    lettered = (kinds[first] & b.DIGIT) == 0
    words, tokens = per_unit(unit[lettered]), per_unit(unit)
    _, once = np.unique(b.mix(word ^ b.mix(unit.astype(np.uint64))), return_index=True)

    parted = white | (points == 124) | (points == 59)
    cell, cell_end, cell_unit = _within(*b.runs(~parted), starts, ends)
    digits = (points >= 48) & (points <= 57)
    # a figure: signs, then digits with points and commas, then a percent sign, then a bracket
    rank = np.select([_set(FIGURE_START)[low], _set(FIGURE_BODY)[low], points == 37, points == 41], [0, 1, 2, 3], 9).astype(np.int8)
    wrong = np.concatenate(([False], (rank[1:] < rank[:-1]) | ((rank[1:] == rank[:-1]) & (rank[1:] >= 2))))
    figure = (count(wrong, cell + 1, cell_end) == 0) & (rank[cell_end - 1] < 9) & (count(digits, cell, cell_end) > 0)
    figure |= (cell_end - cell == 1) & _set(DASHES)[low[cell]]
    figures = per_unit(cell_unit[figure])
    length = cell_end - cell
    longest = np.zeros(n)
    np.maximum.at(longest, cell_unit, length)
    long = length >= UNBROKEN

    code = np.zeros(len(points), bool)
    if len(points) > 4:
        code[:-4] = (points[:-4] == 40) & (points[1:-3] == 99) & (points[2:-2] == 105) & (points[3:-1] == 100) & (points[4:] == 58)
    same = np.concatenate(([False], (points[1:] == points[:-1]) & ~named[1:] & ~parted[1:]))
    out = {
        "chars": size,
        "words": words,
        "figures": figures / np.maximum(figures + words, 1),
        "common": per_unit(unit[np.isin(word, _common())]) / np.maximum(words, 1),
        "ended": _set(SENTENCE_END)[low[ends - 1]].astype(float),
        "marked": _marked(points, starts, ends).astype(float),
        "longest": longest,
        "symbols": count(~named & ~white) / size,
        "odd": count(_set(ODD)[low]) / size,
        "garbled": count(_set(GARBLED)[low]) / size,
        "glyphs": (8 * count(code) + count(points == 0xFFFD)) / size,
        "distinct": per_unit(unit[once]) / np.maximum(tokens, 1),
        "repeated": count(same) / size,
        "foreign": count((kinds & b.FOREIGN) > 0) / size,
        "capital": per_unit(unit[lettered & ((kinds[first] & b.UPPER) > 0)]) / np.maximum(words, 1),
        "unbroken": per_unit(cell_unit[long], length[long]) / size,
    }
    return np.searchsorted(text_starts, starts, "right") - 1, out


SEED = 0x165667B19E3779F9


def _common() -> np.ndarray:
    points, starts = b.code_points(list(dict.fromkeys(COMMON)))
    return b.run_hashes(points, starts[:-1], starts[1:] - 1, [SEED])[0]


def units(text: Column) -> Column:
    """array<struct<chars, MEASURES>> of the units of a text, all doubles; null and blank texts have none."""
    names = ("chars", *MEASURES)
    schema = "array<struct<" + ",".join(f"{n}:double" for n in names) + ">>"

    @F.arrow_udf(schema)
    def run(batch: pa.Array) -> pa.Array:
        texts, out = [t or "" for t in batch.to_pylist()], []
        for _, part in b.parts(texts):
            of, measured = measure_units(part)
            offsets = np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(measured[n]) for n in names], list(names))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([(n, pa.float64()) for n in names])))

    return run.asNondeterministic()(text)  # so that no filter on the units is pushed below them and their join, which would measure every text


@dataclass(frozen=True)
class Rule:
    """If every (feature, "<=" or ">", threshold) holds, the example is of this kind."""

    kind: str
    tests: tuple[tuple[str, str, float], ...]

    def covers(self, row: dict) -> bool:
        return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in self.tests)


def _held(table: pd.DataFrame, tests: Sequence[tuple[str, str, float]]) -> np.ndarray:
    out = np.ones(len(table), bool)
    for f, op, t in tests:
        out &= (table[f] <= t if op == "<=" else table[f] > t).to_numpy()
    return out


def _grow(table: pd.DataFrame, right: np.ndarray, weight: np.ndarray, names: Sequence[str], most: int = 8) -> list[tuple[str, str, float]]:
    """Adds the test with the most information gain until no other kind is covered, nothing is gained, or ``most`` are there."""
    tests: list[tuple[str, str, float]] = []
    while len(tests) < most:
        yes, no = weight[right].sum(), weight[~right].sum()
        if yes <= 0 or no <= 0:
            break
        base, best = np.log2(yes / (yes + no)), (0.0, 0.0, None)
        for f in names:
            values = table[f].to_numpy(float)
            order = np.argsort(values, kind="stable")
            values = values[order]
            cuts = np.flatnonzero(values[1:] > values[:-1])
            if not len(cuts):
                continue
            p, n = np.cumsum(np.where(right, weight, 0)[order])[cuts], np.cumsum(np.where(right, 0, weight)[order])[cuts]
            for op, x, y in (("<=", p, n), (">", yes - p, no - n)):
                x, y = np.maximum(x, 0), np.maximum(y, 0)
                gain = np.where(x > 1e-12, x * (np.log2(np.maximum(x, 1e-12) / np.maximum(x + y, 1e-12)) - base), -1.0).round(9)
                gap = (values[cuts + 1] - values[cuts]) / (values[-1] - values[0])
                i = max(np.flatnonzero(gain == gain.max()), key=lambda j: gap[j])
                if (gain[i], gap[i]) > best[:2]:
                    best = (gain[i], gap[i], (f, op, float((values[cuts[i]] + values[cuts[i] + 1]) / 2)))
        if best[2] is None or best[0] <= 0:
            break
        tests.append(best[2])
        left = _held(table, tests[-1:])
        table, right, weight = table[left], right[left], weight[left]
    return tests


def induce(rows: Sequence[dict] | pd.DataFrame, label: str, default: str, names: Sequence[str], weight: str | None = None, seed: int = 7, misses: int = 5) -> list[Rule]:
    """An ordered rule list by incremental reduced-error pruning; kinds from the rarest to the most common, ``default`` last.

    A kind is left once ``misses`` draws in a row give no rule that is right more often than not. Deterministic for
    equal rows in any order. Without rows, or with one kind only, the list is empty.
    """
    table = pd.DataFrame(rows)
    if not len(table):
        return []
    table = table.sort_values([label, *names, *([weight] if weight else [])], kind="stable").reset_index(drop=True)
    kinds, weights = table[label].to_numpy(object), table[weight].to_numpy(float) if weight else np.ones(len(table))
    draw, out, left = np.random.default_rng(seed), [], np.arange(len(table))
    for kind in sorted({*kinds} - {default}, key=lambda k: (weights[kinds == k].sum(), k)):
        missed = 0
        while missed < misses and (kinds[left] == kind).any():
            side = draw.random(len(left))
            grow, prune = left[side < 2 / 3], left[side >= 2 / 3]
            tests = _grow(table.iloc[grow], kinds[grow] == kind, weights[grow], names)

            def worth(k: int, tests=tests, prune=prune, kind=kind) -> tuple[float, int]:
                covered = _held(table.iloc[prune], tests[:k])
                yes, every = weights[prune][covered & (kinds[prune] == kind)].sum(), weights[prune][covered].sum()
                return ((2 * yes - every) / every if every > 0 else -1.0, -k)

            value, keep = max((worth(k) for k in range(1, len(tests) + 1)), default=(-1.0, 0))
            covered = _held(table.iloc[left], tests[:-keep])
            if value <= 0 or not (kinds[left][covered] == kind).any():
                missed += 1
                continue
            missed = 0
            out.append(Rule(kind, tuple(tests[:-keep])))
            left = left[~covered]
    return out


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def case_sql(rules: Sequence[Rule], default: str, row: str = "") -> str:
    """The rule list as one SQL CASE expression over the feature columns, or over the fields of ``row``."""
    if not rules:
        return _text(default)
    at = f"{row}." if row else ""
    whens = " ".join("WHEN " + " AND ".join(f"{at}{f} {op} CAST('{t!r}' AS DOUBLE)" for f, op, t in r.tests) + f" THEN {_text(r.kind)}" for r in rules)
    return f"CASE {whens} ELSE {_text(default)} END"


@dataclass(frozen=True)
class Model:
    """The rules of the units, the kinds in order (their shares are s0, s1, ...), and the rules of the documents."""

    unit_rules: tuple[Rule, ...]
    kinds: tuple[str, ...]
    document_rules: tuple[Rule, ...]
    default: str


def _shares(df: DataFrame, units_column: str, unit_rules: Sequence[Rule], kinds: Sequence[str], default: str) -> DataFrame:
    """``df`` with s0, s1, ...: the share of the characters that the units of each kind hold; 0 without units."""
    named = F.expr(f"transform({units_column}, u -> struct({case_sql(unit_rules, default, 'u')} as kind, u.chars as chars))")
    out = df.withColumn("fm_named", named)
    total = F.aggregate("fm_named", F.lit(0.0), lambda a, u: a + u["chars"])

    def held(kind: str) -> Column:
        return F.aggregate("fm_named", F.lit(0.0), lambda a, u: a + F.when(u["kind"] == kind, u["chars"]).otherwise(0.0))

    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[_ratio(held(k), total).alias(f"s{i}") for i, k in enumerate(kinds)])


def learn(docs: DataFrame, key: str, text: str, labels: DataFrame, label: str, default: str = "prose", max_rows: int = 20_000, max_units: int = 60_000) -> Model:
    """Both rule lists from the labelled documents, at most ``max_rows`` of them and ``max_units`` of their units (those of the least hash).

    Repeated labels count once; of conflicting labels of one document the least counts. Each document weighs the same.
    """
    given = labels.select(F.col(key).alias("fm_key"), F.col(label).alias("fm_label")).filter("fm_key is not null and fm_label is not null").groupBy("fm_key").agg(F.min("fm_label").alias("fm_label"))
    sample = F.broadcast(given.orderBy(F.xxhash64("fm_key"), "fm_key").limit(max_rows))  # at most max_rows short rows
    measured = docs.select(F.col(key).alias("fm_key"), F.col(text).alias("fm_text")).join(sample, "fm_key").withColumn("fm_units", units(F.col("fm_text"))).drop("fm_text")
    each = measured.select("fm_label", F.aggregate("fm_units", F.lit(0.0), lambda a, u: a + u["chars"]).alias("fm_total"), F.posexplode("fm_units").alias("fm_no", "u"), "fm_key")
    rows = each.select("fm_label", (F.col("u.chars") / F.col("fm_total")).alias("fm_weight"), *[f"u.{m}" for m in MEASURES], F.xxhash64("fm_key", "fm_no").alias("fm_hash")).orderBy("fm_hash").limit(max_units).drop("fm_hash").toPandas()
    unit_rules = induce(rows, "fm_label", default, MEASURES, "fm_weight")
    kinds = (*sorted({*rows["fm_label"]} - {default}), default)
    whole = _shares(measured, "fm_units", unit_rules, kinds, default).drop("fm_units", "fm_key").toPandas()
    return Model(tuple(unit_rules), kinds, tuple(induce(whole, "fm_label", default, [f"s{i}" for i in range(len(kinds))])), default)


def document_kinds(docs: DataFrame, key: str, text: str, labels: DataFrame, label: str, default: str = "prose", max_rows: int = 20_000, model: Model | None = None) -> DataFrame:
    """``key``, STATISTICS, share_KIND (of the characters, by the unit rules) for every kind labelled, and ``kind`` by the document rules.

    Null text has the statistics of an empty one. Learns from the labels when the query is built, unless a ``model`` is given.
    """
    m = model or learn(docs, key, text, labels, label, default, max_rows)
    base = statistics(docs.select(F.col(key).alias("fm_key"), F.col(text).alias("fm_text")), "fm_text").withColumn("fm_units", units(F.col("fm_text")))
    held = _shares(base, "fm_units", m.unit_rules, m.kinds, default)
    return held.select(F.col("fm_key").alias(key), *STATISTICS, *[F.col(f"s{i}").alias(f"share_{k}") for i, k in enumerate(m.kinds)], F.expr(case_sql(m.document_rules, default)).alias("kind"))
