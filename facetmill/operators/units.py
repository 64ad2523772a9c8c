"""Amounts in many units and scales brought to common units (problem 6).

Every printed amount gets the unit symbol stated nearest to it: in its cell, its row's label, its column's
header, the table's corner, the table's scale, or the statement just before the table. A symbol such as ``m``
or ``USDm`` may mean more than one factor; the meanings are chosen together from an identity that holds between
the two columns of the data, printed x factor(printed symbol) = tagged x factor(tagged symbol), by the
combination with the least sum of absolute log residuals over all facts. Symbols that mean something else in a
combination as good, such as those no fact speaks about, keep the conventional meaning on a tie and are flagged.
A source whose own facts plainly speak for another combination than all facts together (``source_meanings``) gets
that one, so that one filer who writes ``m`` for thousands is read as that filer means it.

The evidence that reaches the driver is one count per (symbol, symbol, rounded log ratio): both symbols come
from the fixed lists below and the ratio has at most 801 values, so its size has a bound that the data cannot move.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a unit symbol may mean, the conventional meaning first.
PRINTED: dict[str, tuple[float, ...]] = {
    "one": (1.0,), "thousand": (1e3,), "million": (1e6,), "billion": (1e9,), "k": (1e3,), "m": (1e6, 1e3), "M": (1e6, 1e3), "mm": (1e6, 1e3), "b": (1e9,), "bn": (1e9,),
    "cent": (0.01,), "percent": (0.01,), "bp": (1e-4,),
}
TAGGED: dict[str, tuple[float, ...]] = {
    "one": (1.0,), "thousand": (1e3,), "k": (1e3,), "million": (1e6,), "m": (1e6, 1e3), "mm": (1e6, 1e3), "billion": (1e9,), "bn": (1e9,), "cent": (0.01,), "percent": (0.01,), "bp": (1e-4,),
}

#: Any statement of a unit within a short phrase.
UNIT_WORD = r"(?i)thousand|million|billion|(?<![\d.,])000s?\b|\bmm\b|\bbn\b|[$]\s?(?:mm?|bn?|k)\b|\bUS[$]\s?(?:mm?|k|bn?)\b|\bUSD\s?(?:mm?|k|bn?)\b|\bdollars\b|US[$]|\bUSD\b|[$]\)?\s*$|\bnumber\b|\bcents?\b|¢|%|\bpercent\b|\bpct\b|\bbasis points\b|\bbps?\b"
FOLD_FROM = "".join(map(chr, [*range(0xFF01, 0xFF5F), 0xA0, 0x2007, 0x202F, 0x2009, 0x2002, 0x2003, 0x2005, 0x3000, 0x2212, 0x2010, 0x2011, 0x2012]))
FOLD_TO = "".join(map(chr, range(0x21, 0x7F))) + " " * 8 + "----"


def folded(text: Column) -> Column:
    """Full-width forms, spaces and minus signs as their plain ones; invisible characters gone."""
    return F.translate(F.regexp_replace(text, "[­​-‏⁠︀-️﻿]", ""), FOLD_FROM, FOLD_TO)


def printed_number(cell: Column) -> Column:
    """The number of a printed cell without its unit; parentheses or a leading minus make it negative, a lone dash is 0, no number is null."""
    s = F.regexp_replace(folded(cell), r"\s", "")
    lone = s.rlike("^[$(]*[-–—]+[)]*$")
    digits = F.regexp_replace(F.regexp_extract(s, r"(\d[\d,]*(?:\.\d+)?|\.\d+)", 1), ",", "")
    value = digits.try_cast("double")
    return F.when(lone, F.lit(0.0)).otherwise(F.when(s.rlike(r"^[$]?\(|^[$]?[-–—]"), -value).otherwise(value))


# The spellings of each unit symbol.
SPELLINGS: dict[str, str] = {
    "thousand": "thousand", "thousands": "thousand", "000": "thousand", "000s": "thousand", "k": "k", "million": "million", "millions": "million", "mm": "mm", "m": "m", "M": "M", "billion": "billion", "billions": "billion", "bn": "bn", "b": "b",
    "cent": "cent", "cents": "cent", "c": "cent", "¢": "cent", "%": "percent", "percent": "percent", "pct": "percent", "bp": "bp", "bps": "bp", "basis point": "bp", "basis points": "bp",
}
TOKEN = r"thousands?|millions?|billions?|(?<![\d.,])000s?\b|\bmm\b|\bbn\b|(?<=[$]|[$] |USD|USD |[(])(?:mm?|bn?|k)\b|\bcents?\b|¢|%|\bpercent\b|\bpct\b|\bbasis points?\b|\bbps?\b"
BASE = r"(?i)\bdollars\b|US[$]|\bUSD\b|[$]\)?\s*$|\bnumber\b|\bsingle shares\b"


def _symbol(token: Column) -> Column:
    """One lookup in a literal map, so that the generated code stays small."""
    names = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, token), F.try_element_at(names, F.lower(token)))


def cell_symbol(cell: Column) -> Column:
    """The unit symbol written after a cell's number, null if none."""
    return _symbol(F.regexp_extract(F.trim(folded(cell)), r"[\d.]\s*([A-Za-z%¢][A-Za-z ]*?)\s*\)?$", 1))


def phrase_symbol(phrase: Column) -> Column:
    """The money or count symbol of a short phrase such as ``(US$ m)`` or ``in thousands``, null if none."""
    return F.coalesce(_symbol(F.regexp_extract(phrase, "(?i)" + TOKEN, 0)), F.when(phrase.rlike(BASE), "one"))


def factor_symbol(factor: Column) -> Column:
    """The symbol of an explicit scale factor; a factor outside the fixed list gives null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ((1.0, "one"), (1e3, "thousand"), (1e6, "million"), (1e9, "billion"), (0.01, "cent")) for x in pair]), factor.cast("double"))


def tagged_symbol(unit: Column) -> Column:
    """The scale symbol of a tagged unit; a null or unknown unit counts as single units."""
    token = F.regexp_extract(F.trim(unit), r"(?i)thousands?|millions?|billions?|(?<![\d.,])000\b|(?:\b|(?<=USD))(?:mm|bn)\b|^k(?=[A-Z]{3}$)|(?<=^[A-Z]{3})[mk]$|\b[mk]\b|\bcents?\b|¢|%|\bpercent\b|\bpct\b|\bbps?\b|\bbasis points?\b", 0)
    return F.coalesce(_symbol(F.lower(token)), F.lit("one"))


def statement(text: Column) -> Column:
    """What a text block states about the amounts that follow: struct<money, shares, per_share> of symbols, null if nothing.

    The last sentence or line that speaks of amounts counts. A sentence without a share clause covers shares too
    when it excepts only per-share amounts.
    """
    opens = r"(?i)^\W*(?:amounts|figures|dollars|in (?:thousands|millions|billions|whole|single)|tabular|all (?:amounts|figures)|expressed|us[$]|[$](?:0|m|b|k|thousand|million))"
    parts = F.split(folded(text), r"\n|(?<=[a-z)][.])\s+")
    said = F.filter(parts, lambda s: s.rlike(r"(?i)per-share (?:amounts|data)|in (?:thousands|millions|billions|whole dollars)|[$]000s|US[$] ?(?:mm?|k|bn)\b") & (s.rlike(opens) | s.rlike("(?i)per-share amounts")))
    s = F.element_at(said, -1)
    clause = F.regexp_extract(s, r"(?i)\b((?:number of )?(?:shares|share counts?)\b[^;,.]*)", 1)
    money = phrase_symbol(F.regexp_replace(s, r"(?i)\b(?:number of |and )?(?:shares|share counts?)\b.*$|\b(?:except )?per-share.*$", ""))
    shares = F.when(clause != "", phrase_symbol(clause)).when(s.rlike(r"(?i)per-share"), money)
    per_share = F.when(s.rlike(r"(?i)per-share [^.;]*\bcents\b"), "cent").when(s.rlike(r"(?i)per-share"), "one")
    return F.when(F.size(said) > 0, F.struct(money.alias("money"), shares.alias("shares"), per_share.alias("per_share")))


@dataclass(frozen=True)
class Meanings:
    """The chosen factor of every symbol, and the symbols whose choice is not unique."""

    printed: dict[str, float]
    tagged: dict[str, float]
    open_symbols: tuple[str, ...]


UNSURE = [(kind, s) for kind, options in enumerate((PRINTED, TAGGED)) for s, factors in options.items() if len(factors) > 1]
COMBINATIONS = list(product(*[(PRINTED, TAGGED)[kind][s] for kind, s in UNSURE]))  # 32, the conventional one first


def _costs(evidence: Iterable[tuple[str, str, float, int]], cap: float) -> list[float]:
    """The sum of the capped absolute log residuals under each combination."""
    place = {x: i for i, x in enumerate(UNSURE)}
    spread: dict[tuple[str, str], list[tuple[float, int]]] = defaultdict(list)
    for p, t, d, n in evidence:
        if p in PRINTED and t in TAGGED:
            spread[p, t].append((d, n))

    def factor(picks: tuple[float, ...], kind: int, symbol: str) -> float:
        return picks[place[kind, symbol]] if (kind, symbol) in place else (PRINTED, TAGGED)[kind][symbol][0]

    @cache
    def cost(p: str, t: str, shift: float) -> float:
        return sum(n * min(cap, abs(d + shift)) for d, n in spread[p, t])

    return [sum(cost(p, t, math.log10(factor(picks, 1, t)) - math.log10(factor(picks, 0, p))) for p, t in spread) for picks in COMBINATIONS]


def choose_meanings(evidence: Iterable[tuple[str, str, float, int]], cap: float = 1.5, margin: float = 1.05) -> Meanings:
    """The symbol meanings with the least total log residual.

    ``evidence`` holds (printed symbol, tagged symbol, log10 of |tagged| / |printed|, count). Residuals are
    capped so that wrong amounts count alike whatever their size. Every combination of the meanings of the ambiguous
    symbols is tried (32, from the fixed lists); a tie keeps the conventional meaning. A symbol is open if it has
    another meaning in any combination within ``margin`` of the least.
    """
    costs = _costs(evidence, cap)
    best = COMBINATIONS[costs.index(min(costs))]
    near = [x for x, c in zip(COMBINATIONS, costs, strict=True) if not c > margin * min(costs)]
    opened = tuple(("printed ", "tagged ")[kind] + s for i, (kind, s) in enumerate(UNSURE) if any(x[i] != best[i] for x in near))
    chosen = {x: f for x, f in zip(UNSURE, best, strict=True)}
    return Meanings({s: chosen.get((0, s), PRINTED[s][0]) for s in PRINTED}, {s: chosen.get((1, s), TAGGED[s][0]) for s in TAGGED}, opened)


def departures(evidence: Iterable[tuple[str, str, float, int]], common: Meanings, cap: float = 1.5, least: int = 20) -> list[tuple[str, str, float]]:
    """(printed or tagged, symbol, factor) where one source means another combination than all sources together.

    The common meanings are the prior: the source's own least-cost combination counts only if it saves the residuals
    of at least ``least`` wholly wrong facts and halves the cost, so a few wrong amounts never explain themselves away.
    """
    costs = _costs(evidence, cap)
    prior = tuple((common.printed, common.tagged)[kind][s] for kind, s in UNSURE)
    usual, best = costs[COMBINATIONS.index(prior)], min(costs)
    if usual - best < least * cap or best > usual / 2:
        return []
    near = [x for x, c in zip(COMBINATIONS, costs, strict=True) if c <= best]
    pick = min(near, key=lambda x: sum(a != b for a, b in zip(x, prior, strict=True)))  # of equals the nearest to the prior
    return [(("printed", "tagged")[kind], s, f) for (kind, s), f, was in zip(UNSURE, pick, prior, strict=True) if f != was]


def _may_state(text: Column) -> Column:
    """False only where ``statement`` is surely null: cheap tests of plain text before its patterns."""
    low = F.lower(text)
    hints = [low.contains(x) for x in ("per-share", "in thousands", "in millions", "in billions", "in whole dollars", "$000s", "us$")]
    any_hint = hints[0]
    for h in hints[1:]:
        any_hint = any_hint | h
    return (F.octet_length(text) != F.char_length(text)) | any_hint


def _table_statements(records: DataFrame) -> DataFrame:
    """rec_id of each table and what the Text block just before it on its page states."""
    w = Window.partitionBy("doc_id", "page").orderBy("block_order").rangeBetween(Window.unboundedPreceding, -1)
    slim = records.select("rec_id", "doc_id", "page", "block_order", F.col("tbl").isNotNull().alias("has"), F.when((F.col("block_type") == "Text") & _may_state(F.col("text")), statement(F.col("text"))).alias("said"))
    return slim.select("rec_id", "has", F.last(F.struct("said")).over(w)["said"].alias("said")).filter(F.col("has") & F.col("said").isNotNull()).select("rec_id", "said").dropDuplicates(["rec_id"])


def cell_facts(records: DataFrame, facts: DataFrame, source: str | None = None) -> DataFrame:
    """Facts that name a printed cell, with the cell, its kind and its symbol: one row per fact and distinct table.

    Columns: fact_id, rec_id, row_no, col_no, fact_value, unit, kind, printed (text), number, symbol, stated_in
    (cell, row, column, corner, scale, text or none), explicit (the scale's own factor where it is none of the usual
    ones), tagged (symbol) and source (of the record; null without ``source``). Facts without a cell, of a record that
    is absent or has no table, or beyond its grid have no row. Where row_kinds is absent or too short the kind is
    read from the label (per share, shares, else money).
    """
    named = facts.select("fact_id", "rec_id", "row_no", "col_no", "fact_value", "unit").filter("rec_id is not null and row_no >= 0 and col_no >= 0").distinct()
    tables = _printed_tables(records, source)
    j = named.join(tables, "rec_id").join(_table_statements(records), "rec_id", "left")
    header = "coalesce(get(kinds, q) = 'header', q = 0)"
    above = f"filter(transform(if(row_no > 0, sequence(0, row_no - 1), cast(array() as array<int>)), q -> if({header}, get(get(raw, q), %s), null)), h -> h rlike unit_word)"
    j = j.withColumn("unit_word", F.lit(UNIT_WORD)).selectExpr("*", "get(get(raw, row_no), col_no) as printed", "get(get(raw, row_no), 0) as label", f"try_element_at({above % 'col_no'}, -1) as head", f"try_element_at({above % '0'}, -1) as corner", "get(kinds, row_no) as stated_kind")
    r = _with_symbols(_stated_in_row(j), ["fact_id", "fact_value", "unit", "source"])
    return r.select("source", "fact_id", "rec_id", "row_no", "col_no", "fact_value", "unit", "kind", "printed", "number", "symbol", "stated_in", "explicit", tagged_symbol(F.col("unit")).alias("tagged"))


def _printed_tables(records: DataFrame, source: str | None) -> DataFrame:
    named = f"cast(`{source}` as string)" if source else "cast(null as string)"
    return records.filter("tbl.raw_cells is not null").selectExpr("rec_id", f"{named} as source", "tbl.raw_cells as raw", "tbl.scale as scale", "tbl.row_kinds as kinds")


def _stated_in_row(j: DataFrame) -> DataFrame:
    """Adds kind, rate, in_row and in_corner to rows with label, stated_kind and corner: what does not depend on the column."""
    j = j.withColumn("label", F.coalesce(folded(F.col("label")), F.lit(""))).withColumn("corner", folded(F.col("corner")))
    label = F.col("label")
    kind = F.when(F.col("stated_kind").isin("money", "shares", "per_share"), F.col("stated_kind")).when(label.rlike(r"(?i)per[ -]share"), "per_share").when(label.rlike(r"(?i)\bshares\b"), "shares").otherwise("money")
    j = j.withColumn("kind", kind).withColumn("tail", F.regexp_extract(label, r"((?:[(,]|\bin\s)[^(),]*\)?)\s*$", 1))
    j = j.withColumn("in_row", F.coalesce(phrase_symbol(F.col("tail")), F.when(F.col("tail").rlike("[$]"), "one")))
    rate = F.col("kind").eqNullSafe("money") & label.rlike(r"(?i)\b(?:rate|percentage|growth)\b|\bchange in\b")
    return j.withColumn("in_corner", phrase_symbol(F.col("corner"))).withColumn("rate", rate).drop("tail", "label", "stated_kind")


def _with_symbols(j: DataFrame, keep: list[str]) -> DataFrame:
    """keep, the place, the cell, its kind, number, symbol, stated_in and explicit, of rows that hold what is stated around a cell."""
    j = j.filter("printed is not null").withColumn("head", folded(F.col("head"))).withColumn("in_head", phrase_symbol(F.col("head")))
    in_row, in_head, in_corner, rate = F.col("in_row"), F.col("in_head"), F.col("in_corner"), F.col("rate")
    money, shares, per_share = (F.col("kind") == k for k in ("money", "shares", "per_share"))
    of_shares = F.lit(r"(?i)\bshares?\b|per.share amounts")
    j = j.withColumn("scale_factor", F.try_element_at("scale", F.col("kind")))
    from_scale = F.coalesce(factor_symbol(F.col("scale_factor")), F.when(F.col("scale_factor").isNotNull(), "explicit"))
    ways = [
        ("cell", cell_symbol(F.col("printed"))),
        ("row", F.when(money & (~rate | in_row.isin("percent", "bp")), in_row).when(shares & ~in_row.isin("cent", "percent", "bp"), in_row).when(per_share & in_row.isin("cent", "one"), in_row)),
        ("column", F.when(money & ~rate, in_head).when(shares & F.rlike("head", of_shares), in_head).when(per_share & (in_head == "cent"), in_head)),
        ("corner", F.when(money & ~rate, in_corner).when(shares & F.rlike("corner", of_shares), in_corner).when(per_share & (in_corner == "cent"), in_corner)),
        ("scale", F.when(~rate, from_scale)),
        ("text", F.when(money & ~rate, F.col("said.money")).when(shares, F.col("said.shares")).when(per_share, F.col("said.per_share"))),
    ]
    found = F.coalesce(*[F.when(s.isNotNull(), F.struct(s.alias("symbol"), F.lit(w).alias("stated_in"))) for w, s in ways], F.struct(F.lit("one").alias("symbol"), F.lit("none").alias("stated_in")))
    return j.withColumn("fm_unit", found).select(*keep, "rec_id", "row_no", "col_no", "kind", "printed", printed_number(F.col("printed")).alias("number"), "fm_unit.symbol", "fm_unit.stated_in", F.when(F.col("fm_unit.symbol") == "explicit", F.col("scale_factor")).alias("explicit"))


def printed_cells(records: DataFrame, source: str | None = None) -> DataFrame:
    """Every printed cell of every table with its kind and its symbol, whether or not a fact names it: one row per cell and distinct table.

    Columns: source, place (header, label or body), rec_id, row_no, col_no, kind, printed (text), number, symbol, stated_in
    and explicit, as in ``cell_facts``. A table's few header rows travel with each of its rows, so the cells of a
    table cost its cells times its header rows.
    """
    header = "coalesce(get(kinds, {q}) = 'header', {q} = 0)"
    tables = _printed_tables(records, source)
    tables = tables.withColumn("heads", F.expr(f"filter(transform(raw, (x, i) -> struct(i as q, x as cells)), h -> {header.format(q='h.q')})"))
    lines = tables.join(_table_statements(records), "rec_id", "left").select("rec_id", "source", "scale", "kinds", "heads", "said", F.posexplode("raw").alias("row_no", "line"))
    lines = lines.withColumn("unit_word", F.lit(UNIT_WORD)).selectExpr("rec_id", "source", "row_no", "line", "scale", "said", "unit_word", "get(kinds, row_no) as stated_kind", f"{header.format(q='row_no')} as in_header", "get(line, 0) as label", "filter(heads, h -> h.q < row_no) as heads")
    lines = lines.withColumn("corner", F.expr("try_element_at(filter(transform(heads, h -> get(h.cells, 0)), h -> h rlike unit_word), -1)"))
    lines = _stated_in_row(lines)
    cells = lines.select(*[c for c in lines.columns if c != "line"], F.posexplode("line").alias("col_no", "printed"))
    cells = cells.withColumn("head", F.expr("try_element_at(filter(transform(heads, h -> get(h.cells, col_no)), h -> h rlike unit_word), -1)"))
    cells = cells.withColumn("place", F.when(F.col("in_header"), "header").when(F.col("col_no") == 0, "label").otherwise("body"))
    return _with_symbols(cells, ["source", "place"]).distinct()


def all_amounts(records: DataFrame, facts: DataFrame, source: str | None = None) -> DataFrame:
    """Every printed cell and every fact, side by side where the fact names the cell; input of ``meanings`` and ``convert``.

    Columns as in ``cell_facts``, and place. A cell without a fact has a null fact_id; a fact that names no cell, or
    one of an absent record or beyond its grid, has a null printed. The years of header rows and the digits of
    labels are no amounts: their number is null unless a fact names them.
    """
    tagged = facts.select("fact_id", "rec_id", "row_no", "col_no", "fact_value", "unit").distinct().withColumn("tagged", tagged_symbol(F.col("unit"))).withColumn("fm_fact", F.lit(True))
    names = F.coalesce(F.expr("rec_id is not null and row_no >= 0 and col_no >= 0"), F.lit(False))
    both = printed_cells(records, source).join(tagged.filter(names), ["rec_id", "row_no", "col_no"], "full_outer")
    rows = both.unionByName(tagged.filter(~names), allowMissingColumns=True)
    amount = F.col("fm_fact").isNotNull() | (F.col("place") == "body")
    return rows.select("source", "fact_id", "rec_id", "row_no", "col_no", "fact_value", "unit", "place", "kind", "printed", F.when(amount, F.col("number")).alias("number"), "symbol", "stated_in", "explicit", "tagged")


def evidence(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, symbol, tagged, log ratio, count) over all facts with two non-zero numbers."""
    ratio = F.round(F.log10(F.abs("fact_value")) - F.log10(F.abs("number")), 1)
    usable = rows.filter("number <> 0 and fact_value <> 0 and not isnan(fact_value)")
    return usable.groupBy(*by, "symbol", "tagged", F.greatest(F.lit(-40.0), F.least(F.lit(40.0), ratio)).alias("ratio")).agg(F.count(F.lit(1)).alias("n"))


def meanings(rows: DataFrame) -> Meanings:
    """The symbol meanings that the facts support; the collected evidence has at most 13 x 11 x 801 rows."""
    return choose_meanings([(r["symbol"], r["tagged"], r["ratio"], r["n"]) for r in evidence(rows).collect()])


def source_meanings(rows: DataFrame, common: Meanings, cap: float = 1.5, least: int = 20) -> DataFrame:
    """source, printed and tagged (maps of symbol to factor) of the sources that mean other factors than ``common``.

    The counts of a source, of bounded number like those of ``meanings``, meet in one group. Sources whose facts with
    ambiguous symbols cannot save what ``departures`` asks for, whatever the combination, are left out before.
    """
    counts = evidence(rows.filter("source is not null"), ("source",))
    shift = F.log10(_factor(F.col("tagged"), common.tagged)) - F.log10(_factor(F.col("symbol"), common.printed))
    residual = F.coalesce(F.col("n") * F.least(F.lit(cap), F.abs(F.col("ratio") + shift)), F.lit(0.0))
    unsure = F.concat(F.lit("0"), "symbol").isin(*[f"{k}{s}" for k, s in UNSURE]) | F.concat(F.lit("1"), "tagged").isin(*[f"{k}{s}" for k, s in UNSURE])
    one = Window.partitionBy("source")
    counts = counts.withColumn("fm_all", F.sum(residual).over(one)).withColumn("fm_unsure", F.sum(F.when(unsure, residual).otherwise(0.0)).over(one))
    counts = counts.filter((F.col("fm_unsure") >= least * cap * (1 - 1e-9)) & (2 * F.col("fm_unsure") >= F.col("fm_all") * (1 - 1e-9))).drop("fm_all", "fm_unsure")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        found = departures(zip(group.symbol, group.tagged, group.ratio, group.n, strict=True), common, cap, least)
        return pd.DataFrame([(group.source.iloc[0], *x) for x in found], columns=["source", "kind", "symbol", "factor"])

    schema = T.StructType([T.StructField(c, T.DoubleType() if c == "factor" else T.StringType()) for c in ("source", "kind", "symbol", "factor")])
    every = counts.groupBy("source").applyInPandas(choose, schema)
    of = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("symbol", "factor")))).alias(kind)
    return every.groupBy("source").agg(of("printed"), of("tagged"))


def _factor(symbol: Column, chosen: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair]), symbol)


def convert(rows: DataFrame, chosen: Meanings, rel: float = 1e-3, of_sources: DataFrame | None = None) -> DataFrame:
    """Adds printed_amount and fact_amount in common units, differs, and unit_open (a symbol whose meaning was not unique).

    differs is true where both amounts are present and apart by more than ``rel`` of the printed amount, sign
    included (a printed 0 agrees only with 0); it is null where either amount is missing. ``of_sources`` holds what
    single sources mean (``source_meanings``).
    """
    j = rows if of_sources is None else rows.join(of_sources.select("source", F.col("printed").alias("fm_printed"), F.col("tagged").alias("fm_tagged")), "source", "left")
    own = lambda held, symbol: F.lit(None).cast("double") if of_sources is None else F.try_element_at(held, F.col(symbol))
    own_printed, own_tagged = own("fm_printed", "symbol"), own("fm_tagged", "tagged")
    out = j.withColumn("printed_amount", F.col("number") * F.coalesce(F.col("explicit"), own_printed, _factor(F.col("symbol"), chosen.printed))).withColumn("fact_amount", F.col("fact_value") * F.coalesce(own_tagged, _factor(F.col("tagged"), chosen.tagged)))
    gap = F.abs(F.col("fact_amount") - F.col("printed_amount"))
    unsure = F.array(*[F.lit(s) for s in chosen.open_symbols]) if chosen.open_symbols else F.expr("cast(array() as array<string>)")
    opened = lambda kind, symbol, held: F.coalesce(F.array_contains(unsure, F.concat(F.lit(kind), symbol)), F.lit(False)) & held.isNull()
    out = out.withColumn("differs", gap > F.abs("printed_amount") * rel + 1e-12).withColumn("unit_open", opened("printed ", F.col("symbol"), own_printed) | opened("tagged ", F.col("tagged"), own_tagged))
    return out.drop("fm_printed", "fm_tagged")
