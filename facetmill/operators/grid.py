"""Table grids in long form: (table, r, c, cell).

Every operator takes the columns that name a table (``keys``) and partitions by them; a table is bounded by a
page, so no group grows with the data. Rows and columns of a table are looked at through windows over the table
(ordered by r or c, framed on the current row or column), so that one shuffle by ``keys`` serves a chain of operators.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill.functions import numbers, text


@dataclass(frozen=True)
class TableRules:
    """Thresholds of the table checks."""

    min_rows: int = 5
    min_cols: int = 3
    min_coverage: float = 0.5
    max_label_merge: float = 0.2
    whitespace_weight: float = 0.5
    accept_score: float = 80.0
    shares_pattern: str = r"shares used|weighted.average.*shares|number of shares"
    per_share_pattern: str = r"per share|per-share"


def clean_grid(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drops columns of only blanks and ``$``, then value columns without a digit, then blank rows; renumbers r and c from 0.

    The first column left after the first step holds the labels and always stays. Cells are trimmed, line breaks
    become spaces, null counts as blank.
    """
    k = list(keys)
    blank = F.col("cell").isin("", "$")
    table, column, row = Window.partitionBy(*k), _same(k, "c"), _same(k, "r")
    cells = cells.select(*k, "r", "c", text.strip(F.replace(F.coalesce("cell", F.lit("")), F.lit("\n"), F.lit(" "))).alias("cell"))
    cells = cells.withColumn("fm_first", F.min(F.when(~blank, F.col("c"))).over(table))
    cells = cells.withColumn("fm_any", F.max(~blank).over(column)).withColumn("fm_digit", F.max(F.col("cell").rlike(r"\d")).over(column))
    cells = cells.filter("fm_any and (c = fm_first or fm_digit)").withColumn("fm_c", F.dense_rank().over(table.orderBy("c")) - 1)
    cells = cells.withColumn("fm_row", F.max(F.col("cell") != "").over(row)).filter("fm_row").withColumn("fm_r", F.dense_rank().over(table.orderBy("r")) - 1)
    return cells.select(*k, F.col("fm_r").alias("r"), F.col("fm_c").alias("c"), "cell")


def _same(keys: Sequence[str], by: str):
    """The window of the cells of one row (``r``) or column (``c``) of a table, partitioned by the table only."""
    return Window.partitionBy(*keys).orderBy(by).rangeBetween(Window.currentRow, Window.currentRow)


def as_rows(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, r, row array<string> in column order."""
    ordered = F.array_sort(F.collect_list(F.struct("c", "cell")))
    return cells.groupBy(*keys, "r").agg(F.transform(ordered, lambda x: x["cell"]).alias("row"))


def merge_wrapped_labels(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joins a label that wraps: the row before has a label only and ends in ; or , and the next starts in lower case or with a digit.

    Merges chain on the merged row. A fold over each table's ordered rows; r is renumbered from 0. Tables of one
    column stay as they are.
    """
    k = list(keys)
    rows = as_rows(cells, k).groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "row"))), lambda x: x["row"]).alias("rows"))

    def step(done: Column, row: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        label, first = F.rtrim(last[0], F.lit(text.WHITE)), F.substring(row[0], 1, 1)
        open_label = (F.size(row) > 1) & (last[0] != "") & F.forall(F.slice(last, 2, F.greatest(F.size(last) - 1, F.lit(0))), lambda v: v == "") & label.rlike("[;,]$")
        goes_on = (first != "") & (first.rlike(r"\d") | ((F.lower(first) == first) & (F.upper(first) != first)))
        joined = F.concat(F.array(F.concat_ws(" ", label, text.strip(row[0]))), F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0))))
        merges = (F.size(done) > 0) & F.coalesce(open_label & goes_on, F.lit(False))
        return F.when(merges, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(row)))

    merged = rows.withColumn("rows", F.aggregate("rows", F.expr("cast(array() as array<array<string>>)"), step))
    return merged.select(*k, F.posexplode("rows").alias("r", "row")).select(*k, "r", F.posexplode("row").alias("c", "cell"))


def with_row_kinds(cells: DataFrame, keys: Sequence[str], rules: TableRules = TableRules()) -> DataFrame:
    """cells with row_kind (header, money, shares, per_share): a row without numbers sets the section of the rows below it.

    A row of years without a label is a header; a row's own label overrides the section; a blank label keeps it.
    """
    k = list(keys)
    row = _same(k, "r")
    value = (F.col("c") > 0) & numbers.to_number(F.col("cell"))["value"].isNotNull()
    flagged = cells.withColumn("fm_value", value)
    flagged = flagged.withColumn("fm_label", F.lower(F.max(F.when(F.col("c") == 0, F.col("cell"))).over(row))).withColumn("fm_n", F.count_if("fm_value").over(row))
    flagged = flagged.withColumn("fm_other", F.count_if(F.col("fm_value") & ~text.strip(F.col("cell")).rlike(text.YEAR_ONLY)).over(row))
    label = F.col("fm_label")
    flagged = flagged.withColumn("fm_own", F.when(label.rlike(rules.shares_pattern), "shares").when(label.rlike(rules.per_share_pattern), "per_share"))
    sets = F.when(F.col("fm_n") == 0, F.coalesce("fm_own", F.when(label != "", "money")))
    so_far = Window.partitionBy(*k).orderBy("r").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.coalesce(F.last(sets, True).over(so_far), F.lit("money"))
    header = (F.col("fm_n") == 0) | ((F.col("fm_other") == 0) & (text.strip(label) == ""))
    return flagged.withColumn("row_kind", F.when(header, "header").otherwise(F.coalesce("fm_own", section))).select(*[c for c in cells.columns if c != "row_kind"], "row_kind")


def classify_rows(cells: DataFrame, keys: Sequence[str], rules: TableRules = TableRules()) -> DataFrame:
    """keys, r, row_kind of ``with_row_kinds``."""
    return with_row_kinds(cells, keys, rules).select(*keys, "r", "row_kind").distinct()


def normalize_grid(cells: DataFrame, keys: Sequence[str], captions: DataFrame, rules: TableRules = TableRules()) -> DataFrame:
    """cells with row_kind and num: the scaled number of every value cell outside headers. ``captions``: keys, text of the page."""
    k = list(keys)
    scales = captions.select(*k, numbers.caption_scales(F.coalesce("text", F.lit(""))).alias("fm_scale"))
    joined = with_row_kinds(cells, k, rules).join(scales, k, "left").withColumn("fm_n", numbers.to_number(F.col("cell")))
    one = F.lit(1.0)
    num = numbers.scaled(F.col("fm_n.value"), F.col("fm_n.unit"), F.col("row_kind"), F.coalesce("fm_scale.money", one), F.coalesce("fm_scale.shares", one))
    return joined.select(*k, "r", "c", "row_kind", "cell", F.when((F.col("c") > 0) & (F.col("row_kind") != "header"), num).alias("num"))


def shape_metrics(cells: DataFrame, keys: Sequence[str], page_numbers: Column, rules: TableRules = TableRules()) -> DataFrame:
    """keys, n_rows, n_cols, whitespace (% blank), coverage (value numbers, dashes included, of ``page_numbers``), label_merge, valid_shape.

    ``page_numbers`` is an aggregate or literal Column. The checks use unrounded values.
    """
    blank, labelled = F.col("cell") == "", (F.col("c") == 0) & (text.strip(F.col("cell")) != "")
    m = cells.groupBy(*keys).agg(
        (F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"),
        (F.count_if(blank) * 100.0 / F.greatest(F.count("cell"), F.lit(1))).alias("whitespace"),
        (F.count_if((F.col("c") > 0) & numbers.to_number(F.col("cell"))["value"].isNotNull()) / F.greatest(page_numbers, F.lit(1)).cast("double")).alias("coverage"),
        F.coalesce(F.try_divide(F.count_if(labelled & text.ends_in_number(F.col("cell"))).cast("double"), F.count_if(labelled)), F.lit(1.0)).alias("label_merge"),
    )
    valid = (F.col("n_rows") >= rules.min_rows) & (F.col("n_cols") >= rules.min_cols) & (F.col("coverage") >= rules.min_coverage) & (F.col("label_merge") <= rules.max_label_merge)
    return m.withColumn("valid_shape", valid)


def score(accuracy: Column, whitespace: Column, rules: TableRules = TableRules()) -> Column:
    return F.round(accuracy - rules.whitespace_weight * F.round(whitespace, 2), 2)


def largest_valid(candidates: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Per group the candidate with a valid shape and the most cells; the first of equals. Columns valid_shape, n_rows, n_cols are read."""
    rank = F.struct(F.col("valid_shape"), F.col("n_rows") * F.col("n_cols"), -F.col(seq))
    best = candidates.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in candidates.columns if c not in keys]), rank).alias("fm_best"), F.count(F.lit(1)).alias("n_candidates"))
    return best.select(*keys, "n_candidates", "fm_best.*")


def accept_in_order(candidates: DataFrame, keys: Sequence[str], rules: TableRules = TableRules()) -> DataFrame:
    """Methods in order of ``rank``: the first with a passing table wins by (cells, score); else the best valid by (score, cells); else none.

    Adds decision: accepted, best_below_threshold or no_valid_table. Reads rank, seq, valid_shape, score, cells.
    """
    k = list(keys)
    passing = F.col("valid_shape") & (F.col("score") >= rules.accept_score)
    ranked = candidates.withColumn("fm_pass", passing).withColumn("fm_first", F.min(F.when(passing, F.col("rank"))).over(Window.partitionBy(*k)))
    row = F.struct(*[c for c in candidates.columns if c not in k])
    out = ranked.groupBy(*k).agg(
        F.max_by(row, F.when(F.col("fm_pass") & (F.col("rank") == F.col("fm_first")), F.struct("cells", "score", -F.col("seq")))).alias("accepted"),
        F.max_by(row, F.when(F.col("valid_shape"), F.struct("score", "cells", -F.col("rank"), -F.col("seq")))).alias("valid"),
        F.max("fm_pass").alias("any_pass"), F.max("valid_shape").alias("any_valid"),
    )
    decision = F.when(F.col("any_pass"), "accepted").when(F.col("any_valid"), "best_below_threshold").otherwise("no_valid_table")
    pick = F.when(F.col("any_pass"), F.col("accepted")).when(F.col("any_valid"), F.col("valid"))
    return out.select(*k, decision.alias("decision"), pick.alias("fm_pick")).select(*k, "decision", "fm_pick.*")


def column_years(cells: DataFrame, keys: Sequence[str], first_rows: int | None = 6, header_only: bool = False) -> DataFrame:
    """keys, c, year: the last year of the lowest year cell of each value column, in the first rows or in the header rows."""
    scope = cells.filter("c > 0")
    if first_rows is not None:
        scope = scope.filter(F.col("r") < first_rows)
    if header_only:
        scope = scope.filter("row_kind = 'header'")
    years = scope.withColumn("fm_year", text.last_year(F.col("cell"))).filter("fm_year is not null")
    return years.groupBy(*keys, "c").agg(F.max_by("fm_year", "r").alias("year"))


def dense_grid(sparse: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Cells with 1-based row and col to a full grid of blanks and texts, 0-based; of cells at one place the last (by ``seq``) counts.

    A selected checkbox arrives as its text ``[X]``.
    """
    k = list(keys)
    last = sparse.groupBy(*k, "row", "col").agg(F.max_by("cell", seq).alias("cell"))
    sizes = sparse.groupBy(*k).agg(F.max("row").alias("h"), F.max("col").alias("w"))
    places = sizes.select(*k, F.col("w"), F.explode(F.sequence(F.lit(1), F.col("h"))).alias("row")).select(*k, "row", F.explode(F.sequence(F.lit(1), F.col("w"))).alias("col"))
    return places.join(last, [*k, "row", "col"], "left").select(*k, (F.col("row") - 1).alias("r"), (F.col("col") - 1).alias("c"), F.coalesce("cell", F.lit("")).alias("cell"))


def padded(rows: Column, width: Column) -> Column:
    """Ragged rows with blanks up to a width."""
    return F.transform(rows, lambda x: F.concat(x, F.array_repeat(F.lit(""), F.greatest(width - F.size(x), F.lit(0)))))


def column_names(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, c, name: the header rows without a label at the top, joined by space; else ``label`` and ``colN``. Reads row_kind."""
    k = list(keys)
    lead = F.min((F.col("row_kind") == "header") & ((F.col("c") > 0) | (F.col("cell") == ""))).over(_same(k, "r"))
    so_far = Window.partitionBy(*k).orderBy("r").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = cells.withColumn("fm_lead", lead).withColumn("top", F.min("fm_lead").over(so_far))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("top") & (F.col("cell") != ""), F.struct("r", "cell")))), lambda x: x["cell"])
    named = flagged.groupBy(*k, "c").agg(F.array_join(parts, " ").alias("name"))
    fallback = F.when(F.col("c") == 0, "label").otherwise(F.concat(F.lit("col"), F.col("c").cast("string")))
    return named.select(*k, "c", F.when(F.col("name") == "", fallback).otherwise(F.col("name")).alias("name"))


def occurrences(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "occurrence", start: int = 1) -> DataFrame:
    """Numbers the repetitions of a key in row order."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + start).cast("int"))


def number_positions(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, r, c, position (from 1): the place of each number among the numbers of its row, labels left out."""
    numeric = cells.filter((F.col("c") > 0) & numbers.to_number(F.col("cell"))["value"].isNotNull())
    w = Window.partitionBy(*keys, "r").orderBy("c")
    return numeric.select(*keys, "r", "c", F.row_number().over(w).cast("bigint").alias("position"))
