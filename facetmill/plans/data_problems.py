"""Queries of the general data problems over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.operators import compare, nested, units
from facetmill.sources.checkpoint import settled
from facetmill.sources.tables import table

CELL_RULES = {"part2": compare.Rule("number", 1e-9), "textract": compare.Rule("number", 1e-9), "status": compare.Rule("label")}


def p4_diff(spark: SparkSession, d: str) -> DataFrame:
    """Findings between the two copies of the cells, with both values."""
    return compare.diff_copies(table(spark, d, "table_cells"), table(spark, d, "table_cells_mirror"), ["cell_id"], CELL_RULES, "loaded_at", "missing_in_mirror", "missing_in_cells")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_diff(spark, d).select(F.col("fm_key").alias("cell_id"), "finding")


def _flat(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: nested.flatten_statement_tables(table(spark, d, "filing_records"))[name]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _flat("cells")(spark, d).select("rec_id", "row_no", "col_no").distinct()


def _converted(rows: DataFrame) -> DataFrame:
    kept = settled(rows)
    common = units.meanings(kept)
    return units.convert(kept, common, of_sources=units.source_meanings(kept, common))


def _amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every fact that names a cell, with both amounts in common units and where the unit was stated."""
    return _converted(units.cell_facts(table(spark, d, "filing_records"), table(spark, d, "tagged_facts"), "ticker")).distinct()


def p6_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every fact that names a cell with both amounts in common units, where the unit was stated and whether its meaning was open."""
    return _amounts(spark, d).select("fact_id", "rec_id", "row_no", "col_no", "fact_value", "unit", "kind", "printed", "printed_amount", "fact_amount", "differs", "stated_in", "unit_open")


def p6_all_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every printed cell and every fact in common units; p6_amounts holds only the pairs."""
    out = _converted(units.all_amounts(table(spark, d, "filing_records"), table(spark, d, "tagged_facts"), "ticker"))
    return out.select("fact_id", "rec_id", "row_no", "col_no", "fact_value", "unit", "place", "kind", "printed", "printed_amount", "fact_amount", "differs", "stated_in", "unit_open")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _amounts(spark, d).filter("differs").select("fact_id").distinct()


def p6_identity(spark: SparkSession, d: str) -> DataFrame:
    """p6_found where every tagged unit that says ``m`` means thousands: right only if the identity finds that out."""
    facts = table(spark, d, "tagged_facts")
    facts = facts.withColumn("fact_value", F.when(units.tagged_symbol(F.col("unit")) == "m", F.col("fact_value") * 1000).otherwise(F.col("fact_value")))
    rows = _converted(units.cell_facts(table(spark, d, "filing_records"), facts, "ticker"))
    return rows.filter("differs").select("fact_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_identity": p6_identity, "p6_amounts": p6_amounts, "p6_all_amounts": p6_all_amounts} | {f"p5_{n}": _flat(n) for n in ("tables", "rows", "columns", "cells", "printed", "scales")}


LATEST = """WITH a AS (SELECT * FROM table_cells QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC NULLS LAST, part2 DESC NULLS LAST, textract DESC NULLS LAST, status DESC NULLS LAST) = 1),
b AS (SELECT * FROM table_cells_mirror QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC NULLS LAST, part2 DESC NULLS LAST, textract DESC NULLS LAST, status DESC NULLS LAST) = 1)
"""


def _differs(field: str) -> str:
    return f"SELECT a.cell_id, '{field}' AS finding FROM a JOIN b USING (cell_id) WHERE (a.{field} IS NULL) <> (b.{field} IS NULL) OR abs(a.{field} - b.{field}) > 1e-9 * greatest(abs(a.{field}), abs(b.{field}))"


def _phrase(x: str) -> str:
    """SQL for the factor that a short phrase states."""
    tests = ((r"(?i)thousand|(^|[^\d.,])000s?\b|[$] ?k\b|USD ?k\b", "1e3"), (r"(?i)million|\bmm\b|[$] ?mm?\b|USD ?mm?\b", "1e6"), (r"(?i)billion|\bbn\b|[$] ?bn?\b|USD ?bn?\b", "1e9"), (r"(?i)\bcents?\b|¢", "1e-2"), (r"(?i)%|\bpercent\b|\bpct\b", "1e-2"), (r"(?i)\bbasis points?\b|\bbps?\b", "1e-4"), (r"(?i)\bdollars\b|US[$]|\bUSD\b|[$]\)?\s*$|\bnumber\b|\bsingle shares\b", "1e0"))
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{r}') THEN {f}" for r, f in tests) + " END"


AMOUNTS = rf"""WITH f AS (SELECT DISTINCT fact_id, rec_id, row_no, col_no, fact_value, unit FROM tagged_facts WHERE rec_id IS NOT NULL AND row_no >= 0 AND col_no >= 0),
 b AS (SELECT DISTINCT rec_id, doc_id, page, block_order, block_type, text FROM filing_records),
 t AS (SELECT DISTINCT rec_id, tbl.raw_cells AS raw, tbl.scale AS scale, tbl.row_kinds AS kinds FROM filing_records WHERE tbl.raw_cells IS NOT NULL),
 prior AS (SELECT x.rec_id, arg_max(CASE WHEN y.block_type = 'Text' THEN y.text END, y.block_order) AS text, arg_max(y.block_type, y.block_order) AS kind FROM (SELECT DISTINCT rec_id, doc_id, page, block_order FROM b SEMI JOIN t USING (rec_id)) x JOIN b y ON x.doc_id = y.doc_id AND x.page = y.page AND y.block_order < x.block_order GROUP BY x.rec_id),
 said AS (SELECT rec_id, list_extract(list_filter(regexp_split_to_array(regexp_replace(text, '([a-z][.])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '(?i)per-share amounts')), -1) AS s FROM prior WHERE kind = 'Text'),
 stated AS (SELECT rec_id, regexp_extract(s, '(?i)\b((number of )?(shares|share counts?)\b[^;,.]*)', 1) AS clause, regexp_replace(s, '(?i)\b(number of |and )?(shares|share counts?)\b.*$|\b(except )?per-share.*$', '') AS head, regexp_matches(s, '(?i)per-share [^.;]*\bcents\b') AS cents FROM said WHERE s IS NOT NULL),
 j AS (SELECT f.*, raw[row_no + 1][col_no + 1] AS cell, coalesce(raw[row_no + 1][1], '') AS label, scale, clause, head AS shead, cents,
   CASE WHEN kinds[row_no + 1] IN ('money', 'shares', 'per_share') THEN kinds[row_no + 1] WHEN regexp_matches(raw[row_no + 1][1], '(?i)per[ -]share') THEN 'per_share' WHEN regexp_matches(raw[row_no + 1][1], '(?i)\bshares\b') THEN 'shares' ELSE 'money' END AS kind,
   list_filter(list_transform(range(row_no), lambda q: CASE WHEN coalesce(kinds[q + 1] = 'header', q = 0) THEN raw[q + 1][col_no + 1] END), lambda h: {_phrase("h")} IS NOT NULL)[-1] AS head,
   list_filter(list_transform(range(row_no), lambda q: CASE WHEN coalesce(kinds[q + 1] = 'header', q = 0) THEN raw[q + 1][1] END), lambda h: {_phrase("h")} IS NOT NULL)[-1] AS corner
   FROM f JOIN t USING (rec_id) LEFT JOIN stated USING (rec_id)),
 k AS (SELECT *, regexp_replace(cell, '\s', '', 'g') AS c, regexp_extract(trim(cell), '[\d.]\s*([A-Za-z%¢][A-Za-z ]*?)\s*\)?$', 1) AS suffix, regexp_extract(label, '((?:[(,]|\bin\s)[^(),]*\)?)\s*$', 1) AS tail, regexp_matches(label, '(?i)\b(rate|percentage|growth)\b|\bchange in\b') AND kind = 'money' AS rate FROM j WHERE cell IS NOT NULL),
 u AS (SELECT *, CASE WHEN regexp_matches(c, '^[$(]*[-–—−]+[)]*$') THEN 0.0 ELSE CASE WHEN regexp_matches(c, '^[$]?\(|^[$]?[-–—−]') THEN -1 ELSE 1 END * TRY_CAST(replace(regexp_extract(c, '(\d[\d,]*(?:\.\d+)?|\.\d+)', 1), ',', '') AS DOUBLE) END AS number,
   CASE lower(suffix) WHEN 'thousand' THEN 1e3 WHEN 'k' THEN 1e3 WHEN 'million' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'mm' THEN 1e6 WHEN 'billion' THEN 1e9 WHEN 'b' THEN 1e9 WHEN 'bn' THEN 1e9 WHEN 'c' THEN 1e-2 WHEN '¢' THEN 1e-2 WHEN 'cents' THEN 1e-2 WHEN 'cent' THEN 1e-2 WHEN '%' THEN 1e-2 WHEN 'percent' THEN 1e-2 WHEN 'pct' THEN 1e-2 WHEN 'bp' THEN 1e-4 WHEN 'bps' THEN 1e-4 WHEN 'basis points' THEN 1e-4 END AS in_cell,
   coalesce({_phrase("tail")}, CASE WHEN contains(tail, '$') THEN 1e0 END) AS in_row, {_phrase("head")} AS in_head, {_phrase("corner")} AS in_corner, scale[kind] AS in_scale, {_phrase("shead")} AS s_money, coalesce({_phrase("clause")}, CASE WHEN clause = '' THEN {_phrase("shead")} END) AS s_shares, CASE WHEN cents THEN 1e-2 WHEN shead IS NOT NULL THEN 1e0 END AS s_per FROM k),
 r AS (SELECT *,
   CASE WHEN in_cell IS NOT NULL THEN 'cell' WHEN CASE kind WHEN 'money' THEN CASE WHEN NOT rate OR in_row < 1 THEN in_row END WHEN 'shares' THEN CASE WHEN in_row >= 1 THEN in_row END ELSE CASE WHEN in_row <= 1 THEN in_row END END IS NOT NULL THEN 'row'
     WHEN CASE kind WHEN 'money' THEN CASE WHEN NOT rate THEN in_head END WHEN 'shares' THEN CASE WHEN regexp_matches(head, '(?i)\bshares?\b') THEN in_head END ELSE CASE WHEN in_head = 1e-2 THEN in_head END END IS NOT NULL THEN 'column'
     WHEN CASE kind WHEN 'money' THEN CASE WHEN NOT rate THEN in_corner END WHEN 'shares' THEN CASE WHEN regexp_matches(corner, '(?i)\bshares?\b') THEN in_corner END ELSE CASE WHEN in_corner = 1e-2 THEN in_corner END END IS NOT NULL THEN 'corner'
     WHEN NOT rate AND in_scale IS NOT NULL THEN 'scale' WHEN CASE kind WHEN 'money' THEN CASE WHEN NOT rate THEN s_money END WHEN 'shares' THEN s_shares ELSE s_per END IS NOT NULL THEN 'text' ELSE 'none' END AS stated_in,
   coalesce(in_cell, CASE kind WHEN 'money' THEN CASE WHEN NOT rate OR in_row < 1 THEN in_row END WHEN 'shares' THEN CASE WHEN in_row >= 1 THEN in_row END ELSE CASE WHEN in_row <= 1 THEN in_row END END,
   CASE kind WHEN 'money' THEN CASE WHEN NOT rate THEN in_head END WHEN 'shares' THEN CASE WHEN regexp_matches(head, '(?i)\bshares?\b') THEN in_head END ELSE CASE WHEN in_head = 1e-2 THEN in_head END END,
   CASE kind WHEN 'money' THEN CASE WHEN NOT rate THEN in_corner END WHEN 'shares' THEN CASE WHEN regexp_matches(corner, '(?i)\bshares?\b') THEN in_corner END ELSE CASE WHEN in_corner = 1e-2 THEN in_corner END END,
   CASE WHEN NOT rate THEN in_scale END, CASE kind WHEN 'money' THEN CASE WHEN NOT rate THEN s_money END WHEN 'shares' THEN s_shares ELSE s_per END, 1e0) AS factor,
   CASE WHEN regexp_matches(unit, '(?i)thousand|\(000\)|^k[A-Z]{{3}}$') THEN 1e3 WHEN regexp_matches(unit, '(?i)million|\bmm\b') OR regexp_matches(unit, '^[A-Z]{{3}}m$') THEN 1e6 WHEN regexp_matches(unit, '(?i)billion|\bbn\b') THEN 1e9 WHEN regexp_matches(unit, '(?i)cents?\b|percent|%') THEN 1e-2 WHEN regexp_matches(unit, '(?i)\bbps?\b') THEN 1e-4 ELSE 1e0 END AS tagged FROM u)
"""


def oracle_sql() -> dict[str, str]:
    t = "(SELECT DISTINCT rec_id, tbl FROM filing_records WHERE tbl IS NOT NULL)"
    grid = f"(SELECT rec_id, tbl, unnest(tbl.grid_rows) AS r, generate_subscripts(tbl.grid_rows, 1) - 1 AS row_no FROM {t})"
    cells = f"(SELECT rec_id, row_no, unnest(r) AS x, generate_subscripts(r, 1) - 1 AS col_no FROM {grid})"
    raw = f"(SELECT rec_id, unnest(tbl.raw_cells) AS r, generate_subscripts(tbl.raw_cells, 1) - 1 AS row_no FROM {t})"
    return {
        "p6_found": AMOUNTS + "SELECT DISTINCT fact_id FROM r WHERE abs(fact_value * tagged - number * factor) > 1e-3 * abs(number * factor) + 1e-12",
        "p6_identity": AMOUNTS + "SELECT DISTINCT fact_id FROM r WHERE abs(fact_value * tagged - number * factor) > 1e-3 * abs(number * factor) + 1e-12",
        "p6_amounts": AMOUNTS
        + "SELECT DISTINCT fact_id, rec_id, CAST(row_no AS INTEGER) AS row_no, CAST(col_no AS INTEGER) AS col_no, fact_value, unit, kind, cell AS printed, number * factor AS printed_amount, fact_value * tagged AS fact_amount, abs(fact_value * tagged - number * factor) > 1e-3 * abs(number * factor) + 1e-12 AS differs, stated_in, false AS unit_open FROM r",
        "p4_found": LATEST
        + f"""SELECT cell_id, 'missing_in_mirror' AS finding FROM a ANTI JOIN b USING (cell_id) UNION ALL SELECT cell_id, 'missing_in_cells' FROM b ANTI JOIN a USING (cell_id)
        UNION ALL {_differs("part2")} UNION ALL {_differs("textract")}
        UNION ALL SELECT a.cell_id, 'status' FROM a JOIN b USING (cell_id) WHERE lower(trim(a.status)) IS DISTINCT FROM lower(trim(b.status))""",
        "p5_found": f"SELECT DISTINCT rec_id, CAST(row_no AS INTEGER) AS row_no, CAST(col_no AS INTEGER) AS col_no FROM {cells} WHERE x.s IS NOT NULL OR x.n IS NOT NULL",
        "p5_cells": f"SELECT DISTINCT rec_id, CAST(row_no AS INTEGER) AS row_no, CAST(col_no AS INTEGER) AS col_no, x.s AS s, x.n AS n FROM {cells} WHERE x.s IS NOT NULL OR x.n IS NOT NULL",
        "p5_tables": f"SELECT DISTINCT rec_id, tbl.method AS method, tbl.status AS status, tbl.source_csv AS source_csv, CAST(len(tbl.grid_rows) AS INTEGER) AS n_rows, CAST(len(tbl.col_names) AS INTEGER) AS n_columns FROM {t}",
        "p5_rows": f"SELECT DISTINCT rec_id, CAST(i AS INTEGER) AS row_no, tbl.row_kinds[i + 1] AS row_kind, CAST(len(tbl.grid_rows[i + 1]) AS INTEGER) AS width FROM (SELECT rec_id, tbl, unnest(range(greatest(coalesce(len(tbl.grid_rows), 0), coalesce(len(tbl.row_kinds), 0)))) AS i FROM {t})",
        "p5_columns": f"SELECT DISTINCT rec_id, CAST(col_no AS INTEGER) AS col_no, col_name FROM (SELECT rec_id, unnest(tbl.col_names) AS col_name, generate_subscripts(tbl.col_names, 1) - 1 AS col_no FROM {t})",
        "p5_printed": f"SELECT DISTINCT rec_id, CAST(row_no AS INTEGER) AS row_no, CAST(col_no AS INTEGER) AS col_no, printed FROM (SELECT rec_id, row_no, unnest(r) AS printed, generate_subscripts(r, 1) - 1 AS col_no FROM {raw}) WHERE printed IS NOT NULL",
        "p5_scales": f"SELECT DISTINCT rec_id, CAST(entry_no AS INTEGER) AS entry_no, e.key AS kind, e.value AS factor FROM (SELECT rec_id, unnest(map_entries(tbl.scale)) AS e, generate_subscripts(map_entries(tbl.scale), 1) - 1 AS entry_no FROM {t})",
    }
