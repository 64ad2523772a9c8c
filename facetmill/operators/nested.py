"""Deeply nested records as related flat tables (problem 5).

A target table is named by its path, such as ``tbl.grid_rows[][]``: one ``[]`` for each level of arrays. Its
rows come from a single SQL projection: nested ``transform`` calls attach the ancestor keys and the position at
every level, ``flatten`` joins the levels into one array, and one ``inline`` emits the rows. No row leaves the
JVM and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _quoted(path: str) -> str:
    return ".".join(f"`{p}`" for p in path.split("."))


def child_table(df: DataFrame, keys: Sequence[str], path: str, positions: Sequence[str], values: Mapping[str, str], keep: str | None = None) -> DataFrame:
    """The elements under ``path`` with their parents' ``keys`` and 0-based ``positions``.

    ``values`` maps output columns to SQL over ``x`` (the element), ``p0``, ``p1``, ... (its positions) and the
    columns of ``df``; ``keep`` is an optional condition over the same names. A null or empty array at any level
    gives no rows, a null element gives a row of its own (unless ``keep`` drops it), ragged arrays keep each
    element's true position, and repeated parent rows give repeated child rows. Columns of ``df`` that are not
    asked for are ignored, whatever their names.
    """
    source, depth = path.rstrip("[]"), path.count("[]")
    if depth != len(positions) or depth == 0:
        raise ValueError(f"{path} has {depth} levels, {len(positions)} position names were given")
    fields = [f"'{k}', {_quoted(k)}" for k in keys] + [f"'{n}', p{i}" for i, n in enumerate(positions)] + [f"'{n}', {e}" for n, e in values.items()]
    leaf = f"named_struct({', '.join(fields)})"
    sql = ""
    for level in reversed(range(depth)):
        array = _quoted(source) if level == 0 else f"a{level}"
        element = "x" if level == depth - 1 else f"a{level + 1}"
        if level == depth - 1:
            sql = f"transform({array}, ({element}, p{level}) -> " + (f"if({keep}, {leaf}, null))" if keep else f"{leaf})")
            if keep:
                sql = f"filter({sql}, y -> y is not null)"
        else:
            sql = f"flatten(transform({array}, ({element}, p{level}) -> coalesce({sql}, array())))"
    return df.selectExpr(f"inline({sql})")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Rows once each; the aggregate combines map-side before its one shuffle."""
    return df.distinct()


def flatten_statement_tables(df: DataFrame, key: str = "rec_id", column: str = "tbl") -> dict[str, DataFrame]:
    """The nested statement table of each record as ``tables``, ``rows``, ``columns``, ``cells``, ``printed`` and ``scales``.

    Every table carries ``key``; rows and cells carry ``row_no`` and ``col_no`` (0-based). A record without the
    struct has no row in any table; a null inner array counts as absent; ``row_kind`` is null where row_kinds is
    shorter than the grid; kinds beyond the grid still appear in ``rows`` with a null width. Repeated records
    give each row once.
    """
    c = column
    rows = f"greatest(size({c}.grid_rows), size({c}.row_kinds))"
    numbered = df.filter(F.col(c).isNotNull())
    wide = numbered.withColumn("fm_rows", F.expr(f"if({rows} > 0, sequence(0, {rows} - 1), array())"))
    tables = numbered.selectExpr(key, f"{c}.method as method", f"{c}.status as status", f"{c}.source_csv as source_csv", f"nullif(size({c}.grid_rows), -1) as n_rows", f"nullif(size({c}.col_names), -1) as n_columns")
    out = {
        "tables": tables,
        "rows": child_table(wide, [key], "fm_rows[]", ["row_no"], {"row_kind": f"get({c}.row_kinds, x)", "width": f"nullif(size(get({c}.grid_rows, x)), -1)"}),
        "columns": child_table(numbered, [key], f"{c}.col_names[]", ["col_no"], {"col_name": "x"}),
        "cells": child_table(numbered, [key], f"{c}.grid_rows[][]", ["row_no", "col_no"], {"s": "x.s", "n": "x.n"}, keep="x.s is not null or x.n is not null"),
        "printed": child_table(numbered, [key], f"{c}.raw_cells[][]", ["row_no", "col_no"], {"printed": "x"}, keep="x is not null"),
        "scales": child_table(numbered.withColumn("fm_scale", F.map_entries(f"{c}.scale")), [key], "fm_scale[]", ["entry_no"], {"kind": "x.key", "factor": "x.value"}),
    }
    return {name: distinct_rows(t) for name, t in out.items()}
