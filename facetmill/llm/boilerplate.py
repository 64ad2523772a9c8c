"""Lines repeated across one source's documents (problem 3).

Normalized lines are hashed once and kept, the distinct pages of each (source, hash) are counted in two map-side
combined aggregates, a share of the source's pages is the threshold, and the frequent hashes are joined back to the
lines. What is kept and shuffled per line is a few hashes and the line's address, never its text; a line that stands
in a third of all rows is spread by its pages before it is counted, and its join is split by adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetmill.functions.text import strip
from facetmill.sources.checkpoint import settled

def line_key(line: Column) -> Column:
    """The line without outer white space and letter case, each run of digits 0-9 as one 0."""
    folded = F.replace(F.lower(F.upper(strip(line))), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(folded, "[0-9]+", "0")


def _lines(df: DataFrame, ident: Sequence[str], text: str, source: str, page: Sequence[str]) -> DataFrame:
    """One row per non-blank line: ident, line_no, two hashes of (source, line key), a hash of (source, page)."""
    src = F.col(source).cast("string")
    lines = df.select(*[F.col(c).alias(f"fm_i{i}") for i, c in enumerate(ident)], F.struct(F.lit(source), src).alias("fm_src"), F.xxhash64(F.struct(src, *[F.col(c) for c in page])).alias("fm_page"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("fm_no", "fm_line"))
    key = line_key(F.col("fm_line"))
    keyed = lines.select(*[f"fm_i{i}" for i in range(len(ident))], F.col("fm_no"), "fm_page", "fm_src", key.alias("fm_key")).filter(F.col("fm_key") != "")
    whole = F.concat_ws("\n", F.to_json("fm_src"), "fm_key")
    return keyed.select(*[f"fm_i{i}" for i in range(len(ident))], "fm_no", "fm_page", F.xxhash64("fm_src").alias("fm_s"), F.xxhash64(whole).alias("fm_h"), F.crc32(whole.cast("binary")).alias("fm_c"))


def repeated_lines(df: DataFrame, ident: Sequence[str], text: str, source: str, page: Sequence[str], pages: DataFrame | None = None, least_pages: int = 5, least_share: float = 0.3) -> DataFrame:
    """Every line that repeats within its source: ``ident``, line_no (0-based).

    A line repeats if it stands on at least ``least_pages`` distinct pages of its source and on at least
    ``least_share`` of the pages the source has in ``pages`` (by default ``df``). Two lines are the same by
    ``line_key``; blank lines never count. Null source and null page parts are values of their own; null text
    has no lines. Repeated rows count once. Only the named columns are read, whatever others are called.
    """
    lines = settled(_lines(df, ident, text, source, page))  # read twice: to count and to find
    counts = lines.select("fm_h", "fm_c", "fm_s", "fm_page").distinct().groupBy("fm_h", "fm_c", "fm_s").agg(F.count(F.lit(1)).alias("fm_n")).filter(F.col("fm_n") >= least_pages)
    every = (df if pages is None else pages).select(F.col(source).cast("string").alias("fm_src"), *[F.col(c).alias(f"fm_p{i}") for i, c in enumerate(page)])
    totals = every.select(F.xxhash64(F.struct(F.lit(source), F.col("fm_src"))).alias("fm_s"), F.xxhash64(F.struct("fm_src", *[f"fm_p{i}" for i in range(len(page))])).alias("fm_page")).distinct().groupBy("fm_s").agg(F.count(F.lit(1)).alias("fm_all"))
    frequent = counts.join(totals, "fm_s").filter(F.col("fm_n") >= F.lit(least_share) * F.col("fm_all")).select("fm_h", "fm_c")
    found = lines.select(*[f"fm_i{i}" for i in range(len(ident))], "fm_no", "fm_h", "fm_c").join(frequent, ["fm_h", "fm_c"])
    return found.select(*[F.col(f"fm_i{i}").alias(c) for i, c in enumerate(ident)], F.col("fm_no").alias("line_no")).distinct()


def without_repeated_lines(df: DataFrame, ident: Sequence[str], text: str, source: str, page: Sequence[str], cleaned: str = "clean_text", removed: str = "removed_lines", applies: Column | None = None, least_pages: int = 5, least_share: float = 0.3) -> DataFrame:
    """``df`` with the text rebuilt without its repeated lines, and the array of (line_no, line) that were removed.

    ``applies`` limits the records whose lines are looked at (pages are still counted over all of ``df``). The
    input's ``cleaned`` and ``removed`` columns, if any, are replaced. Records without a repeated line keep
    their text as it is and an empty array; null text stays null. ``ident`` must name one text.
    """
    looked = df if applies is None else df.filter(applies)
    numbers = repeated_lines(looked, ident, text, source, page, df, least_pages, least_share)
    names = [f"fm_i{i}" for i in range(len(ident))]
    numbers = numbers.select(*[F.col(c).alias(n) for c, n in zip(ident, names, strict=True)], "line_no").groupBy(*names).agg(F.array_sort(F.collect_list("line_no")).alias("fm_gone"))
    base = df.drop(cleaned, removed)
    out = base.join(numbers, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(ident, names, strict=True)], "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("fm_gone"), i))
    gone = F.transform("fm_gone", lambda i: F.struct(i.alias("line_no"), F.get(lines, i).alias("line")))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], F.when(F.col("fm_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(cleaned), F.coalesce(gone, F.expr("cast(array() as array<struct<line_no:int,line:string>>)")).alias(removed))
