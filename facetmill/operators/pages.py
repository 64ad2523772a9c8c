"""Pages: statement titles, ruling lines, OCR lines, numbering of a second parser's tables, machine facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetmill.functions import text as tx


def statement_pages(pages: DataFrame, titles: Mapping[str, Sequence[str]], top: int = 6, least_numbers: int = 20, extra: int = 15, text: str = "text") -> DataFrame:
    """Pages that hold a statement, with statement and n_numeric: enough number tokens and a title among the first lines.

    Of several statements the first in the order of ``titles`` counts. The cheap count is tested before the titles.
    """
    lines = F.slice(F.split(F.col(text), "\n"), 1, top)
    found = F.coalesce(*[F.when(_any_title(lines, title, extra), name) for name, options in titles.items() for title in options])
    counted = pages.withColumn("n_numeric", F.size(tx.numeric_tokens(F.col(text))).cast("bigint")).filter(F.col("n_numeric") >= least_numbers)
    return counted.withColumn("statement", found).filter("statement is not null")


def _any_title(lines: Column, title: str, extra: int) -> Column:
    return F.exists(lines, lambda x: tx.title_line(x, F.lit(title), extra))


def ruling_lines(marks: DataFrame, page: Sequence[str], least: float = 100.0, thin: float = 2.0) -> DataFrame:
    """page, ruling_lines: level lines (less than 1 point high) and thin rectangles of at least ``least`` points. Reads kind (line or rect) and bbox."""
    b = F.col("bbox")
    height = F.abs(b["bottom"] - b["top"])
    flat = F.when(F.col("kind") == "line", height < 1).otherwise(height <= thin)
    return marks.groupBy(*page).agg(F.count_if(flat & (b["x1"] - b["x0"] >= least)).alias("ruling_lines"))


def ocr_text(words: DataFrame, page: Sequence[str]) -> DataFrame:
    """page, text, mean_conf: words by (block, par, line) in first-seen order; blank words and those of negative confidence are left out."""
    p = list(page)
    ok = words.filter((F.col("conf") >= 0) & (tx.strip(F.col("text")) != ""))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    lines = ok.groupBy(*p, "block", "par", "line").agg(F.min("seq").alias("first"), F.array_join(ordered, " ").alias("t"), F.sum("conf").alias("s"), F.count(F.lit(1)).alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "t"))), lambda x: x["t"]), "\n")
    return lines.groupBy(*p).agg(joined.alias("text"), F.round(F.sum("s") / F.sum("n"), 1).alias("mean_conf"))


def numbered_tables(items: DataFrame, page: Sequence[str], seq: str = "seq") -> DataFrame:
    """Adds table_no: a second parser's tables numbered per page from 00."""
    n = F.row_number().over(Window.partitionBy(*page).orderBy(seq)) - 1
    return items.withColumn("table_no", F.lpad(n.cast("string"), 2, "0"))


def regions_hit(tables: DataFrame, regions: DataFrame, page: Sequence[str], least: float = 0.8) -> DataFrame:
    """Tables that lie at least ``least`` inside an asked region: page, region_seq, seq, inside. A table without a box passes."""
    from facetmill.functions import geometry as g

    p = list(page)
    r = regions.select(*p, F.col("seq").alias("region_seq"), F.col("bbox").alias("fm_region"))
    j = tables.join(r, p).withColumn("inside", F.when(F.col("bbox").isNull(), 1.0).otherwise(F.coalesce(F.try_divide(g.intersection(F.col("bbox"), F.col("fm_region")), g.area(F.col("bbox"))), F.lit(0.0))))
    return j.filter(F.col("inside") >= least).select(*p, "region_seq", "seq", "inside")


def stem(ticker: Column, form: Column, period: Column) -> Column:
    return F.concat_ws("_", ticker, F.replace(form, F.lit("-"), F.lit("")), F.date_format(period, "yyyyMMdd"))


def block_id(page: Column, order: Column) -> Column:
    return F.format_string("p%04d_b%03d", page, order)


def block_address(block: Column) -> Column:
    """'p0045_b003' as 'page 45, block 3'."""
    return F.concat(F.lit("page "), F.regexp_extract(block, r"^p(\d+)", 1).try_cast("int").cast("string"), F.lit(", block "), F.regexp_extract(block, r"_b(\d+)$", 1).try_cast("int").cast("string"))


def parsed_name(name: Column) -> Column:
    """struct<stem, page, statement> of a file name STEM_pNNNN_STATEMENT."""
    part = lambda i: F.regexp_extract(name, r"^(.*)_p(\d{4})_([a-z_]+)", i)
    return F.struct(part(1).alias("stem"), part(2).try_cast("int").alias("page"), part(3).alias("statement"))


def type_totals(blocks: DataFrame, document: str, kind: str, order: Sequence[str]) -> DataFrame:
    """document (ALL for the total), kind (ALL), n: counts with their totals; kinds without blocks count 0 through ``order``."""
    g = blocks.rollup(document, kind).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("fm_level"))
    named = g.select(F.when(F.col("fm_level") == 3, "ALL").otherwise(F.col(document)).alias(document), F.when(F.col("fm_level") >= 1, "ALL").otherwise(F.col(kind)).alias(kind), "n")
    return named.withColumn("position", F.array_position(F.array(*[F.lit(k) for k in [*order, "ALL"]]), F.col(kind)))


def grid_stats(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_rows, n_cols, n_numeric (cells that are wholly a number token), empty_share."""
    return cells.groupBy(*keys).agg((F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"), F.count_if(tx.strip(F.col("cell")).rlike(f"^(?:{tx.NUM_SIGNED})$")).alias("n_numeric"), (F.count_if(tx.strip(F.col("cell")) == "") / F.count(F.lit(1))).alias("empty_share"))


def version_of(package: str) -> str:
    """The installed version of a package, ``absent`` without one."""
    from importlib import metadata

    try:
        return metadata.version(package)
    except metadata.PackageNotFoundError:
        return "absent"


def machine(spark: SparkSession, packages: Sequence[str] = ("pyspark", "pyarrow", "pandas", "numpy")) -> DataFrame:
    """One row of the session's settings and of the versions that timings depend on."""
    import platform

    conf = dict(spark.sparkContext.getConf().getAll())
    row = (spark.version, platform.python_version(), spark.sparkContext.master, conf.get("spark.driver.memory"), conf.get("spark.executor.memory"), spark.conf.get("spark.sql.shuffle.partitions"), {p: version_of(p) for p in packages})
    return spark.createDataFrame([row], "spark_version string, python_version string, master string, driver_memory string, executor_memory string, shuffle_partitions string, packages map<string,string>")
