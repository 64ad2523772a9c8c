"""Sources and sinks. Decoders of PDF, images and layout models are plug-ins: a function over Arrow or pandas batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetmill.functions.text import strip


class PageDecoder(Protocol):
    """Turns batches of (path, content) into rows of ``schema``; a failing file is a row with an error, never an exception."""

    schema: str

    def decode(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


def decode_files(spark: SparkSession, paths: str, decoder: PageDecoder, glob: str | None = None) -> DataFrame:
    """The files of a directory through a decoder, a model being loaded once per task."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(paths)
    return files.select("path", "content").mapInPandas(decoder.decode, decoder.schema)


def submissions(spark: SparkSession, paths: str) -> DataFrame:
    """path, submission: whole text files."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("submission"))


def embedded_documents(raw: DataFrame, text: str = "submission", suffixes: Sequence[str] = (".htm", ".html", ".xml", ".xsd")) -> DataFrame:
    """One row per embedded document that has a name of a kept suffix and a body: the columns of ``raw`` but the text, filename, body."""
    rest = [c for c in raw.columns if c != text]
    each = raw.select(*rest, F.explode(F.regexp_extract_all(text, F.lit(r"(?s)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))).alias("fm_d"))
    named = each.select(*rest, strip(F.regexp_extract("fm_d", r"<FILENAME>([^\n<]+)", 1)).alias("filename"), F.regexp_extract("fm_d", r"(?s)<TEXT>(.*?)</TEXT>", 1).alias("fm_b"))
    body = strip(F.regexp_replace("fm_b", r"^\s*<(?:XBRL|XML)>\s*|\s*</(?:XBRL|XML)>\s*$", ""))
    kept = F.lower("filename").rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    return named.select(*rest, "filename", body.alias("body")).filter((F.col("filename") != "") & (F.col("body") != "") & kept)


def header_map(text: Column) -> Column:
    """map of the ``KEY: value`` lines before the first document; blanks in keys become dashes, the last of equal keys counts."""
    head = F.substring_index(text, "<DOCUMENT>", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^\s*[A-Za-z][^:]*:\s*\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_replace(strip(F.regexp_extract(x, r"^\s*([^:]+):", 1)), " ", "-").alias("k"), strip(F.regexp_extract(x, r":\s*(.*)$", 1)).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def primary_document(files: DataFrame, filing: Sequence[str], preferred: Sequence[str] = ()) -> DataFrame:
    """One file per filing: a preferred name, else the largest .htm not named like R12.htm, else the largest; of equals the first by name. Reads filename and size."""
    name = F.lower("filename")
    plain = name.rlike(r"\.html?$") & ~name.rlike(r"^r\d+\.htm$")
    rank = (name.isin(*[p.lower() for p in preferred]) if preferred else F.lit(False), plain, F.col("size"))
    rest = [c for c in files.columns if c not in filing]
    return files.groupBy(*filing).agg(F.min_by(F.struct(*rest), F.struct(*[-x.cast("bigint") for x in rank], "filename")).alias("fm_f")).select(*filing, "fm_f.*")


def first_marked(files: DataFrame, filing: Sequence[str], marker: str, within: int = 400_000) -> DataFrame:
    """The first .htm (by name) whose leading characters hold a marker."""
    hits = files.filter(F.lower("filename").rlike(r"\.html?$") & F.substring("body", 1, within).contains(marker))
    return hits.groupBy(*filing).agg(F.min("filename").alias("filename"))


def inline_values(files: DataFrame, filing: Sequence[str], names: Sequence[str], least: int = 2) -> DataFrame:
    """filing, name, value: the first value of each tagged name over the files in name order, inner tags stripped; an error where a filing has fewer than ``least``."""
    one = [F.struct(F.lit(n).alias("name"), F.regexp_extract("body", rf'(?is)<ix:non\w+[^>]*name="[^"]*{n}"[^>]*>(.*?)</ix:non\w+>', 1).alias("v")) for n in names]
    rows = files.select(*filing, "filename", F.explode(F.array(*one)).alias("x")).select(*filing, "filename", "x.name", strip(F.regexp_replace("x.v", "<[^>]+>", "")).alias("v")).filter("v <> ''")
    found = rows.groupBy(*filing, "name").agg(F.min_by("v", "filename").alias("value"))
    counts = found.groupBy(*filing).agg(F.count(F.lit(1)).alias("fm_n"))
    checked = found.join(counts, list(filing))
    return checked.filter(F.when(F.col("fm_n") < least, F.raise_error(F.lit("too few tagged values"))).otherwise(F.lit(True))).drop("fm_n")


def page_selection(spec: str | None) -> list[tuple[int, int]] | None:
    """'1,32-34' as ranges; None for all pages."""
    if spec is None or not spec.strip():
        return None
    out = []
    for part in spec.split(","):
        low, _, high = part.strip().partition("-")
        out.append((int(low), int(high or low)))
    return out


def in_pages(page: Column, spec: str | None) -> Column:
    ranges = page_selection(spec)
    if ranges is None:
        return F.lit(True)
    cond = F.lit(False)
    for low, high in ranges:
        cond = cond | page.between(low, high)
    return cond


def read_or_empty(spark: SparkSession, path: str, schema: str | T.StructType, kind: str = "json", **options: str) -> DataFrame:
    """A JSON-lines, CSV or Parquet source with a schema; an absent one is empty."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).globStatus(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**options).format(kind).load(path)


def from_xml(xml: Column, schema: str) -> Column:
    """A struct of the attributes (``_name``) and children of an XML text."""
    return F.from_xml(xml, schema)


def facts_from_xml(spark: SparkSession, path: str, row_tag: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def write_records(records: DataFrame, path: str, violations: Column) -> None:
    """JSON lines with every key present; nothing is written if any record breaks a rule."""
    bad = records.select(violations.alias("v")).filter(F.size("v") > 0).limit(3).collect()
    if bad:
        raise ValueError(f"invalid records, such as {[r['v'] for r in bad]}")
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_fields(rows: DataFrame, fields: Sequence[str], path: str, mode: str = "overwrite") -> None:
    """CSV of fixed fields; other columns are left out. ``mode`` append adds to a log."""
    rows.select(*fields).write.mode(mode).option("header", "true").csv(path)


def union_all(parts: Sequence[DataFrame]) -> DataFrame | None:
    """Rows of several schemas under the union of their columns in first-seen order; None without parts."""
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def write_if_any(rows: DataFrame | None, path: str) -> bool:
    """CSV unless there are no rows."""
    if rows is None or rows.isEmpty():
        return False
    rows.write.mode("overwrite").option("header", "true").csv(path)
    return True


def nested_json(rows: DataFrame, outer: str, inner: str | None = None) -> DataFrame:
    """outer, json: for each outer name its row as an object, or its rows under their inner names, sorted. A line of the sink each."""
    rest = F.struct(*[c for c in rows.columns if c not in (outer, inner)])
    if inner is None:
        return rows.select(outer, F.to_json(rest).alias("json"))
    return rows.groupBy(outer).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(inner), rest))))).alias("json"))


def stage_if_changed(spark: SparkSession, inputs: Sequence[DataFrame], path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage kept at ``path`` under a hash of its inputs' content; it is built again only if they change.

    The hash is order-independent: the sum of the rows' 64-bit hashes with their count, one aggregate per input.
    """
    total = []
    for df in inputs:
        r = df.agg(F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).head()
        total.append(f"{r['h']}:{r['n']}")
    import hashlib

    at = f"{path}/{hashlib.sha256('|'.join(total).encode()).hexdigest()}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
