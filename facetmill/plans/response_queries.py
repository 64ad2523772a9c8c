"""Operators on the responses of a managed service over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.operators import managed
from facetmill.plans import sql
from facetmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filing_records").dropDuplicates(["rec_id"])


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """The printed tables as the graph of blocks of a response: tables of cells of words, with a dangling child each."""
    raw = table(spark, d, "filing_records").filter("tbl.raw_cells is not null").groupBy("rec_id").agg(F.max("tbl.raw_cells").alias("raw"))
    cells = raw.select("rec_id", F.posexplode("raw").alias("r", "row")).select("rec_id", "r", F.posexplode("row").alias("c", "cell"))
    cells = cells.withColumn("id", F.concat_ws(":", "r", "c")).withColumn("words", F.filter(F.split("cell", " "), lambda w: w != ""))
    ids: Column = F.transform("words", lambda w, i: F.concat_ws(":", "id", i.cast("string")))
    none = {n: F.lit(None).cast(t) for n, t in (("row", "int"), ("col", "int"), ("text", "string"), ("confidence", "double"))}
    box = F.lit(None).cast("struct<x0:double,top:double,x1:double,bottom:double>")

    def block(df: DataFrame, kind: str, **given: Column) -> DataFrame:
        known = none | {"child_ids": F.expr("cast(array() as array<string>)"), "id": F.col("id")} | given
        return df.select("rec_id", F.lit(kind).alias("type"), *[known[n].alias(n) for n in ("id", "row", "col", "text", "confidence", "child_ids")], box.alias("box"))

    of_table = raw.select("rec_id", F.flatten(F.transform("raw", lambda x, r: F.transform(x, lambda _, c: F.concat_ws(":", r.cast("string"), c.cast("string"))))).alias("children"))
    tables = block(of_table, "TABLE", id=F.lit("table"), child_ids=F.concat("children", F.array(F.lit("gone"))))
    of_cells = block(cells, "CELL", row=F.col("r") + 1, col=F.col("c") + 1, confidence=F.col("c").cast("double"), child_ids=F.concat(ids, F.array(F.lit("gone"))))
    words = block(cells.select("rec_id", F.explode(F.arrays_zip(ids.alias("i"), "words")).alias("z")).select("rec_id", F.col("z.i").alias("id"), F.col("z.words").alias("w")), "WORD", text=F.col("w"))
    return tables.unionByName(of_cells).unionByName(words)


def response_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the tables of a response with the words in them."""
    return managed.cells(_blocks(spark, d), ["rec_id"]).select("rec_id", "row", "col", "cell", "confidence")


def block_triggers(spark: SparkSession, d: str) -> DataFrame:
    """Why the content of a record should be replaced, as a table and as a text."""
    r = _records(spark, d)
    return r.select("rec_id", managed.table_trigger(F.col("tbl.status"), F.col("detector_score") * 100).alias("as_table"), managed.text_trigger(F.col("ocr_conf"), F.col("text")).alias("as_text"))


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Requests for the page of each record against the cached responses of every third one."""
    key = managed.cache_key(F.col("sha256"), F.col("page"), F.lit("provider"), F.lit("Analyze"), F.lit("TABLES"))
    r = _records(spark, d).select("rec_id", "page", key.alias("cache_key"))
    cached = r.filter("rec_id % 3 = 0").select("cache_key").distinct()
    return managed.lookup(r, cached, F.col("page") % 2 == 0).select("rec_id", "status")


def cache_insert(spark: SparkSession, d: str) -> DataFrame:
    """Customers as the entries that are there, orders as those that come in."""
    old = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.lit(-1).cast("bigint").alias("n"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("n"))
    return managed.insert_new(old, new, "key", "n")


def import_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why foreign responses are taken or not."""
    k = F.col("rec_id")
    inc = _records(spark, d).select(k.cast("string").alias("cache_key"), F.when(k % 11 > 0, F.col("sha256")).alias("source_sha256"), F.when(k % 7 == 0, 2).otherwise(1).alias("pages"), F.when(k % 5 == 0, "Detect").otherwise("Analyze").alias("api"), F.when(k % 13 == 0, "FORMS").otherwise("layout, TABLES").alias("features"))
    known = table(spark, d, "filing_records").filter("page <= 30").select(F.col("sha256").alias("source_sha256"))
    there = _records(spark, d).filter("rec_id % 9 = 0").select(k.cast("string").alias("cache_key"))
    taken, left = managed.import_checked(inc, known, there, "Analyze", "TABLES+LAYOUT")
    return taken.select("cache_key", F.lit("taken").alias("reason")).unionByName(left.select("cache_key", "reason"))


def replaced_texts(spark: SparkSession, d: str) -> DataFrame:
    """Records with the response's text where a trigger fires and there is one."""
    k = F.col("rec_id")
    r = _records(spark, d).select("rec_id", "tbl.status", F.when(F.col("tbl").isNotNull(), F.col("detector_score") * 100).alias("score"), F.coalesce("ocr", F.lit(False)).alias("ocr"), "text", F.col("ocr_conf").alias("confidence"))
    hits = r.filter(k % 2 == 0).select("rec_id", F.when(k % 8 == 0, "\t ").otherwise("new").alias("hit_text"), F.lit(99.0).alias("hit_confidence"))
    return managed.replaced(r, hits, ["rec_id"]).select("rec_id", "text", "confidence", "trigger", "used")


QUERIES = (response_cells, block_triggers, cache_lookup, cache_insert, import_reasons, replaced_texts)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


RECORDS = "(SELECT * FROM filing_records QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at) = 1)"
AS_TABLE = "CASE WHEN {status} IS NULL OR {status} NOT IN ('accepted', 'best_below_threshold') THEN concat('status:', coalesce({status}, 'none')) WHEN {score} < 80 THEN 'low_score' END"
AS_TEXT = "CASE WHEN strip(coalesce(text, '')) = '' THEN 'ocr_empty' WHEN ocr_conf IS NULL OR ocr_conf < 70 THEN 'low_confidence' END"


def oracle_sql() -> dict[str, str]:
    key = "sha256(concat_ws('|', sha256, concat('p', page), 'provider', 'Analyze', 'TABLES'))"
    checks = {
        "response_cells": "WITH t AS (SELECT rec_id, max(tbl.raw_cells) AS raw FROM filing_records WHERE tbl.raw_cells IS NOT NULL GROUP BY rec_id), l AS (SELECT rec_id, unnest(raw) AS x, generate_subscripts(raw, 1) AS row FROM t), e AS (SELECT rec_id, row, unnest(x) AS cell, generate_subscripts(x, 1) AS col FROM l) SELECT rec_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, array_to_string(list_filter(string_split(coalesce(cell, ''), ' '), lambda w: w <> ''), ' ') AS cell, CAST(col - 1 AS DOUBLE) AS confidence FROM e",
        "block_triggers": f"SELECT rec_id, {AS_TABLE.format(status='tbl.status', score='detector_score * 100')} AS as_table, {AS_TEXT} AS as_text FROM {RECORDS}",
        "cache_lookup": f"WITH r AS (SELECT rec_id, page, {key} AS k FROM {RECORDS}) SELECT rec_id, CASE WHEN k IN (SELECT k FROM r WHERE rec_id % 3 = 0) THEN 'hit' WHEN page % 2 <> 0 THEN 'miss_disabled' ELSE 'call' END AS status FROM r",
        "cache_insert": "SELECT c_custkey AS key, CAST(-1 AS BIGINT) AS n FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY o_custkey",
        "import_reasons": f"""SELECT CAST(rec_id AS VARCHAR) AS cache_key, CASE WHEN rec_id % 11 = 0 OR sha256 IS NULL THEN 'no_meta' WHEN sha256 NOT IN (SELECT sha256 FROM filing_records WHERE page <= 30 AND sha256 IS NOT NULL) THEN 'unknown_source' WHEN rec_id % 7 = 0 THEN 'not_one_page' WHEN rec_id % 5 = 0 THEN 'other_api' WHEN rec_id % 13 = 0 THEN 'other_features' WHEN rec_id % 9 = 0 THEN 'kept_old' ELSE 'taken' END AS reason FROM {RECORDS}""",
        "replaced_texts": f"""WITH r AS (SELECT rec_id, tbl.status AS status, CASE WHEN tbl IS NOT NULL THEN detector_score * 100 END AS score, coalesce(ocr, false) AS ocr, text, ocr_conf FROM {RECORDS}),
          t AS (SELECT *, CASE WHEN status IS NOT NULL OR score IS NOT NULL THEN {AS_TABLE.format(status='status', score='score')} WHEN ocr THEN {AS_TEXT} END AS trigger, rec_id % 2 = 0 AND rec_id % 8 <> 0 AS hit FROM r)
          SELECT rec_id, CASE WHEN trigger IS NOT NULL AND hit THEN 'new' ELSE text END AS text, CASE WHEN trigger IS NOT NULL AND hit THEN 99.0 ELSE ocr_conf END AS confidence, trigger, trigger IS NOT NULL AND hit AS used FROM t""",
    }
    return {name: sql.stripped(q) for name, q in checks.items()}
