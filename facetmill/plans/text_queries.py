"""Text, number and record operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetmill.functions import numbers, text
from facetmill.operators import layout, managed, metrics, pages, records
from facetmill.plans import sql
from facetmill.sources import io
from facetmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def numeric_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", *[F.size(text.numeric_tokens(t, p)).cast("bigint").alias(n) for n, p in (("n_tokens", text.NUM_TOKEN), ("n_percent", text.NUM_TOKEN_PERCENT), ("n_signed", text.NUM_SIGNED))])


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("source", F.explode(text.numeric_tokens(F.col("text"))).alias("token"))
    return t.groupBy("source", "token").agg(F.count(F.lit(1)).alias("n"))


def last_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.last_year(F.col("text")).cast("bigint").alias("last_year"))


def ocr_decision(spark: SparkSession, d: str) -> DataFrame:
    cover = F.pmod("doc_id", F.lit(10)) / 10.0
    o = records.ocr_decision(F.col("text"), cover, 250, 0.05)
    return table(spark, d, "documents").select("doc_id", o.alias("o")).select("doc_id", "o.*")


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.normal_text(F.col("text")).alias("normal"))


def label_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "table_cells").select("label").filter("label is not null").distinct()
    return c.select("label", text.letters_only(F.col("label")).alias("letters"), text.ends_in_number(F.col("label")).alias("ends_in_number"))


def typography(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.typography_normal(F.col("text")).alias("plain"))


def _beside_next(docs: DataFrame) -> DataFrame:
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return docs.join(nxt, "doc_id")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each document beside the next one, as stored."""
    return _beside_next(table(spark, d, "documents").select("doc_id", F.col("text").alias("a")))


def char_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("doc_id", text.char_error_rate(F.col("a"), F.col("b")).alias("cer"))


def word_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("doc_id", text.word_error_rate(F.col("a"), F.col("b")).alias("wer"))


def numeric_recall_pairs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.numeric_recall(_pairs(spark, d), ["doc_id"], "a", "b")


def number_accuracy_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("doc_id", metrics.number_accuracy(F.col("a"), F.col("b")).alias("num_acc"))


def ocr_scores(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.ocr_scores(_pairs(spark, d), "a", "b")
    return s.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("ref_words", "hyp_words", "ref_numbers")], "wer", "cer", "wer_typography", "cer_typography", "num_acc")


def markdown_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.markdown_to_text(F.concat(F.lit("## A [b](c)\n<!-- x -->![i](j)**k**\n|---|---|\n"), "text")).alias("plain"))


def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<p class='x'>"), F.replace("text", F.lit(" "), F.lit("</b> <b>")), F.lit("</p>"))
    return table(spark, d, "documents").select("doc_id", text.strip_tags(html).alias("plain"), text.first_line(F.col("text")).alias("first_line"))


def search_snippet(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select("doc_id", "text")
    return records.search(r, "Revenue", ["doc_id"], ["doc_id"], limit=50)


def format_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", metrics.text_sizes(F.col("text")).alias("s")).select("doc_id", "s.*")


def file_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def cache_key(spark: SparkSession, d: str) -> DataFrame:
    """The key of the page of every record."""
    k = managed.cache_key(F.col("sha256"), F.col("page"), F.lit("provider"), F.lit("Analyze"), F.lit("TABLES, layout+ "))
    return table(spark, d, "filing_records").select("rec_id", k.alias("cache_key")).distinct()


STYLES = (
    "CASE CAST(c_custkey % 8 AS INT) WHEN 0 THEN {s} WHEN 1 THEN concat('$ ', {s}) WHEN 2 THEN concat('(', {s}, ')') WHEN 3 THEN concat('(', {s}) WHEN 4 THEN concat({s}, '%') WHEN 5 THEN concat({s}, '(1)') WHEN 6 THEN '—' ELSE concat('n/a ', {s}) END"
)


def to_number_cells(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("fm_s", F.regexp_replace(F.abs(F.col("c_acctbal")).cast("decimal(18,2)").cast("string"), r"(?<=\d)(?=(?:\d{3})+\.)", ","))
    n = numbers.to_number(F.expr(STYLES.format(s="fm_s")))
    return c.select("c_custkey", n["value"].alias("value"), n["unit"].alias("unit"))


def caption_scales(spark: SparkSession, d: str) -> DataFrame:
    s = numbers.caption_scales(F.col("text"))
    return table(spark, d, "filing_records").filter("block_type = 'Text' and text is not null").select("rec_id", s.alias("s")).select("rec_id", "s.money", "s.shares").distinct()


def classify_status(spark: SparkSession, d: str) -> DataFrame:
    v = F.expr("CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN o_totalprice WHEN 1 THEN -o_totalprice WHEN 2 THEN o_totalprice * 1000 WHEN 3 THEN o_totalprice / 1000000 WHEN 4 THEN o_totalprice + 0.4 WHEN 5 THEN o_totalprice + 7 ELSE o_totalprice * 1000000000 END")
    cmp = numbers.compare_value(v, F.col("o_totalprice"), F.when(F.col("o_orderkey") % 7 == 4, "0").otherwise("2"), F.col("o_orderkey") % 2 == 0)
    return table(spark, d, "orders").select("o_orderkey", cmp["status"].alias("status"))


def validate_records(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule of the record schema is broken."""
    r = table(spark, d, "filing_records").select("rec_id", F.explode(records.violations()).alias("field")).distinct()
    return r.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filing_records").dropDuplicates(["rec_id"])


def section_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).select("rec_id", "doc_id", "page", "block_order", F.lit(None).cast("string").alias("section"), F.when((F.col("block_type") == "Title") & F.col("text").rlike(text.ITEM), F.concat(F.lit("Item "), F.upper(F.regexp_extract("text", text.ITEM, 1)))).alias("item"))
    return records.with_sections(b, ["doc_id"], ["page", "block_order", "rec_id"]).select("rec_id", "section")


def previous_line(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).select("rec_id", "doc_id", "page", "block_order", "block_type", "text")
    return records.previous_line(b, ["doc_id", "page"], ["block_order", "rec_id"]).select("rec_id", "context")


def carried_title(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).select("rec_id", "doc_id", "page", "block_order", F.col("block_type").alias("type"), "text")
    return layout.carried_section(b, ["doc_id"], ["page", "block_order", "rec_id"]).select("rec_id", "section")


ORDER = ["page", "block_order", "rec_id"]


def markdown_export(spark: SparkSession, d: str) -> DataFrame:
    """Each filing with its title line, its item headings, all its blocks, their whole text and their tables, and how many footers were left out."""
    b = _blocks(spark, d).select("rec_id", "doc_id", "page", "section", "block_id", "block_order", "block_type", "text", "tbl", "figure_path", "company", "form", "fiscal_year", "bbox")
    b = records.with_headings(b, ["doc_id"], ORDER, "rec_id")
    return records.documents_of(records.fragments(b, ["doc_id"], ORDER), ["doc_id"], ORDER)


def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    t = _blocks(spark, d).filter("tbl.raw_cells is not null and size(tbl.raw_cells) > 0")
    return t.select("rec_id", records.table_markdown(F.col("tbl.raw_cells")).alias("md"))


def trace_block(spark: SparkSession, d: str) -> DataFrame:
    """Every block of the export traced back to what the Markdown shows for it."""
    docs = markdown_export(spark, d).select("doc_id", "markdown")
    b = _blocks(spark, d).select("doc_id", "rec_id", "block_id")
    return b.join(docs, "doc_id").select("rec_id", records.trace(F.col("markdown"), F.col("block_id")).alias("shown"))


def markdown_slice(spark: SparkSession, d: str) -> DataFrame:
    return records.slice_pages(markdown_export(spark, d), ["doc_id"], "markdown", 10, 40)


def slice_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of each filing's pages 10 to 40 as Markdown and as text."""
    b = _blocks(spark, d).filter(io.in_pages(F.col("page"), "10-40"))
    plain = records.documents_of(records.fragments(b, ["doc_id"], ORDER), ["doc_id"], ORDER).select("doc_id", F.lit("txt").alias("format"), F.col("plain").alias("t"))
    md = markdown_slice(spark, d).select("doc_id", F.lit("md").alias("format"), F.col("slice").alias("t"))
    return plain.unionByName(md).filter("t is not null").select("doc_id", "format", metrics.text_sizes(F.col("t")).alias("s")).select("doc_id", "format", "s.*")


def record_pages(spark: SparkSession, d: str) -> DataFrame:
    """The records of a page selection, with who made their content."""
    r = _blocks(spark, d).filter(io.in_pages(F.col("page"), "1,3-5, 40-60"))
    who = records.extractor_of(F.col("extractor") == "managed", F.col("tbl.method"), F.coalesce("ocr", F.lit(False)), F.coalesce("text", F.lit("")))
    return r.select("rec_id", who.alias("made_by"))


def first_marked(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").select("ticker", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".htm").otherwise(".xml")).alias("filename"), F.col("text").alias("body"))
    return io.first_marked(f, ["ticker"], "revenue")


def _tagged_pages(spark: SparkSession, d: str) -> DataFrame:
    """Two tagged pages of each filing of the manifest, of which the second repeats a name."""
    m = table(spark, d, "manifest").select("accession", F.year("report_period").cast("string").alias("year"), "form").distinct()
    tag = lambda name, value: F.concat(F.lit(f"<ix:nonNumeric id='x' name=\"dei:{name}\" format='y'>\n <b> "), value, F.lit(" </b></ix:nonNumeric>"))
    a = m.select("accession", F.lit("a.htm").alias("filename"), F.concat(F.lit("<p>"), tag("DocumentFiscalYearFocus", F.col("year")), F.lit("</p>")).alias("body"))
    b = m.select("accession", F.lit("b.htm").alias("filename"), F.concat(tag("DocumentFiscalYearFocus", F.lit("1900")), tag("DocumentFiscalPeriodFocus", F.col("form"))).alias("body"))
    return a.unionByName(b)


def inline_values(spark: SparkSession, d: str) -> DataFrame:
    return io.inline_values(_tagged_pages(spark, d), ["accession"], ["DocumentFiscalYearFocus", "DocumentFiscalPeriodFocus"])


def xml_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts written as XML and read back."""
    f = table(spark, d, "tagged_facts").select("fact_id", "doc_id", "concept", F.col("fact_value").alias("v"), "unit").distinct()
    attribute = lambda n, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f' {n}="'), F.col(c), F.lit('"'))).otherwise("")
    xml = F.concat(F.lit("<fact"), attribute("concept", "concept"), attribute("unit", "unit"), F.lit(">"), F.when(F.col("v").isNotNull(), F.concat(F.lit("<value>"), F.col("v").cast("string"), F.lit("</value>"))).otherwise(""), F.lit("</fact>"))
    return f.select("fact_id", "doc_id", io.from_xml(xml, "_concept string, _unit string, value double").alias("x")).select("fact_id", "doc_id", F.col("x._concept").alias("concept"), F.col("x._unit").alias("unit"), F.col("x.value").alias("fact_value"))


def nested_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The block counts of each filing by page as one JSON object."""
    n = _blocks(spark, d).groupBy("doc_id", F.col("block_type").alias("kind")).agg(F.count(F.lit(1)).alias("blocks"), F.count("text").alias("texts")).filter("kind is not null")
    return io.nested_json(n, "doc_id", "kind")


def scale_json(spark: SparkSession, d: str) -> DataFrame:
    """The scales of each table as canonical JSON."""
    r = _blocks(spark, d).filter("tbl.scale is not null")
    return r.select("rec_id", text.canonical_json(F.transform_values("tbl.scale", lambda k, v: v.cast("bigint").cast("string"))).alias("scale"))


def plain_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct printed cell as a plain number with commas, and as text or number."""
    c = table(spark, d, "filing_records").select(F.explode(F.flatten("tbl.raw_cells")).alias("cell")).distinct()
    v = numbers.plain_value(F.col("cell"))
    return c.select("cell", numbers.as_number(F.col("cell")).alias("as_number"), v["s"].alias("s"), v["n"].alias("n"))


def filings(spark: SparkSession, d: str) -> DataFrame:
    """Each filing of the manifest with its block counts by type."""
    m = table(spark, d, "manifest").select("accession", "stem", "company", "form").distinct()
    n = _blocks(spark, d).groupBy("doc_id").pivot("block_type", list(records.BLOCK_TYPES)).agg(F.count(F.lit(1))).na.fill(0)
    return m.join(n, m.accession == n.doc_id, "left").select("accession", "stem", "company", "form", *[F.coalesce(F.col(t), F.lit(0)).alias(f"n_{t.lower()}") for t in records.BLOCK_TYPES])


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "table_cells").select("cell_id", "ticker", F.lower(text.strip(F.col("status"))).alias("status")).distinct()
    g = c.groupBy("ticker", "status").agg(F.count(F.lit(1)).alias("n")).groupBy("ticker").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("status", F.lit("none")), "n")))).alias("m"))
    return g.select("ticker", F.try_element_at("m", F.lit("match")).alias("n_match"), F.try_element_at("m", F.lit("differ")).alias("n_differ"))


QUERIES = (
    numeric_tokens, token_counts, last_years, ocr_decision, normalize_text, label_keys, typography, char_error_rate, word_error_rate, numeric_recall_pairs, number_accuracy_pairs, ocr_scores, markdown_to_text, strip_tags, search_snippet,
    format_sizes, file_hash, cache_key, to_number_cells, caption_scales, classify_status, validate_records, section_forward_fill, previous_line, carried_title, markdown_export, markdown_tables, trace_block, markdown_slice, slice_sizes, record_pages,
    first_marked, inline_values, xml_facts, nested_metrics, scale_json, plain_cells, filings, status_counts,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


PAIRS = "pairs AS (SELECT x.doc_id, x.text AS a, y.text AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1)"
BLOCKS = "(SELECT * FROM filing_records QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at) = 1)"
NT, NP, NS = (p.replace("'", "''") for p in (text.NUM_TOKEN, text.NUM_TOKEN_PERCENT, text.NUM_SIGNED))
TRIM = "regexp_replace({x}, '^ +| +$', '', 'g')"
CHUNK = "concat(chr(10), chr(10))"
CELL = "strip(replace(replace(x, '|', '\\|'), chr(10), ' '))"
MD_TABLE = f"array_to_string(list_concat(list_concat([concat('| ', array_to_string(list_transform(raw[1], lambda x: {CELL}), ' | '), ' |')], [concat('|', repeat('---|', len(raw[1])))]), list_transform(raw[2:], lambda r: concat('| ', array_to_string(list_transform(r, lambda x: {CELL}), ' | '), ' |'))), chr(10))"
FOOT = rf"coalesce(strip(t) <> '' AND NOT has AND NOT contains(strip(t), chr(10)) AND length(strip(t)) <= 80 AND regexp_matches(strip(t), '{records.FOOTER}'), false)"
BODY = rf"strip(array_to_string(list_filter(string_split(coalesce(t, ''), chr(10)), lambda x: NOT regexp_matches(strip(x), '{records.FOOTER_LINE}')), chr(10)))"
ITEM_AT, ITEM_REST = r"(?i)^\s*item\s+(\d{1,2}[a-c]?)\s*[.:–—-]", r"(?i)^\s*(\d{1,2}[a-c]?)\s*[.:–—-]\s*\S"
HEADINGS = rf"""b0 AS (SELECT rec_id, doc_id, page, section, block_id, block_order, block_type, figure_path, company, form, fiscal_year, text AS t, tbl IS NOT NULL AS has, tbl.raw_cells AS raw, bbox, CASE WHEN block_type IN ('Title', 'Text') AND strip(text) <> '' THEN strip(text) END AS y FROM {BLOCKS}),
h AS (SELECT rec_id, concat('Item ', upper(regexp_extract(y, '{ITEM_AT}', 1))) AS item, strip(split_part(y, chr(10), 1)) AS heading, CAST(NULL AS BIGINT) AS part FROM b0 WHERE length(y) <= 150 AND regexp_matches(y, '{ITEM_AT}')
  UNION ALL SELECT r.rec_id, concat('Item ', upper(regexp_extract(r.y, '{ITEM_REST}', 1))), concat('Item ', strip(split_part(r.y, chr(10), 1))), min(w.rec_id) FROM b0 r JOIN b0 w ON r.doc_id = w.doc_id AND r.page = w.page AND regexp_matches(w.y, '(?i)^\s*item\s*$')
    AND least(w.bbox.bottom, r.bbox.bottom) - greatest(w.bbox.top, r.bbox.top) > least(w.bbox.bottom - w.bbox.top, r.bbox.bottom - r.bbox.top) * 0.5 AND w.bbox.x0 <= r.bbox.x0 + 5 AND w.bbox.x1 < r.bbox.x1
    WHERE length(r.y) <= 150 AND regexp_matches(r.y, '{ITEM_REST}') AND NOT regexp_matches(r.y, '{ITEM_AT}') GROUP BY r.rec_id, r.y),
b1 AS (SELECT b0.* EXCLUDE (section), coalesce(last_value(item IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, block_order, rec_id), section) AS section, item, heading FROM b0 LEFT JOIN h USING (rec_id)),
o1 AS (SELECT doc_id, item AS of, heading AS named, rec_id AS at_rec FROM b1 WHERE item IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, item ORDER BY page, block_order, rec_id) = 1),
g1 AS (SELECT part AS rec_id, min(item) AS whole FROM h WHERE part IS NOT NULL GROUP BY part)"""
EXPORT = rf"""{HEADINGS}, b AS (SELECT b1.* EXCLUDE (section), coalesce(whole, section) AS section, named, coalesce(at_rec = b1.rec_id, false) AS is_heading, whole IS NOT NULL AS is_part FROM b1 LEFT JOIN o1 ON o1.doc_id = b1.doc_id AND o1.of = b1.section LEFT JOIN g1 ON g1.rec_id = b1.rec_id),
f AS (SELECT *, {FOOT} AS footer FROM b),
shown AS (SELECT *, strip(t) AS s, {BODY} AS body FROM f WHERE NOT footer AND NOT is_part),
c AS (SELECT *, row_number() OVER w = 1 OR section IS DISTINCT FROM lag(section) OVER w AS changed, concat('<!-- ', doc_id, ' p', page, ' ', block_id, ' -->') AS src FROM shown WINDOW w AS (PARTITION BY doc_id ORDER BY page, block_order, rec_id)),
p AS (SELECT *, CASE WHEN changed AND NOT is_heading AND section <> '' THEN concat('## ', coalesce(named, section)) END AS lead,
  CASE WHEN is_heading THEN concat(src, {CHUNK}, '## ', named) WHEN block_type = 'Title' THEN CASE WHEN s IS NULL THEN src ELSE concat(src, {CHUNK}, '### ', s) END
       WHEN block_type = 'Table' AND len(raw) > 0 THEN concat(src, {CHUNK}, {MD_TABLE})
       WHEN block_type = 'Figure' THEN concat(src, {CHUNK}, CASE WHEN figure_path IS NOT NULL THEN concat('![Figure, page ', page, '](', figure_path, ')') ELSE '*[Figure]*' END, CASE WHEN s <> '' THEN concat({CHUNK}, s) ELSE '' END)
       WHEN body <> '' THEN concat(src, {CHUNK}, body) END AS piece,
  CASE WHEN len(raw) > 0 THEN array_to_string(list_transform(raw, lambda r: array_to_string(list_filter(r, lambda x: x <> ''), ' ')), chr(10)) ELSE body END AS txt FROM c),
m AS (SELECT doc_id, string_agg(concat_ws({CHUNK}, lead, piece), {CHUNK} ORDER BY page, block_order, rec_id) FILTER (lead IS NOT NULL OR piece IS NOT NULL) AS md,
  coalesce(string_agg(txt, {CHUNK} ORDER BY page, block_order, rec_id) FILTER (txt <> ''), '') AS plain FROM p GROUP BY doc_id),
o AS (SELECT doc_id, concat('# ', coalesce(company, 'null'), ' ', coalesce(form, 'null'), ' FY', coalesce(CAST(fiscal_year AS VARCHAR), 'null'), ' (', doc_id, ')') AS title FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, block_order, rec_id) = 1),
n AS (SELECT doc_id, count(*) FILTER (footer) AS skipped FROM f GROUP BY doc_id),
export AS (SELECT doc_id, skipped, CASE WHEN m.doc_id IS NOT NULL THEN concat_ws({CHUNK}, title, md) END AS markdown, plain FROM n JOIN o USING (doc_id) LEFT JOIN m USING (doc_id))
"""
SLICE = rf"""WITH {EXPORT}, k AS (SELECT doc_id, unnest(string_split(markdown, {CHUNK})) AS chunk, generate_subscripts(string_split(markdown, {CHUNK}), 1) AS pos FROM export),
q AS (SELECT *, TRY_CAST(nullif(regexp_extract(strip(chunk), '^<!-- \S+ p(\d+) \S+ -->', 1), '') AS INT) AS page FROM k),
v AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS own, page IS NULL AND starts_with(chunk, '## ') AS heads FROM q),
z AS (SELECT *, (SELECT x.page FROM v x WHERE x.doc_id = v.doc_id AND x.pos > v.pos AND (x.heads OR x.page IS NOT NULL) ORDER BY x.pos LIMIT 1) AS next FROM v)
SELECT doc_id, concat(rtrim(string_agg(chunk, {CHUNK} ORDER BY pos), chr(10)), chr(10)) AS slice FROM z WHERE pos = 1 OR own BETWEEN 10 AND 40 OR (heads AND next BETWEEN 10 AND 40) GROUP BY doc_id"""


def _typographic(x: str) -> str:
    return f"translate({x}, '–—‘’“”®™©', '--''''\"\"')"


def _light(x: str) -> str:
    return f"strip(regexp_replace(lower({x}), '{sql.COLLAPSED}+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{sql.COLLAPSED}+'), lambda w: w <> '')"


PLAIN = r"regexp_full_match({x}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')"


def oracle_sql() -> dict[str, str]:
    s = "regexp_replace(printf('%.2f', abs(c_acctbal)), '(\\d)(\\d{3})(\\.)', '\\1,\\2\\3')"
    style = STYLES.format(s="fm_s")
    checks = {
        "numeric_tokens": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{NT}')) AS BIGINT) AS n_tokens, CAST(len(regexp_extract_all(text, '{NP}')) AS BIGINT) AS n_percent, CAST(len(regexp_extract_all(text, '{NS}')) AS BIGINT) AS n_signed FROM documents",
        "token_counts": f"SELECT source, token, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '{NT}')) AS token FROM documents) GROUP BY ALL",
        "last_years": "SELECT doc_id, CAST(list_extract(regexp_extract_all(regexp_replace(text, '\\p{L}|\\p{M}', 'x', 'g'), '\\b(?:19|20)\\d{2}\\b'), -1) AS BIGINT) AS last_year FROM documents",
        "ocr_decision": r"""WITH t AS (SELECT doc_id, length(strip(text)) AS n, list_filter(regexp_split_to_array(text, '[\s\p{Z}\x0b\x1c-\x1f\x85]+'), lambda x: x <> '') AS w, (doc_id % 10) / 10.0 AS c FROM documents),
          r AS (SELECT *, coalesce(len(list_filter(w, lambda x: regexp_matches(x, '\(cid:\d+\)|�|[\x00-\x08\x0b\x0c\x0e-\x1f]'))) / nullif(len(w), 0), 0) AS j FROM t),
          q AS (SELECT *, concat_ws(';', CASE WHEN n < 250 THEN 'few_chars' END, CASE WHEN j > 0.05 THEN 'junk_ratio' END, CASE WHEN c > 0.6 THEN 'image_coverage' END) AS why FROM r)
          SELECT doc_id, why <> '' AS triggered, CASE WHEN why = '' THEN 'none' ELSE why END AS reason, CAST(n AS BIGINT) AS n_chars, CAST(j AS DOUBLE) AS junk_ratio FROM q""",
        "normalize_text": f"SELECT doc_id, {sql.normal('text')} AS normal FROM documents",
        "label_keys": "SELECT DISTINCT label, regexp_replace(lower(label), '[^a-z]', '', 'g') AS letters, regexp_matches(label, '\\d[\\d,]*\\)?$') AS ends_in_number FROM table_cells WHERE label IS NOT NULL",
        "typography": "SELECT doc_id, translate(text, '–—‘’“”®™©', '--''''\"\"') AS plain FROM documents",
        "char_error_rate": f"WITH {PAIRS} SELECT doc_id, CASE WHEN length(a) > 0 THEN {sql.distance('a', 'b')} / length(a) WHEN length(b) = 0 THEN 0.0 ELSE 1.0 END AS cer FROM pairs",
        "word_error_rate": f"WITH RECURSIVE {PAIRS}, wp AS (SELECT doc_id AS id, {_words('a')} AS a, {_words('b')} AS b FROM pairs), {sql.word_distances('wp')} SELECT id AS doc_id, CASE WHEN len(a) > 0 THEN d / len(a) WHEN len(b) = 0 THEN 0.0 ELSE 1.0 END AS wer FROM wp JOIN distances USING (id)",
        "numeric_recall_pairs": f"""WITH {PAIRS}, r AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(a, '{NP}')) AS t FROM pairs) GROUP BY ALL), h AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(b, '{NP}')) AS t FROM pairs) GROUP BY ALL),
          s AS (SELECT r.doc_id, sum(r.n) AS n_ref, sum(least(r.n, coalesce(h.n, 0))) AS n_found FROM r LEFT JOIN h ON r.doc_id = h.doc_id AND r.t = h.t GROUP BY r.doc_id)
          SELECT p.doc_id, CAST(coalesce(n_ref, 0) AS BIGINT) AS n_ref, CAST(coalesce(n_found, 0) AS BIGINT) AS n_found, CAST(n_found AS DOUBLE) / n_ref AS numeric_recall FROM pairs p LEFT JOIN s ON s.doc_id = p.doc_id""",
        "number_accuracy_pairs": f"WITH {PAIRS}, x AS (SELECT doc_id, regexp_extract_all(a, '{NS}') AS r, regexp_extract_all(b, '{NS}') AS h FROM pairs) SELECT doc_id, len(list_filter(r, lambda t: list_contains(h, t))) / greatest(len(r), 1) AS num_acc FROM x",
        "ocr_scores": f"""WITH RECURSIVE {PAIRS}, n AS (SELECT doc_id, a AS ra, b AS rb, {_light('a')} AS x, {_light('b')} AS y, {_light(_typographic('a'))} AS u, {_light(_typographic('b'))} AS v FROM pairs),
          wp AS (SELECT 2 * doc_id AS id, {_words('x')} AS a, {_words('y')} AS b FROM n UNION ALL SELECT 2 * doc_id + 1, {_words('u')}, {_words('v')} FROM n), {sql.word_distances('wp')}, w AS (SELECT wp.*, d FROM wp JOIN distances USING (id))
          SELECT doc_id, CAST(len(w.a) AS BIGINT) AS ref_words, CAST(len(w.b) AS BIGINT) AS hyp_words, CAST(len(regexp_extract_all(ra, '{NS}')) AS BIGINT) AS ref_numbers, w.d / greatest(len(w.a), 1) AS wer, {sql.distance('x', 'y')} / greatest(length(x), 1) AS cer, t.d / greatest(len(t.a), 1) AS wer_typography, {sql.distance('u', 'v')} / greatest(length(u), 1) AS cer_typography,
          len(list_filter(regexp_extract_all(ra, '{NS}'), lambda z: list_contains(regexp_extract_all(rb, '{NS}'), z))) / greatest(len(regexp_extract_all(ra, '{NS}')), 1) AS num_acc FROM n JOIN w ON w.id = 2 * n.doc_id JOIN w t ON t.id = 2 * n.doc_id + 1""",
        "markdown_to_text": r"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(concat('## A [b](c)', chr(10), '<!-- x -->![i](j)**k**', chr(10), '|---|---|', chr(10), text), chr(10)), lambda x: regexp_replace(x, '<!--.*?-->', ' ', 'g')), lambda x: NOT regexp_full_match(x, '\s*\|?[\s:|-]+\|?\s*')),
          lambda x: replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '^\s*#+\s*', ''), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '|', ' '), '**', ''), '__', '')), chr(10)) AS plain FROM documents""",
        "strip_tags": "SELECT doc_id, regexp_replace(concat('<p class=''x''>', replace(text, ' ', '</b> <b>'), '</p>'), '<[^>]+>', '', 'g') AS plain, split_part(text, chr(10), 1) AS first_line FROM documents",
        "search_snippet": "WITH f AS (SELECT doc_id, text, instr(lower(text), 'revenue') AS i FROM documents WHERE contains(lower(text), 'revenue') ORDER BY doc_id LIMIT 50) SELECT doc_id, concat(CASE WHEN i - 81 > 0 THEN '...' ELSE '' END, substring(text, greatest(i - 81, 0) + 1, least(i - 1 + 7 + 80, length(text)) - greatest(i - 81, 0)), '...') AS snippet FROM f",
        "format_sizes": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS chars, CAST(round_even(length(text) / 4, 0) AS BIGINT) AS approx_tokens FROM documents",
        "file_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "cache_key": "SELECT DISTINCT rec_id, sha256(concat_ws('|', sha256, concat('p', page), 'provider', 'Analyze', 'LAYOUT+TABLES')) AS cache_key FROM filing_records",
        "to_number_cells": f"""WITH c AS (SELECT c_custkey, {s} AS fm_s FROM customer), x AS (SELECT c_custkey, {style} AS cell FROM c), f AS (SELECT *, translate(regexp_replace(cell, '([0-9)])\\s*\\([0-9]\\)$', '\\1'), '$, ', '') AS t FROM x),
          n AS (SELECT *, regexp_replace(t, '[()%]', '', 'g') AS u FROM f) SELECT c_custkey, CASE WHEN t = '—' THEN 0.0 WHEN regexp_full_match(u, '\\d+\\.?\\d*') THEN CASE WHEN t[1] = '(' THEN -CAST(u AS DOUBLE) ELSE CAST(u AS DOUBLE) END END AS value, CASE WHEN t LIKE '%!%' ESCAPE '!' AND regexp_full_match(u, '\\d+\\.?\\d*') THEN 'pct' ELSE 'num' END AS unit FROM n""",
        "caption_scales": r"""WITH t AS (SELECT DISTINCT rec_id, lower(text) AS t FROM filing_records WHERE block_type = 'Text' AND text IS NOT NULL), u AS (SELECT rec_id, regexp_extract(t, '\bin\s+(thousands|millions|billions)\b', 1) AS m, regexp_extract(t, 'shares[^.)]*?\bin\s+(thousands|millions|billions)\b', 1) AS s FROM t),
          f AS (SELECT rec_id, CASE m WHEN 'thousands' THEN 1e3 WHEN 'millions' THEN 1e6 WHEN 'billions' THEN 1e9 ELSE 1.0 END AS money, CASE s WHEN 'thousands' THEN 1e3 WHEN 'millions' THEN 1e6 WHEN 'billions' THEN 1e9 END AS sh FROM u)
          SELECT DISTINCT rec_id, money, coalesce(sh, money) AS shares FROM f""",
        "classify_status": "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'match' WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'match_negated' ELSE 'sign' END WHEN 2 THEN 'scale_x1000' WHEN 3 THEN 'scale_x1e-06' WHEN 4 THEN 'match' WHEN 5 THEN 'mismatch' ELSE 'scale_x1e+09' END AS status FROM orders",
        "section_forward_fill": rf"WITH b AS (SELECT rec_id, doc_id, page, block_order, CASE WHEN block_type = 'Title' AND regexp_matches(text, '(?i)^\s*item\s+(\d{{1,2}}[a-c]?)\s*[.:–—-]') THEN concat('Item ', upper(regexp_extract(text, '(?i)^\s*item\s+(\d{{1,2}}[a-c]?)\s*[.:–—-]', 1))) END AS item FROM {BLOCKS}) SELECT rec_id, last_value(item IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, block_order, rec_id) AS section FROM b",
        "previous_line": f"WITH b AS (SELECT rec_id, doc_id, page, block_order, block_type, strip(split_part(strip(text), chr(10), 1)) AS l FROM {BLOCKS}) SELECT rec_id, coalesce(last_value(CASE WHEN block_type <> 'Table' AND length(l) > 10 AND NOT starts_with(l, '(') THEN l END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY block_order, rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM b",
        "carried_title": f"WITH b AS (SELECT rec_id, doc_id, page, block_order, block_type, substring(strip(regexp_replace(text, '{sql.COLLAPSED}+', ' ', 'g')), 1, 150) AS t FROM {BLOCKS}) SELECT rec_id, last_value(CASE WHEN block_type = 'Title' AND t <> '' THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, block_order, rec_id) AS section FROM b",
        "markdown_export": f"WITH {EXPORT} SELECT * FROM export",
        "markdown_slice": SLICE,
        "slice_sizes": f"""WITH s AS ({SLICE}), b AS (SELECT doc_id, page, block_order, rec_id, tbl.raw_cells AS raw, text AS t, tbl IS NOT NULL AS has FROM {BLOCKS} WHERE page BETWEEN 10 AND 40), f AS (SELECT * FROM b WHERE NOT {FOOT}),
          x AS (SELECT *, CASE WHEN len(raw) > 0 THEN array_to_string(list_transform(raw, lambda r: array_to_string(list_filter(r, lambda x: x <> ''), ' ')), chr(10)) ELSE {BODY} END AS txt FROM f),
          a AS (SELECT doc_id, 'md' AS format, slice AS t FROM s WHERE slice IS NOT NULL UNION ALL SELECT doc_id, 'txt', coalesce(string_agg(txt, {CHUNK} ORDER BY page, block_order, rec_id) FILTER (txt <> ''), '') FROM x GROUP BY doc_id)
          SELECT doc_id, format, CAST(strlen(t) AS BIGINT) AS bytes, CAST(length(t) AS BIGINT) AS chars, CAST(round_even(length(t) / 4, 0) AS BIGINT) AS approx_tokens FROM a""",
        "trace_block": f"WITH {EXPORT} SELECT rec_id, split_part(split_part(markdown, concat(' ', block_id, ' -->', {CHUNK}), 2), {CHUNK}, 1) AS shown FROM b JOIN export USING (doc_id)",
        "markdown_tables": f"SELECT rec_id, {MD_TABLE} AS md FROM (SELECT rec_id, tbl.raw_cells AS raw FROM {BLOCKS}) WHERE len(raw) > 0",
        "record_pages": f"SELECT rec_id, CASE WHEN extractor = 'managed' THEN 'managed' WHEN tbl.method IS NOT NULL THEN tbl.method WHEN ocr THEN 'ocr' WHEN text <> '' THEN 'text-layer' ELSE 'layout' END AS made_by FROM {BLOCKS} WHERE page = 1 OR page BETWEEN 3 AND 5 OR page BETWEEN 40 AND 60",
        "first_marked": "SELECT ticker, min(filename) AS filename FROM (SELECT ticker, concat('f', doc_id, CASE WHEN lang = 'en' THEN '.htm' ELSE '.xml' END) AS filename, text FROM documents) WHERE filename LIKE '%.htm' AND contains(substring(text, 1, 400000), 'revenue') GROUP BY ticker",
        "inline_values": "WITH m AS (SELECT DISTINCT accession, CAST(year(report_period) AS VARCHAR) AS y, form FROM manifest) SELECT accession, 'DocumentFiscalYearFocus' AS name, min(y) AS value FROM m GROUP BY accession UNION ALL SELECT accession, 'DocumentFiscalPeriodFocus', min(form) FROM m GROUP BY accession",
        "xml_facts": "SELECT DISTINCT fact_id, doc_id, concept, unit, fact_value FROM tagged_facts",
        "nested_metrics": f"""SELECT doc_id, concat('{{', string_agg(concat('"', block_type, '":{{"blocks":', n, ',"texts":', t, '}}'), ',' ORDER BY block_type), '}}') AS json FROM (SELECT doc_id, block_type, count(*) AS n, count(text) AS t FROM {BLOCKS} WHERE block_type IS NOT NULL GROUP BY ALL) GROUP BY doc_id""",
        "scale_json": f"""SELECT rec_id, concat('{{', array_to_string(list_transform(list_sort(map_entries(tbl.scale)), lambda e: concat('"', e.key, '":"', CAST(e.value AS BIGINT), '"')), ','), '}}') AS scale FROM {BLOCKS} WHERE tbl.scale IS NOT NULL""",
        "plain_cells": f"""SELECT cell, CASE WHEN {PLAIN.format(x="replace(t, ',', '')")} THEN CAST(replace(t, ',', '') AS DOUBLE) END AS as_number, CASE WHEN t <> '' AND NOT {PLAIN.format(x="t")} THEN cell END AS s, CASE WHEN {PLAIN.format(x="t")} THEN CAST(t AS DOUBLE) END AS n FROM (SELECT DISTINCT cell, strip(cell) AS t FROM (SELECT unnest(flatten(tbl.raw_cells)) AS cell FROM filing_records))""",
        "filings": f"""WITH n AS (SELECT doc_id, {", ".join(f"count(*) FILTER (block_type = '{t}') AS n_{t.lower()}" for t in records.BLOCK_TYPES)} FROM {BLOCKS} GROUP BY doc_id), m AS (SELECT DISTINCT accession, stem, company, form FROM manifest)
          SELECT accession, stem, company, form, {", ".join(f"coalesce(n_{t.lower()}, 0) AS n_{t.lower()}" for t in records.BLOCK_TYPES)} FROM m LEFT JOIN n ON m.accession = n.doc_id""",
        "status_counts": "WITH c AS (SELECT DISTINCT cell_id, ticker, lower(strip(status)) AS status FROM table_cells) SELECT ticker, nullif(count(*) FILTER (status = 'match'), 0) AS n_match, nullif(count(*) FILTER (status = 'differ'), 0) AS n_differ FROM c GROUP BY ticker",
        "validate_records": f"""WITH b AS (SELECT DISTINCT * FROM (SELECT rec_id, doc_id, cik, fiscal_year, fiscal_period, page, block_id, block_type, bbox, source_path, figure_path, detector_score, sha256, ocr, ocr_conf, text, tbl FROM filing_records)), v AS (
          SELECT rec_id, 'doc_id' AS field FROM b WHERE NOT coalesce(regexp_full_match(doc_id, '\\d{{10}}-\\d{{2}}-\\d{{6}}'), false) UNION SELECT rec_id, 'cik' FROM b WHERE NOT regexp_full_match(cik, '\\d{{10}}') UNION SELECT rec_id, 'fiscal_year' FROM b WHERE fiscal_year NOT BETWEEN 1990 AND 2100
          UNION SELECT rec_id, 'fiscal_period' FROM b WHERE NOT regexp_full_match(fiscal_period, 'FY|Q[1-4]|H[12]') UNION SELECT rec_id, 'page' FROM b WHERE NOT coalesce(page >= 1, false) UNION SELECT rec_id, 'block_id' FROM b WHERE NOT coalesce(regexp_full_match(block_id, 'p\\d{{4}}_b\\d{{3,}}'), false)
          UNION SELECT rec_id, 'block_type' FROM b WHERE NOT coalesce(block_type IN ('Text', 'Title', 'List', 'Table', 'Figure', 'Footnote'), false) UNION SELECT rec_id, 'bbox' FROM b WHERE NOT coalesce(bbox.x0 < bbox.x1 AND bbox.top < bbox.bottom AND bbox.x0 >= -1 AND bbox.top >= -1, false)
          UNION SELECT rec_id, 'source_path' FROM b WHERE starts_with(source_path, '/') OR contains(source_path, '\\') OR regexp_matches(source_path, '^[A-Za-z]:|(^|/)\\.\\.(/|$)') UNION SELECT rec_id, 'figure_path' FROM b WHERE starts_with(figure_path, '/') OR contains(figure_path, '\\') OR regexp_matches(figure_path, '^[A-Za-z]:|(^|/)\\.\\.(/|$)')
          UNION SELECT rec_id, 'detector_score' FROM b WHERE detector_score NOT BETWEEN 0 AND 1 UNION SELECT rec_id, 'sha256' FROM b WHERE NOT coalesce(regexp_full_match(sha256, '[0-9a-f]{{64}}'), false) UNION SELECT rec_id, 'ocr_conf' FROM b WHERE ocr_conf IS NOT NULL AND (NOT coalesce(ocr, false) OR ocr_conf NOT BETWEEN 0 AND 100)
          UNION SELECT rec_id, 'text' FROM b WHERE block_type IN ('Text', 'Title', 'List', 'Footnote') AND text IS NULL
          UNION SELECT rec_id, 'table' FROM b WHERE tbl IS NOT NULL AND (block_type <> 'Table' OR len(list_filter(coalesce(tbl.grid_rows, []), lambda r: len(r) <> len(tbl.col_names))) > 0 OR coalesce(len(tbl.row_kinds) <> len(tbl.grid_rows), false)))
          SELECT field, count(*) AS n FROM v GROUP BY field""",
    }
    return {name: sql.stripped(q) for name, q in checks.items()}
