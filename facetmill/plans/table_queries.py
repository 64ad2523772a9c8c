"""Grid, layout, matching, metric and stream operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.functions import geometry, text
from facetmill.operators import grid, layout, managed, match, metrics, nested, pages
from facetmill.plans import sql
from facetmill.sources import io
from facetmill.sources.tables import table
from facetmill.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]


def _tables(spark: SparkSession, d: str) -> DataFrame:
    """The printed cells of each record once: rec_id, raw. Records are told apart before their cells are exploded."""
    t = table(spark, d, "filing_records").filter("tbl.raw_cells is not null")
    return t.groupBy("rec_id").agg(F.max("tbl.raw_cells").alias("raw"))


def _grids(spark: SparkSession, d: str) -> DataFrame:
    """The printed cells of every table of the filings, padded: rec_id, r, c, cell."""
    wide = _tables(spark, d).withColumn("raw", grid.padded(F.col("raw"), F.array_max(F.transform("raw", F.size))))
    return nested.child_table(wide, ["rec_id"], "raw[][]", ["r", "c"], {"cell": "x"})


def clean_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.clean_grid(_grids(spark, d), ["rec_id"])


def classify_rows(spark: SparkSession, d: str) -> DataFrame:
    return grid.classify_rows(_grids(spark, d), ["rec_id"])


def shape_metrics(spark: SparkSession, d: str) -> DataFrame:
    return grid.shape_metrics(_grids(spark, d), ["rec_id"], F.lit(40), grid.TableRules(max_label_merge=0.5))


def normalize_grid(spark: SparkSession, d: str) -> DataFrame:
    captions = table(spark, d, "filing_records").filter("tbl is not null").select("rec_id", F.concat(F.lit("(in millions, except shares in thousands) "), F.coalesce("section", F.lit(""))).alias("text")).dropDuplicates(["rec_id"])
    return grid.normalize_grid(_grids(spark, d), ["rec_id"], captions).filter("num is not null").select("rec_id", "r", "c", "row_kind", "num")


def column_years(spark: SparkSession, d: str) -> DataFrame:
    return grid.column_years(_grids(spark, d), ["rec_id"]).select("rec_id", "c", F.col("year").cast("bigint"))


def column_names(spark: SparkSession, d: str) -> DataFrame:
    return grid.column_names(grid.with_row_kinds(_grids(spark, d), ["rec_id"]), ["rec_id"])


def merged_labels(spark: SparkSession, d: str) -> DataFrame:
    return grid.merge_wrapped_labels(grid.clean_grid(_grids(spark, d), ["rec_id"]), ["rec_id"])


def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    g = _grids(spark, d)
    captions = g.select("rec_id", F.lit("in millions").alias("text")).distinct()
    return match.grid_cells(grid.normalize_grid(g, ["rec_id"], captions), ["rec_id"])


def dense_grid(spark: SparkSession, d: str) -> DataFrame:
    """The ragged printed cells of every table as full grids."""
    cells = nested.child_table(_tables(spark, d), ["rec_id"], "raw[][]", ["r", "c"], {"cell": "x"})
    return grid.dense_grid(cells.select("rec_id", (F.col("r") + 1).cast("int").alias("row"), (F.col("c") + 1).cast("int").alias("col"), "cell", F.col("cell").alias("seq")), ["rec_id"])


def number_positions(spark: SparkSession, d: str) -> DataFrame:
    return grid.number_positions(_grids(spark, d), ["rec_id"])


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).cast("int").alias("rank"), (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + (F.col("l_extendedprice") * 100).cast("bigint")).alias("seq"), (F.col("l_quantity") > 10).alias("valid_shape"), F.floor(F.col("l_extendedprice") / 800).cast("int").alias("score"), F.col("l_quantity").cast("int").alias("cells"), F.col("l_quantity").cast("int").alias("n_rows"), F.col("l_linenumber").cast("int").alias("n_cols"))
    return li.distinct()


def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    return grid.largest_valid(_candidates(spark, d), ["l_orderkey"]).select("l_orderkey", "seq", "n_candidates")


def ordered_accept(spark: SparkSession, d: str) -> DataFrame:
    return grid.accept_in_order(_candidates(spark, d), ["l_orderkey"]).select("l_orderkey", "decision", "seq")


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity").alias("seq"))
    return match.dedupe_first(li, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity").alias("seq"))
    return match.dedupe_last(li, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("bigint").alias("year"))
    return grid.occurrences(o, ["o_custkey", "year"], ["o_orderkey"]).withColumn("occurrence", F.col("occurrence").cast("bigint"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filing_records").dropDuplicates(["rec_id"]).select("doc_id", "page", F.col("rec_id").alias("seq"), F.col("block_type").alias("type"), F.coalesce("detector_score", F.lit(0.3)).alias("score"), "bbox")


PAGE = ["doc_id", "page"]


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).withColumn("width", F.lit(500.0))
    return layout.reading_order(b, PAGE).select(F.col("seq").alias("rec_id"), F.col("position").cast("bigint").alias("position"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select(*PAGE, F.col("seq").alias("word"), (F.col("bbox.x0") + 5).alias("x"), (F.col("bbox.top") + 30).alias("y"), (F.col("bbox.x0") - 30).alias("x0"), (F.col("bbox.x0") - 20).alias("x1"))


def point_in_box(spark: SparkSession, d: str) -> DataFrame:
    return layout.assign_points(_points(spark, d), _boxes(spark, d), PAGE, ["word"]).select("word", "seq")


def snap_to_box(spark: SparkSession, d: str) -> DataFrame:
    return layout.snap_points(_points(spark, d), _boxes(spark, d), PAGE, ["word"], 40.0).select("word", "seq", "gap")


def overlap_argmax(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    return layout.best_overlap(b.filter("type <> 'Table'"), b.filter("type = 'Table'"), PAGE, 0.05).select("seq", "right_seq", "ratio")


def overlap_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    return layout.one_to_one(layout.best_overlap(b.filter("type <> 'Table'"), b.filter("type = 'Table'"), PAGE, 0.05), PAGE).select("seq", "right_seq")


def inside_tables(spark: SparkSession, d: str) -> DataFrame:
    return layout.inside_tables(_boxes(spark, d), PAGE).select("seq", "inside")


def filter_boxes(spark: SparkSession, d: str) -> DataFrame:
    return layout.filter_boxes(_boxes(spark, d), PAGE, layout.LayoutRules(duplicate_cover=0.2, inside_table=0.3)).select("seq", "type", "score")


def image_coverage(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    pages = b.select(*PAGE, F.lit(400.0).alias("width"), F.lit(600.0).alias("height")).distinct()
    return layout.image_coverage(b.filter("type = 'Figure'").select(*PAGE, "bbox"), pages, PAGE)


def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    return layout.union_boxes(_boxes(spark, d), PAGE).select(*PAGE, "bbox.*")


def _words(spark: SparkSession, d: str) -> DataFrame:
    """The words of every text, set eight to a line below the corner of their block: page, x0, top, x1, bottom, text."""
    r = table(spark, d, "filing_records").filter("text is not null").dropDuplicates(["rec_id"])
    w = r.select(*PAGE, "bbox", F.posexplode(F.split("text", " ")).alias("n", "text")).filter("text <> ''")
    x, y = F.col("bbox.x0") + F.col("n") % 8 * 24, F.col("bbox.top") + F.floor(F.col("n") / 8) * 10
    return w.select(*PAGE, x.alias("x0"), y.cast("double").alias("top"), (x + 20).alias("x1"), (y + 8).cast("double").alias("bottom"), "text")


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.text_of_blocks(_words(spark, d), PAGE)


def fallback_blocks(spark: SparkSession, d: str) -> DataFrame:
    return layout.fallback_blocks(_words(spark, d), PAGE).select(*PAGE, F.col("seq").cast("bigint").alias("seq"), "bbox.*", "text")


def pixel_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in pixels of a 150 dpi image as points, clipped to the page."""
    b = geometry.clip(geometry.from_pixels(F.col("bbox"), F.lit(150.0)), F.lit(200.0), F.lit(300.0))
    return _boxes(spark, d).select("seq", b.alias("b")).select("seq", "b.*")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "tagged_facts")
    return f.select("doc_id", F.col("fact_id").alias("seq"), "concept", "fact_value", "decimals", F.coalesce("instant", F.lit(False)).alias("instant"), "start_date", "end_date", F.coalesce("dims_key", F.lit("{}")).alias("dims_key"))


PATHS = ("first", "second")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """The latest version of every table cell as cells of two extraction paths, one of which loses some."""
    c = match.dedupe_last(table(spark, d, "table_cells").select("cell_id", "doc_id", "rec_id", "page", "label", "occurrence", "part2", F.struct("loaded_at", "part2", "label").alias("seq")), ["cell_id"])
    year = table(spark, d, "filing_records").groupBy("doc_id").agg(F.max("fiscal_year").alias("year"))
    paths = F.when(F.col("cell_id") % 5 == 0, F.array(F.lit("second"))).otherwise(F.array(F.lit("first"), F.lit("second")))
    return c.join(year, "doc_id", "left").select("cell_id", "doc_id", F.explode(paths).alias("path"), "page", F.when(F.col("rec_id") % 2 == 0, "balance").otherwise("income").alias("statement"), "label", (F.col("occurrence") + 1).alias("occurrence"), "year", F.col("part2").alias("value"))


def _reconciled(spark: SparkSession, d: str, cutoff: float = 2.0) -> DataFrame:
    mapped = match.map_labels(_cells(spark, d), table(spark, d, "label_linkbase"), None, cutoff, texts=table(spark, d, "table_cells"))
    return match.reconcile(mapped, _facts(spark, d), ["cell_id", "path"])


def fiscal_year_ends(spark: SparkSession, d: str) -> DataFrame:
    return match.fiscal_year_ends(_facts(spark, d).distinct()).select("doc_id", F.col("year").cast("bigint").alias("year"), "fy_end")


def index_facts(spark: SparkSession, d: str) -> DataFrame:
    return match.index_facts(_facts(spark, d).distinct()).select("doc_id", "concept", "dims_key", "end_date", "instant", "fact_value")


def _concepts(m: DataFrame) -> DataFrame:
    return m.select("cell_id", "path", F.array_join(F.transform("concepts", lambda c: c["concept"]), "|").alias("concepts"), "map_method")


def map_labels(spark: SparkSession, d: str) -> DataFrame:
    return _concepts(match.map_labels(_cells(spark, d), table(spark, d, "label_linkbase"), None, 2.0, texts=table(spark, d, "table_cells")))


def map_labels_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return _concepts(match.map_labels(_cells(spark, d), table(spark, d, "label_linkbase"), None, 0.88, texts=table(spark, d, "table_cells")))


def map_labels_curated(spark: SparkSession, d: str) -> DataFrame:
    """With a curated map of the labels of even label_id, those divisible by four only for a first occurrence."""
    lab = table(spark, d, "label_linkbase")
    own = lab.filter("label_id % 2 = 0").groupBy(F.when(F.col("period_type") == "instant", "balance").otherwise("income").alias("statement"), text.label_normal(F.col("label")).alias("label")).agg(F.min("label_id").alias("i"), F.min("concept").alias("first"), F.max("concept").alias("last"))
    curated = own.select("statement", "label", F.when(F.col("i") % 4 == 0, 1).alias("occurrence"), F.array("last", "first").alias("concepts"), F.lit("{}").alias("dims_key"), F.lit(None).cast("boolean").alias("negate"))
    m = match.map_labels(_cells(spark, d), lab, curated, 2.0)
    return _concepts(m)


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: table cells against tagged facts."""
    return _reconciled(spark, d, 0.88)


def reconcile_exact(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).select("cell_id", "path", "concept", "period_end", "fact_value", "status")


def lost_lines(spark: SparkSession, d: str) -> DataFrame:
    lost = match.lost_lines(_reconciled(spark, d), PATHS, ["doc_id", "statement", "concept", "dims_key", "period_end"], "cell_id")
    return lost.select("doc_id", "statement", "concept", "period_end", "path", "cell_id")


def reconcile_summary(spark: SparkSession, d: str) -> DataFrame:
    """Over every cell that holds a number."""
    s = match.summarize(_reconciled(spark, d).filter("value is not null"))
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("status_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return s.select("path", "statement", "numbers", "mapped", "match", "match_rate", "match_rate_of_mapped", counts.alias("counts"))


def _copies(spark: SparkSession, d: str):
    a = match.dedupe_last(table(spark, d, "table_cells").select("cell_id", "part2", F.struct("loaded_at", "part2").alias("seq")), ["cell_id"])
    b = match.dedupe_last(table(spark, d, "table_cells_mirror").select("cell_id", "part2", F.struct("loaded_at", "part2").alias("seq")), ["cell_id"])
    return [x.select((F.col("cell_id") % 7).alias("g"), "cell_id", F.col("part2").alias("value")) for x in (a, b)]


def cell_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cell_scores(*_copies(spark, d), ["g", "cell_id"], ["g"])


def micro_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.micro_scores(cell_scores(spark, d).withColumn("h", F.col("g") % 2), ["h"])


def path_status(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.drop("g") for x in _copies(spark, d))
    return managed.compare_paths(a, b, ["cell_id"]).select("cell_id", "status")


def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    a, b = _copies(spark, d)
    s = managed.compare_paths(a, b, ["g", "cell_id"])
    names = ["match", "part2_only", "textract_only", "differ"]
    return s.groupBy("g").pivot("status", names).agg(F.count(F.lit(1))).na.fill(0)


def below_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Tables of a low status beside the tables of a service (here those of the page, moved), with the shape of ours."""
    r = table(spark, d, "filing_records").filter("block_type = 'Table'").dropDuplicates(["rec_id"])
    ours = r.select(*PAGE, F.col("rec_id").alias("seq"), "bbox", "tbl.status", "tbl.method", F.lit(None).cast("double").alias("score"))
    moved = ours.filter("seq % 3 > 0").select(*PAGE, "seq", geometry.box(F.col("bbox.x0") + 30, F.col("bbox.top") + 10, F.col("bbox.x1") + 30, F.col("bbox.bottom") + 10).alias("bbox"))
    low = managed.below_threshold(ours, moved, PAGE, ["below_threshold", "no_valid_table"])
    stats = pages.grid_stats(_grids(spark, d), ["rec_id"]).withColumnRenamed("rec_id", "seq")
    return low.join(stats, "seq", "left").select("seq", "method", "status", "overlap", "found_seq", "n_rows", "n_cols", "n_numeric", F.round("empty_share", 3).alias("empty_share"))


def page_averages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("stratum"), (F.col("n_chars") / 4096.0).alias("wer"), (F.col("n_chars") / 8192.0).alias("cer"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 8 / 8.0).alias("numeric_recall"))
    a = metrics.page_averages(p)
    return a.select("source", "stratum", "pages", *[F.round(c, 8).alias(c) for c in ("wer", "cer", "numeric_recall")])


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """The thresholds over synthetic pages and the cell scores of the two copies."""
    p = table(spark, d, "documents").select(F.when(F.col("lang") == "en", "statement").otherwise("scanned").alias("stratum"), (F.col("n_chars") / 65536.0).alias("wer"), F.when(F.col("doc_id") % 3 == 0, 1 - F.col("doc_id") % 8 / 64.0).alias("numeric_recall"))
    return metrics.quality_gate(p, cell_scores(spark, d))


def _timings(spark: SparkSession, d: str) -> DataFrame:
    phase = F.when(F.col("event_id") % 10 == 0, "model_load").when(F.col("event_id") % 10 == 1, "cold").otherwise("warm")
    return table(spark, d, "events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 3).alias("run"), phase.alias("phase"), F.col("value").alias("seconds"), (F.col("event_id") % 977).cast("int").alias("rss_mb"), F.when(F.col("event_id") % 50 == 7, "error").otherwise("ok").alias("status"), F.col("event_id").alias("seq"))


def stage_summary(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.stage_summary(_timings(spark, d), ["click", "view"], {"purchase": 61})
    return s.withColumn("mean", F.round("mean", 6))


def cold_start(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cold_start(_timings(spark, d))


def drift(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.size(F.split("text", " ")).cast("bigint").alias("length"))
    return metrics.drift(b, ["lang"], "length", 30)


def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.size(F.split("text", " ")).alias("length"))
    return metrics.histogram(b, ["lang"], "length")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = ingest.tumbling_counts(table(spark, d, "events"), "ts", "event_type")
    return w.withColumn("total", F.round("total", 4))


def embedded_documents(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("K: a\nK: b\nLONG KEY:\tc d\n<DOCUMENT>\n<TYPE>10-K\n<FILENAME>main"), F.col("doc_id").cast("string"), F.lit(".htm\n<TEXT>\n<XBRL>\n"), F.regexp_replace("text", "<", ""), F.lit("\n</XBRL>\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<FILENAME>logo.jpg\n<TEXT>x</TEXT>\n</DOCUMENT>\n"))
    raw = table(spark, d, "documents").select("doc_id", body.alias("submission"))
    docs = io.embedded_documents(raw)
    heads = raw.select("doc_id", io.header_map(F.col("submission")).alias("h")).select("doc_id", F.try_element_at("h", F.lit("K")).alias("k"), F.try_element_at("h", F.lit("LONG-KEY")).alias("long_key"))
    return docs.join(heads, "doc_id").select("doc_id", "filename", F.char_length("body").cast("bigint").alias("n_body"), "k", "long_key")


def primary_document(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "R").otherwise("doc"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 0, ".xml").otherwise(".htm"))
    f = table(spark, d, "part").select("p_brand", name.alias("filename"), (F.col("p_partkey") * 7919 % 100_003).alias("size"))
    return io.primary_document(f, ["p_brand"], ["doc7.htm"]).select("p_brand", "filename")


def statement_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "filing_records").filter("text is not null").select("rec_id", "text").distinct()
    titles = {"cash_flows": ["AS OF YEAR END"], "income": ["AUDITED", "YEARS ENDED"]}
    return pages.statement_pages(p, titles, 2, 12).select("rec_id", "statement", "n_numeric")


def ruling_lines(spark: SparkSession, d: str) -> DataFrame:
    m = _boxes(spark, d).select(*PAGE, F.when(F.col("seq") % 2 == 0, "line").otherwise("rect").alias("kind"), F.struct("bbox.x0", "bbox.top", "bbox.x1", (F.col("bbox.top") + F.col("seq") % 5 * 0.7).alias("bottom")).alias("bbox"))
    return pages.ruling_lines(m, PAGE, 250.0)


def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    w = _boxes(spark, d).select(*PAGE, "seq", (F.col("seq") % 3).alias("block"), (F.col("seq") % 2).alias("par"), F.lit(1).alias("line"), F.concat(F.lit("w"), F.col("seq").cast("string")).alias("text"), (F.col("seq") % 8 - 1).cast("double").alias("conf"))
    return pages.ocr_text(w, PAGE)


def numbered_tables(spark: SparkSession, d: str) -> DataFrame:
    return pages.numbered_tables(_boxes(spark, d).filter("type = 'Table'").select(*PAGE, "seq"), PAGE)


def region_tables(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    return pages.regions_hit(b.filter("type <> 'Table'"), b.filter("type = 'Table'"), PAGE, 0.3).select("region_seq", "seq", "inside")


def stems(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select("accession", pages.stem(F.col("ticker"), F.col("form"), F.col("report_period")).alias("stem"))
    n = pages.parsed_name(F.concat("stem", F.lit("_p0012_cash_flows.csv")))
    return m.distinct().withColumn("n", n).select("accession", "stem", F.col("n.stem").alias("again"), "n.page", "n.statement")


def block_ids(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "filing_records").select("rec_id", "block_id", pages.block_id(F.col("page"), F.col("block_order")).alias("made"), pages.block_address(F.col("block_id")).alias("address"))
    return r.distinct()


def type_totals(spark: SparkSession, d: str) -> DataFrame:
    from facetmill.operators.records import BLOCK_TYPES

    return pages.type_totals(_boxes(spark, d), "doc_id", "type", BLOCK_TYPES)


def grid_stats(spark: SparkSession, d: str) -> DataFrame:
    return pages.grid_stats(_grids(spark, d), ["rec_id"])


def yearly_cost(spark: SparkSession, d: str) -> DataFrame:
    from facetmill.functions import numbers

    s = metrics.stage_summary(_timings(spark, d))
    return s.select("stage", F.round(numbers.yearly_cost(F.col("p50"), 0.1, 300_000), 6).alias("p50_cost"), F.round(numbers.yearly_cost(F.col("p95"), 0.1, 300_000), 6).alias("p95_cost"))


QUERIES = (
    statement_pages, ruling_lines, ocr_lines, numbered_tables, region_tables, stems, block_ids, type_totals, grid_stats, yearly_cost, clean_grid, classify_rows, shape_metrics, normalize_grid, column_years, column_names, merged_labels, grid_cells, dense_grid, number_positions,
    best_candidate, ordered_accept, dedupe_first, dedupe_last, occurrences, reading_order, point_in_box, snap_to_box, overlap_argmax, overlap_one_to_one, inside_tables, filter_boxes, image_coverage, page_boxes, pixel_boxes, page_lines, fallback_blocks,
    fiscal_year_ends, index_facts, map_labels, map_labels_fuzzy, map_labels_curated, reconcile, reconcile_exact, lost_lines, reconcile_summary, below_threshold, cell_scores, micro_scores, path_status, status_pivot, page_averages, quality_gate, stage_summary, cold_start, drift, length_histogram, event_windows, embedded_documents, primary_document,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


GRID = """grids AS (SELECT DISTINCT rec_id, r, CAST(c AS INTEGER) AS c, coalesce(raw[r + 1][c + 1], '') AS cell FROM (SELECT rec_id, raw, CAST(r AS INTEGER) AS r, unnest(range(w)) AS c FROM
  (SELECT rec_id, raw, list_max(list_transform(raw, lambda x: len(x))) AS w, unnest(range(len(raw))) AS r FROM (SELECT DISTINCT rec_id, tbl.raw_cells AS raw FROM filing_records WHERE tbl.raw_cells IS NOT NULL))))"""
NUM = r"""numbered AS (SELECT *, translate(regexp_replace(regexp_replace(strip(cell), '([0-9)])\s*\([0-9]\)$', '\1'), '\s*(\([a-z]\)|\*+|\[[0-9]+\])$', ''), '$, ', '') AS s FROM grids),
 stripped AS (SELECT *, regexp_replace(s, '^[()]+|[()]+$', '', 'g') AS u FROM numbered),
 valued AS (SELECT *, CASE WHEN s IN ('-', '–', '—', '−') THEN 0.0 WHEN regexp_full_match(regexp_replace(regexp_replace(u, '^[-–—−]', ''), '%+$', ''), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN
   CASE WHEN starts_with(s, '(') OR regexp_matches(u, '^[-–—−]') THEN -1 ELSE 1 END * CAST(regexp_replace(regexp_replace(u, '^[-–—−]', ''), '%+$', '') AS DOUBLE) END AS v FROM stripped)"""
KINDS = rf"""{GRID}, {NUM}, rows AS (SELECT rec_id, r, lower(max(cell) FILTER (c = 0)) AS label, count(*) FILTER (c > 0 AND v IS NOT NULL) AS n, count(*) FILTER (c > 0 AND v IS NOT NULL AND NOT regexp_matches(strip(cell), '^(19|20)\d{{2}}$')) AS ny FROM valued GROUP BY ALL),
 own AS (SELECT *, CASE WHEN regexp_matches(label, '{grid.TableRules.shares_pattern}') THEN 'shares' WHEN regexp_matches(label, '{grid.TableRules.per_share_pattern}') THEN 'per_share' END AS o FROM rows),
 sec AS (SELECT *, coalesce(last_value(CASE WHEN n = 0 THEN coalesce(o, CASE WHEN label <> '' THEN 'money' END) END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY r), 'money') AS section FROM own),
 kinds AS (SELECT rec_id, r, CASE WHEN n = 0 OR (ny = 0 AND strip(label) = '') THEN 'header' ELSE coalesce(o, section) END AS row_kind FROM sec)"""
CLEAN = r"""t AS (SELECT rec_id, r, c, strip(replace(cell, chr(10), ' ')) AS cell FROM grids), k AS (SELECT rec_id, c, bool_or(regexp_matches(cell, '\d')) AS d FROM t GROUP BY ALL HAVING NOT bool_and(cell IN ('', '$'))),
 k2 AS (SELECT rec_id, c, row_number() OVER (PARTITION BY rec_id ORDER BY c) - 1 AS nc FROM (SELECT *, min(c) OVER (PARTITION BY rec_id) = c AS f FROM k) WHERE f OR d), x AS (SELECT t.rec_id, r, nc, cell FROM t JOIN k2 ON t.rec_id = k2.rec_id AND t.c = k2.c),
 q AS (SELECT rec_id, r, row_number() OVER (PARTITION BY rec_id ORDER BY r) - 1 AS nr FROM (SELECT DISTINCT rec_id, r FROM x WHERE cell <> '')), clean AS (SELECT x.rec_id, CAST(nr AS INTEGER) AS r, CAST(nc AS INTEGER) AS c, cell FROM x JOIN q ON x.rec_id = q.rec_id AND x.r = q.r)"""
LINES = """WITH RECURSIVE v AS (SELECT doc_id, page, bbox, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS n FROM (SELECT * FROM filing_records WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at) = 1)),
 u AS (SELECT doc_id, page, bbox.x0 + n % 8 * 24 AS x0, bbox.top + n // 8 * 10 AS top, text FROM v WHERE text <> ''), w AS (SELECT *, x0 + 20 AS x1, top + 8 AS bottom, row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(top, 0), x0, top, x0 + 20, top + 8, text) AS n FROM u),
 f AS (SELECT doc_id, page, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(top DOUBLE, x1 DOUBLE)[]) AS ends, CAST(0 AS BIGINT) AS line FROM w WHERE n = 1
   UNION ALL SELECT doc_id, page, n, CASE WHEN pos IS NULL THEN list_append(ends, {'top': top, 'x1': x1}) ELSE list_transform(ends, lambda x, i: CASE WHEN i = pos THEN {'top': top, 'x1': x1} ELSE x END) END, coalesce(pos, len(ends) + 1) FROM (
     SELECT w.doc_id, w.page, w.n, f.ends, w.top, w.x1, nullif(list_position(list_transform(f.ends, lambda x: abs(x.top - w.top) <= 3 AND w.x0 - x.x1 BETWEEN 0 AND 20), true), 0) AS pos FROM f JOIN w ON w.doc_id = f.doc_id AND w.page = f.page AND w.n = f.n + 1)),
 lines AS (SELECT doc_id, page, line, arg_min(top, n) AS top, arg_min(x0, n) AS x0, min(top) AS lowest, min(x0) AS left, max(x1) AS right, max(bottom) AS bottom, string_agg(text, ' ' ORDER BY n) AS text FROM f JOIN w USING (doc_id, page, n) GROUP BY ALL)
"""
BOXES = "boxes AS (SELECT doc_id, page, rec_id AS seq, block_type AS type, coalesce(detector_score, 0.3) AS score, bbox.x0 AS x0, bbox.top AS t, bbox.x1 AS x1, bbox.bottom AS b FROM filing_records QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at) = 1)"
INTER = "greatest(least(a.x1, k.x1) - greatest(a.x0, k.x0), 0) * greatest(least(a.b, k.b) - greatest(a.t, k.t), 0)"
POINTS = "points AS (SELECT doc_id, page, seq AS word, x0 + 5 AS x, t + 30 AS y, x0 - 30 AS p0, x0 - 20 AS p1 FROM boxes)"
FACTS = "facts AS (SELECT doc_id, fact_id AS seq, concept, fact_value, decimals, coalesce(instant, false) AS instant, start_date, end_date, coalesce(dims_key, '{}') AS dims_key FROM tagged_facts QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY loaded_at) = 1)"
ENDS = "ends AS (SELECT doc_id, year(end_date) AS year, end_date AS fy_end FROM (SELECT doc_id, end_date, count(*) AS n, min(seq) AS first FROM facts WHERE NOT instant AND dims_key = '{}' AND datediff('day', start_date, end_date) BETWEEN 350 AND 380 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, year(end_date) ORDER BY n DESC, first) = 1)"
INDEX = "idx AS (SELECT doc_id, concept, dims_key, end_date, instant, fact_value, decimals FROM facts WHERE instant OR datediff('day', start_date, end_date) BETWEEN 350 AND 380 QUALIFY row_number() OVER (PARTITION BY doc_id, concept, dims_key, end_date, instant ORDER BY seq DESC) = 1)"
CELLS = rf"""cells AS (SELECT c.cell_id, c.doc_id, unnest(CASE WHEN c.cell_id % 5 = 0 THEN ['second'] ELSE ['first', 'second'] END) AS path, CASE WHEN c.rec_id % 2 = 0 THEN 'balance' ELSE 'income' END AS statement, c.label, c.occurrence + 1 AS occurrence, y.year, c.part2 AS value, n.lab
  FROM (SELECT * FROM table_cells QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC NULLS LAST, part2 DESC NULLS LAST, label DESC NULLS LAST) = 1) c LEFT JOIN (SELECT doc_id, max(fiscal_year) AS year FROM filing_records GROUP BY doc_id) y USING (doc_id)
  LEFT JOIN (SELECT label, {sql.label_normal("label")} AS lab FROM (SELECT DISTINCT label FROM table_cells WHERE label IS NOT NULL)) n ON n.label = c.label),
 hits AS (SELECT {sql.label_normal("label")} AS lab, concept, max(period_type) AS pt, bool_or(contains(lower(label_role), 'negated')) AS neg FROM label_linkbase GROUP BY ALL),
 cand AS (SELECT c.*, h.concept, h.pt, h.neg, count(h.concept) OVER w AS k, count(*) FILTER (h.pt = CASE WHEN c.statement = 'balance' THEN 'instant' ELSE 'duration' END) OVER w AS fit FROM cells c LEFT JOIN hits h ON h.lab = c.lab AND h.lab <> '' WINDOW w AS (PARTITION BY c.cell_id, c.path)),
 picked AS (SELECT *, count(concept) OVER (PARTITION BY cell_id, path) AS np FROM cand WHERE fit = 0 OR pt = CASE WHEN statement = 'balance' THEN 'instant' ELSE 'duration' END),
 mapping AS (SELECT cell_id, path, any_value(statement) AS statement, any_value(lab) AS lab, any_value(occurrence) AS occurrence, CASE WHEN count(concept) = 0 THEN NULL WHEN count(concept) = 1 THEN max(concept) ELSE '' END AS concepts, CASE WHEN count(concept) = 0 THEN 'none' WHEN count(concept) = 1 THEN 'linkbase' ELSE concat('ambiguous:', string_agg(concept, '|' ORDER BY concept)) END AS map_method FROM picked GROUP BY cell_id, path)"""
TOL = "coalesce(0.5 * pow(10, -TRY_CAST(decimals AS INT)), 1e-9)"
RECON = (
    f"WITH {FACTS}, {ENDS}, {INDEX}, {CELLS}"
    + f""", probe AS (SELECT p.*, CASE WHEN np = 1 THEN coalesce(e.fy_end, CASE WHEN pt = 'instant' AND contains(lower(label), 'beginning') THEN (SELECT max(f.end_date) FROM facts f WHERE f.doc_id = p.doc_id AND f.concept = p.concept AND f.instant AND year(f.end_date) = p.year - 1) END) END AS pe
   FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, path ORDER BY concept) AS rn FROM picked) p LEFT JOIN ends e ON e.doc_id = p.doc_id AND e.year = p.year - CASE WHEN pt = 'instant' AND contains(lower(label), 'beginning') THEN 1 ELSE 0 END WHERE rn = 1),
 found AS (SELECT p.*, i.fact_value, i.decimals, {TOL} AS tol FROM probe p LEFT JOIN idx i ON np = 1 AND i.doc_id = p.doc_id AND i.concept = p.concept AND i.dims_key = '{{}}' AND i.end_date = p.pe AND i.instant = (p.pt = 'instant')),
 recon AS (SELECT cell_id, doc_id, path, statement, value, CASE WHEN np = 1 THEN concept END AS concept, pe AS period_end, fact_value, CASE WHEN np <> 1 THEN 'unmapped' WHEN fact_value IS NULL THEN 'xbrl_missing' WHEN value IS NULL THEN 'value_missing' WHEN abs(value - fact_value) <= tol THEN 'match' WHEN abs(value + fact_value) <= tol THEN CASE WHEN neg THEN 'match_negated' ELSE 'sign' END
   {" ".join(f"WHEN fact_value <> 0 AND abs(value - fact_value * {k!r}) <= greatest(tol * {k!r}, tol) THEN '{n}'" for k, n in ((1e3, "scale_x1000"), (1e6, "scale_x1e+06"), (1e9, "scale_x1e+09"), (1e-3, "scale_x0.001"), (1e-6, "scale_x1e-06"), (1e-9, "scale_x1e-09")))} ELSE 'mismatch' END AS status FROM found)
"""
)
COPIES = "a AS (SELECT cell_id % 7 AS g, cell_id, part2 AS value, true AS here FROM (SELECT * FROM table_cells QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC NULLS LAST, part2 DESC NULLS LAST) = 1)), b AS (SELECT cell_id % 7 AS g, cell_id, part2 AS value, true AS here FROM (SELECT * FROM table_cells_mirror QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC NULLS LAST, part2 DESC NULLS LAST) = 1))"
SCORES = f"{COPIES}, s AS (SELECT coalesce(a.g, b.g) AS g, count(*) FILTER (abs(a.value - b.value) < 1e-9) AS tp, count(a.here) AS cells_gt, count(b.here) AS cells_pred FROM a FULL JOIN b USING (cell_id) GROUP BY ALL)"
RATIOS = "coalesce(tp / nullif(cells_pred, 0), 0) AS precision, coalesce(tp / nullif(cells_gt, 0), 0) AS recall, coalesce(2 * (tp / nullif(cells_pred, 0)) * (tp / nullif(cells_gt, 0)) / nullif(tp / nullif(cells_pred, 0) + tp / nullif(cells_gt, 0), 0), 0) AS f1"
STATUS = f"{COPIES}, s AS (SELECT coalesce(a.g, b.g) AS g, cell_id, CASE WHEN a.value IS NULL AND b.value IS NULL THEN 'match' WHEN b.value IS NULL THEN 'part2_only' WHEN a.value IS NULL THEN 'textract_only' WHEN a.value = b.value THEN 'match' ELSE 'differ' END AS status FROM a FULL JOIN b USING (cell_id))"
TIMES = "t AS (SELECT event_type AS stage, user_id % 3 AS run, CASE event_id % 10 WHEN 0 THEN 'model_load' WHEN 1 THEN 'cold' ELSE 'warm' END AS phase, value AS seconds, CAST(event_id % 977 AS INTEGER) AS rss_mb, CASE WHEN event_id % 50 = 7 THEN 'error' ELSE 'ok' END AS status, event_id AS seq FROM events)"
CANDIDATES = "cand AS (SELECT DISTINCT l_orderkey, l_suppkey % 3 AS rank, CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(trunc(l_extendedprice * 100) AS BIGINT) AS seq, l_quantity > 10 AS valid, CAST(floor(l_extendedprice / 800) AS INT) AS score, CAST(l_quantity AS INT) AS cells, l_linenumber AS nc FROM lineitem)"
BINS = "CASE " + " ".join(f"WHEN n >= {lo} AND n {'<=' if hi == 2000 else '<'} {hi} THEN {lo}" for lo, hi in zip(metrics.EDGES, metrics.EDGES[1:], strict=False)) + " END"


def oracle_sql() -> dict[str, str]:
    checks = {
        "statement_pages": f"""WITH p AS (SELECT DISTINCT rec_id, list_transform(string_split(text, chr(10))[1:2], lambda x: upper(strip(x))) AS l, len(regexp_extract_all(text, '{text.NUM_TOKEN}')) AS n FROM filing_records WHERE text IS NOT NULL), h AS (SELECT *, lambda_hits(l) AS s FROM p)
          SELECT rec_id, s AS statement, CAST(n AS BIGINT) AS n_numeric FROM h WHERE n >= 12 AND s IS NOT NULL""".replace("lambda_hits(l)", "CASE " + " ".join(f"WHEN len(list_filter(l, lambda x: starts_with(x, '{t}') AND length(x) - {len(t)} <= 15)) > 0 THEN '{n}'" for n, t in (("cash_flows", "AS OF YEAR END"), ("income", "AUDITED"), ("income", "YEARS ENDED"))) + " END"),
        "ruling_lines": f"WITH {BOXES} SELECT doc_id, page, count(*) FILTER (CASE WHEN seq % 2 = 0 THEN abs(t + seq % 5 * 0.7 - t) < 1 ELSE abs(t + seq % 5 * 0.7 - t) <= 2 END AND x1 - x0 >= 250) AS ruling_lines FROM boxes GROUP BY ALL",
        "ocr_lines": f"WITH {BOXES}, l AS (SELECT doc_id, page, min(seq) AS f, string_agg(concat('w', seq), ' ' ORDER BY seq) AS t, sum(seq % 8 - 1) AS s, count(*) AS n FROM boxes WHERE seq % 8 - 1 >= 0 GROUP BY doc_id, page, seq % 3, seq % 2) SELECT doc_id, page, string_agg(t, chr(10) ORDER BY f) AS text, round(sum(s) / sum(n), 1) AS mean_conf FROM l GROUP BY ALL",
        "numbered_tables": f"WITH {BOXES} SELECT doc_id, page, seq, lpad(CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) - 1 AS VARCHAR), 2, '0') AS table_no FROM boxes WHERE type = 'Table'",
        "region_tables": f"WITH {BOXES}, o AS (SELECT k.seq AS region_seq, a.seq, coalesce({INTER} / nullif((a.x1 - a.x0) * (a.b - a.t), 0), 0) AS inside FROM boxes a JOIN boxes k USING (doc_id, page) WHERE a.type <> 'Table' AND k.type = 'Table') SELECT * FROM o WHERE inside >= 0.3",
        "stems": "SELECT DISTINCT accession, s AS stem, s AS again, 12 AS page, 'cash_flows' AS statement FROM (SELECT accession, concat_ws('_', ticker, replace(form, '-', ''), strftime(report_period, '%Y%m%d')) AS s FROM manifest)",
        "block_ids": "SELECT DISTINCT rec_id, block_id, printf('p%04d_b%03d', page, block_order) AS made, concat('page ', CAST(regexp_extract(block_id, '^p(\\d+)', 1) AS INT), ', block ', CAST(regexp_extract(block_id, '_b(\\d+)$', 1) AS INT)) AS address FROM filing_records",
        "type_totals": f"WITH {BOXES} SELECT coalesce(doc_id, 'ALL') AS doc_id, coalesce(type, 'ALL') AS type, count(*) AS n, CAST(list_position(['Text', 'Title', 'List', 'Table', 'Figure', 'Footnote', 'ALL'], coalesce(type, 'ALL')) AS BIGINT) AS position FROM boxes GROUP BY ROLLUP (doc_id, type)",
        "grid_stats": f"WITH {GRID} SELECT rec_id, max(r) + 1 AS n_rows, max(c) + 1 AS n_cols, count(*) FILTER (regexp_full_match(strip(cell), '{text.NUM_SIGNED}')) AS n_numeric, count(*) FILTER (strip(cell) = '') / count(*) AS empty_share FROM grids GROUP BY rec_id",
        "yearly_cost": f"WITH {TIMES} SELECT stage, round(quantile_cont(seconds, 0.5) FILTER (status = 'ok') * 300000 / 3600 * 0.1, 6) AS p50_cost, round(quantile_cont(seconds, 0.95) FILTER (status = 'ok') * 300000 / 3600 * 0.1, 6) AS p95_cost FROM t GROUP BY stage",
        "clean_grid": f"WITH {GRID}, {CLEAN} SELECT * FROM clean",
        "classify_rows": f"WITH {KINDS} SELECT rec_id, r, row_kind FROM kinds",
        "shape_metrics": f"""WITH {GRID}, {NUM}, m AS (SELECT rec_id, max(r) + 1 AS n_rows, max(c) + 1 AS n_cols, count(*) FILTER (cell = '') * 100.0 / count(*) AS whitespace, count(*) FILTER (c > 0 AND v IS NOT NULL) / 40.0 AS coverage,
          coalesce(count(*) FILTER (c = 0 AND strip(cell) <> '' AND regexp_matches(cell, '\\d[\\d,]*\\)?$')) / nullif(count(*) FILTER (c = 0 AND strip(cell) <> ''), 0), 1.0) AS label_merge FROM valued GROUP BY rec_id)
          SELECT *, n_rows >= 5 AND n_cols >= 3 AND coverage >= 0.5 AND label_merge <= 0.5 AS valid_shape FROM m""",
        "normalize_grid": f"WITH {KINDS} SELECT rec_id, r, c, row_kind, CAST(CASE WHEN regexp_matches(u, '%$') AND s NOT IN ('-', '–', '—', '−') THEN v WHEN row_kind = 'money' THEN v * 1e6 WHEN row_kind = 'shares' THEN v * 1e3 ELSE v END AS DOUBLE) AS num FROM valued JOIN kinds USING (rec_id, r) WHERE c > 0 AND row_kind <> 'header' AND v IS NOT NULL",
        "column_years": f"WITH {GRID}, y AS (SELECT rec_id, c, r, CAST(list_extract(regexp_extract_all(cell, '\\b(?:19|20)\\d{{2}}\\b'), -1) AS BIGINT) AS year FROM grids WHERE c > 0 AND r < 6) SELECT rec_id, c, arg_max(year, r) AS year FROM y WHERE year IS NOT NULL GROUP BY ALL",
        "column_names": f"""WITH {KINDS}, l AS (SELECT g.rec_id, g.r, bool_and(row_kind = 'header' AND (c > 0 OR cell = '')) AS lead FROM grids g JOIN kinds USING (rec_id, r) GROUP BY ALL), top AS (SELECT rec_id, r, bool_and(lead) OVER (PARTITION BY rec_id ORDER BY r) AS top FROM l),
          n AS (SELECT g.rec_id, c, string_agg(cell, ' ' ORDER BY g.r) FILTER (top AND cell <> '') AS name FROM grids g JOIN top USING (rec_id, r) GROUP BY ALL) SELECT rec_id, c, coalesce(name, CASE WHEN c = 0 THEN 'label' ELSE concat('col', c) END) AS name FROM n""",
        "dense_grid": "WITH l AS (SELECT rec_id, unnest(tbl.raw_cells) AS x, generate_subscripts(tbl.raw_cells, 1) AS row FROM filing_records), e AS (SELECT rec_id, row, unnest(x) AS cell, generate_subscripts(x, 1) AS col FROM l), s AS (SELECT rec_id, row, col, max(cell) AS cell FROM e GROUP BY ALL), z AS (SELECT rec_id, max(row) AS h, max(col) AS w FROM s GROUP BY rec_id), p AS (SELECT rec_id, row, unnest(range(1, w + 1)) AS col FROM (SELECT rec_id, w, unnest(range(1, h + 1)) AS row FROM z)) SELECT p.rec_id, CAST(p.row - 1 AS INTEGER) AS r, CAST(p.col - 1 AS INTEGER) AS c, coalesce(cell, '') AS cell FROM p LEFT JOIN s ON s.rec_id = p.rec_id AND s.row = p.row AND s.col = p.col",
        "number_positions": f"WITH {GRID}, {NUM} SELECT rec_id, r, c, row_number() OVER (PARTITION BY rec_id, r ORDER BY c) AS position FROM valued WHERE c > 0 AND v IS NOT NULL",
        "merged_labels": rf"""WITH RECURSIVE {GRID}, {CLEAN}, w AS (SELECT rec_id, r, list(cell ORDER BY c) AS row FROM clean GROUP BY ALL), f AS (SELECT rec_id, r AS pos, CAST(0 AS BIGINT) AS n, row FROM w WHERE r = 0
          UNION ALL SELECT rec_id, pos, n + CASE WHEN joins THEN 0 ELSE 1 END, CASE WHEN joins THEN list_prepend(concat_ws(' ', rtrim(old[1], '{text.WHITE}'), strip(new[1])), new[2:]) ELSE new END FROM (
            SELECT w.rec_id, w.r AS pos, f.n, f.row AS old, w.row AS new, len(w.row) > 1 AND f.row[1] <> '' AND len(list_filter(f.row[2:], lambda x: x <> '')) = 0 AND regexp_matches(rtrim(f.row[1], '{text.WHITE}'), '[;,]$') AND w.row[1] <> '' AND (regexp_matches(w.row[1][1], '\d') OR (lower(w.row[1][1]) = w.row[1][1] AND upper(w.row[1][1]) <> w.row[1][1])) AS joins
            FROM f JOIN w ON w.rec_id = f.rec_id AND w.r = f.pos + 1)),
          e AS (SELECT rec_id, n, row FROM f QUALIFY row_number() OVER (PARTITION BY rec_id, n ORDER BY pos DESC) = 1) SELECT rec_id, CAST(n AS INTEGER) AS r, unnest(row) AS cell, CAST(generate_subscripts(row, 1) - 1 AS INTEGER) AS c FROM e""".replace("\\\\", "\\"),
        "grid_cells": rf"""WITH {KINDS}, y AS (SELECT rec_id, c, arg_max(year, r) AS year FROM (SELECT rec_id, c, r, CAST(list_extract(regexp_extract_all(cell, '\b(?:19|20)\d{{2}}\b'), -1) AS INTEGER) AS year FROM grids JOIN kinds USING (rec_id, r) WHERE c > 0 AND row_kind = 'header') WHERE year IS NOT NULL GROUP BY ALL),
          l AS (SELECT rec_id, r, strip(cell) AS label, row_number() OVER (PARTITION BY rec_id, {sql.label_normal("strip(cell)")} ORDER BY r) AS occurrence FROM grids JOIN kinds USING (rec_id, r) WHERE row_kind <> 'header' AND c = 0 AND strip(cell) <> '')
          SELECT rec_id, r, c, label, CAST(occurrence AS INTEGER) AS occurrence, year, CAST(CASE WHEN regexp_matches(u, '%$') AND s NOT IN ('-', '–', '—', '−') THEN v WHEN row_kind IN ('money', 'shares') THEN v * 1e6 ELSE v END AS DOUBLE) AS value FROM valued JOIN kinds USING (rec_id, r) JOIN y USING (rec_id, c) JOIN l USING (rec_id, r) WHERE c > 0 AND row_kind <> 'header' AND v IS NOT NULL""",
        "best_candidate": f"WITH {CANDIDATES} SELECT l_orderkey, arg_max(seq, (valid, cells * nc, -seq)) AS seq, count(*) AS n_candidates FROM cand GROUP BY l_orderkey",
        "ordered_accept": f"""WITH {CANDIDATES}, p AS (SELECT *, valid AND score >= 80 AS ok, min(rank) FILTER (valid AND score >= 80) OVER (PARTITION BY l_orderkey) AS fr FROM cand)
          SELECT l_orderkey, CASE WHEN bool_or(ok) THEN 'accepted' WHEN bool_or(valid) THEN 'best_below_threshold' ELSE 'no_valid_table' END AS decision, CASE WHEN bool_or(ok) THEN arg_max(seq, (cells, score, -seq)) FILTER (ok AND rank = fr) WHEN bool_or(valid) THEN arg_max(seq, (score, cells, -rank, -seq)) FILTER (valid) END AS seq FROM p GROUP BY l_orderkey""",
        "dedupe_first": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) = 1",
        "dedupe_last": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1",
        "occurrences": "SELECT o_orderkey, o_custkey, year(o_orderdate) AS year, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS occurrence FROM orders",
        "reading_order": f"""WITH {BOXES}, f AS (SELECT *, x1 - x0 >= 0.6 * 500 AS wide FROM boxes), n AS (SELECT *, coalesce(count(*) FILTER (wide) OVER (PARTITION BY doc_id, page ORDER BY t, x0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS band FROM f),
          m AS (SELECT *, max(b) OVER (PARTITION BY doc_id, page, band, wide ORDER BY t, x0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, band, wide ORDER BY t, x0, seq) AS grp, CASE WHEN wide OR (x0 + x1) / 2 < 250 THEN 0 ELSE 1 END AS side FROM m)
          SELECT seq AS rec_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, wide, grp, side, t, x0, seq) AS position FROM i""",
        "point_in_box": f"WITH {BOXES}, {POINTS} SELECT word, arg_min(seq, ((x1 - x0) * (b - t), seq)) AS seq FROM points p JOIN boxes k USING (doc_id, page) WHERE x BETWEEN x0 AND x1 AND y BETWEEN t AND b GROUP BY word",
        "snap_to_box": f"WITH {BOXES}, {POINTS}, g AS (SELECT word, seq, greatest(k.x0 - p1, p0 - k.x1, 0.0) AS gap FROM points p JOIN boxes k USING (doc_id, page) WHERE y BETWEEN t AND b) SELECT word, arg_min(seq, (gap, seq)) AS seq, min(gap) AS gap FROM g WHERE gap <= 40 GROUP BY word",
        "overlap_argmax": f"WITH {BOXES}, o AS (SELECT a.seq, k.seq AS rs, coalesce({INTER} / nullif(least((a.x1 - a.x0) * (a.b - a.t), (k.x1 - k.x0) * (k.b - k.t)), 0), 0) AS ratio FROM boxes a JOIN boxes k USING (doc_id, page) WHERE a.type <> 'Table' AND k.type = 'Table') SELECT seq, arg_max(rs, (ratio, -rs)) AS right_seq, max(ratio) AS ratio FROM o WHERE ratio > 0.05 GROUP BY seq",
        "overlap_one_to_one": f"WITH {BOXES}, o AS (SELECT a.seq, k.seq AS rs, coalesce({INTER} / nullif(least((a.x1 - a.x0) * (a.b - a.t), (k.x1 - k.x0) * (k.b - k.t)), 0), 0) AS ratio FROM boxes a JOIN boxes k USING (doc_id, page) WHERE a.type <> 'Table' AND k.type = 'Table'), m AS (SELECT seq, arg_max(rs, (ratio, -rs)) AS right_seq FROM o WHERE ratio > 0.05 GROUP BY seq) SELECT min(seq) AS seq, right_seq FROM m GROUP BY right_seq",
        "inside_tables": f"WITH {BOXES} SELECT a.seq, least(coalesce(sum(CASE WHEN k.seq IS NULL THEN 0 ELSE {INTER} END / CASE WHEN (a.x1 - a.x0) * (a.b - a.t) > 0 THEN (a.x1 - a.x0) * (a.b - a.t) ELSE 1 END), 0), 1) AS inside FROM boxes a LEFT JOIN boxes k ON a.doc_id = k.doc_id AND a.page = k.page AND k.type = 'Table' AND k.score >= a.score WHERE a.type <> 'Table' GROUP BY a.seq",
        "image_coverage": f"WITH {BOXES}, p AS (SELECT doc_id, page, sum(CASE WHEN type = 'Figure' THEN greatest(greatest(0, least(x1, 400)) - greatest(0, least(x0, 400)), 0) * greatest(greatest(0, least(b, 600)) - greatest(0, least(t, 600)), 0) ELSE 0 END) AS a FROM boxes GROUP BY ALL) SELECT doc_id, page, least(a / 240000.0, 1.0) AS image_coverage FROM p",
        "page_boxes": f"WITH {BOXES} SELECT doc_id, page, min(x0) AS x0, min(t) AS top, max(x1) AS x1, max(b) AS bottom FROM boxes GROUP BY ALL",
        "pixel_boxes": f"WITH {BOXES}, p AS (SELECT seq, x0 * 0.48 AS x0, t * 0.48 AS t, x1 * 0.48 AS x1, b * 0.48 AS b FROM boxes) SELECT seq, greatest(0.0, least(x0, 200)) AS x0, greatest(0.0, least(t, 300)) AS top, greatest(0.0, least(x1, 200)) AS x1, greatest(0.0, least(b, 300)) AS bottom FROM p",
        "page_lines": LINES + "SELECT doc_id, page, string_agg(text, chr(10) ORDER BY top, x0, line) AS text FROM lines GROUP BY ALL",
        "fallback_blocks": LINES
        + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY lowest, x0, line) AS n FROM lines), g AS (SELECT doc_id, page, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(x0 DOUBLE, x1 DOUBLE, b DOUBLE)[]) AS boxes, CAST(0 AS BIGINT) AS block FROM o WHERE n = 1
          UNION ALL SELECT doc_id, page, n, CASE WHEN pos IS NULL THEN list_append(boxes, {'x0': x0, 'x1': x1, 'b': b}) ELSE list_transform(boxes, lambda x, i: CASE WHEN i = pos THEN {'x0': least(x.x0, x0), 'x1': greatest(x.x1, x1), 'b': b} ELSE x END) END, coalesce(pos, len(boxes) + 1) FROM (
            SELECT o.doc_id, o.page, o.n, g.boxes, o.left AS x0, o.right AS x1, o.bottom AS b, nullif(list_position(list_transform(g.boxes, lambda x: o.lowest - x.b BETWEEN 0 AND 6 AND least(x.x1, o.right) > greatest(x.x0, o.left)), true), 0) AS pos FROM g JOIN o ON o.doc_id = g.doc_id AND o.page = g.page AND o.n = g.n + 1)),
          k AS (SELECT doc_id, page, block, min(o.left) AS x0, arg_min(o.lowest, n) AS top, max(o.right) AS x1, arg_max(o.bottom, n) AS bottom, string_agg(text, ' ' ORDER BY n) AS text FROM g JOIN o USING (doc_id, page, n) GROUP BY ALL)
          SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY block) AS seq, round(x0, 2) AS x0, round(top, 2) AS top, round(x1, 2) AS x1, round(bottom, 2) AS bottom, text FROM k WHERE length(strip(text)) >= 3""",
        "filter_boxes": f"""WITH RECURSIVE {BOXES}, q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, seq) AS n, CASE WHEN (x1 - x0) * (b - t) > 0 AND x1 > x0 THEN (x1 - x0) * (b - t) ELSE 1 END AS size FROM boxes WHERE score >= 0.25),
          f AS (SELECT doc_id, page, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(n BIGINT, type VARCHAR, x0 DOUBLE, t DOUBLE, x1 DOUBLE, b DOUBLE)[]) AS kept FROM q WHERE n = 1
            UNION ALL SELECT q.doc_id, q.page, q.n, CASE WHEN least(coalesce(list_sum(list_transform(list_filter(f.kept, lambda k: k.type = q.type), lambda k: greatest(least(q.x1, k.x1) - greatest(q.x0, k.x0), 0) * greatest(least(q.b, k.b) - greatest(q.t, k.t), 0))), 0), q.size) / q.size >= 0.2 THEN f.kept ELSE list_append(f.kept, {{'n': q.n, 'type': q.type, 'x0': q.x0, 't': q.t, 'x1': q.x1, 'b': q.b}}) END FROM f JOIN q ON q.doc_id = f.doc_id AND q.page = f.page AND q.n = f.n + 1),
          z AS (SELECT doc_id, page, unnest(list_transform(kept, lambda k: k.n)) AS n FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC) = 1), a AS (SELECT q.* FROM q JOIN z USING (doc_id, page, n))
          SELECT a.seq, a.type, a.score FROM a LEFT JOIN a k ON k.doc_id = a.doc_id AND k.page = a.page AND k.type = 'Table' AND k.score >= a.score GROUP BY a.seq, a.type, a.score, a.size HAVING a.type = 'Table' OR coalesce(sum(CASE WHEN k.seq IS NULL THEN 0 ELSE {INTER} END), 0) / a.size < 0.3""",
        "quality_gate": f"""WITH {SCORES}, p AS (SELECT CASE WHEN lang = 'en' THEN 'statement' ELSE 'scanned' END AS stratum, n_chars / 65536.0 AS wer, CASE WHEN doc_id % 3 = 0 THEN 1 - doc_id % 8 / 64.0 END AS recall FROM documents), x AS (SELECT *, {RATIOS} FROM s),
          o AS (SELECT 'scanned_max_wer' AS rule, max(wer) AS observed, 0.05::DOUBLE AS lim, true AS most FROM p WHERE stratum = 'scanned' UNION ALL SELECT 'statement_max_wer', max(wer), 0.05::DOUBLE, true FROM p WHERE stratum = 'statement' UNION ALL SELECT 'min_numeric_recall', min(recall), 0.98::DOUBLE, false FROM p WHERE stratum = 'statement' UNION ALL SELECT 'table_min_f1', min(f1), 0.98::DOUBLE, false FROM x)
          SELECT rule, observed, lim AS "limit", coalesce(CASE WHEN most THEN observed <= lim ELSE observed >= lim END, true) AS passed FROM o""",
        "fiscal_year_ends": f"WITH {FACTS}, {ENDS} SELECT doc_id, year, fy_end FROM ends",
        "index_facts": f"WITH {FACTS}, {INDEX} SELECT doc_id, concept, dims_key, end_date, instant, fact_value FROM idx",
        "map_labels": f"WITH {CELLS} SELECT cell_id, path, concepts, map_method FROM mapping",
        "map_labels_curated": f"""WITH {CELLS}, own AS (SELECT CASE WHEN period_type = 'instant' THEN 'balance' ELSE 'income' END AS statement, {sql.label_normal("label")} AS lab, min(label_id) AS i, concat(max(concept), '|', min(concept)) AS cs FROM label_linkbase WHERE label_id % 2 = 0 GROUP BY ALL)
          SELECT m.cell_id, m.path, coalesce(o.cs, m.concepts) AS concepts, CASE WHEN o.cs IS NOT NULL THEN 'curated' ELSE m.map_method END AS map_method FROM mapping m LEFT JOIN own o ON o.statement = m.statement AND o.lab = m.lab AND (o.i % 4 <> 0 OR m.occurrence = 1)""",
        "reconcile_exact": RECON + "SELECT cell_id, path, concept, period_end, fact_value, status FROM recon",
        "lost_lines": RECON
        + ", e AS (SELECT doc_id, statement, concept, period_end, arg_min(cell_id, (cell_id, path)) AS cell_id, list(DISTINCT path) AS have FROM recon WHERE status NOT IN ('unmapped', 'xbrl_missing', 'value_missing') GROUP BY ALL) SELECT doc_id, statement, concept, period_end, p.path, cell_id FROM e, (SELECT DISTINCT path FROM recon) p WHERE NOT list_contains(have, p.path)",
        "reconcile_summary": RECON + ", g AS (SELECT path, coalesce(statement, 'ALL') AS statement, status, count(*) AS n FROM recon WHERE value IS NOT NULL GROUP BY GROUPING SETS ((path, statement, status), (path, status))), h AS (SELECT path, statement, CAST(sum(n) AS BIGINT) AS numbers, CAST(coalesce(sum(n) FILTER (status <> 'unmapped'), 0) AS BIGINT) AS mapped, CAST(coalesce(sum(n) FILTER (status IN ('match', 'match_negated')), 0) AS BIGINT) AS match, string_agg(concat(status, '=', n), ',' ORDER BY status) AS counts FROM g GROUP BY path, statement) SELECT path, statement, numbers, mapped, match, round(match / numbers, 4) AS match_rate, round(match / nullif(mapped, 0), 4) AS match_rate_of_mapped, counts FROM h",
        "below_threshold": f"""WITH {GRID}, {BOXES}, o AS (SELECT b.*, f.method, f.status FROM boxes b JOIN (SELECT rec_id, any_value(tbl.method) AS method, any_value(tbl.status) AS status FROM filing_records GROUP BY rec_id) f ON f.rec_id = b.seq WHERE type = 'Table'), k AS (SELECT doc_id, page, seq, x0 + 30 AS x0, t + 10 AS t, x1 + 30 AS x1, b + 10 AS b FROM o WHERE seq % 3 > 0),
          j AS (SELECT a.seq, a.method, a.status, k.seq AS ks, CASE WHEN k.seq IS NULL THEN 0 ELSE coalesce({INTER} / nullif(least((a.x1 - a.x0) * (a.b - a.t), (k.x1 - k.x0) * (k.b - k.t)), 0), 0) END AS ratio FROM o a LEFT JOIN k USING (doc_id, page) WHERE a.status IN ('below_threshold', 'no_valid_table')),
          m AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY seq ORDER BY ratio DESC, ks) = 1), g AS (SELECT rec_id, max(r) + 1 AS n_rows, max(c) + 1 AS n_cols, count(*) FILTER (regexp_full_match(strip(cell), '{text.NUM_SIGNED}')) AS n_numeric, round(count(*) FILTER (strip(cell) = '') / count(*), 3) AS empty_share FROM grids GROUP BY rec_id)
          SELECT seq, method, status, round(ratio, 2) AS overlap, CASE WHEN ratio > 0.5 THEN ks END AS found_seq, n_rows, n_cols, n_numeric, empty_share FROM m LEFT JOIN g ON g.rec_id = m.seq""",
        "cell_scores": f"WITH {SCORES} SELECT *, {RATIOS} FROM s",
        "micro_scores": f"WITH {SCORES}, h AS (SELECT g % 2 AS h, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(cells_gt) AS BIGINT) AS cells_gt, CAST(sum(cells_pred) AS BIGINT) AS cells_pred FROM s GROUP BY ALL) SELECT *, {RATIOS} FROM h",
        "path_status": f"WITH {STATUS} SELECT cell_id, status FROM s",
        "status_pivot": f"WITH {STATUS} SELECT g, count(*) FILTER (status = 'match') AS match, count(*) FILTER (status = 'part2_only') AS part2_only, count(*) FILTER (status = 'textract_only') AS textract_only, count(*) FILTER (status = 'differ') AS differ FROM s GROUP BY g",
        "page_averages": "WITH p AS (SELECT coalesce(source, 'none') AS source, coalesce(lang, 'none') AS stratum, round(n_chars / 4096.0, 4) AS wer, round(n_chars / 8192.0, 4) AS cer, CASE WHEN doc_id % 3 = 0 THEN doc_id % 8 / 8.0 END AS numeric_recall FROM documents) SELECT source, coalesce(stratum, 'ALL') AS stratum, count(*) AS pages, round(avg(wer), 8) AS wer, round(avg(cer), 8) AS cer, round(avg(numeric_recall), 8) AS numeric_recall FROM p GROUP BY GROUPING SETS ((source, stratum), (source))",
        "stage_summary": f"WITH {TIMES}, s AS (SELECT *, CASE WHEN status = 'ok' AND (stage NOT IN ('click', 'view') OR phase = 'warm') THEN CASE WHEN stage = 'purchase' THEN seconds / 61 ELSE seconds END END AS x FROM t) SELECT stage, count(x) AS n, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.95) AS p95, round(avg(x), 6) AS mean, max(rss_mb) AS peak, count(*) FILTER (status <> 'ok') AS failures, array_to_string(list_sort(list(DISTINCT CAST(run AS VARCHAR))), ',') AS runs FROM s GROUP BY stage",
        "cold_start": f"WITH {TIMES} SELECT stage, run, arg_min(seconds, seq) FILTER (phase = 'model_load') AS model_load, arg_min(seconds, seq) FILTER (phase = 'cold') AS first_cold, quantile_cont(seconds, 0.5) FILTER (phase = 'warm') AS warm_p50, quantile_cont(seconds, 0.95) FILTER (phase = 'warm') AS warm_p95, max(rss_mb) AS peak FROM t GROUP BY ALL",
        "drift": "WITH b AS (SELECT coalesce(lang, 'none') AS lang, len(string_split(text, ' ')) AS n FROM documents) SELECT lang, count(*) AS n, CAST(list_extract(list_sort(list(n)), CAST(count(*) // 2 + 1 AS INT)) AS BIGINT) AS median, round(count(*) FILTER (n < 30) / count(*), 4) AS share_short, CAST(sum(n) AS BIGINT) AS total FROM b GROUP BY lang",
        "length_histogram": f"WITH b AS (SELECT coalesce(lang, 'none') AS lang, len(string_split(text, ' ')) AS n FROM documents), c AS (SELECT lang, {BINS} AS bin FROM b) SELECT lang, bin, count(*) AS n FROM c WHERE bin IS NOT NULL GROUP BY ALL",
        "event_windows": "SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
        "embedded_documents": "SELECT doc_id, concat('main', doc_id, '.htm') AS filename, CAST(length(trim(regexp_replace(replace(text, '<', ''), '^\\s+|\\s+$', '', 'g'))) AS BIGINT) AS n_body, 'b' AS k, 'c d' AS long_key FROM documents",
        "primary_document": "WITH f AS (SELECT p_brand, concat(CASE WHEN p_partkey % 3 = 0 THEN 'R' ELSE 'doc' END, p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '.xml' ELSE '.htm' END) AS filename, p_partkey * 7919 % 100003 AS size FROM part) SELECT p_brand, arg_max(filename, (lower(filename) = 'doc7.htm', regexp_matches(lower(filename), '\\.html?$') AND NOT regexp_matches(lower(filename), '^r\\d+\\.htm$'), size)) AS filename FROM (SELECT * FROM f ORDER BY filename DESC) GROUP BY p_brand",
    }
    return {name: sql.stripped(q) for name, q in checks.items()}
