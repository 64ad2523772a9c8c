"""Records: validation, sections, Markdown and text, search and trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill.functions import geometry as g
from facetmill.functions import text as tx

# Formats of the record's fields.
ACCESSION = r"^\d{10}-\d{2}-\d{6}$"
CIK = r"^\d{10}$"
BLOCK_ID = r"^p\d{4}_b\d{3,}$"
FISCAL_PERIOD = r"^(?:FY|Q[1-4]|H[12])$"
SHA256 = r"^[0-9a-f]{64}$"
BLOCK_TYPES = ("Text", "Title", "List", "Table", "Figure", "Footnote")
# A footer block, and a footer line merged into a bigger block, as the export settings give them.
FOOTER = r"(\|\s*\d{4}\s+Form\s+10-[KQ]\s*\|\s*\d+|^\s*\d{1,3})\s*$"
FOOTER_LINE = r"\|\s*\d{4}\s+Form\s+10-[KQ]\s*\|\s*\d+\s*$"


def violations(table: str = "tbl") -> Column:
    """array<string> of the names of the fields that break a rule of the record schema, empty for a valid record."""
    c = F.col
    path_bad = lambda p: c(p).isNotNull() & (c(p).startswith("/") | c(p).contains("\\") | c(p).rlike(r"^[A-Za-z]:|(?:^|/)\.\.(?:/|$)"))
    b = c("bbox")
    width_bad = F.exists(F.coalesce(c(f"{table}.grid_rows"), F.expr("array()")), lambda r: F.size(r) != F.size(c(f"{table}.col_names")))
    checks = {
        "doc_id": ~F.coalesce(c("doc_id").rlike(ACCESSION), F.lit(False)),
        "cik": c("cik").isNotNull() & ~c("cik").rlike(CIK),
        "fiscal_year": c("fiscal_year").isNotNull() & ~c("fiscal_year").between(1990, 2100),
        "fiscal_period": c("fiscal_period").isNotNull() & ~c("fiscal_period").rlike(FISCAL_PERIOD),
        "page": ~F.coalesce(c("page") >= 1, F.lit(False)),
        "block_id": ~F.coalesce(c("block_id").rlike(BLOCK_ID), F.lit(False)),
        "block_type": ~F.coalesce(c("block_type").isin(*BLOCK_TYPES), F.lit(False)),
        "bbox": ~F.coalesce((b["x0"] < b["x1"]) & (b["top"] < b["bottom"]) & (b["x0"] >= -1) & (b["top"] >= -1), F.lit(False)),
        "source_path": path_bad("source_path"),
        "figure_path": path_bad("figure_path"),
        "detector_score": c("detector_score").isNotNull() & ~c("detector_score").between(0, 1),
        "sha256": ~F.coalesce(c("sha256").rlike(SHA256), F.lit(False)),
        "ocr_conf": c("ocr_conf").isNotNull() & (~F.coalesce(c("ocr"), F.lit(False)) | ~c("ocr_conf").between(0, 100)),
        "text": c("block_type").isin("Text", "Title", "List", "Footnote") & c("text").isNull(),
        "table": (c(table).isNotNull() & (c("block_type") != "Table")) | (c(table).isNotNull() & (width_bad | (F.size(c(f"{table}.row_kinds")) != F.size(c(f"{table}.grid_rows"))))),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in checks.items()]))


def item_headings(blocks: DataFrame, page: Sequence[str], limit: int = 150) -> DataFrame:
    """page, seq, item, heading, fragment_seq: headings ``Item N`` in Title and Text blocks, also where a block ``Item`` stands to the left on the line.

    The fragment is joined within the page; the first (by seq) counts.
    """
    p = list(page)
    s = tx.strip(F.col("text"))
    b = blocks.filter(F.col("type").isin("Title", "Text") & (s != "")).select(*p, "seq", "bbox", s.alias("s"))
    short = b.filter(F.char_length("s") <= limit)
    whole = short.filter(F.col("s").rlike(tx.ITEM)).select(*p, "seq", F.concat(F.lit("Item "), F.upper(F.regexp_extract("s", tx.ITEM, 1))).alias("item"), tx.strip(tx.first_line(F.col("s"))).alias("heading"), F.lit(None).cast("int").alias("fragment_seq"))
    rest = short.filter(F.col("s").rlike(tx.ITEM_REST) & ~F.col("s").rlike(tx.ITEM))
    lone = b.filter(F.col("s").rlike(tx.ITEM_WORD)).select(*p, F.col("seq").alias("wseq"), F.col("bbox").alias("wbox"))
    pair = rest.join(lone, p).filter(g.same_line(F.col("wbox"), F.col("bbox")) & (F.col("wbox.x0") <= F.col("bbox.x0") + 5) & (F.col("wbox.x1") < F.col("bbox.x1")))
    joined = pair.groupBy(*p, "seq", "s").agg(F.min("wseq").cast("int").alias("fragment_seq")).select(*p, "seq", F.concat(F.lit("Item "), F.upper(F.regexp_extract("s", tx.ITEM_REST, 1))).alias("item"), F.concat(F.lit("Item "), tx.strip(tx.first_line(F.col("s")))).alias("heading"), "fragment_seq")
    return whole.unionByName(joined)


def with_sections(blocks: DataFrame, doc: Sequence[str], order: Sequence[str], item: str = "item", layout_section: str = "section") -> DataFrame:
    """``section`` becomes the last item heading so far in the document, else the layout's section."""
    w = Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.coalesce(F.last(item, True).over(w), F.col(layout_section)))


def with_headings(records: DataFrame, doc: Sequence[str], order: Sequence[str], seq: str, kind: str = "block_type", limit: int = 150) -> DataFrame:
    """records with section replaced, and section_heading, is_heading and is_fragment added.

    section is the last item heading so far (``Item 7``, as in ``item_headings``), else the record's own. The first
    heading of an item names it: its line is section_heading of every record of the section, its record is_heading. A
    lone ``Item`` to the left of a heading is_fragment, and belongs to the heading's section. ``order`` names the page
    first. Windows over pages and filings, after one shuffle by ``doc``.
    """
    d = list(doc)
    s = tx.strip(F.col("text"))
    usable = F.col(kind).isin("Title", "Text") & (s != "")
    short = usable & (F.char_length(s) <= limit)
    lone = F.when(usable & s.rlike(tx.ITEM_WORD), F.struct(F.col(seq).alias("seq"), F.col("bbox").alias("box")))
    on_page = Window.partitionBy(*d, order[0])
    r = records.repartition(*d).withColumn("fm_lone", F.collect_list(lone).over(on_page))
    left = F.filter("fm_lone", lambda w: g.same_line(w["box"], F.col("bbox")) & (w["box"]["x0"] <= F.col("bbox.x0") + 5) & (w["box"]["x1"] < F.col("bbox.x1")))
    whole = F.coalesce(short & s.rlike(tx.ITEM), F.lit(False))
    r = r.withColumn("fm_part", F.when(short & s.rlike(tx.ITEM_REST) & ~whole, F.array_min(F.transform(left, lambda w: w["seq"]))))
    joined = F.col("fm_part").isNotNull()
    item = lambda pattern: F.concat(F.lit("Item "), F.upper(F.regexp_extract(s, pattern, 1)))
    line = tx.strip(tx.first_line(s))
    r = r.withColumn("fm_item", F.when(whole, item(tx.ITEM)).when(joined, item(tx.ITEM_REST))).withColumn("fm_heading", F.when(whole, line).when(joined, F.concat(F.lit("Item "), line)))
    so_far = Window.partitionBy(*d).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("fm_section", F.coalesce(F.last("fm_item", True).over(so_far), "section"))
    first = F.first(F.when(F.col("fm_item") == F.col("fm_section"), F.struct("fm_heading", seq)), True)
    r = r.withColumn("fm_first", first.over(Window.partitionBy(*d, "fm_section").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    parts = F.collect_list(F.when(joined, F.struct(F.col("fm_part").alias("seq"), F.col("fm_item").alias("item"))))
    r = r.withColumn("fm_parts", parts.over(on_page)).withColumn("fm_whole", F.array_min(F.transform(F.filter("fm_parts", lambda x: x["seq"] == F.col(seq)), lambda x: x["item"])))
    return r.select(
        *[c for c in records.columns if c != "section"], F.coalesce("fm_whole", "fm_section").alias("section"), F.col("fm_first.fm_heading").alias("section_heading"),
        F.coalesce(F.col(f"fm_first.{seq}") == F.col(seq), F.lit(False)).alias("is_heading"), F.col("fm_whole").isNotNull().alias("is_fragment"),
    )


def previous_line(blocks: DataFrame, page: Sequence[str], order: Sequence[str], kind: str = "block_type", name: str = "context") -> DataFrame:
    """Adds the first line of the last qualifying block before each block on its page: no table, over 10 characters, not in parentheses; else ''."""
    line = tx.strip(tx.first_line(tx.strip(F.col("text"))))
    ok = (F.col(kind) != "Table") & (F.char_length(line) > 10) & ~line.startswith("(")
    w = Window.partitionBy(*page).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn(name, F.coalesce(F.last(F.when(ok, line), True).over(w), F.lit("")))


def table_markdown(raw: Column) -> Column:
    """Printed cells as a pipe table."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x: tx.strip(tx.escape_cell(x))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(raw[0])))
    return F.array_join(F.concat(F.array(row(raw[0]), rule), F.transform(F.slice(raw, 2, F.greatest(F.size(raw) - 1, F.lit(0))), row)), "\n")


def fragments(records: DataFrame, doc: Sequence[str], order: Sequence[str], table: str = "tbl") -> DataFrame:
    """doc, order, md, txt, furniture and title: the Markdown and text pieces of each record.

    A provenance comment leads each piece; ``##`` marks a change of section or its heading's record, ``###`` a title.
    Page footers (``furniture``) and the halves of split headings have no piece. Where records carry section_heading,
    is_heading and is_fragment (``with_headings``), the heading's line stands at ``##``; where they carry company, form
    and fiscal_year, title is ``# company form FYyear (doc)``, else null.
    """
    c = F.col
    known = lambda name, otherwise: c(name) if name in records.columns else otherwise
    is_heading, heading = known("is_heading", F.lit(False)), known("section_heading", F.lit(None).cast("string"))
    has_table = c(table).isNotNull() & c(f"{table}.raw_cells").isNotNull() & (F.size(c(f"{table}.raw_cells")) > 0)
    furniture = F.coalesce(tx.footer(c("text"), c(table).isNotNull(), FOOTER) & (tx.strip(c("text")) != ""), F.lit(False))
    out = records.withColumn("fm_foot", furniture).withColumn("fm_hidden", c("fm_foot") | known("is_fragment", F.lit(False)))
    w = Window.partitionBy(*doc, "fm_hidden").orderBy(*order)
    out = out.withColumn("fm_changed", ~c("section").eqNullSafe(F.lag("section").over(w)) | (F.row_number().over(w) == 1))
    src = F.format_string("<!-- %s p%d %s -->", c("doc_id"), c("page"), c("block_id"))
    body = tx.strip(tx.without_lines(F.coalesce(c("text"), F.lit("")), FOOTER_LINE))
    none = F.expr("cast(array() as array<string>)")
    picture = F.when(c("figure_path").isNotNull(), F.concat(F.lit("![Figure, page "), c("page").cast("string"), F.lit("]("), c("figure_path"), F.lit(")"))).otherwise("*[Figure]*")
    piece = (
        F.when(is_heading, F.array(src, F.concat(F.lit("## "), heading)))
        .when(c("block_type") == "Title", F.array(src, F.concat(F.lit("### "), tx.strip(c("text")))))
        .when((c("block_type") == "Table") & has_table, F.array(src, table_markdown(c(f"{table}.raw_cells"))))
        .when(c("block_type") == "Figure", F.array(src, picture, F.nullif(tx.strip(c("text")), F.lit(""))))
        .when(body != "", F.array(src, body))
        .otherwise(none)
    )
    lead = F.when(c("fm_changed") & ~is_heading & F.coalesce(c("section") != "", F.lit(False)), F.array(F.concat(F.lit("## "), F.coalesce(heading, "section")))).otherwise(none)
    lines = F.array_join(F.transform(c(f"{table}.raw_cells"), lambda r: F.array_join(F.filter(r, lambda x: x != ""), " ")), "\n")
    txt = F.when(has_table, lines).when(body != "", body)
    named = {"company", "form", "fiscal_year"} <= set(records.columns)
    title = F.format_string("# %s %s FY%s (%s)", c("company"), c("form"), c("fiscal_year").cast("string"), F.concat_ws(" ", *doc)) if named else F.lit(None).cast("string")
    seen = lambda x: F.when(~c("fm_hidden"), x)
    return out.select(*doc, *[c(x) for x in order if x not in doc], seen(F.array_join(F.array_compact(F.concat(lead, piece)), "\n\n")).alias("md"), seen(txt).alias("txt"), c("fm_foot").alias("furniture"), title.alias("title"))


def documents_of(pieces: DataFrame, doc: Sequence[str], order: Sequence[str]) -> DataFrame:
    """doc, markdown, plain, skipped (footers): the pieces of each document in order, under the title of the first record.

    A document must fit one row, as one file of a filing does; without a visible piece it has no texts.
    """
    key = F.struct(*order)
    joined = lambda v: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), v.alias("v")))), lambda x: x["v"]), lambda x: x != ""), "\n\n")
    shown = F.count("md") > 0
    out = pieces.groupBy(*doc).agg(F.min_by("title", key).alias("title"), joined(F.col("md")).alias("md"), joined(F.col("txt")).alias("plain"), shown.alias("shown"), F.count_if("furniture").alias("skipped"))
    return out.select(*doc, F.when(F.col("shown"), F.concat_ws("\n\n", "title", F.nullif("md", F.lit("")))).alias("markdown"), F.when(F.col("shown"), F.col("plain")).alias("plain"), "skipped")


def slice_pages(documents: DataFrame, doc: Sequence[str], markdown: str, low: int, high: int, name: str = "slice") -> DataFrame:
    """doc, ``name``: the chunks of each Markdown whose provenance comment lies on pages low..high, and the chunk it opens with.

    A chunk belongs to the last comment before it (or to itself, if it is one). A ``##`` heading that belongs to no
    such page stays if the next comment does and no other heading comes between.
    """
    d = list(doc)
    chunks = documents.select(*d, F.posexplode(F.split(markdown, "\n\n", -1)).alias("fm_at", "fm_chunk"))
    page = F.regexp_extract(tx.strip(F.col("fm_chunk")), r"^<!-- \S+ p(\d+) \S+ -->", 1).try_cast("int")
    chunks = chunks.withColumn("fm_page", page).withColumn("fm_heads", F.col("fm_page").isNull() & F.col("fm_chunk").startswith("## "))
    w = Window.partitionBy(*d).orderBy("fm_at")
    inside = lambda c: F.coalesce(c.between(low, high), F.lit(False))
    own = inside(F.last("fm_page", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    following = F.first(F.when(F.col("fm_page").isNotNull() | F.col("fm_heads"), F.struct("fm_page")), True).over(w.rowsBetween(1, Window.unboundedFollowing))
    kept = chunks.withColumn("fm_keep", (F.col("fm_at") == 0) | own | (F.col("fm_heads") & inside(following["fm_page"]))).filter("fm_keep")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fm_at", "fm_chunk"))), lambda x: x["fm_chunk"]), "\n\n")
    return kept.groupBy(*d).agg(F.concat(F.rtrim(joined, F.lit("\n")), F.lit("\n")).alias(name))


def search(records: DataFrame, query: str, order: Sequence[str], keep: Sequence[str], stem: tuple[str, str] | None = None, limit: int = 50, table: str = "tbl") -> DataFrame:
    """The first ``limit`` records whose text or table holds the query, letter case aside, with a snippet. A blank query finds nothing."""
    q = query.strip().lower()
    rows = records if stem is None else records.filter(F.col(stem[0]) == stem[1])
    hay = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.to_json(table)) if table in records.columns else F.coalesce(F.col("text"), F.lit(""))
    found = rows.withColumn("fm_hay", hay).filter(F.lower("fm_hay").contains(q) & F.lit(bool(q)))
    return found.orderBy(*order).limit(limit).select(*keep, tx.snippet(F.col("fm_hay"), F.lit(q)).alias("snippet"))


def trace(markdown: Column, block_id: Column) -> Column:
    """What follows a block's provenance comment in the Markdown, up to the next chunk break."""
    after = F.split_part(markdown, F.concat(F.lit(" "), block_id, F.lit(" -->\n\n")), F.lit(2))
    return F.split_part(after, F.lit("\n\n"), F.lit(1))


def ocr_decision(t: Column, image_coverage: Column, min_chars: int = 50, junk: float = 0.3, coverage: float = 0.6) -> Column:
    """struct<triggered, reason, n_chars, junk_ratio>: too few characters, too many junk tokens, or too much image; reasons joined by ``;``."""
    s = F.coalesce(t, F.lit(""))
    tokens = tx.words(s)
    bad = F.size(F.filter(tokens, lambda x: x.rlike(r"\(cid:\d+\)|�|[\x00-\x08\x0b\x0c\x0e-\x1f]")))
    ratio = F.coalesce(F.try_divide(bad.cast("double"), F.size(tokens)), F.lit(0.0))
    chars = F.char_length(tx.strip(s))
    reason = F.concat_ws(";", F.when(chars < min_chars, "few_chars"), F.when(ratio > junk, "junk_ratio"), F.when(image_coverage > coverage, "image_coverage"))
    return F.struct((reason != "").alias("triggered"), F.coalesce(F.nullif(reason, F.lit("")), F.lit("none")).alias("reason"), chars.cast("bigint").alias("n_chars"), ratio.alias("junk_ratio"))


def extractor_of(managed: Column, table_method: Column, ocr: Column, t: Column) -> Column:
    """Who made a record's content: a managed hit, the table method, OCR, the text layer, else the layout detector."""
    return F.when(managed, "managed").when(table_method.isNotNull(), table_method).when(ocr, "ocr").when(t != "", "text-layer").otherwise("layout")
