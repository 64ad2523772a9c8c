"""Responses of a managed extraction service, read from a table of cached responses.

responses: cache_key, page, blocks array<struct<id, type, row, col, text, confidence, box, child_ids>>. The remote
call itself stays outside; a miss is a row with a status.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill.functions import geometry as g
from facetmill.functions.text import strip


def feature_list(features: Column) -> Column:
    """Features of a list in text, parted by comma or plus: trimmed, upper case, blanks dropped, sorted."""
    return F.array_sort(F.filter(F.transform(F.split(features, "[,+]"), lambda x: F.upper(strip(x))), lambda x: x != ""))


def cache_key(sha256: Column, page: Column, provider: Column, api: Column, features: Column) -> Column:
    return F.sha2(F.concat_ws("|", sha256, F.concat(F.lit("p"), page.cast("string")), provider, api, F.array_join(feature_list(features), "+")), 256)


def lookup(requests: DataFrame, responses: DataFrame, enabled: Column, key: str = "cache_key") -> DataFrame:
    """requests with their response and a status: hit (also where calls are disabled), miss_disabled, or call."""
    r = responses.withColumn("fm_hit", F.lit(True))
    return requests.join(r, key, "left").withColumn("status", F.when(F.col("fm_hit"), "hit").when(~enabled, "miss_disabled").otherwise("call")).drop("fm_hit")


def insert_new(existing: DataFrame, incoming: DataFrame, key: str, seq: str) -> DataFrame:
    """existing plus the first row of each new key: old entries win."""
    rest = [c for c in incoming.columns if c != key]
    fresh = incoming.join(existing.select(key), key, "left_anti").groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("fm_r")).select(key, "fm_r.*")
    return existing.unionByName(fresh.select(*existing.columns))


def children(blocks: DataFrame, keys: Sequence[str], parent_type: str) -> DataFrame:
    """keys, id, pos and the child block of every child id of the parents of a type; dangling ids are dropped."""
    k = list(keys)
    edges = blocks.filter(F.col("type") == parent_type).select(*k, "id", F.posexplode("child_ids").alias("pos", "child_id"))
    child = blocks.select(*k, F.col("id").alias("child_id"), F.struct("type", "row", "col", "text", "confidence", "box").alias("child"))
    return edges.join(child, [*k, "child_id"])


def line_text(blocks: DataFrame, keys: Sequence[str], parent_type: str) -> DataFrame:
    """keys, id, text and mean confidence (rounded to 2) of the LINE children in order."""
    lines = children(blocks, keys, parent_type).filter("child.type = 'LINE'")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("child.text").alias("t")))), lambda x: x["t"])
    return lines.groupBy(*keys, "id").agg(F.array_join(ordered, "\n").alias("text"), F.round(F.avg("child.confidence"), 2).alias("confidence"))


def cells(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, id, row, col, seq, cell, confidence: the CELL children of tables with the words (and selected boxes as [X]) in them."""
    k = list(keys)
    of_table = children(blocks, k, "TABLE").filter("child.type = 'CELL'").select(*k, "id", F.col("child_id").alias("cell_id"), F.col("pos").alias("seq"), "child.row", "child.col", "child.confidence")
    words = children(blocks, k, "CELL").withColumn("t", F.when(F.col("child.type") == "SELECTION_ELEMENT", F.when(F.col("child.text") == "SELECTED", "[X]")).otherwise(F.col("child.text"))).filter("t is not null")
    joined = words.groupBy(*k, F.col("id").alias("cell_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), " ").alias("cell"))
    return of_table.join(joined, [*k, "cell_id"], "left").select(*k, "id", "row", "col", "seq", F.coalesce("cell", F.lit("")).alias("cell"), "confidence")


def to_points(b: Column, width: Column, height: Column) -> Column:
    return g.from_fractions(b, width, height)


def table_trigger(status: Column, score: Column, accept: float = 80.0) -> Column:
    """Why a table should be replaced: its status is low, or its score; null if it need not."""
    return F.when(status.isNull() | ~status.isin("accepted", "best_below_threshold"), F.concat(F.lit("status:"), F.coalesce(status, F.lit("none")))).when(score < accept, "low_score")


def text_trigger(confidence: Column, text: Column, least: float = 70.0) -> Column:
    """Why a text should be replaced: it is blank, or its confidence is low or unknown; null if it need not."""
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", "ocr_empty").when(confidence.isNull() | (confidence < least), "low_confidence")


def compare_paths(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str = "value", names: tuple[str, str] = ("part2", "textract")) -> DataFrame:
    """keys, both values and a status for every cell of two extraction paths: match (also two nulls), NAME_only or differ."""
    a, b = left.select(*keys, F.col(value).alias(names[0])), right.select(*keys, F.col(value).alias(names[1]))
    x, y = F.col(names[0]), F.col(names[1])
    status = F.when(x.isNull() & y.isNull(), "match").when(y.isNull(), f"{names[0]}_only").when(x.isNull(), f"{names[1]}_only").when(x == y, "match").otherwise("differ")
    return a.join(b, list(keys), "full_outer").withColumn("status", status)


# What the service's layout types become.
LAYOUT_TYPES = {"LAYOUT_TITLE": "Title", "LAYOUT_SECTION_HEADER": "Title", "LAYOUT_LIST": "List", "LAYOUT_TABLE": "Table", "LAYOUT_FIGURE": "Figure", "LAYOUT_FOOTER": "Footnote"}


def response_blocks(blocks: DataFrame, keys: Sequence[str], width: Column, height: Column, least: float = 0.5) -> DataFrame:
    """The blocks of each response in order: keys, n (1-based), type, bbox (points), text, confidence, table_id.

    ``blocks`` carries seq, the order in the response. A layout box over a table (more than ``least`` of the smaller)
    becomes that table; the first such box claims it and further ones vanish; one over no table is Text. Tables that
    no box claims come by their top after the layout boxes; without layout boxes every line is a Text block.
    """
    k = list(keys)
    placed = blocks.withColumn("bbox", to_points(F.col("box"), width, height))
    filled = cells(blocks, k).select(*k, F.col("id").alias("tid")).distinct()
    tables = placed.filter("type = 'TABLE'").select(*k, F.col("id").alias("tid"), F.col("seq").alias("tseq"), F.col("bbox").alias("tbox")).join(filled, [*k, "tid"])
    boxes = placed.filter(F.col("type").startswith("LAYOUT_"))
    kinds = F.create_map(*[F.lit(x) for pair in LAYOUT_TYPES.items() for x in pair])
    typed = boxes.select(*k, "id", "seq", "bbox", F.coalesce(F.try_element_at(kinds, F.col("type")), F.lit("Text")).alias("kind"))
    over = typed.filter("kind = 'Table'").join(tables, k).withColumn("ratio", g.overlap_of_smaller(F.col("bbox"), F.col("tbox"))).filter(F.col("ratio") > least)
    best = over.groupBy(*k, "id", "seq").agg(F.max_by(F.struct("tid", "tbox"), F.struct("ratio", -F.col("tseq"))).alias("t"))
    claim = best.withColumn("claim", F.row_number().over(Window.partitionBy(*k, "t.tid").orderBy("seq")))
    said = None
    for t in sorted({*LAYOUT_TYPES, "LAYOUT_TEXT", "LAYOUT_HEADER", "LAYOUT_PAGE_NUMBER", "LAYOUT_KEY_VALUE"}):
        part = line_text(blocks, k, t)
        said = part if said is None else said.unionByName(part)
    j = typed.join(claim.select(*k, "id", "t", "claim"), [*k, "id"], "left").join(said, [*k, "id"], "left").filter("claim is null or claim = 1")
    is_table = F.col("t").isNotNull()
    out = j.select(*k, F.col("seq").cast("double").alias("at"), F.when(is_table, "Table").when(F.col("kind") == "Table", "Text").otherwise(F.col("kind")).alias("type"), F.when(is_table, F.col("t.tbox")).otherwise(F.col("bbox")).alias("bbox"), F.when(~is_table, F.coalesce("text", F.lit(""))).alias("text"), F.when(~is_table, F.col("confidence")).alias("confidence"), F.col("t.tid").alias("table_id"))
    free = tables.join(claim.filter("claim = 1").select(*k, F.col("t.tid").alias("tid")), [*k, "tid"], "left_anti")
    out = out.unionByName(free.select(*k, (F.lit(1e9) + F.col("tbox.top") / 1e4).alias("at"), F.lit("Table").alias("type"), F.col("tbox").alias("bbox"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("confidence"), F.col("tid").alias("table_id")))
    bare = placed.filter("type = 'LINE'").join(boxes.select(*k).distinct(), k, "left_anti")
    out = out.unionByName(bare.select(*k, F.col("seq").cast("double").alias("at"), F.lit("Text").alias("type"), "bbox", F.coalesce("text", F.lit("")).alias("text"), F.col("confidence"), F.lit(None).cast("string").alias("table_id")))
    return out.select(*k, F.row_number().over(Window.partitionBy(*k).orderBy("at", "type", "table_id")).alias("n"), "type", "bbox", "text", "confidence", "table_id")


def below_threshold(tables: DataFrame, found: DataFrame, page: Sequence[str], low: Sequence[str] = ("best_below_threshold", "no_valid_table"), least: float = 0.5) -> DataFrame:
    """page, seq, method, score, status, overlap and found_seq of each table of a ``low`` status: the service's table over it.

    The service's table that covers most of the smaller of the two boxes counts (the first of equals) with its
    overlap, rounded to 2; its content is found only above ``least``, else found_seq is null.
    """
    p = list(page)
    ours = tables.filter(F.col("status").isin(*low))
    theirs = found.select(*p, F.col("seq").alias("fm_seq"), F.col("bbox").alias("fm_box"))
    j = ours.join(theirs, p, "left").withColumn("fm_ratio", F.when(F.col("fm_seq").isNotNull(), g.overlap_of_smaller(F.col("bbox"), F.col("fm_box"))).otherwise(0.0))
    best = j.groupBy(*p, "seq", "method", "score", "status").agg(F.max_by(F.struct("fm_seq", "fm_ratio"), F.struct("fm_ratio", -F.col("fm_seq"))).alias("b"))
    return best.select(*p, "seq", "method", "score", "status", F.round(F.coalesce("b.fm_ratio", F.lit(0.0)), 2).alias("overlap"), F.when(F.col("b.fm_ratio") > least, F.col("b.fm_seq")).alias("found_seq"))


def import_checked(incoming: DataFrame, known: DataFrame, existing: DataFrame, api: str, features: str, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): foreign responses with a meta, a known source, one page, this API and these features; old entries win.

    Reads source_sha256 (null without a meta), pages, api and features; ``known`` holds source_sha256.
    """
    have = existing.select(F.col(key).alias("fm_key")).distinct().withColumn("fm_old", F.lit(True))
    src = known.select(F.col("source_sha256").alias("fm_src")).distinct().withColumn("fm_known", F.lit(True))
    j = incoming.join(src, F.col("source_sha256") == F.col("fm_src"), "left").join(have, F.col(key) == F.col("fm_key"), "left")
    want = F.lit("+".join(sorted(x.strip().upper() for x in features.replace(",", "+").split("+") if x.strip())))
    reason = F.when(F.col("source_sha256").isNull(), "no_meta").when(F.col("fm_known").isNull(), "unknown_source").when(F.col("pages") != 1, "not_one_page").when(F.col("api") != api, "other_api").when(F.array_join(feature_list(F.col("features")), "+") != want, "other_features").when(F.col("fm_old"), "kept_old")
    out = j.withColumn("reason", reason).select(*incoming.columns, "reason")
    return out.filter("reason is null").drop("reason"), out.filter("reason is not null")


def replaced(records: DataFrame, hits: DataFrame, key: Sequence[str], accept: float = 80.0, least: float = 70.0) -> DataFrame:
    """records with the response's content where a trigger fires and a hit has some: text, confidence, trigger, used.

    records: key, status, score, ocr, text, confidence; hits: key, hit_text, hit_confidence. Tables (status or score
    present) use the table trigger, OCR texts the text trigger; other records never trigger.
    """
    table = F.col("status").isNotNull() | F.col("score").isNotNull()
    trigger = F.when(table, table_trigger(F.col("status"), F.col("score"), accept)).when(F.col("ocr"), text_trigger(F.col("confidence"), F.col("text"), least))
    j = records.join(hits, list(key), "left").withColumn("trigger", trigger)
    used = F.col("trigger").isNotNull() & (strip(F.col("hit_text")) != "")
    used = F.coalesce(used, F.lit(False))
    return j.select(*[c for c in records.columns if c not in ("text", "confidence")], F.when(used, F.col("hit_text")).otherwise(F.col("text")).alias("text"), F.when(used, F.col("hit_confidence")).otherwise(F.col("confidence")).alias("confidence"), "trigger", used.alias("used"))
