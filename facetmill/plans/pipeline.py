"""Composite pipelines: page layout to ordered blocks, candidate tables to accepted normalized grids, scored pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.functions import geometry as g
from facetmill.operators import grid, layout, metrics, pages

TEXT_TYPES = ("Text", "Title", "List", "Footnote")


def layout_blocks(words: DataFrame, detections: DataFrame, sizes: DataFrame, page: Sequence[str], rules: layout.LayoutRules = layout.LayoutRules(), table_reach: float = 40.0, text_reach: float = 15.0) -> DataFrame:
    """page, position, block_id, type, source, score, bbox, text: the blocks of each page in reading order.

    words: page, seq, text, bbox; detections: page, seq, type, score, bbox; sizes: page, width. Each word goes to the
    smallest kept box that holds its centre; words left over snap sideways to tables, then the rest to text blocks
    (distances are to the boxes as detected), whose boxes grow. A text or table box whose words all went to smaller
    boxes is dropped; words no box takes become fallback blocks.
    """
    p = list(page)
    boxes = layout.filter_boxes(detections, p, rules)
    w = words.select(*p, F.col("seq").alias("word"), "text", F.col("bbox").alias("wbox"), g.center_x(F.col("bbox")).alias("x"), g.center_y(F.col("bbox")).alias("y"), F.col("bbox.x0").alias("x0"), F.col("bbox.x1").alias("x1"))
    inside = layout.assign_points(w, boxes, p, ["word"])
    left = w.join(inside.select(*p, "word"), [*p, "word"], "left_anti")
    to_table = layout.snap_points(left, boxes.filter("type = 'Table'"), p, ["word"], table_reach)
    rest = left.join(to_table.select(*p, "word"), [*p, "word"], "left_anti")
    to_text = layout.snap_points(rest, boxes.filter(F.col("type").isin(*TEXT_TYPES)), p, ["word"], text_reach)
    taken = inside.select(*p, "word", "seq").unionByName(to_table.select(*p, "word", "seq")).unionByName(to_text.select(*p, "word", "seq"))
    held = taken.join(w.select(*p, "word", "text", "wbox"), [*p, "word"]).select(*p, "seq", "word", "text", F.col("wbox").alias("bbox"))
    texts = layout.text_of_blocks(held.select(*p, "seq", "bbox.*", "text"), [*p, "seq"], rules)
    grown = held.groupBy(*p, "seq").agg(g.union_of("bbox").alias("fm_words"))
    full = boxes.join(texts, [*p, "seq"], "left").join(grown, [*p, "seq"], "left")
    a, b = F.col("bbox"), F.col("fm_words")
    snapped = to_table.select(*p, "seq").unionByName(to_text.select(*p, "seq")).distinct().withColumn("fm_snapped", F.lit(True))
    full = full.join(snapped, [*p, "seq"], "left").withColumn("bbox", F.when(F.col("fm_snapped"), g.box(F.least(a["x0"], b["x0"]), F.least(a["top"], b["top"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["bottom"], b["bottom"]))).otherwise(a))
    covered = w.join(boxes.select(*p, "seq", F.col("bbox").alias("fm_box")), p).filter(g.contains_point(F.col("fm_box"), F.col("x"), F.col("y"))).select(*p, "seq").distinct().withColumn("fm_covered", F.lit(True))
    lost = F.col("text").isNull() & F.col("type").isin(*TEXT_TYPES, "Table") & F.coalesce("fm_covered", F.lit(False))
    kept = full.join(covered, [*p, "seq"], "left").filter(~lost).select(*p, "seq", "type", F.lit("model").alias("source"), "score", "bbox", "text")
    free = w.join(taken.select(*p, "word"), [*p, "word"], "left_anti").select(*p, "wbox.*", "text")
    extra = layout.fallback_blocks(free, p, rules).select(*p, (F.lit(1_000_000) + F.col("seq")).alias("seq"), F.lit("Text").alias("type"), F.lit("fallback").alias("source"), F.lit(None).cast("double").alias("score"), "bbox", "text")
    placed = layout.reading_order(kept.withColumn("seq", F.col("seq").cast("bigint")).unionByName(extra.withColumn("seq", F.col("seq").cast("bigint"))).join(sizes.select(*p, "width"), p), p, rules=rules)
    return placed.select(*p, "position", pages.block_id(F.col(p[-1]).cast("int"), F.col("position")).alias("block_id"), "type", "source", "score", "bbox", "text")


def accepted_tables(cells: DataFrame, candidates: DataFrame, captions: DataFrame, page: Sequence[str], rules: grid.TableRules = grid.TableRules()) -> tuple[DataFrame, DataFrame]:
    """(decisions, normalized cells of the chosen tables).

    cells: table_id, r, c, cell; candidates: page, table_id, rank, seq, accuracy, n_numeric; captions: page, text.
    Every candidate is cleaned and scored alike; methods are tried in rank order.
    """
    p = list(page)
    clean = grid.merge_wrapped_labels(grid.clean_grid(cells, ["table_id"]), ["table_id"])
    known = clean.join(candidates.select("table_id", "n_numeric"), "table_id")
    shapes = grid.shape_metrics(known, ["table_id"], F.max("n_numeric"), rules)
    scored = candidates.join(shapes, "table_id").withColumn("score", grid.score(F.coalesce("accuracy", F.lit(0.0)), F.col("whitespace"), rules)).withColumn("cells", F.col("n_rows") * F.col("n_cols"))
    decisions = grid.accept_in_order(scored, p, rules)
    chosen = clean.join(decisions.filter("table_id is not null").select(*p, "table_id"), "table_id").join(captions.select(*p, "text"), p, "left")
    texts = chosen.select("table_id", "text").distinct()
    return decisions, grid.normalize_grid(chosen.select("table_id", "r", "c", "cell"), ["table_id"], texts, rules)


def scored_pages(pairs: DataFrame, keys: Sequence[str], reference: str, hypothesis: str) -> tuple[DataFrame, DataFrame]:
    """(rows per page with wer, cer and numeric_recall, their averages by source and stratum). ``keys`` include source and stratum."""
    scores = metrics.text_scores(pairs, reference, hypothesis).select(*keys, "wer", "cer", "ref_words", "hyp_words")
    recall = metrics.numeric_recall(pairs, keys, reference, hypothesis).select(*keys, "numeric_recall")
    rows = scores.join(recall, list(keys))
    return rows, metrics.page_averages(rows)
