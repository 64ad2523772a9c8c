"""Composite pipelines on hand-made pages."""

import pytest
from pyspark.sql import functions as F

from facetmill.plans import pipeline

BOX = "struct<x0:double,top:double,x1:double,bottom:double>"


def test_layout(spark):
    words = [(1, "Title", (10, 5, 40, 12)), (2, "left", (10, 30, 20, 38)), (3, "text", (22, 30, 40, 38)), (4, "right", (60, 30, 80, 38)), (5, "Label", (5, 62, 15, 70)), (6, "7", (60, 62, 70, 70)), (7, "stray", (10, 190, 30, 198))]
    boxes = [(1, "Title", 0.9, (5, 0, 95, 15)), (2, "Text", 0.9, (8, 28, 45, 50)), (3, "Text", 0.8, (55, 28, 95, 50)), (4, "Table", 0.9, (30, 60, 90, 80)), (5, "Text", 0.1, (0, 180, 90, 199)), (6, "List", 0.5, (9, 29, 42, 39)), (7, "Figure", 0.9, (10, 100, 90, 150))]
    w = spark.createDataFrame([("d", 3, i, t, tuple(map(float, b))) for i, t, b in words], f"doc string, page int, seq int, text string, bbox {BOX}")
    d = spark.createDataFrame([("d", 3, i, t, s, tuple(map(float, b))) for i, t, s, b in boxes], f"doc string, page int, seq int, type string, score double, bbox {BOX}")
    size = spark.createDataFrame([("d", 3, 100.0)], "doc string, page int, width double")
    got = [(r["block_id"], r["type"], r["source"], r["text"]) for r in pipeline.layout_blocks(w, d, size, ["doc", "page"]).orderBy("position").collect()]
    assert got == [("p0003_b001", "Title", "model", "Title"), ("p0003_b002", "List", "model", "left text"), ("p0003_b003", "Text", "model", "right"), ("p0003_b004", "Table", "model", "Label\n7"), ("p0003_b005", "Figure", "model", None), ("p0003_b006", "Text", "fallback", "stray")]


def test_tables(spark):
    rows = [["", "2020", "2019"], ["Sales", "1,000", "900"], ["Cost", "(400)", "(300)"], ["Gain", "$ 600", "600"], ["Tax", "10", "5"], ["Shares used", "50", "40"]]
    grids = {"small": [["x", "1"]], "good": rows, "late": rows}
    cells = spark.createDataFrame([(t, r, c, v) for t, g in grids.items() for r, row in enumerate(g) for c, v in enumerate(row)], "table_id string, r int, c int, cell string")
    cand = spark.createDataFrame([(1, "small", 0, 1, 100.0, 10), (1, "good", 1, 2, 97.0, 10), (1, "late", 2, 3, 99.0, 10)], "page int, table_id string, rank int, seq int, accuracy double, n_numeric int")
    captions = spark.createDataFrame([(1, "(in millions, except shares in thousands)")], "page int, text string")
    decisions, normal = pipeline.accepted_tables(cells, cand, captions, ["page"])
    assert [(r["decision"], r["table_id"]) for r in decisions.collect()] == [("accepted", "good")]
    got = {(r["r"], r["c"]): r["num"] for r in normal.filter("num is not null").collect()}
    assert got[(1, 1)] == 1e9 and got[(2, 2)] == -3e8 and got[(5, 1)] == 5e4


def test_scores(spark):
    df = spark.createDataFrame([(1, "a", "s", "Net sales 5", "net  sales 5"), (2, "a", "s", "x y", "x z")], "page int, source string, stratum string, ref string, hyp string")
    rows, means = pipeline.scored_pages(df, ["page", "source", "stratum"], "ref", "hyp")
    assert {r["page"]: r["wer"] for r in rows.collect()} == {1: 0.0, 2: 0.5}
    assert means.filter(F.col("stratum") == "ALL").head()["wer"] == pytest.approx(0.25)
