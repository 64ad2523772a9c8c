"""Queries over whole inputs, on small hand-made tables."""

from datetime import date, datetime

import pytest

from facetmill.plans import catalogue


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("cells"))
    old, new = datetime(2021, 1, 1), datetime(2021, 2, 1)
    rows = [
        (1, "d", 1, 1, "Net income", 0, 100.0, old), (1, "d", 1, 1, "\uff2e\uff45\uff54 \uff49\uff4e\uff43\uff4f\uff4d\uff45", 0, 101.0, new),
        (2, "d", 2, 1, "Total\u00a0assets", 0, 500.0, old), (3, "d", 1, 1, None, 0, 7.0, old), (4, "d", 2, 1, "Total assets", 0, 500.0, old), (4, "d", 2, 1, "Total assets", 0, None, new),
        (5, "d", 1, 1, "Net income", 0, 100.0, old), (6, "d", 1, 1, "N\u0435t income", 0, 100.0, old), (7, "gone", 1, 1, "Net income", 0, 1.0, old),
    ]
    save(spark, d, "table_cells", rows, "cell_id bigint, doc_id string, rec_id bigint, page int, label string, occurrence int, part2 double, loaded_at timestamp")
    save(spark, d, "filing_records", [("d", 2020), ("d", None)], "doc_id string, fiscal_year int")
    save(spark, d, "label_linkbase", [("NetIncomeLoss", "label", "Net income", "duration"), ("Assets", "label", "Total assets", "instant")], "concept string, label_role string, label string, period_type string")
    facts = [(1, "d", "NetIncomeLoss", 100.0, "0", False, date(2020, 1, 1), date(2020, 12, 31), None), (2, "d", "Assets", 500.0, "0", True, None, date(2020, 12, 31), None)]
    save(spark, d, "tagged_facts", facts, "fact_id bigint, doc_id string, concept string, fact_value double, decimals string, instant boolean, start_date date, end_date date, dims_key string")
    return d


def run(spark, name, d):
    return catalogue.queries()[name](spark, d).collect()


def test_cells_of_any_label_are_mapped_and_reconciled(spark, cells):
    exact = {1: "linkbase", 2: "linkbase", 3: "none", 4: "linkbase", 5: "linkbase", 6: "none", 7: "linkbase"}
    assert {r["cell_id"]: r["map_method"] for r in run(spark, "map_labels", cells)} == exact
    assert {r["cell_id"]: r["map_method"] for r in run(spark, "map_labels_fuzzy", cells)} == exact | {6: "fuzzy:net income"}
    status = {1: "mismatch", 2: "match", 3: "unmapped", 4: "value_missing", 5: "match", 6: "unmapped", 7: "xbrl_missing"}
    for name, want in (("reconcile_exact", status), ("reconcile", status | {6: "match"})):
        got = sorted((r["cell_id"], r["path"], r["status"]) for r in run(spark, name, cells))
        assert got == sorted((k, p, s) for k, s in want.items() for p in ("first", "second") if k != 5 or p == "second")
    summary = {(r["path"], r["statement"]): (r["numbers"], r["mapped"], r["match"]) for r in run(spark, "reconcile_summary", cells)}
    assert summary == {("first", "ALL"): (5, 3, 1), ("first", "balance"): (1, 1, 1), ("first", "income"): (4, 2, 0), ("second", "ALL"): (6, 4, 2), ("second", "balance"): (1, 1, 1), ("second", "income"): (5, 3, 1)}
    assert run(spark, "lost_lines", cells) == []


def test_export_holds_every_block_table_and_character(spark, tmp_path):
    raw = [["", "2020"], ["Caf\u00e9 | bar", "1 \u20ac"]]
    rows = [
        (1, "d", 1, "Item 1", "b1", 1, "Title", "R\u00e9sum\u00e9 \u2014 \u03b1", None, None), (2, "d", 1, "Item 1", "b2", 2, "Table", None, (raw,), None),
        (3, "d", 1, "Item 1", "b3", 3, None, "na\u00efve", None, None), (4, "d", 2, "Item 1", "b4", 1, "List", "\u2022 x", None, None), (5, "d", 11, "Item 1", "b5", 1, "Figure", None, None, "f.png"), (1, "d", 1, "Item 1", "b1", 1, "Title", "R\u00e9sum\u00e9 \u2014 \u03b1", None, None),
    ]
    d = str(tmp_path)
    rows = [(*r, "Acme", "10-K", 2020, None) for r in rows] + [(6, "d", 11, "Item 1", "b6", 2, "Text", "\u2003| 2020 Form 10-K | 7\t", None, None, None, None, None, None)]
    save(spark, d, "filing_records", rows, "rec_id bigint, doc_id string, page int, section string, block_id string, block_order int, block_type string, text string, tbl struct<raw_cells:array<array<string>>>, figure_path string, company string, form string, fiscal_year int, bbox struct<x0:double,top:double,x1:double,bottom:double>")
    pipe = "|  | 2020 |\n|---|---|\n| Caf\u00e9 \\| bar | 1 \u20ac |"
    shown = {1: "### R\u00e9sum\u00e9 \u2014 \u03b1", 2: pipe, 3: "na\u00efve", 4: "\u2022 x", 5: "![Figure, page 11](f.png)"}
    pages = {1: 1, 2: 1, 3: 1, 4: 2, 5: 11}
    chunks = [f"<!-- d p{pages[k]} b{k} -->\n\n{v}" for k, v in shown.items()]
    (got,) = run(spark, "markdown_export", d)
    assert got["markdown"] == "# Acme 10-K FY2020 (d)\n\n## Item 1\n\n" + "\n\n".join(chunks) and got["skipped"] == 1
    assert got["plain"] == "\n\n".join(["R\u00e9sum\u00e9 \u2014 \u03b1", "2020\nCaf\u00e9 | bar 1 \u20ac", "na\u00efve", "\u2022 x"])
    assert {r["rec_id"]: r["shown"] for r in run(spark, "trace_block", d)} == shown | {6: ""}
    assert [r["slice"] for r in run(spark, "markdown_slice", d)] == ["# Acme 10-K FY2020 (d)\n\n" + chunks[4] + "\n"]
    assert {r["section"] for r in run(spark, "carried_title", d)} == {"R\u00e9sum\u00e9 \u2014 \u03b1"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_scores_of_whole_texts(spark, tmp_path):
    texts = ["Caf\u00e9 \u2014 \u201cnet\u201d 1,234\nna\u00efve \U0001d538", "Cafe - \"net\" 1,234 naive \U0001d539", "\u03b1\u03b2 \u0416 12.5% \u2013 7", "\u03b1\u03b3 \u0416 12.5% - 8", ""]
    d = str(tmp_path)
    save(spark, d, "documents", list(enumerate(texts)), "doc_id bigint, text string")
    pairs = {i: (texts[i], texts[i + 1]) for i in range(len(texts) - 1)}
    rate = lambda a, b: distance(a, b) / len(a) if a else float(bool(b))
    assert {r["doc_id"]: r["cer"] for r in run(spark, "char_error_rate", d)} == pytest.approx({i: rate(a, b) for i, (a, b) in pairs.items()})
    assert {r["doc_id"]: r["wer"] for r in run(spark, "word_error_rate", d)} == pytest.approx({i: rate(a.split(), b.split()) for i, (a, b) in pairs.items()})
    plain = lambda x: x.translate(str.maketrans("\u2013\u2014\u2018\u2019\u201c\u201d", "--''\"\""))
    light = lambda x: " ".join(x.lower().split())
    scores = {r["doc_id"]: r for r in run(spark, "ocr_scores", d)}
    for i, (a, b) in pairs.items():
        assert scores[i]["cer"] == pytest.approx(distance(light(a), light(b)) / max(len(light(a)), 1))
        assert scores[i]["cer_typography"] == pytest.approx(distance(light(plain(a)), light(plain(b))) / max(len(light(plain(a))), 1))
    assert scores[0]["cer_typography"] < scores[0]["cer"]
    assert {r["doc_id"]: (r["n_ref"], r["n_found"]) for r in run(spark, "numeric_recall_pairs", d)} == {0: (1, 1), 1: (1, 0), 2: (2, 1), 3: (2, 0)}
    assert {r["doc_id"]: r["num_acc"] for r in run(spark, "number_accuracy_pairs", d)} == {0: 1.0, 1: 0.0, 2: 0.5, 3: 0.0}


def test_dense_grids_and_cache_keys_of_records(spark, tmp_path):
    from hashlib import sha256

    d, raw = str(tmp_path), [["a"], ["b", "c", "d"], []]
    rows = [(1, "s", 3, (raw,)), (1, "s", 3, (raw,)), (2, "t", 4, None)]
    save(spark, d, "filing_records", rows, "rec_id bigint, sha256 string, page int, tbl struct<raw_cells:array<array<string>>>")
    got = sorted((r["rec_id"], r["r"], r["c"], r["cell"]) for r in run(spark, "dense_grid", d))
    assert got == [(1, 0, 0, "a"), (1, 0, 1, ""), (1, 0, 2, ""), (1, 1, 0, "b"), (1, 1, 1, "c"), (1, 1, 2, "d")]
    key = lambda s, p: sha256(f"{s}|p{p}|provider|Analyze|LAYOUT+TABLES".encode()).hexdigest()
    assert sorted(tuple(r) for r in run(spark, "cache_key", d)) == [(1, key("s", 3)), (2, key("t", 4))]
