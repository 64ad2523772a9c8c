"""Operators on small tables: hand-made cases, empty inputs and plain models."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetmill.operators import compare, grid, layout, managed, match, metrics, nested, records, units

BOX = "struct<x0:double,top:double,x1:double,bottom:double>"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# differences between two copies
RULES = {"v": compare.Rule("number", 1e-9), "s": compare.Rule("label")}
SCHEMA = "k bigint, v double, s string, at int, fm_key string, fm_row int"


def test_differences(spark):
    nan = float("nan")
    left = [(1, 1.0, "ok", 1, None, None), (1, 2.0, "ok", 2, None, None), (1, 2.0, "ok", 2, None, None), (2, 1e9, " OK ", 1, None, None), (3, None, None, 1, None, None), (4, nan, "", 1, None, None), (5, 1.0, "x", None, None, None), (None, 1.0, "n", 1, None, None), (7, -0.0, "z", 1, None, None)]
    right = [(1, 2.0, "OK", 1, None, None), (2, 1e9 + 0.5, "ok", 1, None, None), (3, None, "a", 1, None, None), (4, nan, None, 1, None, None), (6, 1.0, "x", 1, None, None), (None, 2.0, "n", 1, None, None), (7, 0.0, "z", 1, None, None)]
    out = compare.diff_copies(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"], RULES, "at", buckets=3)
    got = sorted((r["fm_key"] if r["fm_key"] is not None else -1, r["finding"]) for r in out.collect())
    assert got == [(-1, "v"), (3, "s"), (4, "s"), (5, "missing_in_right"), (6, "missing_in_left")]


def test_differences_empty_and_composite(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, 1.0, "a", 1, "x", 1), (1, 1.0, "a", 1, "y", 1)], SCHEMA)
    assert compare.diff_copies(none, none, ["k"], RULES, "at").count() == 0
    assert rows(compare.diff_copies(some, none, ["k"], RULES, "at"), "fm_key", "finding") == [(1, "missing_in_right")]
    assert {r["finding"] for r in compare.diff_copies(none, some, ["k", "fm_key"], RULES, "at").collect()} == {"missing_in_left"}
    assert compare.diff_copies(none, some, ["k", "fm_key"], RULES, "at").count() == 2


def test_differences_against_pandas(spark):
    rng = random.Random(5)
    make = lambda: pd.DataFrame([{"k": rng.randint(1, 60), "v": rng.choice([1.0, 2.0, None]), "s": rng.choice(["a", "A ", "b", None]), "at": i} for i in range(150)])
    a, b = make(), make()
    out = compare.diff_copies(spark.createDataFrame(a, "k bigint, v double, s string, at int"), spark.createDataFrame(b, "k bigint, v double, s string, at int"), ["k"], RULES, "at", buckets=5)
    x, y = (t.sort_values("at").drop_duplicates("k", keep="last").set_index("k") for t in (a, b))
    want = [(k, "missing_in_right") for k in x.index.difference(y.index)] + [(k, "missing_in_left") for k in y.index.difference(x.index)]
    for k in x.index.intersection(y.index):
        p, q = x.loc[k], y.loc[k]
        if pd.isna(p.v) != pd.isna(q.v) or (not pd.isna(p.v) and p.v != q.v):
            want.append((k, "v"))
        if (p.s is None) != (q.s is None) or (p.s is not None and p.s.strip().lower() != q.s.strip().lower()):
            want.append((k, "s"))
    assert rows(out, "fm_key", "finding") == sorted(want)


# nested records
TBL = "rec_id bigint, p0 int, row_no int, tbl struct<col_names:array<string>,grid_rows:array<array<struct<s:string,n:double>>>,raw_cells:array<array<string>>,scale:map<string,double>,row_kinds:array<string>,method:string,status:string,source_csv:string>"


def test_flatten(spark):
    t = (["label", None], [[("a", None), (None, 1.0), (None, None)], None, []], [["a", None], None], {"money": 1e6}, ["header"], "m", "ok", None)
    bare = (None, None, None, None, ["money", "money"], None, None, None)
    df = spark.createDataFrame([(1, 9, 9, t), (1, 9, 9, t), (2, 9, 9, None), (3, 9, 9, bare)], TBL)
    flat = nested.flatten_statement_tables(df)
    assert rows(flat["cells"], "rec_id", "row_no", "col_no") == [(1, 0, 0), (1, 0, 1)]
    assert rows(flat["tables"], "rec_id", "n_columns") == [(1, 2), (3, None)] or {r["rec_id"] for r in flat["tables"].collect()} == {1, 3}
    assert sorted((r["rec_id"], r["row_no"], r["row_kind"], r["width"]) for r in flat["rows"].fillna(-9, ["width"]).fillna("none", ["row_kind"]).collect()) == [(1, 0, "header", 3), (1, 1, "none", -9), (1, 2, "none", 0), (3, 0, "money", -9), (3, 1, "money", -9)]
    assert rows(flat["printed"], "rec_id", "printed") == [(1, "a")]
    assert rows(flat["scales"], "rec_id", "kind", "factor") == [(1, "money", 1e6)]
    assert flat["columns"].count() == 2
    for name, table in nested.flatten_statement_tables(spark.createDataFrame([], TBL)).items():
        assert table.count() == 0, name
    with pytest.raises(ValueError, match="levels"):
        nested.child_table(df, ["rec_id"], "tbl.grid_rows[][]", ["r"], {})


# units
def test_choose_meanings_follows_the_identity():
    m = units.choose_meanings([("M", "one", 3.0, 50), ("thousand", "one", 3.0, 50), ("m", "one", 6.0, 40), ("m", "one", 3.0, 2)])
    assert m.printed["M"] == 1e3 and m.printed["m"] == 1e6
    assert "printed mm" in m.open_symbols and "printed M" not in m.open_symbols
    assert units.choose_meanings([]).printed["m"] == 1e6


def test_choose_meanings_tries_every_combination():
    m = units.choose_meanings([("m", "m", 0.0, 100), ("m", "one", 3.0, 1)])
    assert (m.printed["m"], m.tagged["m"]) == (1e3, 1e3) and not {"printed m", "tagged m"} & set(m.open_symbols)
    tie = units.choose_meanings([("m", "m", 0.0, 100)])
    assert (tie.printed["m"], tie.tagged["m"]) == (1e6, 1e6) and {"printed m", "tagged m"} <= set(tie.open_symbols)
    noisy = units.choose_meanings([("mm", "mm", 0.3, 7), ("M", "one", 5.7, 3)])
    assert (noisy.printed["mm"], noisy.tagged["mm"], noisy.printed["M"]) == (1e6, 1e6, 1e6)


def test_a_source_means_its_own_units(spark):
    common = units.choose_meanings([("m", "one", 6.0, 5000)])
    assert units.departures([("m", "one", 3.0, 60), ("m", "one", 6.0, 3)], common) == [("printed", "m", 1e3)]
    assert units.departures([("m", "one", 3.0, 19)], common) == [] and units.departures([("m", "one", 3.0, 60), ("m", "one", 6.0, 40)], common) == []
    assert units.departures([], common) == []
    raw = [["", "2020, US$ m"], *[[f"Item {i}", f"{i + 1}.5"] for i in range(40)]]
    recs = spark.createDataFrame([(k, str(k), 1, 1, "Table", None, (raw, None, None), None) for k in (1, 2)], REC)
    facts = spark.createDataFrame([(100 * k + i, k, i + 1, 1, (i + 1.5) * (1e3 if k == 2 else 1e6) * (1000 if i == 7 else 1), "USD", None) for k in (1, 2) for i in range(40)], FACT)
    r = units.cell_facts(recs, facts, "doc_id")
    chosen = units.Meanings(common.printed, common.tagged, ())
    out = units.convert(r, chosen, of_sources=units.source_meanings(r, chosen))
    assert {x["fact_id"] for x in out.filter("differs").collect()} == {107, 207}
    assert units.source_meanings(r.limit(0), chosen).count() == 0


REC = "rec_id bigint, doc_id string, page int, block_order int, block_type string, text string, tbl struct<raw_cells:array<array<string>>,scale:map<string,double>,row_kinds:array<string>>, said string"
FACT = "fact_id bigint, rec_id bigint, row_no int, col_no int, fact_value double, unit string, kind string"


def test_units(spark):
    raw = [["", "2020, $m"], ["Net sales", "(1.5)"], ["Shares (thousands)", "7"], ["EPS", "3¢"], ["Growth rate", "4%"], ["Debt, in thousands", "5"], ["Cash", "6 bn"], ["Blank", ""]]
    kinds = ["header", "money", "shares", "per_share", "money", "money", "money", "money"]
    text = "Prose.\n(Dollars in thousands, shares in millions, per-share amounts in cents)"
    recs = [(1, "d", 1, 2, "Table", None, (raw, None, kinds), None), (1, "d", 1, 2, "Table", None, (raw, None, kinds), None), (2, "d", 2, 1, "Text", text, None, None), (3, "d", 2, 2, "Table", None, ([["", "2020"], ["A", "1"], ["B shares", "2"], ["C per share", "3"]], {}, ["header", "money", "shares", "per_share"]), None), (4, "d", 3, 1, "Table", None, ([["", "x"], ["A", "1"]], {"money": 1e6}, None), None), (6, "d", 4, 1, "Table", None, ([["", "x"], ["A", "2"]], {"money": 1e4}, None), None), (5, None, None, None, None, None, None, None)]
    good = [(1, 1, 1, 1, -1.5, "USDm"), (2, 1, 2, 1, 7000.0, "shares"), (3, 1, 3, 1, 3.0, "cents/share"), (4, 1, 4, 1, 400.0, "bps"), (5, 1, 5, 1, 5.0, "kUSD"), (6, 1, 6, 1, 6e9, None), (7, 1, 7, 1, 1.0, "USD"), (8, 3, 1, 1, 1000.0, "usd"), (9, 3, 2, 1, 2e6, "shares"), (10, 3, 3, 1, 0.03, "USD/share"), (11, 4, 1, 1, 1.0, "USDm"), (15, 6, 1, 1, 20.0, "kUSD"), (12, 1, 99, 1, 1.0, "USD"), (13, None, None, None, 1.0, "USD"), (14, 9, 0, 0, 1.0, "USD")]
    facts = spark.createDataFrame([(*g, None) for g in good + [(20, 1, 1, 1, 1.5, "USDm"), (21, 1, 5, 1, 5.1, "kUSD"), (21, 1, 5, 1, 5.1, "kUSD")]], FACT)
    r = units.cell_facts(spark.createDataFrame(recs, REC), facts)
    out = {x["fact_id"]: x for x in units.convert(r, units.meanings(r)).collect()}
    assert {k for k, x in out.items() if x["differs"]} == {20, 21}
    assert out[7]["differs"] is None and set(out) == {*range(1, 12), 15, 20, 21}
    assert [out[i]["stated_in"] for i in (1, 2, 3, 5, 6, 8, 11)] == ["column", "row", "cell", "row", "cell", "text", "scale"]
    none = units.cell_facts(spark.createDataFrame([], REC), spark.createDataFrame([], FACT))
    assert units.convert(none, units.meanings(none)).count() == 0


def test_all_amounts_hold_every_cell_and_every_fact(spark):
    raw = [["($000s)", "2020", "2021, $m"], ["Net sales (1)", "(1.5)", "2"], ["Shares", "7", "—"], ["Debt", "n/a", "5 bn"]]
    kinds = ["header", "money", "shares", "money"]
    late = [["", "x"], ["A", "1"], ["", "y, in thousands"], ["B", "2"]]
    recs = [(1, "d", 1, 1, "Table", None, (raw, None, kinds), None), (1, "d", 1, 1, "Table", None, (raw, None, kinds), None), (2, "d", 2, 1, "Table", None, (late, {"money": 1e6}, ["header", "money", "header", "money"]), None), (3, "d", 3, 1, "Table", None, ([["", "z"], ["C", "3", "4"]], {}, None), None), (4, "d", 4, 1, "Text", "t", None, None)]
    facts = [(1, 1, 1, 2, 2.0, "USDm"), (1, 1, 1, 2, 2.0, "USDm"), (2, 1, 1, 1, 9.0, "kUSD"), (3, None, None, None, 5.0, "USDm"), (4, 1, 99, 1, 6.0, "bps"), (5, 9, 0, 0, 7.0, None), (6, 2, None, 1, 8.0, "kUSD")]
    rec, fact = spark.createDataFrame(recs, REC), spark.createDataFrame([(*f, None) for f in facts], FACT)
    r = units.all_amounts(rec, fact)
    out = units.convert(r, units.meanings(r)).collect()
    cells = {(x["rec_id"], x["row_no"], x["col_no"]): x for x in out if x["printed"] is not None}
    assert set(cells) == {(1, i, j) for i in range(4) for j in range(3)} | {(2, i, j) for i in range(4) for j in range(2)} | {(3, 0, 0), (3, 0, 1), (3, 1, 0), (3, 1, 1), (3, 1, 2)}
    amounts = {k: x["printed_amount"] for k, x in cells.items() if x["printed_amount"] is not None}
    assert amounts == {(1, 1, 1): -1500.0, (1, 1, 2): 2e6, (1, 2, 1): 7.0, (1, 2, 2): 0.0, (1, 3, 2): 5e9, (2, 1, 1): 1e6, (2, 3, 1): 2000.0, (3, 1, 1): 3.0, (3, 1, 2): 4.0}
    assert [cells[k]["stated_in"] for k in ((1, 1, 1), (1, 1, 2), (1, 3, 2), (2, 1, 1), (2, 3, 1), (3, 1, 1))] == ["corner", "column", "cell", "scale", "column", "none"]
    tagged = {x["fact_id"]: x for x in out if x["fact_id"] is not None}
    assert {k: x["fact_amount"] for k, x in tagged.items()} == pytest.approx({1: 2e6, 2: 9000.0, 3: 5e6, 4: 6e-4, 5: 7.0, 6: 8000.0})
    assert {k: x["differs"] for k, x in tagged.items()} == {1: False, 2: True, 3: None, 4: None, 5: None, 6: None}
    assert len(out) == len(cells) + 4 and all(x["unit_open"] is not None for x in out)
    pairs = units.cell_facts(rec, fact)
    same = ["fact_id", "kind", "printed", "printed_amount", "fact_amount", "differs", "stated_in", "unit_open"]
    assert sorted(str([x[c] for c in same]) for x in units.convert(pairs, units.meanings(r)).distinct().collect()) == sorted(str([x[c] for c in same]) for x in out if x["fact_id"] in (1, 2))


# grids
def long(spark, table):
    return spark.createDataFrame([("t", r, c, v) for r, row in enumerate(table) for c, v in enumerate(row)], "t string, r int, c int, cell string")


def back(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["r"], {})[r["c"]] = r["cell"]
    return [[row[c] for c in sorted(row)] for _, row in sorted(out.items())]


STATEMENT = [["", "$", "2020", "x"], ["Common stock, par;", "", "", ""], ["shares issued", "$", "9", "x"], ["", "", "", ""], ["Sales,", "", "", ""], ["Net", "", "5", "x"], ["Earnings per share:", "", "", ""], ["Basic", "$", "1.5", "x"]]


def test_clean_and_merge(spark):
    clean = grid.clean_grid(long(spark, STATEMENT), ["t"])
    assert back(clean)[0] == ["", "2020"] and len(back(clean)) == 7
    merged = back(grid.merge_wrapped_labels(clean, ["t"]))
    assert merged[1] == ["Common stock, par; shares issued", "9"] and ["Sales,", ""] in merged
    assert grid.merge_wrapped_labels(grid.clean_grid(long(spark, STATEMENT).limit(0), ["t"]), ["t"]).count() == 0


def test_row_kinds(spark):
    kinds = {r["r"]: r["row_kind"] for r in grid.classify_rows(grid.clean_grid(long(spark, STATEMENT), ["t"]), ["t"]).collect()}
    assert [kinds[i] for i in sorted(kinds)] == ["header", "header", "money", "header", "money", "header", "per_share"]


def test_acceptance(spark):
    c = spark.createDataFrame([("a", 0, 1, True, 70.0, 9), ("a", 1, 2, True, 85.0, 4), ("a", 1, 3, True, 90.0, 4), ("b", 0, 1, True, 70.0, 9), ("b", 1, 2, False, 99.0, 9), ("c", 0, 1, False, 99.0, 1)], "k string, rank int, seq int, valid_shape boolean, score double, cells int")
    assert sorted((r["k"], r["decision"], r["seq"] or 0) for r in grid.accept_in_order(c, ["k"]).collect()) == [("a", "accepted", 3), ("b", "best_below_threshold", 1), ("c", "no_valid_table", 0)]


def test_dense(spark):
    s = spark.createDataFrame([("t", 1, 2, "a", 0), ("t", 1, 2, "b", 1), ("t", 2, 1, "c", 2)], "t string, row int, col int, cell string, seq int")
    assert back(grid.dense_grid(s, ["t"])) == [["", "b"], ["c", ""]]


# layout
def boxes(spark, items):
    return spark.createDataFrame([(1, i, t, s, b) for i, (t, s, b) in enumerate(items)], f"page int, seq int, type string, score double, bbox {BOX}")


def test_greedy_boxes_against_plain_model(spark):
    rng = random.Random(8)
    size = lambda b: max(b[2] - b[0], 0) * max(b[3] - b[1], 0)
    cut = lambda a, b: max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    for _ in range(4):
        items = []
        for _ in range(14):
            x, y = rng.uniform(0, 60), rng.uniform(0, 60)
            items.append((rng.choice(["Text", "Table"]), round(rng.uniform(0.1, 1), 3), (x, y, x + rng.uniform(5, 50), y + rng.uniform(5, 50))))
        got = {r["seq"] for r in layout.filter_boxes(boxes(spark, items), ["page"]).collect()}
        kept = []
        for i, (t, s, b) in sorted(((i, it) for i, it in enumerate(items) if it[1] >= 0.25), key=lambda z: -z[1][1]):
            if min(sum(cut(b, items[k][2]) for k in kept if items[k][0] == t), size(b)) / size(b) < 0.6:
                kept.append(i)
        want = {i for i in kept if items[i][0] == "Table" or min(sum(cut(items[i][2], items[k][2]) for k in kept if items[k][0] == "Table" and items[k][1] >= items[i][1]), size(items[i][2])) / size(items[i][2]) < 0.8}
        assert got == want


def test_reading_order(spark):
    items = [("Title", 1, (0, 0, 100, 10)), ("Text", 1, (0, 20, 45, 80)), ("Text", 1, (55, 15, 100, 50)), ("Text", 1, (55, 55, 100, 90)), ("Text", 1, (0, 95, 100, 99))]
    df = boxes(spark, [(t, float(s), tuple(map(float, b))) for t, s, b in items]).withColumn("width", F.lit(100.0))
    assert [r["seq"] for r in layout.reading_order(df, ["page"]).orderBy("position").collect()] == [0, 1, 2, 3, 4]


def test_words(spark):
    w = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 8.0, "left"), (1, 12.0, 1.0, 20.0, 9.0, "side"), (1, 60.0, 0.0, 70.0, 8.0, "right"), (1, 0.0, 12.0, 10.0, 20.0, "below"), (1, 90.0, 90.0, 91.0, 91.0, "1")], "page int, x0 double, top double, x1 double, bottom double, text string")
    assert layout.text_of_blocks(w, ["page"]).head()["text"] == "left side\nright\nbelow\n1"
    assert [r["text"] for r in layout.fallback_blocks(w, ["page"]).orderBy("seq").collect()] == ["left side below", "right"]
    assert layout.fallback_blocks(w.limit(0), ["page"]).count() == 0


def test_words_in_crossing_columns(spark):
    words = [("a1", 0, 0.4), ("a2", 30, 0.6), ("b1", 200, 2.0), ("b2", 232, 1.0), ("a3", 0, 9.0), ("a4", 28, 9.4), ("b3", 205, 9.0), ("far", 300, 60.0)]
    w = spark.createDataFrame([(p, float(x), y, x + 20.0, y + 6, t) for p in (1, 2) for t, x, y in words], "page int, x0 double, top double, x1 double, bottom double, text string")
    assert {r["page"]: r["text"] for r in layout.text_of_blocks(w, ["page"]).collect()} == dict.fromkeys((1, 2), "a1 a2\nb2\nb1\na3 a4\nb3\nfar")
    got = [(r["seq"], r["text"], r["bbox"]["x0"], r["bbox"]["bottom"]) for r in layout.fallback_blocks(w, ["page"]).filter("page = 1").orderBy("seq").collect()]
    assert got == [(1, "a1 a2 a3 a4", 0.0, 15.4), (2, "b1 b3", 200.0, 15.0), (3, "far", 300.0, 66.0)]


# matching
def test_reconcile(spark):
    day = lambda s: pd.Timestamp(s).date()
    facts = spark.createDataFrame([("d", 1, "Sales", 100.0, "0", False, day("2020-01-01"), day("2020-12-31"), "{}"), ("d", 2, "Cash", 7.0, "0", True, None, day("2020-12-31"), "{}"), ("d", 3, "Cash", 5.0, "0", True, None, day("2019-12-30"), "{}"), ("d", 4, "Buy", 30.0, "0", False, day("2020-01-01"), day("2020-12-31"), "{}")], "doc_id string, seq bigint, concept string, fact_value double, decimals string, instant boolean, start_date date, end_date date, dims_key string")
    labels = spark.createDataFrame([("Sales", "label", "Net sales", "duration"), ("Cash", "label", "Cash", "instant"), ("Cash", "label", "Cash, beginning of year", "instant"), ("Buy", "negatedLabel", "Purchases", "duration"), ("A", "label", "Twin", "duration"), ("B", "label", "Twin", "duration")], "concept string, label_role string, label string, period_type string")
    lines = [("Net sales", "income", 0.1), ("Net sale", "income", 100.0), ("Cash", "balance", 7.0), ("Cash, beginning of year", "cash_flows", 5.0), ("Purchases", "cash_flows", -30.0), ("Twin", "income", 1.0), ("Unknown thing", "income", 1.0)]
    cells = spark.createDataFrame([("d", "p", 1, s, lab, 1, 2020, v) for lab, s, v in lines], "doc_id string, path string, page int, statement string, label string, occurrence int, year int, value double")
    got = {r["label"]: (r["status"], r["map_method"]) for r in match.reconcile(match.map_labels(cells, labels), facts).collect()}
    assert got == {"Net sales": ("scale_x0.001", "linkbase"), "Net sale": ("match", "fuzzy:net sales"), "Cash": ("match", "linkbase"), "Cash, beginning of year": ("match", "linkbase"), "Purchases": ("match_negated", "linkbase"), "Twin": ("unmapped", "ambiguous:A|B"), "Unknown thing": ("unmapped", "none")}
    curated = spark.createDataFrame([("income", "twin", None, ["X", "Sales"], "{}", None)], "statement string, label string, occurrence int, concepts array<string>, dims_key string, negate boolean")
    row = match.reconcile(match.map_labels(cells.filter("label = 'Twin'"), labels, curated), facts).head()
    assert (row["concept"], row["map_method"], row["status"]) == ("Sales", "curated", "mismatch")
    summary = {r["statement"]: r for r in match.summarize(match.reconcile(match.map_labels(cells, labels), facts)).collect()}
    assert summary["ALL"]["numbers"] == 7 and summary["ALL"]["mapped"] == 5 and summary["ALL"]["status_counts"]["unmapped"] == 2


def test_reconcile_keeps_equal_cells_and_lost_lines(spark):
    labels = spark.createDataFrame([("Sales", "label", "Net sales", "duration")], "concept string, label_role string, label string, period_type string")
    day = lambda s: pd.Timestamp(s).date()
    facts = spark.createDataFrame([("d", 1, "Sales", 100.0, "0", False, day("2020-01-01"), day("2020-12-31"), "{}")] * 2, "doc_id string, seq bigint, concept string, fact_value double, decimals string, instant boolean, start_date date, end_date date, dims_key string")
    cells = spark.createDataFrame([("d", "p", "income", "Net sales", 2020, 100.0, 1)] * 3 + [("d", "q", "income", None, 2020, 1.0, 2)], "doc_id string, path string, statement string, label string, year int, value double, cell_id bigint")
    out = match.reconcile(match.map_labels(cells, labels), facts)
    assert rows(out, "path", "status") == [("p", "match")] * 3 + [("q", "unmapped")]
    keyed = match.reconcile(match.map_labels(cells.distinct(), labels), facts, ["cell_id", "path"])
    assert rows(keyed, "cell_id", "status", "period_end") == [(1, "match", day("2020-12-31")), (2, "unmapped", None)] and keyed.columns == out.columns
    lost = match.lost_lines(keyed, ["p", "q"], ["doc_id", "statement", "concept", "period_end"], "cell_id")
    assert rows(lost, "path", "cell_id", "status") == [("q", 1, "pdf_missing")]


# metrics
def test_percentiles(spark):
    rng = random.Random(4)
    data = [(k, rng.choice([None, 1.0, 2.5, rng.random()])) for k in "abc" for _ in range(rng.randint(1, 60))] + [("z", None)]
    got = {r["k"]: (r["p50"], r["p95"]) for r in metrics.percentiles(spark.createDataFrame(data, "k string, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    frame = pd.DataFrame(data, columns=["k", "v"]).dropna().groupby("k").v
    assert got == {k: (pytest.approx(x), pytest.approx(y)) for k, x, y in zip(frame.groups, frame.quantile(0.5), frame.quantile(0.95), strict=True)}


def test_drift_upper_median(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 3, 4)] + [("b", n) for n in (9, 7, 8)], "k string, n int")
    assert rows(metrics.drift(df, ["k"], "n"), "k", "n", "median", "share_short", "total") == [("a", 4, 3, 1.0, 10), ("b", 3, 8, 0.0, 24)]


def test_numeric_recall(spark):
    df = spark.createDataFrame([(1, "1 1 2", "1 2 2"), (2, "none", "3")], "k int, a string, b string")
    assert [(r["k"], r["numeric_recall"]) for r in metrics.numeric_recall(df, ["k"], "a", "b").orderBy("k").collect()] == [(1, pytest.approx(2 / 3)), (2, None)]


def test_scores_fail_when_broken(spark):
    gt = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, value double").withColumn("g", F.lit(1))
    assert metrics.cell_scores(gt, gt, ["g", "k"], ["g"]).head()["f1"] == 1.0
    assert metrics.cell_scores(gt, gt.withColumn("value", -F.col("value")), ["g", "k"], ["g"]).head()["f1"] == 0.0


# responses and records
def test_response_graph(spark):
    blocks = [("T", "TABLE", None, None, None, 90.0, ["c1", "gone", "c2"]), ("c1", "CELL", 1, 1, None, 80.0, ["w1", "w2"]), ("c2", "CELL", 2, 2, None, 70.0, ["s"]), ("w1", "WORD", None, None, "Net", 1.0, []), ("w2", "WORD", None, None, "sales", 1.0, []), ("s", "SELECTION_ELEMENT", None, None, "SELECTED", 1.0, [])]
    df = spark.createDataFrame([("k", i, t, r, c, x, f, (0.0, 0.0, 1.0, 1.0), ch) for i, t, r, c, x, f, ch in blocks], f"cache_key string, id string, type string, row int, col int, text string, confidence double, box {BOX}, child_ids array<string>")
    cells = managed.cells(df, ["cache_key"])
    assert back(grid.dense_grid(cells, ["cache_key", "id"])) == [["Net sales", ""], ["", "[X]"]]
    req = spark.createDataFrame([("k", 1), ("z", 2)], "cache_key string, n int")
    hits = managed.lookup(req, df.select("cache_key").distinct(), F.lit(False))
    assert rows(hits, "n", "status") == [(1, "hit"), (2, "miss_disabled")]
    assert managed.insert_new(req, spark.createDataFrame([("k", 9), ("y", 4), ("y", 3)], "cache_key string, n int"), "cache_key", "n").count() == 3


def test_triggers(spark):
    df = spark.createDataFrame([(None, None, 80.0, "x"), ("accepted", 50.0, None, "x"), ("accepted", 99.0, 60.0, " "), ("accepted", 99.0, 90.0, "x")], "st string, sc double, conf double, t string")
    got = [(r[0], r[1]) for r in df.select(managed.table_trigger(F.col("st"), F.col("sc")), managed.text_trigger(F.col("conf"), F.col("t"))).collect()]
    assert got == [("status:none", None), ("low_score", "low_confidence"), (None, "ocr_empty"), (None, None)]


def test_item_headings(spark):
    b = spark.createDataFrame([(1, 1, "Title", (0.0, 0.0, 20.0, 10.0), "Item"), (1, 2, "Title", (25.0, 1.0, 90.0, 11.0), "16. Summary"), (1, 3, "Text", (0.0, 20.0, 50.0, 30.0), "Item 7 - Analysis\nmore"), (1, 4, "Table", (0.0, 40.0, 50.0, 50.0), "Item 8. no")], f"page int, seq int, type string, bbox {BOX}, text string")
    assert sorted((r["seq"], r["item"], r["heading"], r["fragment_seq"] or 0) for r in records.item_headings(b, ["page"]).collect()) == [(2, "Item 16", "Item 16. Summary", 1), (3, "Item 7", "Item 7 - Analysis", 0)]


def test_headings_in_the_export(spark):
    blocks = [(1, "Title", "Cover", (0, 0, 9, 9)), (2, "Title", "Item", (0, 20, 20, 30)), (3, "Title", "2. Properties", (25, 21, 90, 31)), (4, "Text", "plants", (0, 40, 9, 50)), (5, "Title", "Item 3 – Suits\nnone", (0, 60, 9, 70)), (6, "Text", "later", (0, 80, 9, 90)), (7, "Text", "Item 2. Properties, again", (0, 100, 9, 110)), (8, "Text", "end", (0, 120, 9, 130))]
    df = spark.createDataFrame([("d", 1, i, f"b{i}", t, x, tuple(map(float, b)), "old", None, None) for i, t, x, b in blocks], f"doc_id string, page int, block_order int, block_id string, block_type string, text string, bbox {BOX}, section string, tbl struct<raw_cells:array<array<string>>>, figure_path string")
    h = records.with_headings(df, ["doc_id"], ["page", "block_order"], "block_order")
    assert rows(h, "block_order", "section", "is_heading", "is_fragment") == [(1, "old", False, False), (2, "Item 2", False, True), (3, "Item 2", True, False), (4, "Item 2", False, False), (5, "Item 3", True, False), (6, "Item 3", False, False), (7, "Item 2", False, False), (8, "Item 2", False, False)]
    md = records.documents_of(records.fragments(h, ["doc_id"], ["page", "block_order"]), ["doc_id"], ["page", "block_order"]).head()["markdown"]
    at = lambda i: f"<!-- d p1 b{i} -->"
    assert md == "\n\n".join(["## old", at(1), "### Cover", at(3), "## Item 2. Properties", at(4), "plants", at(5), "## Item 3 – Suits", at(6), "later", "## Item 2. Properties", at(7), "Item 2. Properties, again", at(8), "end"])
    assert records.with_headings(df.limit(0), ["doc_id"], ["page", "block_order"], "block_order").count() == 0


def test_markdown_slice(spark):
    md = "# T\n\n## A\n\n<!-- d p1 b1 -->\n\none\n\n## B\n\n<!-- d p2 b2 -->\n\ntwo\n\n<!-- d p3 b3 -->\n\nthree\n"
    cut = lambda text, low, high: records.slice_pages(spark.createDataFrame([("d", text)], "d string, m string"), ["d"], "m", low, high).head()["slice"]
    assert cut(md, 2, 2) == "# T\n\n## B\n\n<!-- d p2 b2 -->\n\ntwo\n"
    assert cut(md, 1, 2) == "# T\n\n## A\n\n<!-- d p1 b1 -->\n\none\n\n## B\n\n<!-- d p2 b2 -->\n\ntwo\n" and cut(md, 7, 9) == "# T\n"
    twice = "x\n\n## A\n\n## B\n\n<!-- d p2 b2 -->\n\ny\n\n## C\n\n<!-- d p3 b3 -->"
    assert cut(twice, 2, 2) == "x\n\n## B\n\n<!-- d p2 b2 -->\n\ny\n\n## C\n" and cut("", 1, 9) == "\n"
    assert records.slice_pages(spark.createDataFrame([], "d string, m string"), ["d"], "m", 1, 2).count() == 0
    assert spark.createDataFrame([(md,)], "m string").select(records.trace(F.col("m"), F.lit("b2"))).head()[0] == "two"


def test_search_blank(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], "id int, text string")
    assert records.search(df, " ", ["id"], ["id"]).count() == 0
    assert [r["id"] for r in records.search(df, "TEXT", ["id"], ["id"]).collect()] == [1]


def test_response_blocks(spark):
    items = [("t1", "TABLE", (0.1, 0.1, 0.9, 0.4), ["c1"]), ("c1", "CELL", (0.1, 0.1, 0.5, 0.2), ["w1"]), ("w1", "WORD", (0.1, 0.1, 0.2, 0.2), []), ("l1", "LINE", (0.1, 0.5, 0.9, 0.6), []), ("a", "LAYOUT_TEXT", (0.1, 0.5, 0.9, 0.6), ["l1"]), ("b", "LAYOUT_TABLE", (0.1, 0.1, 0.9, 0.35), []), ("c", "LAYOUT_TABLE", (0.1, 0.1, 0.9, 0.4), []), ("d", "LAYOUT_TABLE", (0.1, 0.8, 0.9, 0.9), [])]
    df = spark.createDataFrame([("k", i, n, t, 1, 1, "x", 80.0, b, ch) for n, (i, t, b, ch) in enumerate(items)], f"cache_key string, id string, seq int, type string, row int, col int, text string, confidence double, box {BOX}, child_ids array<string>")
    got = [(r["n"], r["type"], r["text"], r["table_id"]) for r in managed.response_blocks(df, ["cache_key"], F.lit(100.0), F.lit(200.0)).orderBy("n").collect()]
    assert got == [(1, "Text", "x", None), (2, "Table", None, "t1"), (3, "Text", "", None)]
    lines = managed.response_blocks(df.filter("type = 'LINE'"), ["cache_key"], F.lit(100.0), F.lit(200.0)).collect()
    assert [(r["type"], r["text"]) for r in lines] == [("Text", "x")]


def test_below_threshold(spark):
    t = spark.createDataFrame([(1, 1, "no_valid_table", (0.0, 0.0, 10.0, 10.0)), (1, 2, "accepted", (0.0, 0.0, 10.0, 10.0)), (1, 3, "no_valid_table", (50.0, 50.0, 60.0, 60.0)), (2, 4, "no_valid_table", (0.0, 0.0, 1.0, 1.0))], f"page int, seq int, status string, bbox {BOX}").withColumn("method", F.lit("m")).withColumn("score", F.lit(1.0))
    f = spark.createDataFrame([(1, 7, (2.0, 0.0, 12.0, 10.0)), (1, 6, (2.0, 0.0, 12.0, 10.0)), (1, 8, (58.0, 50.0, 70.0, 60.0))], f"page int, seq int, bbox {BOX}")
    assert rows(managed.below_threshold(t, f, ["page"]).fillna(0), "seq", "overlap", "found_seq") == [(1, 0.8, 6), (3, 0.2, 0), (4, 0.0, 0)]


def test_import_guards(spark):
    cols = "cache_key string, source_sha256 string, pages int, api string, features string"
    inc = spark.createDataFrame([("n", "s", 1, "A", "TABLES,layout"), ("o", "s", 1, "A", "LAYOUT+TABLES"), ("m", None, 1, "A", "X"), ("u", "z", 1, "A", "X"), ("p", "s", 2, "A", "X"), ("q", "s", 1, "B", "X"), ("f", "s", 1, "A", "FORMS")], cols)
    ok, bad = managed.import_checked(inc, spark.createDataFrame([("s",)], "source_sha256 string"), spark.createDataFrame([("o",)], "cache_key string"), "A", "LAYOUT+TABLES")
    assert [r["cache_key"] for r in ok.collect()] == ["n"]
    assert {r["cache_key"]: r["reason"] for r in bad.collect()} == {"o": "kept_old", "m": "no_meta", "u": "unknown_source", "p": "not_one_page", "q": "other_api", "f": "other_features"}


def test_replacement(spark):
    recs = spark.createDataFrame([(1, "accepted", 10.0, False, "old", None), (2, None, None, True, "", 99.0), (3, None, None, True, "fine", 90.0), (4, None, None, True, "low", None)], "id int, status string, score double, ocr boolean, text string, confidence double")
    hits = spark.createDataFrame([(1, "new", 95.0), (2, " ", 95.0), (3, "new", 95.0)], "id int, hit_text string, hit_confidence double")
    got = {r["id"]: (r["text"], r["trigger"], r["used"]) for r in managed.replaced(recs, hits, ["id"]).collect()}
    assert got == {1: ("new", "low_score", True), 2: ("", "ocr_empty", False), 3: ("fine", None, False), 4: ("low", "low_confidence", False)}
