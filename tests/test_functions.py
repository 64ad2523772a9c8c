"""Column functions against tables of cases and plain Python models."""

import random

import pytest
from pyspark.sql import functions as F

from facetmill.functions import geometry, numbers, text

CELLS = [
    ("12", 12.0, "num"), ("+0.5", 0.5, "num"), (".75", 0.75, "num"), ("8.", 8.0, "num"), ("90,210.4", 90210.4, "num"), ("$3", 3.0, "num"), ("$ 44,001", 44001.0, "num"), ("2.5e3", 2500.0, "num"),
    ("(17)", -17.0, "num"), ("(9.1", -9.1, "num"), ("$(6)", -6.0, "num"), ("−88", -88.0, "num"), ("–7", -7.0, "num"), ("(2)", -2.0, "num"), ("—", 0.0, "num"), ("−", 0.0, "num"), (" - ", 0.0, "num"),
    ("55(2)", 55.0, "num"), ("55 (b)", 55.0, "num"), ("55**", 55.0, "num"), ("55[12]", 55.0, "num"), ("(55)(3)", -55.0, "num"), ("3%", 3.0, "pct"), ("(0.4%)", -0.4, "pct"), ("7 %", 7.0, "pct"),
    ("\xa06,500", 6500.0, "num"), ("6,500\t", 6500.0, "num"), ("\n(5)\u2003", -5.0, "num"), ("\u3000-\x0b", 0.0, "num"), ("  ", None, "num"), ("*", None, "num"), ("%", None, "num"), ("Total", None, "num"),
    ("infinity", None, "num"), ("NaN", None, "num"), ("5_0", None, "num"), ("1d", None, "num"), ("1.2.3", None, "num"), ("FY 2020", None, "num"), (None, None, None),
]


def test_to_number(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(CELLS)], "i int, c string")
    got = {r["i"]: r["n"] for r in df.select("i", numbers.to_number(F.col("c")).alias("n")).collect()}
    for i, (cell, value, unit) in enumerate(CELLS):
        assert got[i]["value"] == value, cell
        if cell is not None:
            assert got[i]["unit"] == unit, cell


def test_compare_value(spark):
    rows = [(5.0, 5.4, "0", False, "match"), (-5.0, 5.0, "2", True, "match_negated"), (-5.0, 5.0, "2", False, "sign"), (5000.0, 5.0, "2", False, "scale_x1000"), (5e-6, 5.0, "9", False, "scale_x1e-06"), (7.0, 5.0, "2", False, "mismatch"), (5.0, 5.0, "INF", False, "match"), (5.1, 5.0, None, False, "mismatch")]
    df = spark.createDataFrame(rows, "v double, f double, d string, n boolean, want string")
    for r in df.select("want", numbers.compare_value(F.col("v"), F.col("f"), F.col("d"), F.col("n"))["status"].alias("got")).collect():
        assert r["got"] == r["want"]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates(spark):
    rng = random.Random(3)
    pairs = [(" ".join(rng.choices("ab cd é fg h".split(), k=rng.randint(0, 12))), " ".join(rng.choices("ab cd é fg h".split(), k=rng.randint(0, 12)))) for _ in range(150)] + [("", ""), ("", "a"), ("a", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", text.word_error_rate(F.col("a"), F.col("b")).alias("w"), text.char_error_rate(F.col("a"), F.col("b")).alias("c")).collect():
        for got, a, b in ((r["w"], r["a"].split(), r["b"].split()), (r["c"], r["a"], r["b"])):
            want = plain_distance(a, b) / len(a) if a else float(bool(b))
            assert got == pytest.approx(want)


def test_normal_forms(spark):
    df = spark.createDataFrame([("Ｎｅｔ Sales – “$5”",), ("Gross margin: (1)",)], "t string")
    got = [r[0] for r in df.select(text.normal_text(F.col("t"))).collect()]
    assert got == ['net sales - " $ 5"', "gross margin: (1)"]
    assert spark.createDataFrame([("Net sales:: ",)], "t string").select(text.label_normal(F.col("t"))).head()[0] == "net sales"


def test_snippet_and_markdown(spark):
    df = spark.createDataFrame([("x" * 100 + "Needle" + "y" * 100,), ("needle",)], "t string")
    a, b = (r[0] for r in df.select(text.snippet(F.col("t"), F.lit("needle"), 5)).collect())
    assert a == "...xxxxxNeedleyyyyy..." and b == "needle..."
    md = spark.createDataFrame([("# T\n|a|b|\n|---|---|\n![i](p)[l](u) **x**<!-- c -->",)], "t string").select(text.markdown_to_text(F.col("t"))).head()[0]
    assert md == "T\n a b \n l x "


def test_boxes(spark):
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 20.0, 8.0)), ((0.0, 0.0, 10.0, 10.0), (10.0, 0.0, 20.0, 10.0)), ((0.0, 0.0, 10.0, 10.0), (None, 0.0, 20.0, 10.0))], "a struct<x0:double,top:double,x1:double,bottom:double>, b struct<x0:double,top:double,x1:double,bottom:double>")
    got = [(r[0], r[1]) for r in df.select(geometry.intersection(F.col("a"), F.col("b")), geometry.overlap_of_smaller(F.col("a"), F.col("b"))).collect()]
    assert got == [(15.0, pytest.approx(15 / 45)), (0.0, 0.0), (None, 0.0)]
    flipped = df.limit(1).select(geometry.flip(F.col("b"), F.lit(18.0), F.lit(100.0)).alias("f")).head()["f"]
    assert tuple(flipped) == (5.0, 92.0, 18.0, 95.0)


def test_edit_distance_of_any_size():
    rng = random.Random(11)
    for _ in range(300):
        a, b = (tuple(rng.choices(range(rng.choice([2, 30, 900])), k=rng.choice([0, 1, 7, 31, 64, 130]))) for _ in range(2))
        assert text.edit_distance(a, b) == plain_distance(a, b)
    many = [f"w{i}" for i in range(50_000)]
    assert text.edit_distance(many, many[1:50] + ["x"] + many[50:20_000]) == 30_002


def test_match_ratio(spark):
    from difflib import SequenceMatcher

    rng = random.Random(2)
    pairs = [("".join(rng.choices("abcde ", k=rng.randint(0, 12))), "".join(rng.choices("abcde ", k=rng.randint(0, 12)))) for _ in range(200)] + [(None, "a"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", text.match_ratio(F.col("a"), F.col("b")).alias("every"), text.match_ratio(F.col("a"), F.col("b"), 0.7).alias("high")).collect():
        want = None if r["a"] is None else SequenceMatcher(None, r["a"], r["b"]).ratio()
        assert r["every"] == want and (r["high"] == want or (want is not None and want < 0.7 and r["high"] is None))


def test_plain_values(spark):
    df = spark.createDataFrame([("1,5",), ("\xa07.5\t",), (" ",), ("nan",), ("x",), (None,)], "c string")
    got = [(r[0], r[1]["s"], r[1]["n"]) for r in df.select(numbers.as_number(F.col("c")), numbers.plain_value(F.col("c"))).collect()]
    assert got == [(15.0, "1,5", None), (7.5, None, 7.5), (None, None, None), (None, "nan", None), (None, "x", None), (None, None, None)]


def test_word_distance_of_very_many_distinct_words(spark):
    n = 36_200
    df = spark.range(1).select(F.expr(f"transform(sequence(0, {n} - 1), i -> concat('w', i))").alias("a"))
    swap = F.array(*[F.element_at("a", i) for i in (n, n - 1, n - 2, n - 200)])
    r = df.select(text.word_distance(F.col("a"), swap).alias("far"), text.word_distance(F.slice("a", n - 399, 400), F.expr(f"transform(sequence({n} - 400, {n} - 1), i -> if(i % 100 = 7, a[i - 5], a[i]))")).alias("near"))
    assert r.select("near").head()[0] == 4
    assert r.select("far").head()[0] == n - 1
