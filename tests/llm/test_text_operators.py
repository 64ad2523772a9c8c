"""Text operators against brute force, exact round trips and held-out accuracy."""

import random
import string
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetmill.llm import boilerplate, canonical, chunking, leakage, mixing, quality


# 1: visually identical text
@pytest.mark.parametrize(
    ("stored", "form"),
    [("Ｎｅｔ　ｓａｌｅｓ", "Net sales"), ("Nеt ﻿sаlеѕ", "Net sales"), ("résultat", "résultat"), ("proﬁt​", "profit"), ("ТОTАL", "TOTAL"), ("Αngνik", "Angvik"), ("Long‐term", "Long-term"), ("сор", "cop"), ("The β of", "The β of"), ("note¹", "note¹"), ("Déferred", "Déferred"), ("𝟣𝟤", "12"), ("a\xa0 b \n c", "a b\nc"), ("наша сор", "наша сор"), ("наша cop", "наша сор"), ("", ""), ("​ \n", "")],
)
def test_consistent(stored, form):
    assert canonical.consistent(stored) == form
    assert canonical.consistent(form) == form


@pytest.mark.parametrize("stored", ["Ꭺsset", "ꓮsset", "Ⲁsset", "Аsset", "ɑsset", "Ａsset"])
def test_spellings_of_other_scripts(stored):
    assert canonical.consistent(stored).lower() == "asset"


def test_more_spellings():
    assert canonical.consistent("ɡain") == "gain" and canonical.consistent("Ӏncome") == "Income"
    for kept in ("αβ of", "σας", "Straße", "sınır", "日本のカタカナ", "서울 漢字", "а Жизнь", "ספר"):
        assert canonical.consistent(kept) == kept


def test_the_form_is_its_own_form():
    for i in range(0x10000):
        if not 0xD800 <= i < 0xE000:
            for t in (chr(i), f"a{chr(i)}b"):
                once = canonical.consistent(t)
                assert canonical.consistent(once) == once, hex(i)


def test_classes(spark):
    texts = ["Net sales", "Nеt sаles", "Net sales", "net sales", None, "", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[1])], "id bigint, t string")
    assert sorted(map(tuple, canonical.look_classes(df, "id", "t").collect())) == [(0, 0, 3, 2), (1, 0, 3, 2), (2, 0, 3, 2)]
    assert canonical.look_classes(df.limit(0), "id", "t").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=string.ascii_letters + "éÅßβζжя 0123\n.,-", max_size=40), st.integers(0, 10**6))
def test_disguise_is_undone(text, seed):
    rng = random.Random(seed)
    out = []
    for c in text:
        spell = canonical.spellings().get(c)
        if "А" <= c <= "я" or c in "βζ":
            out.append(c)
        elif spell and "LATIN" in spell and c.isascii() and rng.random() < 0.3 and not any("А" <= x <= "я" or x in "βζ" for x in text):
            out.append(rng.choice([s for s in spell.values()]))
        elif c == " " and rng.random() < 0.3:
            out.append(rng.choice("\xa0  "))
        elif "!" <= c <= "~" and rng.random() < 0.2:
            out.append(chr(ord(c) + 0xFEE0))
        else:
            out.append(c)
        if rng.random() < 0.2:
            out.append(rng.choice("​­⁠"))
    assert canonical.consistent("".join(out)) == canonical.consistent(text)


def test_native_test_never_skips_a_text_that_changes(spark):
    rng = random.Random(1)
    letters = string.printable + "éÅβνο–—•“”¹²½…́​\xa0ﬁаТ"
    rows = [(i, "".join(rng.choices(letters, k=rng.randint(0, 12)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("same", canonical.is_canonical(F.col("t")))
    for r in df.filter("same").collect():
        assert canonical.consistent(r["t"]) == r["t"], repr(r["t"])


def test_pairs(spark):
    texts = ["Net sales", "Nеt sаles", "Net  sales ", "net sales", None, "", "x", "Net sales", "​"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(1, "Nеt sаles", 1)], "id bigint, t string, fm_key int")
    brute = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a is not None and b is not None and a != b and canonical.consistent(a) == canonical.consistent(b)}
    assert {tuple(r) for r in canonical.same_look(df, "id", "t").collect()} == brute
    clean = spark.createDataFrame([(10, "Net sales"), (11, None)], "lid bigint, label string")
    assert {tuple(r) for r in canonical.same_look_as(df, "id", "t", clean, "lid", "label").collect()} == {(1, 10), (2, 10)}
    assert canonical.same_look(df.limit(0), "id", "t").count() == 0
    out = df.select(canonical.canonical(F.col("t")).alias("f")).collect()
    assert out[4]["f"] is None and out[5]["f"] == ""


# 2: oversized items
def test_pieces_rebuild_the_text(spark):
    rng = random.Random(4)
    topics = [["sales", "growth", "market"], ["lease", "asset", "term"], ["é", "tax", "rate"]]
    def long_text(n):
        return " ".join(" ".join(rng.choices(topics[(i // 6) % 3], k=8)).capitalize() + rng.choice([".", "!", "?\n"]) for i in range(n))
    texts = [long_text(n) for n in (1, 5, 40, 200)] + ["x" * 1000, "", None, "é" * 300, "word " * 400]
    df = spark.createDataFrame([(i, t, "A" if i % 2 else "B", 7) for i, t in enumerate(texts)] + [(90, "y" * 500, "Z", 7), (91, "y" * 500, None, 7)], "id int, body string, kind string, piece_no int")
    limits = spark.createDataFrame([("A", 120, 20), ("B", 60, None), ("C", None, 5)], "kind string, max_chars int, overlap_chars int")
    out = {}
    for r in chunking.split_oversized(df, limits, ["id"], "body", "kind").collect():
        out.setdefault(r["id"], []).append(r)
    assert set(out) == {*range(len(texts)), 90, 91}
    for i, t in enumerate(texts):
        pieces = sorted(out[i], key=lambda r: r["piece_no"])
        most, over = (120, 20) if i % 2 else (60, 0)
        if t is None:
            assert [p["piece"] for p in pieces] == [None]
            continue
        built = pieces[0]["piece"]
        for a, b in zip(pieces, pieces[1:], strict=False):
            assert a["piece_end"] - b["piece_start"] == over and a["piece"][len(a["piece"]) - over :] == b["piece"][:over]
            built += b["piece"][over:]
        assert built == t and all(len(p["piece"]) <= most for p in pieces) and len(pieces) == pieces[0]["n_pieces"]
        assert (len(pieces) > 1) == (len(t) > most)
    assert len(out[90]) == len(out[91]) == 1
    assert chunking.split_oversized(df.limit(0), limits, ["id"], "body", "kind").count() == 0


def test_cut_at_the_topic_change():
    a, b = "Sales of valves rose in the year. " * 6, "Lease terms end when options lapse soon. " * 6
    cuts = chunking.cut_points(a + b, 300, 0)
    assert cuts[0] == len(a)


def test_similarities_are_exact():
    rng = random.Random(5)
    sentences = [[rng.randrange(8000) if rng.random() < 0.5 else rng.randrange(20) for _ in range(rng.randint(0, 30))] for _ in range(700)]
    got = chunking._similarities(sentences)
    for g in range(1, len(sentences)):
        a, b = (Counter(w for s in part for w in s) for part in (sentences[max(0, g - 3) : g], sentences[g : g + 3]))
        norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
        assert got[g - 1] == pytest.approx(sum(v * b[w] for w, v in a.items()) / norm if norm else 0.0)
    assert len(chunking._similarities([])) == len(chunking._similarities([[1]])) == 0


def test_the_least_of_several_limits(spark):
    df = spark.createDataFrame([(1, "word " * 40, "A")], "id int, body string, kind string")
    limits = spark.createDataFrame([("A", 150, 0), ("A", 60, 10), ("A", None, 1)], "kind string, max_chars int, overlap_chars int")
    assert max(len(r["piece"]) for r in chunking.split_oversized(df, limits, ["id"], "body", "kind").collect()) <= 60


def test_very_long_text():
    text = "One more sentence about sales. " * 40_000
    cuts = chunking.cut_points(text, 1500, 150)
    assert cuts[-1] == len(text) and max(y - x for x, y in zip([0, *cuts], cuts, strict=False)) <= 1500


# 3: repeated lines
def brute_lines(rows, pages=5, share=0.3):
    import re
    key = lambda s: re.sub("[0-9]+", "0", s.strip().upper().lower())
    seen, every = {}, {}
    for _, src, doc, page, t in rows:
        every.setdefault(src, set()).add((doc, page))
        for line in (t or "").split("\n") if t is not None else []:
            if key(line):
                seen.setdefault((src, key(line)), set()).add((doc, page))
    return {(i, n) for i, src, _, _, t in rows if t is not None for n, line in enumerate(t.split("\n")) if key(line) and len(seen[(src, key(line))]) >= max(pages, 0) and len(seen[(src, key(line))]) >= share * len(every[src])}


def test_repeated_lines(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        src = rng.choice(["a", "b", None])
        lines = rng.choices(["Page 1 of 9", " PAGE 22 of 3 ", "ÉCLAIR Straße", "éclair strasse", "", "  ", "unique " + str(i) + "x" * i, "rare"], k=rng.randint(1, 5))
        rows.append((i, src, rng.choice(["d1", "d2", None]), rng.randint(1, 12), "\n".join(lines) if i % 17 else None))
    df = spark.createDataFrame([(*r, "z") for r in rows + rows[:5]], "id bigint, src string, doc string, page int, t string, fm_no string")
    want = brute_lines(rows)
    assert want and {(r["id"], r["line_no"]) for r in boilerplate.repeated_lines(df, ["id"], "t", "src", ["doc", "page"]).collect()} == want
    clean = boilerplate.without_repeated_lines(df, ["id"], "t", "src", ["doc", "page"])
    assert clean.count() == len(rows) + 5
    for r in clean.collect():
        if r["t"] is None:
            assert r["clean_text"] is None and r["removed_lines"] == []
        else:
            lines = r["t"].split("\n")
            assert r["clean_text"] == "\n".join(x for n, x in enumerate(lines) if (r["id"], n) not in want)
            assert [x["line_no"] for x in r["removed_lines"]] == sorted(n for i, n in want if i == r["id"])
    assert boilerplate.without_repeated_lines(df.limit(0), ["id"], "t", "src", ["doc", "page"]).count() == 0


# 7: leaks
def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)] + ["it's", "naïve"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 40)))) for i in range(25)] + [(90, None), (91, "")]
    docs = []
    for d in range(80):
        words = rng.choices(vocab, k=rng.randint(0, 60))
        if d % 2:
            it = rng.choice(items[:25])[1].split()
            at = rng.randint(0, max(0, len(it) - 12))
            part = it[at : at + rng.choice([10, 11, 12, 15])]
            part = [w.upper().replace("A", "А") if rng.random() < 0.3 else w for w in part]
            words[3:3] = part
        docs.append((d, rng.choice([" ", "\n", ", "]).join(words)))
    docs += [(200, None), (201, "")]
    found = {(r["doc"], r["item"]): r for r in leakage.leaked_items(spark.createDataFrame(docs + docs[:3], "doc bigint, text string"), "doc", "text", spark.createDataFrame(items, "item bigint, text string"), "item", "text").collect()}
    runs = lambda t: {tuple(w[i : i + 12]) for w in [leakage.words_of(t or "")] for i in range(len(w) - 11)}
    want = {(d, i): len(runs(t) & runs(u)) for d, t in docs for i, u in items if runs(t) & runs(u)}
    assert want and {k: r["shared_runs"] for k, r in found.items()} == want


def test_words_of():
    assert leakage.words_of("It’s  lot² 5, Tram-\nway!") == ["its", "lot", "5", "tram", "way"]


def test_leaks_at_the_edges(spark):
    item = " ".join(f"word{i}" for i in range(14))
    filler = "lorem ipsum dolor sit amet " * 100_000  # 2.7 million characters, a part of its own
    docs = [(1, filler + item, 0), (2, "x " + item.replace(" ", "\n") + " y", 0), (None, item, 0), (3, " ".join(item.split()[:11]), 0), (4, "", 0), (5, None, 0), (2, "x " + item.replace(" ", "\n") + " y", 9)]
    d = spark.createDataFrame(docs, "id bigint, text string, fm_text int")
    i = spark.createDataFrame([("a", item, 1), ("a", item, 1), ("b", " ".join(item.split()[1:13]), 1), ("c", None, 1)], "item string, text string, fm_b int")
    got = sorted(((r["id"] or 0), r["item"], r["shared_runs"], r["item_runs"]) for r in leakage.leaked_items(d, "id", "text", i, "item", "text").collect())
    assert got == [(k, n, s, s) for k in (0, 1, 2) for n, s in (("a", 3), ("b", 1))]
    assert leakage.leaked_items(d.limit(0), "id", "text", i, "item", "text").count() == leakage.leaked_items(d, "id", "text", i.limit(0), "item", "text").count() == 0


def test_kinds_at_the_edges(spark):
    prose, entry = "The company sold units in the year and it was paid. ", "- item part\n"
    docs = [(k, (prose if k % 2 else entry) * 6, "x") for k in range(40)] + [(None, prose, "x"), (50, None, "x"), (51, " \n ", "x"), (52, prose * 30_000, "x"), (52, prose * 30_000, "x")]
    d = spark.createDataFrame(docs, "id bigint, text string, fm_units string")
    labels = spark.createDataFrame([(k, "prose" if k % 2 else "o'list") for k in range(40)] * 2 + [(None, "prose"), (51, None)], "id bigint, kind string")
    got = quality.document_kinds(d, "id", "text", labels, "kind").collect()
    assert len(got) == len(docs) and {r["kind"] for r in got if r["id"] is not None and r["id"] < 40 and r["id"] % 2 == 0} == {"o'list"}
    assert all(r["kind"] == "prose" for r in got if r["id"] is None or r["id"] in (50, 51, 52) or r["id"] % 2)
    assert {r["share_prose"] for r in got if r["id"] in (50, 51)} == {0.0}


def test_words_of_a_batch_are_those_of_each_text():
    texts = ["It’s  lot² 5, Tram-\nway!", "", "ΑΣ Σας naïve x\u0301y", "a", "𝔘 \U00020000 one_two 3½", "İst Straße"]
    texts = [canonical.consistent(t) for t in texts]
    one, _, of = leakage._words(texts)
    seen: dict[str, int] = {}
    for i, t in enumerate(texts):
        words = leakage.words_of(t)
        assert (of == i).sum() == len(words)
        for w, h in zip(words, one[of == i], strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# 8: mixing
def test_mix(spark):
    rng = random.Random(6)
    docs = [(i, rng.choices(["big", "mid", "tiny", "none", None], [70, 20, 2, 5, 3])[0], rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame([*docs, docs[0], (9001, "big", None)], "id bigint, source string, n bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mix(df, "id", "source", F.col("n"), targets, rows_per_slice=100)
    rows = mixed.collect()
    size = {s: sum(n for _, x, n in docs if x == s) for s in ("big", "mid", "tiny")}
    budget = min(size["big"] / (0.5 / 0.9), 2 * size["mid"] / (0.3 / 0.9), 3 * size["tiny"] / (0.1 / 0.9))
    uses, used = Counter(r["id"] for r in rows), Counter()
    for r in rows:
        used[r["source"]] += r["n_tokens"]
    for s, w, m in (("big", 0.5 / 0.9, 1), ("mid", 0.3 / 0.9, 2), ("tiny", 0.1 / 0.9, 3)):
        assert budget * w - 9 <= used[s] <= budget * w + 1e-6
        assert max(uses[i] for i, x, _ in docs if x == s) <= m
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows)
    got = {r["source"]: r for r in shares().collect()}
    assert got["absent"]["tokens"] == 0 and abs(got["big"]["reached_share"] - 0.5 / 0.9) < 0.05 and set(got) == {"big", "mid", "tiny", "absent"}
    again = mixing.mix(df, "id", "source", F.col("n"), targets, rows_per_slice=100)[0].collect()
    assert [(r["id"], r["copy_no"]) for r in again] == [(r["id"], r["copy_no"]) for r in rows]
    assert mixing.mix(df.limit(0), "id", "source", F.col("n"), targets)[0].count() == 0
    assert mixing.mix(df, "id", "source", F.col("n"), targets.limit(0))[0].count() == 0


def test_budget_beyond_the_sources(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "id bigint, source string, n bigint")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mix(df, "id", "source", F.col("n"), t, budget=100)
    assert mixed.count() == 3 and {r["source"]: r["uses"] for r in shares().collect()} == {"a": 2, "b": 1}


def test_token_count(spark):
    import os

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer here")
    got = [r[0] for r in spark.createDataFrame([("Net sales rose.",), ("",), (None,), ("<|endoftext|>",)], "t string").select(mixing.token_count(F.col("t"), path)).collect()]
    assert got[0] >= 3 and got[1] == 0 and got[2] is None and got[3] > 1


# 9: kinds
def make_docs(rng, n):
    prose = ["The company sold units in the year and it was paid by the customers.", "We expect that the rate will rise because of the demand for our parts."]
    out = []
    for i in range(n):
        kind = rng.choice(["prose", "prose", "list", "table", "junk"])
        if kind == "prose":
            t = rng.choice([" ", "\n"]).join(rng.choices(prose, k=rng.randint(2, 8)))
        elif kind == "list":
            t = "\n".join(f"{rng.choice('-*•')} item part {rng.randint(1, 9)}" for _ in range(rng.randint(5, 20)))
        elif kind == "table":
            t = "\n".join("Net sales" + rng.choice(["  ", ";", " | "]).join(["", "1,234", "(56)", "7.8%"]) for _ in range(rng.randint(4, 12)))
        else:
            t = rng.choice(["".join(rng.choices(string.ascii_letters, k=300)), " ".join(["income"] * 60), "(cid:12) " * 40, " ".join("".join(rng.choices("bcdfghjk", k=6)) for _ in range(40))])
        out.append((i, t, kind))
    return out


def test_kinds_on_held_out_documents(spark):
    docs = make_docs(random.Random(3), 400)
    df = spark.createDataFrame([(i, t, "c") for i, t, _ in docs] + [(1000, None, "c"), (1001, "", "c")], "id bigint, text string, kind string")
    labels = spark.createDataFrame([(i, k) for i, _, k in docs[:150]] + [(docs[0][0], docs[0][2]), (5000, "junk"), (3, None)], "id bigint, kind string")
    got = {r["id"]: r["kind"] for r in quality.document_kinds(df, "id", "text", labels, "kind").collect()}
    right = sum(got[i] == k for i, _, k in docs[150:])
    assert right / 250 >= 0.98 and len(got) == 402 and got[1000] is not None
    none = quality.document_kinds(df, "id", "text", labels.limit(0), "kind")
    assert {r["kind"] for r in none.collect()} == {"prose"}
    assert quality.document_kinds(df.limit(0), "id", "text", labels, "kind").count() == 0


def test_a_kind_with_quotes(spark):
    rules = [quality.Rule("o'list\\", (("x", ">", 0.5),))]
    got = spark.createDataFrame([(1.0,), (0.0,)], "x double").select(F.expr(quality.case_sql(rules, "p'"))).collect()
    assert [r[0] for r in got] == ["o'list\\", "p'"]


def test_measures_of_units():
    of, m = quality.measure_units(["Sales rose in 2020. It is so.\n1,234 (12)  56%", "", "- one item\n(iv) two items\nBase/64+" + "x" * 40])
    assert of.tolist() == [0, 0, 0, 2, 2, 2] and m["ended"].tolist() == [1, 1, 0, 0, 0, 0] and m["marked"].tolist() == [0, 0, 0, 1, 1, 0]
    assert m["figures"][2] == 1 and m["unbroken"].tolist()[3:] == [0, 0, 1] and m["words"].tolist() == [3, 3, 0, 2, 3, 2]
    assert all(len(v) == 6 for v in m.values()) and len(quality.measure_units(["", " \n"])[0]) == 0


def test_statistics(spark):
    df = spark.createDataFrame([("Net sales rose.\nAnd fell",), ("",), (None,)], "t string")
    a, b, c = quality.statistics(df, "t").collect()
    assert (a["n_words"], a["n_lines"], a["share_punctuated"]) == (5, 2, 0.5) and a["share_common"] == pytest.approx(0.2)
    assert b["n_words"] == c["n_words"] == 0 and b["symbol_ratio"] == 0.0


def test_rules_are_stable_under_order():
    rows = [{"kind": "a" if x > 5 else "b", "x": float(x), "y": 1.0} for x in range(12)]
    first = quality.induce(rows, "kind", "b", ["x", "y"])
    assert first == quality.induce(rows[::-1], "kind", "b", ["x", "y"]) and first[0].covers({"x": 9.0, "y": 1.0})
    assert quality.induce([], "kind", "b", ["x"]) == [] and quality.case_sql([], "b") == "'b'"
