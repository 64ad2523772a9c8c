"""The named text queries run, and agree with their SQL, over the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

from facetmill.llm import canonical, leakage, quality, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def rows(spark, name, *columns):
    return [tuple(r[c] for c in columns) for r in queries.queries()[name](spark, str(DATA)).collect()]


def stored(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(*columns).distinct().collect()]


def test_pairs_against_brute_force(spark):
    form = canonical.consistent
    texts = [(k, t) for k, t in stored(spark, "filing_records", "rec_id", "text") if t is not None]
    clean = stored(spark, "label_linkbase", "label_id", "label")
    look = {}
    for k, t in texts:
        look.setdefault(form(t), []).append((k, t))
    want = {("text", min(a, b), max(a, b)) for group in look.values() for a, t in group for b, u in group if a != b and t != u}
    want |= {("label", c, i) for c, t in stored(spark, "table_cells", "cell_id", "label") if t is not None for i, u in clean if t != u and form(t) == form(u)}
    assert want and set(rows(spark, "p1_found", "field", "key_a", "key_b")) == want
    classes = {(k, min(i for i, _ in g), len({i for i, _ in g}), len({t for _, t in g})) for g in look.values() if len({t for _, t in g}) > 1 for k, _ in g}
    assert set(rows(spark, "p1_classes", "rec_id", "class_id", "rows", "spellings")) == classes


def test_pieces_keep_limit_overlap_and_text(spark):
    limits = {k: (m, o) for k, m, o in stored(spark, "chunk_limits", "block_type", "max_chars", "overlap_chars")}
    texts = {(r, t): k for r, t, k in stored(spark, "filing_records", "rec_id", "text", "block_type")}
    kinds = {r: k for (r, _), k in texts.items()}
    parts = {}
    for r, n, a, z, piece in set(rows(spark, "p2_pieces", "rec_id", "piece_no", "piece_start", "piece_end", "piece")):
        parts.setdefault(r, []).append((n, a, z, piece))
    built = set()
    for r, pieces in parts.items():
        pieces.sort()
        text = pieces[0][3]
        for (_, _, z, _), (_, a, _, piece) in zip(pieces, pieces[1:], strict=False):
            assert z - a == min(limits[kinds[r]][1], limits[kinds[r]][0] // 2)
            text += piece[z - a :]
        assert len(pieces) == 1 or max(len(p[3]) for p in pieces) <= limits[kinds[r]][0]
        built.add((r, text))
    assert built == set(texts)


def test_leaks_against_brute_force(spark):
    def runs(t):
        w = leakage.words_of(t or "")
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    items = [(i, runs(t)) for i, t in stored(spark, "eval_items", "item_id", "text")]
    docs = [(d, runs(t)) for d, t in stored(spark, "documents", "doc_id", "text")]
    want = {(d, i, len(a & b), len(b)) for d, a in docs for i, b in items if a & b}
    assert want and set(rows(spark, "p7_leaks", "doc_id", "item_id", "shared_runs", "item_runs")) == want
    assert set(rows(spark, "p7_found", "doc_id", "item_id")) == {w[:2] for w in want}


def test_shares_of_the_mix(spark):
    got = rows(spark, "p8_shares", "source", "target_share", "max_repeats", "available_tokens", "tokens", "most_uses")
    present = [g for g in got if g[3] > 0]
    whole, used = sum(g[1] for g in present), sum(g[4] for g in present)
    longest = max(r[0] for r in rows(spark, "p8_mix", "n_tokens"))
    assert all(abs(g[4] - used * g[1] / whole) <= len(present) * longest and g[5] <= g[2] for g in present)


def test_kinds_of_held_out_documents(spark):
    d = Path("/root/testdata/sf0.1")
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "doc_labels"))
    kinds = dict(labels.filter("kind is not null").select("doc_id", "kind").distinct().collect())
    taught = labels.filter("doc_id % 3 <> 0")
    held = docs.join(labels.filter("doc_id % 3 = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    model = quality.learn(docs, "doc_id", "text", taught, "kind")
    got = {r["doc_id"]: r["kind"] for r in quality.document_kinds(held, "doc_id", "text", taught, "kind", model=model).collect()}
    right = sum(kinds[i] == k for i, k in got.items())
    print(f"{right} of {len(got)} held-out documents right")
    assert len(got) > 150 and right / len(got) >= 0.97


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = queries.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = Counter(tuple(cell(r[c]) for c in cols) for r in df.collect())
    sql = queries.oracle_sql().get(name)
    if sql:
        db = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        cur = db.execute(sql)
        have = [x[0] for x in cur.description]
        assert got == Counter(tuple(cell(r[have.index(c)]) for c in cols) for r in cur.fetchall())
