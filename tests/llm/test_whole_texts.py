"""Text queries over whole inputs, on small hand-made tables."""

from facetmill.llm import canonical, queries


def test_forms_of_texts_and_of_labels(spark, tmp_path):
    texts = [(1, "Net\u00a0income"), (1, "Net\u00a0income"), (2, None), (3, "plain")]
    labels = [(1, "\uff2e\uff45\uff54 income"), (1, "\uff2e\uff45\uff54 income"), (1, "Net income"), (2, None), (3, "N\u0435t income"), (4, "nowhere in a linkbase")]
    spark.createDataFrame(texts, "rec_id bigint, text string").write.parquet(f"{tmp_path}/filing_records.parquet")
    spark.createDataFrame(labels, "cell_id bigint, label string").write.parquet(f"{tmp_path}/table_cells.parquet")
    form = lambda x: None if x is None else canonical.consistent(x)
    want = {("text", k, form(x)) for k, x in texts} | {("label", k, form(x)) for k, x in labels}
    got = [tuple(r[c] for c in ("field", "key", "form")) for r in queries.queries()["p1_forms"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {f for field, k, f in got if field == "label" and k in (1, 3)} == {"Net income"}
