"""Sources, sinks and streams over a temporary directory."""

import json

import pytest
from pyspark.sql import functions as F

from facetmill.operators import records
from facetmill.sources import io
from facetmill.streaming import ingest


def test_submission(spark, tmp_path):
    (tmp_path / "s.txt").write_text("A: 1\nTWO WORDS: x\nA: 2\n<DOCUMENT>\n<FILENAME>a.htm\n<TEXT>\n<XBRL>\n<p>hi</p>\n</XBRL>\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<FILENAME>b.gif\n<TEXT>x</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TEXT>nameless</TEXT>\n</DOCUMENT>\n")
    raw = io.submissions(spark, str(tmp_path / "s.txt"))
    assert [(r["filename"], r["body"]) for r in io.embedded_documents(raw).collect()] == [("a.htm", "<p>hi</p>")]
    assert raw.select(io.header_map(F.col("submission"))).head()[0] == {"A": "2", "TWO-WORDS": "x"}


def test_pages():
    assert io.page_selection("1,32-34") == [(1, 1), (32, 34)] and io.page_selection(None) is None


def test_missing_source_is_empty(spark, tmp_path):
    assert io.read_or_empty(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_decoder_isolates_errors(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"1")
    (tmp_path / "b.bin").write_bytes(b"x")

    class Digits:
        schema = "path string, value int, error string"

        def decode(self, batches):
            for b in batches:
                rows = []
                for p, c in zip(b.path, b.content, strict=True):
                    try:
                        rows.append((p, int(c), None))
                    except ValueError as e:
                        rows.append((p, None, str(e)))
                yield __import__("pandas").DataFrame(rows, columns=["path", "value", "error"])

    out = io.decode_files(spark, str(tmp_path), Digits(), "*.bin").collect()
    assert sorted((r["value"] is None, r["error"] is None) for r in out) == [(False, True), (True, False)]


def test_records_are_written_whole_or_not_at_all(spark, tmp_path):
    good = spark.createDataFrame([("0000000001-20-000001", None)], "doc_id string, note string")
    rule = F.when(~F.col("doc_id").rlike(records.ACCESSION), F.array(F.lit("doc_id"))).otherwise(F.expr("cast(array() as array<string>)"))
    io.write_records(good, str(tmp_path / "ok"), rule)
    line = "".join(p.read_text() for p in (tmp_path / "ok").iterdir() if p.name.startswith("part"))
    assert json.loads(line) == {"doc_id": "0000000001-20-000001", "note": None}
    with pytest.raises(ValueError, match="doc_id"):
        io.write_records(good.unionByName(spark.createDataFrame([("bad", None)], "doc_id string, note string")), str(tmp_path / "no"), rule)
    assert not (tmp_path / "no").exists()


def test_union_and_empty_sink(spark, tmp_path):
    u = io.union_all([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")])
    assert u.columns == ["a", "b"] and u.count() == 2
    assert io.write_if_any(None, str(tmp_path / "x")) is False and io.write_if_any(u.limit(0), str(tmp_path / "x")) is False


def test_fields_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", True), (2, None, False)], "n int, t string, left_out boolean")
    at = str(tmp_path / "log")
    io.write_fields(df, ["t", "n"], at)
    io.write_fields(df.filter("n = 1"), ["t", "n"], at, "append")
    back = io.read_or_empty(spark, at, "t string, n int", "csv", header="true")
    assert back.columns == ["t", "n"] and sorted((r["n"], r["t"]) for r in back.collect()) == [(1, "a"), (1, "a"), (2, None)]
    assert io.write_if_any(df.select("n"), str(tmp_path / "some")) and spark.read.option("header", "true").csv(str(tmp_path / "some")).count() == 2


def test_lines_of_json_are_read(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n{"a": 2, "b": 3}\n')
    assert sorted(r["a"] for r in io.read_or_empty(spark, str(tmp_path / "x.json"), "a int").collect()) == [1, 2]


def test_xml_facts(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<facts><fact unit='USD'><value>5.5</value></fact><fact><value>7</value></fact></facts>")
    got = io.facts_from_xml(spark, str(tmp_path / "f.xml"), "fact", "_unit string, value double")
    assert sorted((r["_unit"] or "", r["value"]) for r in got.collect()) == [("", 7.0), ("USD", 5.5)]


def test_primary_document_of_equals(spark):
    files = [("k", n, s) for n, s in (("doc2.htm", 9), ("doc1.htm", 9), ("R1.htm", 99), ("big.xml", 999))] + [("l", "z.txt", 1)]
    for order in (files, files[::-1]):
        df = spark.createDataFrame(order, "filing string, filename string, size long")
        assert {r["filing"]: r["filename"] for r in io.primary_document(df, ["filing"]).collect()} == {"k": "doc1.htm", "l": "z.txt"}
    assert {r["filename"] for r in io.primary_document(df, ["filing"], ["BIG.XML"]).collect()} == {"big.xml", "z.txt"}


def test_too_few_tagged_values(spark):
    df = spark.createDataFrame([("k", "a.htm", '<ix:nonNumeric name="dei:Year">20<b>20</b></ix:nonNumeric>')], "filing string, filename string, body string")
    assert io.inline_values(df, ["filing"], ["Year", "Period"], 1).head()["value"] == "2020"
    with pytest.raises(Exception, match="too few"):
        io.inline_values(df, ["filing"], ["Year", "Period"]).collect()


def test_settled_tables_can_be_released(spark):
    from pathlib import Path

    from facetmill.sources import checkpoint

    checkpoint.release(spark)
    kept = checkpoint.settled(spark.createDataFrame([(1, None)], "a int, b string"))
    assert [tuple(r) for r in kept.collect()] == [(1, None)] and checkpoint.settled(kept.limit(0)).count() == 0
    folders = list(Path(checkpoint.directory(spark).removeprefix("file:")).glob("facetmill-*"))
    assert len(folders) >= 2 and checkpoint.release(spark) == 2 and checkpoint.release(spark) == 0


def test_machine(spark):
    from facetmill.operators import pages

    row = pages.machine(spark, ["pyspark", "no-such-package"]).head()
    assert row["spark_version"] == spark.version and row["packages"] == {"pyspark": pages.version_of("pyspark"), "no-such-package": "absent"}


def test_stage_is_built_once(spark, tmp_path):
    calls = []
    df = spark.createDataFrame([(1,)], "a int")
    build = lambda: (calls.append(1), df)[1]
    for _ in range(2):
        assert io.stage_if_changed(spark, [df], str(tmp_path / "st"), build).count() == 1
    assert len(calls) == 1


def test_stream_takes_new_files_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    one = spark.createDataFrame([("k", "2024-01-01 00:10:00"), ("k", "2024-01-01 00:11:00"), ("j", "2024-01-01 00:12:00")], "id string, t string").select("id", F.to_timestamp("t").alias("at"))
    one.coalesce(1).write.parquet(src)
    for _ in range(2):
        ingest.into_table(ingest.new_records(ingest.landing(spark, src, "id string, at timestamp"), "id", "at"), out, cp).awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["j", "k"]
