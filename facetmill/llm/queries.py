"""Queries of the text problems over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.llm import boilerplate, canonical, chunking, leakage, mixing, quality
from facetmill.sources.tables import table


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every text of the filings and of every label of the cells; the distinct labels are normalized once."""
    texts = table(spark, d, "filing_records").select("rec_id", canonical.canonical(F.col("text")).alias("form")).distinct()
    cells = table(spark, d, "table_cells").select("cell_id", "label").distinct()
    forms = cells.filter("label is not null").select("label").distinct().withColumn("form", canonical.canonical(F.col("label")))
    labels = cells.join(forms, "label", "left").select("cell_id", "form").distinct()
    return texts.select(F.lit("text").alias("field"), F.col("rec_id").alias("key"), "form").unionAll(labels.select(F.lit("label").alias("field"), F.col("cell_id").alias("key"), "form"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of each record's text by its look, its size in rows and in spellings: the classes of several spellings."""
    return canonical.look_classes(table(spark, d, "filing_records"), "rec_id", "text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Labels that look like a linkbase label, and records that look alike, in other characters."""
    labels = canonical.same_look_as(table(spark, d, "table_cells"), "cell_id", "label", table(spark, d, "label_linkbase"), "label_id", "label")
    texts = canonical.same_look(table(spark, d, "filing_records"), "rec_id", "text")
    return labels.select(F.lit("label").alias("field"), "key_a", "key_b").unionAll(texts.select(F.lit("text").alias("field"), "key_a", "key_b"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every block of the filings in ordered pieces within the limit of its type."""
    records = table(spark, d, "filing_records")
    return chunking.split_oversized(records, table(spark, d, "chunk_limits"), ["rec_id", "doc_id", "section", "block_id"], "text", "block_type")


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The text of each record put together again from its pieces, whether they keep the limit, and what consecutive ones share."""
    limits = table(spark, d, "chunk_limits").select(F.col("block_type"), "max_chars")
    kinds = table(spark, d, "filing_records").select("rec_id", "block_type").distinct().join(limits, "block_type", "left").select("rec_id", "max_chars")
    p = p2_pieces(spark, d).select("rec_id", "n_pieces", "piece_no", "piece_start", "piece_end", "piece").distinct()
    each = p.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece_start", "piece_end", "piece"))).alias("ps"), F.max(F.char_length("piece")).alias("longest"))
    shared = F.transform("ps", lambda x, i: F.when(i > 0, F.get("ps", i - 1)["piece_end"] - x["piece_start"]))
    text = F.array_join(F.transform("ps", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], F.get("ps", i - 1)["piece_end"] - x["piece_start"] + 1, F.char_length(x["piece"])))), "")
    whole = F.when(F.get("ps", F.lit(0))["piece"].isNotNull(), text)
    return each.join(kinds, "rec_id").select("rec_id", whole.alias("text"), (F.coalesce(F.col("longest") <= F.col("max_chars"), F.lit(True)) | F.col("max_chars").isNull()).alias("within"), F.array_max(shared).cast("bigint").alias("most_shared"), F.array_min(shared).cast("bigint").alias("least_shared"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that had to be cut."""
    return p2_pieces(spark, d).filter((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("rec_id").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that repeat on the pages of one filer."""
    records = table(spark, d, "filing_records")
    looked = records.filter(F.col("block_type").isNull() | (F.col("block_type") != "Table"))
    return boilerplate.repeated_lines(looked, ["rec_id"], "text", "ticker", ["doc_id", "page"], records).select("rec_id", F.col("line_no").cast("int")).distinct()


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Each record without its repeated lines, how many went, and which."""
    records = table(spark, d, "filing_records").select("rec_id", "doc_id", "page", "ticker", "block_type", "text")
    clean = boilerplate.without_repeated_lines(records, ["rec_id"], "text", "ticker", ["doc_id", "page"], applies=F.col("block_type").isNull() | (F.col("block_type") != "Table"))
    lines = F.array_join(F.transform("removed_lines", lambda x: x["line"]), "\n")
    return clean.select("rec_id", "clean_text", F.size("removed_lines").cast("bigint").alias("n_removed"), lines.alias("removed"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item, and how much of it."""
    return leakage.leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


#: The setting that names the tokenizer file, and the file where it is unset.
TOKENIZER = ("facetmill.tokenizer", "/opt/tokenizers/byte_bpe_50k.json")


def _mixed(spark: SparkSession, d: str):
    docs = table(spark, d, "documents")
    return mixing.mix(docs, "doc_id", "source", mixing.token_count(F.col("text"), spark.conf.get(*TOKENIZER)), table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents mixed to the target shares, in order of virtual finish time."""
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of the tokens that each source reached."""
    return _mixed(spark, d)[1]()


def _mixed_by_characters(spark: SparkSession, d: str):
    """As p8_mix with characters as sizes and an order that SQL can follow."""
    place = lambda turn, key: F.conv(F.substring(F.md5(F.concat_ws(":", turn.cast("string"), key.cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint") * 8
    return mixing.mix(table(spark, d, "documents"), "doc_id", "source", F.char_length("text"), table(spark, d, "mix_targets"), order=place)


def p8_mix_chars(spark: SparkSession, d: str) -> DataFrame:
    return _mixed_by_characters(spark, d)[0].withColumn("finish", F.round("finish", 3))


def p8_shares_chars(spark: SparkSession, d: str) -> DataFrame:
    return _mixed_by_characters(spark, d)[1]()


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its features and its kind by the learned rules."""
    return quality.document_kinds(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "doc_labels"), "kind")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_kinds(spark, d).filter("kind <> 'prose'").select("doc_id", "kind").distinct()


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    """Plain text statistics of every document."""
    return quality.statistics(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_forms, p1_classes, p2_found, p2_pieces, p2_rebuilt, p3_found, p3_clean, p7_found, p7_leaks, p8_mix, p8_shares, p8_mix_chars, p8_shares_chars, p9_found, p9_kinds, p9_stats)}


REPEATED = r"""
WITH lines AS (
  SELECT DISTINCT rec_id, ticker, doc_id, page, block_type, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM (SELECT DISTINCT rec_id, ticker, doc_id, page, block_type, text FROM filing_records)
  WHERE block_type IS DISTINCT FROM 'Table'
), keyed AS (
  SELECT *, regexp_replace(replace(lower(upper(regexp_replace(line, '^[\s\p{Z}\x0b\x1c-\x1f\x85]+|[\s\p{Z}\x0b\x1c-\x1f\x85]+$', '', 'g'))), 'ß', 'ss'), '[0-9]+', '0', 'g') AS k FROM lines
), pages AS (
  SELECT ticker, count(*) AS n_all FROM (SELECT DISTINCT ticker, doc_id, page FROM filing_records) GROUP BY ticker
), often AS (
  SELECT k, keyed.ticker, count(DISTINCT (doc_id, page)) AS n FROM keyed WHERE k <> '' GROUP BY k, keyed.ticker
), kept AS (
  SELECT o.k, o.ticker FROM often o JOIN pages p ON o.ticker IS NOT DISTINCT FROM p.ticker WHERE o.n >= 5 AND o.n >= 0.3 * p.n_all
), hits AS (
  SELECT DISTINCT rec_id, line_no FROM keyed JOIN kept ON keyed.k = kept.k AND keyed.ticker IS NOT DISTINCT FROM kept.ticker
)
"""


MIX = """WITH d AS (SELECT doc_id, source, max(length(text)) AS n FROM documents GROUP BY ALL), t AS (SELECT source, max(target_share) AS w, max(max_repeats) AS m FROM mix_targets WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT source, w, m, sum(n) AS n FROM d JOIN t USING (source) GROUP BY ALL), u AS (SELECT *, w / sum(w) OVER () AS share FROM a WHERE n > 0 AND w > 0 AND m > 0), p AS (SELECT *, min(n * m / share) OVER () AS budget FROM u),
q AS (SELECT *, least(greatest(CAST(ceil(budget * share / n) AS INT), 1), m) AS passes FROM p), x AS (SELECT d.doc_id, d.source, d.n, q.share, q.budget, unnest(range(passes)) AS k FROM d JOIN q USING (source)),
y AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY k, md5(concat(k, ':', doc_id))[1:15], doc_id ROWS UNBOUNDED PRECEDING) / share AS finish FROM x), z AS (SELECT * FROM y WHERE finish <= budget * (1 + 1e-12))
"""


def oracle_sql() -> dict[str, str]:
    common = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.COMMON))
    return {
        "p9_stats": f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]')) AS lines FROM documents)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(length(array_to_string(words, '')) / nullif(len(words), 0), 0) AS mean_word_length,
        coalesce(length(regexp_replace(text, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\s\xa0]', '', 'g')) / nullif(length(text), 0), 0) AS symbol_ratio, coalesce(length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) / nullif(length(text), 0), 0) AS digit_ratio,
        coalesce(length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 0), 0) AS upper_ratio,
        coalesce(len(list_filter(words, lambda x: x IN ({common}))) / nullif(len(words), 0), 0) AS share_common,
        coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;…。！？]["''”’)\\]]*\\s*$'))) / nullif(len(lines), 0), 0) AS share_punctuated,
        CAST(len(lines) AS BIGINT) AS n_lines, coalesce(length(array_to_string(lines, '')) / nullif(len(lines), 0), 0) AS mean_line_length FROM w""",
        "p8_mix_chars": MIX + "SELECT doc_id, source, CAST(k AS INT) AS copy_no, n AS n_tokens, round(finish, 3) AS finish FROM z",
        "p8_shares_chars": MIX
        + """, g AS (SELECT source, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS uses, max(k) + 1 AS most_uses, sum(n) / sum(sum(n)) OVER () AS reached FROM z GROUP BY source)
        SELECT t.source, w AS target_share, t.m AS max_repeats, CAST(coalesce(a.n, 0) AS BIGINT) AS available_tokens, coalesce(tokens, 0) AS tokens, coalesce(uses, 0) AS uses, CAST(coalesce(most_uses, 0) AS INT) AS most_uses, coalesce(reached, 0) AS reached_share FROM t LEFT JOIN a USING (source, w, m) LEFT JOIN g USING (source)""",
        "p2_found": "SELECT DISTINCT rec_id FROM filing_records r JOIN chunk_limits c USING (block_type) WHERE length(r.text) > c.max_chars",
        "p2_rebuilt": "WITH r AS (SELECT DISTINCT rec_id, text, block_type FROM filing_records) SELECT rec_id, text, true AS within, CASE WHEN length(text) > max_chars THEN least(coalesce(overlap_chars, 0), max_chars // 2) END AS most_shared, CASE WHEN length(text) > max_chars THEN least(coalesce(overlap_chars, 0), max_chars // 2) END AS least_shared FROM r LEFT JOIN chunk_limits c USING (block_type)",
        "p3_found": REPEATED + "SELECT rec_id, CAST(line_no AS INTEGER) AS line_no FROM hits",
        "p3_clean": REPEATED
        + """, ls AS (SELECT rec_id, text, ticker, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM (SELECT rec_id, text, ticker, row_number() OVER () AS rid FROM filing_records)),
        cut AS (SELECT DISTINCT l.rec_id, l.line_no, l.line, h.rec_id IS NULL AS stays FROM ls l LEFT JOIN hits h ON l.rec_id = h.rec_id AND l.line_no = h.line_no),
        joined AS (SELECT rec_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (stays), '') AS t, count(*) FILTER (NOT stays) AS n, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT stays) AS gone FROM cut GROUP BY rec_id)
        SELECT r.rec_id, j.t AS clean_text, CAST(coalesce(j.n, 0) AS BIGINT) AS n_removed, coalesce(j.gone, '') AS removed FROM filing_records r LEFT JOIN joined j USING (rec_id)""",
    }
