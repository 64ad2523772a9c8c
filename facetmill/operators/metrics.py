"""Extraction quality, timing and drift metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill.functions import numbers, text

EDGES = (0, 1, 2, 3, 5, 10, 20, 50, 100, 200, 500, 1000, 2000)


def numeric_recall(pairs: DataFrame, keys: Sequence[str], reference: str, hypothesis: str) -> DataFrame:
    """keys, n_ref, n_found, numeric_recall: the multiset share of the reference's number tokens found; null without any."""
    k = list(keys)
    tokens = lambda c: text.numeric_tokens(F.col(c), text.NUM_TOKEN_PERCENT)
    a = pairs.select(*k, F.explode(tokens(reference)).alias("t")).groupBy(*k, "t").agg(F.count(F.lit(1)).alias("a"))
    b = pairs.select(*k, F.explode(tokens(hypothesis)).alias("t")).groupBy(*k, "t").agg(F.count(F.lit(1)).alias("b"))
    hit = a.join(b, [*k, "t"], "left").groupBy(*k).agg(F.sum("a").alias("n_ref"), F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("n_found"))
    return pairs.select(*k).join(hit, k, "left").select(*k, F.coalesce("n_ref", F.lit(0)).alias("n_ref"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.try_divide(F.col("n_found").cast("double"), F.col("n_ref")).alias("numeric_recall"))


def number_accuracy(reference: Column, hypothesis: Column) -> Column:
    """Share of the reference's number tokens that occur in the hypothesis at all; each occurrence counts, 0 without any."""
    a, b = text.numeric_tokens(reference, text.NUM_SIGNED), text.numeric_tokens(hypothesis, text.NUM_SIGNED)
    return F.size(F.filter(a, lambda t: F.array_contains(b, t))) / F.greatest(F.size(a), F.lit(1))


def text_scores(pairs: DataFrame, reference: str, hypothesis: str, normal=text.normal_text) -> DataFrame:
    """``pairs`` with wer, cer, ref_words and hyp_words of the normal texts."""
    t = pairs.withColumn("fm_a", normal(F.coalesce(F.col(reference), F.lit("")))).withColumn("fm_b", normal(F.coalesce(F.col(hypothesis), F.lit(""))))
    a, b = F.col("fm_a"), F.col("fm_b")
    return t.select(*pairs.columns, text.word_error_rate(a, b).alias("wer"), text.char_error_rate(a, b).alias("cer"), F.size(text.words(a)).alias("ref_words"), F.size(text.words(b)).alias("hyp_words"))


def ocr_scores(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """``pairs`` with word and character error rates of the lower-case texts, the same with plain typography, and the number accuracy.

    Rates are distances over the reference's size, at least 1. ``ref_numbers`` counts the reference's number tokens.
    """
    a, b = F.coalesce(F.col(reference), F.lit("")), F.coalesce(F.col(hypothesis), F.lit(""))
    t = pairs.withColumn("fm_a", text.light_normal(a)).withColumn("fm_b", text.light_normal(b)).withColumn("fm_p", text.light_normal(text.typography_normal(a))).withColumn("fm_q", text.light_normal(text.typography_normal(b)))

    def rates(x: Column, y: Column) -> tuple[Column, Column]:
        u, v = text.words(x), text.words(y)
        return text.word_distance(u, v) / F.greatest(F.size(u), F.lit(1)), text.char_distance(x, y) / F.greatest(F.char_length(x), F.lit(1))

    (wer, cer), (plain_wer, plain_cer) = rates(F.col("fm_a"), F.col("fm_b")), rates(F.col("fm_p"), F.col("fm_q"))
    sizes = [F.size(text.words(F.col(c))).alias(n) for c, n in (("fm_a", "ref_words"), ("fm_b", "hyp_words"))]
    return t.select(*pairs.columns, *sizes, wer.alias("wer"), cer.alias("cer"), plain_wer.alias("wer_typography"), plain_cer.alias("cer_typography"), F.size(text.numeric_tokens(a, text.NUM_SIGNED)).alias("ref_numbers"), number_accuracy(a, b).alias("num_acc"))


def cell_scores(truth: DataFrame, predicted: DataFrame, keys: Sequence[str], group: Sequence[str], value: str = "value") -> DataFrame:
    """group, tp, cells_gt, cells_pred, precision, recall, f1: full outer by key; a cell is right within 1e-9."""
    k = list(keys)
    a = truth.select(*k, F.col(value).alias("fm_a"), F.lit(True).alias("in_a"))
    b = predicted.select(*k, F.col(value).alias("fm_b"), F.lit(True).alias("in_b"))
    j = a.join(b, k, "full_outer")
    out = j.groupBy(*group).agg(F.count_if(F.coalesce(F.col("in_a") & F.col("in_b") & (F.abs(F.col("fm_a") - F.col("fm_b")) < 1e-9), F.lit(False))).alias("tp"), F.count_if("in_a").alias("cells_gt"), F.count_if("in_b").alias("cells_pred"))
    return with_ratios(out)


def with_ratios(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 of tp, cells_gt and cells_pred; 0 where a denominator is 0."""
    p, r = numbers.ratio(F.col("tp"), F.col("cells_pred")), numbers.ratio(F.col("tp"), F.col("cells_gt"))
    out = counts.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", numbers.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def micro_scores(tables: DataFrame, by: Sequence[str]) -> DataFrame:
    """Micro averages: the counts are summed over tables before the ratios."""
    return with_ratios(tables.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("cells_gt").alias("cells_gt"), F.sum("cells_pred").alias("cells_pred")))


def page_averages(pages: DataFrame, values: Sequence[str] = ("wer", "cer", "numeric_recall")) -> DataFrame:
    """source, stratum (ALL for the whole source), pages and the unweighted page means, nulls left out; wer and cer are rounded per page first."""
    first = [F.round(F.col(v), 4).alias(v) if v in ("wer", "cer") else F.col(v) for v in values]
    p = pages.select("source", "stratum", *first)
    g = p.groupingSets([["source", "stratum"], ["source"]], "source", "stratum").agg(F.count(F.lit(1)).alias("pages"), *[F.avg(v).alias(v) for v in values], F.grouping("stratum").alias("fm_all"))
    return g.select("source", F.when(F.col("fm_all") == 1, "ALL").otherwise(F.col("stratum")).alias("stratum"), "pages", *values)


def percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, and for each name in ``shares`` the interpolated percentile of the values that are not null; no row where there are none.

    Equal values are counted map-side; their running counts give the two neighbours of each percentile, so no group's
    values are held at once.
    """
    b = list(by)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*b, F.col(value).cast("double").alias("fm_v")).agg(F.count(F.lit(1)).alias("fm_n"))
    run = counts.withColumn("fm_run", F.sum("fm_n").over(Window.partitionBy(*b).orderBy("fm_v"))).withColumn("fm_all", F.sum("fm_n").over(Window.partitionBy(*b)))
    at = lambda share: F.lit(share) * (F.col("fm_all") - 1)
    low = {n: F.min(F.when(F.col("fm_run") > F.floor(at(s)), F.col("fm_v"))).alias(f"{n}_low") for n, s in shares.items()}
    high = {n: F.min(F.when(F.col("fm_run") > F.ceil(at(s)), F.col("fm_v"))).alias(f"{n}_high") for n, s in shares.items()}
    ends = run.groupBy(*b).agg(F.max("fm_all").alias("fm_all"), *low.values(), *high.values())
    between = lambda n, s: F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (at(s) - F.floor(at(s)))
    return ends.select(*b, *[between(n, s).alias(n) for n, s in shares.items()])


def stage_summary(timings: DataFrame, model_stages: Sequence[str] = (), per_page: dict[str, int] | None = None) -> DataFrame:
    """stage, n, p50, p95, mean, peak, failures, runs: model stages use warm rows only for their times.

    ``per_page`` names stages whose seconds are of a whole document, with its number of pages. Null stages are one stage.
    """
    warm = ~F.col("stage").isin(*model_stages) | (F.col("phase") == "warm") if model_stages else F.lit(True)
    seconds = F.col("seconds")
    for stage, pages in (per_page or {}).items():
        seconds = F.when(F.col("stage") == stage, F.col("seconds") / pages).otherwise(seconds)
    t = timings.withColumn("fm_s", F.when((F.col("status") == "ok") & warm, seconds))
    plain = t.groupBy("stage").agg(F.count("fm_s").alias("n"), F.avg("fm_s").alias("mean"), F.max("rss_mb").alias("peak"), F.count_if(F.col("status") != "ok").alias("failures"), F.array_join(F.array_sort(F.collect_set(F.col("run").cast("string"))), ",").alias("runs"))
    p = percentiles(t, ["stage"], "fm_s", {"p50": 0.5, "p95": 0.95}).withColumnRenamed("stage", "fm_stage")
    return plain.join(p, F.col("stage").eqNullSafe(F.col("fm_stage")), "left").select("stage", "n", "p50", "p95", "mean", "peak", "failures", "runs")


def cold_start(timings: DataFrame, seq: str = "seq") -> DataFrame:
    """stage, run, model_load, first_cold, warm_p50, warm_p95, peak."""
    first = lambda phase: F.min_by("seconds", F.when(F.col("phase") == phase, F.col(seq)))
    plain = timings.groupBy("stage", "run").agg(first("model_load").alias("model_load"), first("cold").alias("first_cold"), F.max("rss_mb").alias("peak"))
    p = percentiles(timings.filter("phase = 'warm'"), ["stage", "run"], "seconds", {"warm_p50": 0.5, "warm_p95": 0.95}).withColumnRenamed("stage", "fm_stage").withColumnRenamed("run", "fm_run")
    j = plain.join(p, F.col("stage").eqNullSafe(F.col("fm_stage")) & F.col("run").eqNullSafe(F.col("fm_run")), "left")
    return j.select("stage", "run", "model_load", "first_cold", "warm_p50", "warm_p95", "peak")


# The thresholds of the quality gate, as the settings name them.
GATE = {"scanned_max_wer": 0.05, "statement_max_wer": 0.05, "min_numeric_recall": 0.98, "table_min_f1": 0.98}


def quality_gate(pages: DataFrame, tables: DataFrame, limits: dict[str, float] = GATE) -> DataFrame:
    """rule, observed, limit, passed: the worst page or table for each threshold. Without pages or tables a rule has no value and passes.

    pages: stratum, wer, numeric_recall; tables: f1.
    """
    of = lambda stratum: F.max(F.when(F.col("stratum") == stratum, F.col("wer")))
    worst = pages.agg(of("scanned").alias("scanned_max_wer"), of("statement").alias("statement_max_wer"), F.min(F.when(F.col("stratum") == "statement", F.col("numeric_recall"))).alias("min_numeric_recall"))
    names = ("scanned_max_wer", "statement_max_wer", "min_numeric_recall")
    rows = worst.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("observed")) for n in names])).alias("x")).select("x.*")
    rows = rows.unionByName(tables.agg(F.min("f1").alias("observed")).select(F.lit("table_min_f1").alias("rule"), "observed"))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("rule"))
    most = F.col("rule").contains("max")
    ok = F.when(most, F.col("observed") <= F.col("limit")).otherwise(F.col("observed") >= F.col("limit"))
    return rows.withColumn("limit", limit).withColumn("passed", F.coalesce(ok, F.lit(True)))


def drift(blocks: DataFrame, by: Sequence[str], length: str, short: int = 5) -> DataFrame:
    """by, n, median (the upper of the middle two), share_short, total of a distribution of block lengths.

    Counts per length are combined map-side; the median comes from their running sums, so no group is collected.
    """
    b = list(by)
    hist = blocks.groupBy(*b, length).agg(F.count(F.lit(1)).alias("fm_n"))
    run = F.sum("fm_n").over(Window.partitionBy(*b).orderBy(length).rowsBetween(Window.unboundedPreceding, 0))
    every = F.sum("fm_n").over(Window.partitionBy(*b))
    h = hist.withColumn("fm_run", run).withColumn("fm_all", every)
    return h.groupBy(*b).agg(F.max("fm_all").alias("n"), F.min(F.when(F.col("fm_run") > F.floor(F.col("fm_all") / 2), F.col(length))).alias("median"), F.round(F.sum(F.when(F.col(length) < short, F.col("fm_n")).otherwise(0)) / F.max("fm_all"), 4).alias("share_short"), F.sum(F.col(length) * F.col("fm_n")).alias("total"))


def histogram(values: DataFrame, by: Sequence[str], value: str, edges: Sequence[float] = EDGES) -> DataFrame:
    """by, bin (its lower edge), n: fixed uneven bins, the last one closed; values outside have no bin."""
    v, b = F.col(value), None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (v >= lo) & ((v < hi) if i < len(edges) - 2 else (v <= hi))
        b = F.when(inside, lo) if b is None else b.when(inside, lo)
    return values.withColumn("bin", b).filter("bin is not null").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def text_sizes(t: Column) -> Column:
    """struct<bytes, chars, approx_tokens>."""
    return F.struct(F.octet_length(t).cast("bigint").alias("bytes"), F.char_length(t).cast("bigint").alias("chars"), F.bround(F.char_length(t) / 4).cast("bigint").alias("approx_tokens"))
