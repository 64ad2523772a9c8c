"""Sources mixed to target weights (problem 8).

Weighted fair queueing: within each source the documents are shuffled by hash, once per pass; a document's
virtual finish time is the source's running token count divided by its target weight. All sources advance alike
in virtual time, so the documents that finish by the total budget have the target shares up to one document per
source. The running counts are a two-level prefix sum over hash slices, so a source that holds a third of all
rows is spread over many tasks; the result is range-sorted by finish time and cut at the budget.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetmill.sources.checkpoint import settled

_loaded: dict[str, object] = {}


def _encoder(path: str):
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text by the tokenizer file at ``path``; null for null, 0 for empty.

    ``path`` must lie on every executor, or name a file sent with the job (``SparkContext.addFile``).
    """

    @F.pandas_udf(T.LongType())
    def count(batch: pd.Series) -> pd.Series:
        t, out = _encoder(path), [None] * len(batch)
        rows = [(i, x) for i, x in enumerate(batch) if x is not None]
        for k in range(0, len(rows), 64):  # few encodings in memory at once
            part = rows[k : k + 64]
            for (i, _), e in zip(part, t.encode_batch_fast([x for _, x in part], add_special_tokens=False), strict=True):
                out[i] = len(e)
        return pd.Series(out, dtype="Int64")

    return count(text)


def shuffled(seed: int = 11) -> Callable[[Column, Column], Column]:
    """The place of a document in its source's order as a bigint from 0 to 2^63 - 1, from (pass, key)."""
    return lambda turn, key: F.shiftrightunsigned(F.xxhash64(F.lit(seed), turn, key), 1)


def plan_mix(targets: DataFrame, totals: DataFrame, budget: float | None = None) -> DataFrame:
    """source, weight, tokens, documents, max_repeats, budget, passes of the sources that are present.

    targets: source, target_share, max_repeats; totals: source, tokens, documents. Sources without tokens, with a
    weight that is not positive or no allowed use are left out and the other weights are scaled to sum to 1. Without
    ``budget`` it is the largest at which no source runs out. The sums over all sources are one row, as every source
    is one row here.
    """
    usable = targets.join(totals, "source").filter("tokens > 0 and target_share > 0 and max_repeats > 0").withColumn("fm_one", F.lit(1))
    most = F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share"))
    whole = usable.groupBy("fm_one").agg(F.sum("target_share").alias("fm_whole"), most.alias("fm_most"))
    weighed = usable.join(whole, "fm_one").withColumn("weight", F.col("target_share") / F.col("fm_whole"))
    total = F.col("fm_most") * F.col("fm_whole") if budget is None else F.lit(float(budget))
    passes = F.least(F.greatest(F.ceil(F.col("budget") * F.col("weight") / F.col("tokens")), F.lit(1)), F.col("max_repeats")).cast("int")
    return weighed.withColumn("budget", total).select("source", "weight", "tokens", "documents", "max_repeats", "budget", passes.alias("passes"))


def mix(docs: DataFrame, key: str, source: str, tokens: Column, targets: DataFrame, target_source: str = "source", weight: str = "target_share", repeats: str = "max_repeats", budget: float | None = None, order: Callable[[Column, Column], Column] | None = None, rows_per_slice: int = 100_000) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The mixed documents and a function giving the shares reached.

    Mixed: ``key``, source, copy_no (0-based), n_tokens, finish; one row per use of a document, in order of
    finish. Rows repeated under one key and source are one document (its greatest token count holds). Documents
    of null or untargeted sources are not used; documents without tokens ride along; targets may repeat (the
    greatest weight and repeats of a source count). Empty documents or targets give an empty mix. Without
    ``budget`` the mix is the largest at which every present source keeps its share; beyond that sources that run
    out fall short, as the shares report. ``order`` shuffles a source (by default ``shuffled()``).
    """
    place = order or shuffled()
    given = targets.select(F.col(target_source).alias("source"), F.col(weight).cast("double").alias("target_share"), F.col(repeats).cast("int").alias("max_repeats")).filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = docs.select(F.col(key).alias("fm_key"), F.col(source).alias("source"), tokens.alias("fm_n")).join(given.select("source"), "source", "left_semi")
    sized = settled(wanted.groupBy("fm_key", "source").agg(F.max(F.coalesce("fm_n", F.lit(0))).alias("fm_n")))  # the token counts are read three times
    totals = sized.groupBy("source").agg(F.sum("fm_n").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    plan = settled(plan_mix(given, totals, budget))  # a row a source, joined three times
    slim = plan.select("source", "weight", "budget", "passes", F.greatest(F.ceil(F.col("documents") / rows_per_slice), F.lit(1)).alias("slices"))
    used = sized.join(slim, "source").withColumn("fm_pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    used = used.withColumn("fm_place", place(F.col("fm_pass"), F.col("fm_key"))).withColumn("fm_slice", F.least(F.floor(F.col("fm_place") / F.lit(float(2**63)) * F.col("slices")), F.col("slices") - 1).cast("int"))
    group = ["source", "fm_pass", "fm_slice"]
    before = Window.partitionBy("source").orderBy("fm_pass", "fm_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = used.groupBy(*group).agg(F.sum("fm_n").alias("fm_sum")).select(*group, F.coalesce(F.sum("fm_sum").over(before), F.lit(0)).alias("fm_before"))
    inside = F.sum("fm_n").over(Window.partitionBy(*group).orderBy("fm_place", "fm_key").rowsBetween(Window.unboundedPreceding, 0))
    timed = used.withColumn("fm_run", inside).join(offsets, group).withColumn("finish", (F.col("fm_before") + F.col("fm_run")) / F.col("weight"))
    mixed = timed.filter(F.col("finish") <= F.col("budget") * (1 + 1e-12)).select(F.col("fm_key").alias(key), "source", F.col("fm_pass").alias("copy_no"), F.col("fm_n").alias("n_tokens"), "finish")

    def shares() -> DataFrame:
        got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max(F.col("copy_no") + 1).alias("most_uses")).withColumn("fm_one", F.lit(1))
        every = got.groupBy("fm_one").agg(F.sum("tokens").alias("fm_every"))
        held = got.join(every, "fm_one").select("source", "tokens", "uses", "most_uses", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("fm_every")), F.lit(0.0)).alias("reached_share"))
        out = given.join(totals.select("source", F.col("tokens").alias("available_tokens")), "source", "left").join(held, "source", "left")
        return out.select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("available_tokens", "tokens", "uses", "most_uses")], F.coalesce("reached_share", F.lit(0.0)).alias("reached_share"))

    return mixed.orderBy("finish", "source", "copy_no", key), shares
