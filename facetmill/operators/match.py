"""Extracted table cells reconciled with tagged facts.

cells: doc_id, path, page, statement, label, occurrence, year int, value.
facts: doc_id, seq, concept, fact_value, decimals, instant, start_date, end_date, dims_key.
labels: concept, label_role, label, period_type. label_map: statement, label, occurrence, concepts, dims_key, negate.
Keys are exact columns; doc_id is part of every join, so a join spreads over filings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill.functions import numbers, text

YEAR_LONG = (350, 380)


def dedupe_first(facts: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The first row of each key."""
    rest = [c for c in facts.columns if c not in keys]
    return facts.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("fm_r")).select(*keys, "fm_r.*")


def dedupe_last(facts: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The last row of each key."""
    rest = [c for c in facts.columns if c not in keys]
    return facts.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("fm_r")).select(*keys, "fm_r.*")


def year_long(start: Column, end: Column) -> Column:
    return F.coalesce(F.datediff(end, start).between(*YEAR_LONG), F.lit(False))


def fiscal_year_ends(facts: DataFrame) -> DataFrame:
    """doc_id, year, fy_end: the most frequent end of the year-long durations without dimensions, the first seen of equals."""
    votes = facts.filter(~F.col("instant") & (F.col("dims_key") == "{}") & year_long(F.col("start_date"), F.col("end_date")))
    ends = votes.groupBy("doc_id", "end_date").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    return ends.groupBy("doc_id", F.year("end_date").alias("year")).agg(F.max_by("end_date", F.struct("n", -F.col("first"))).alias("fy_end"))


def index_facts(facts: DataFrame) -> DataFrame:
    """One fact per (doc_id, concept, dims_key, end_date, instant): the last; durations must be about one year. The unit is not part of the key."""
    usable = facts.filter(F.col("instant") | year_long(F.col("start_date"), F.col("end_date")))
    return dedupe_last(usable.select("doc_id", "concept", "dims_key", "end_date", "instant", "seq", "fact_value", "decimals"), ["doc_id", "concept", "dims_key", "end_date", "instant"])


def label_concepts(labels: DataFrame, normal=text.label_normal) -> DataFrame:
    """lab, concepts array<struct<concept, period_type, negated>>: every concept of a normal label."""
    rows = labels.select(normal(F.col("label")).alias("lab"), F.struct("concept", "period_type", F.lower("label_role").contains("negated").alias("negated")).alias("r")).filter("lab <> ''")
    each = rows.groupBy("lab").agg(F.collect_set("r").alias("rs"))

    def merged(concept: Column) -> Column:
        same = F.filter("rs", lambda r: r["concept"] == concept)
        return F.struct(concept.alias("concept"), F.array_max(F.transform(same, lambda r: r["period_type"])).alias("period_type"), F.coalesce(F.exists(same, lambda r: r["negated"]), F.lit(False)).alias("negated"))

    concepts = F.array_sort(F.array_distinct(F.filter(F.transform("rs", lambda r: r["concept"]), lambda c: c.isNotNull())))
    return each.select("lab", F.transform(concepts, merged).alias("hits")).filter(F.size("hits") > 0)


def nearest_labels(missing: DataFrame, known: DataFrame, cutoff: float = 0.88) -> DataFrame:
    """lab, near, near_hits: for each distinct label without a hit the most similar known label, if at least ``cutoff``.

    ``known`` (lab, hits) is a label linkbase, a fixed vocabulary: it is joined to the distinct missing labels by length
    band (similarity r of lengths a, b needs 2 min / (a + b) >= r), the length being part of the join key.
    """
    m = missing.select("lab").distinct().withColumn("la", F.char_length("lab"))
    reach = (2 - cutoff) / cutoff
    m = m.withColumn("lb", F.explode(F.sequence(F.ceil(F.col("la") / reach).cast("int"), F.floor(F.col("la") * reach).cast("int"))))
    k = known.select(F.col("lab").alias("near"), F.col("hits").alias("near_hits"), F.char_length("lab").alias("lb"))
    j = m.join(k, "lb").withColumn("ratio", text.match_ratio(F.col("lab"), F.col("near"), cutoff)).filter(F.col("ratio") >= cutoff)
    return j.groupBy("lab").agg(F.max_by(F.struct("near", "near_hits"), F.struct("ratio", "near")).alias("b")).select("lab", "b.*")


def map_labels(cells: DataFrame, labels: DataFrame, label_map: DataFrame | None = None, cutoff: float = 0.88, normal=text.label_normal, texts: DataFrame | None = None) -> DataFrame:
    """cells with concepts array<struct<concept, period_type, negated>>, dims_key, map_method.

    Each distinct label is mapped once and joined back; ``texts`` (label) may name the labels of the cells, and more,
    where they are cheaper to read than the cells.

    Order: curated (with the occurrence, then without), linkbase, fuzzy. Among several hits those whose period
    type fits the statement (balance: instant, else duration) count; if none fits all stay, and more than one left is ambiguous.
    """
    hits = label_concepts(labels, normal)
    known = (cells if texts is None else texts).select(F.col("label").alias("fm_label")).filter("fm_label is not null").distinct().withColumn("lab", normal(F.col("fm_label"))).join(hits, "lab", "left")
    none = F.lit(None).cast("string")
    if cutoff > 1:
        known = known.withColumn("near", none).withColumn("near_hits", F.when(F.lit(False), F.col("hits")))
    else:
        known = known.join(nearest_labels(known.filter("hits is null"), hits, cutoff), "lab", "left")
    j = cells.join(known, F.col("label") == F.col("fm_label"), "left")
    want = F.when(F.col("statement") == "balance", "instant").otherwise("duration")
    every = F.coalesce("hits", "near_hits")
    fit = F.filter(every, lambda h: h["period_type"] == want)
    picked = F.when(F.size(fit) > 0, fit).otherwise(every)
    method = F.when(F.col("hits").isNotNull(), "linkbase").when(F.col("near").isNotNull(), F.concat(F.lit("fuzzy:"), "near")).otherwise("none")
    many = F.size(picked) > 1
    out = j.select(*cells.columns, "lab", F.when(many | every.isNull(), F.slice(picked, 1, 0)).otherwise(picked).alias("concepts"), F.lit("{}").alias("dims_key"), F.when(many, F.concat(F.lit("ambiguous:"), F.array_join(F.transform(picked, lambda h: h["concept"]), "|"))).otherwise(method).alias("map_method"))
    if label_map is None:
        return out.drop("lab")
    types = labels.groupBy("concept").agg(F.max("period_type").alias("period_type"))
    negated = label_concepts(labels, normal).select(F.col("lab").alias("nlab"), F.explode("hits").alias("h")).filter("h.negated").select("nlab", F.col("h.concept").alias("concept"), F.lit(True).alias("neg"))
    cur = label_map.select("statement", F.col("label").alias("mlab"), F.col("occurrence").alias("mocc"), F.col("dims_key").alias("mdims"), "negate", F.posexplode("concepts").alias("pos", "concept"))
    cur = cur.join(types, "concept", "left").join(negated, (F.col("mlab") == F.col("nlab")) & (cur["concept"] == negated["concept"]), "left").select("statement", "mlab", "mocc", "mdims", "pos", cur["concept"], "period_type", F.coalesce("negate", "neg", F.lit(False)).alias("negated"))
    cur = cur.groupBy("statement", "mlab", "mocc", "mdims").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "concept", "period_type", "negated"))), lambda x: F.struct(x["concept"], x["period_type"], x["negated"])).alias("mconcepts"))
    exact = cur.filter("mocc is not null").select("statement", F.col("mlab").alias("lab"), F.col("mocc").alias("occurrence"), F.struct("mconcepts", "mdims").alias("e"))
    plain = cur.filter("mocc is null").select("statement", F.col("mlab").alias("lab"), F.struct("mconcepts", "mdims").alias("p"))
    k = out.join(exact, ["statement", "lab", "occurrence"], "left").join(plain, ["statement", "lab"], "left").withColumn("m", F.coalesce("e", "p"))
    return k.select(*cells.columns, F.coalesce("m.mconcepts", "concepts").alias("concepts"), F.coalesce("m.mdims", "dims_key").alias("dims_key"), F.when(F.col("m").isNotNull(), "curated").otherwise(F.col("map_method")).alias("map_method"))


def reconcile(mapped: DataFrame, facts: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Each mapped cell with the first of its concepts that has a fact, and the status of the comparison.

    A line whose label says ``beginning`` and whose concept is an instant looks at the end of the year before:
    the fiscal year end, else the latest instant of that concept in that year. On a miss the concept is the first
    of the list and period_end the one computed for the last. status: match, match_negated, sign, scale_xN,
    mismatch, value_missing (no number in the cell), xbrl_missing (no fact) or unmapped (no concept).

    ``key`` names the columns that tell a cell from the others (by default all); cells that are equal in every column
    stay apart. Facts are shuffled once, by filing and concept, whose facts a filing bounds; repeated facts count once.
    """
    one = F.struct("seq", "dims_key", "start_date", "end_date", "instant", "fact_value", "decimals")
    of_concept = facts.groupBy("doc_id", "concept").agg(F.collect_set(one).alias("fm_facts")).withColumnRenamed("concept", "fm_concept")
    votes = of_concept.select("doc_id", F.explode("fm_facts").alias("f")).select("doc_id", "f.*").filter("not instant and dims_key = '{}'")
    ends = fiscal_year_ends(votes.repartition("doc_id"))  # one shuffle for the three groupings
    of_filing = ends.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("year", "fy_end"))).alias("fm_ends"))

    rest = [c for c in mapped.columns if c not in (key or mapped.columns)]
    whole = mapped.withColumn("fm_size", F.greatest(F.coalesce(F.size("concepts"), F.lit(0)), F.lit(0)))
    tried = whole.select("*", F.posexplode_outer("concepts").alias("pos", "c")).withColumn("fm_concept", F.col("c.concept"))
    tried = tried.join(of_filing, "doc_id", "left").join(of_concept, ["doc_id", "fm_concept"], "left")
    instant = F.col("c.period_type").eqNullSafe("instant")
    opening = instant & F.coalesce(F.lower("label").contains("beginning"), F.lit(False))
    year = F.when(opening, F.col("year") - 1).otherwise(F.col("year"))
    last_instant = F.array_max(F.transform(F.filter("fm_facts", lambda f: f["instant"] & (F.year(f["end_date"]) == F.col("fm_year"))), lambda f: f["end_date"]))
    tried = tried.withColumn("fm_year", year).withColumn("fm_opening", opening).withColumn("fm_instant", instant)
    tried = tried.withColumn("fm_end", F.coalesce(F.try_element_at("fm_ends", F.col("fm_year")), F.when(F.col("fm_opening"), last_instant)))
    fits = F.filter("fm_facts", lambda f: (f["dims_key"] == F.col("dims_key")) & (f["end_date"] == F.col("fm_end")) & (f["instant"] == F.col("fm_instant")) & (f["instant"] | year_long(f["start_date"], f["end_date"])))
    probed = tried.withColumn("fm_fact", F.try_element_at(F.array_sort(fits), F.lit(-1)))

    hit = F.col("fm_fact.fact_value").isNotNull()
    found_one = F.struct(F.col("fm_concept").alias("concept"), F.col("fm_end").alias("period_end"), "fm_fact.fact_value", "fm_fact.decimals", F.coalesce("c.negated", F.lit(False)).alias("negated"))
    carried = [F.any_value(F.struct(*rest)).alias("fm_rest")] if rest else []
    rows = probed.groupBy(*(key or mapped.columns)).agg(*carried, F.max("fm_size").alias("fm_size"), F.count(F.lit(1)).alias("fm_rows"), F.min_by(found_one, F.when(hit, F.col("pos"))).alias("hit"), F.min_by("fm_concept", "pos").alias("first"), F.max_by("fm_end", "pos").alias("end"), F.max(hit).alias("found"))
    if rest:
        rows = rows.select(*key, "fm_rest.*", "fm_size", "fm_rows", "hit", "first", "end", "found")
    cmp = numbers.compare_value(F.col("value"), F.col("hit.fact_value"), F.col("hit.decimals"), F.col("hit.negated"))
    found = F.coalesce("found", F.lit(False))
    copies = F.explode(F.sequence(F.lit(1), (F.col("fm_rows") / F.greatest("fm_size", F.lit(1))).cast("int")))  # equal cells stay apart
    return rows.withColumn("fm_copy", copies).withColumn("cmp", cmp).select(
        *[c for c in mapped.columns if c != "concepts"],
        F.when(found, F.col("hit.concept")).otherwise(F.col("first")).alias("concept"), F.when(found, F.col("hit.period_end")).otherwise(F.col("end")).alias("period_end"),
        F.when(found, F.col("hit.fact_value")).alias("fact_value"), F.when(found, F.col("cmp.diff")).alias("diff"),
        F.when(F.col("fm_size") == 0, "unmapped").when(~found, "xbrl_missing").when(F.col("value").isNull(), "value_missing").otherwise(F.col("cmp.status")).alias("status"),
    )


def lost_lines(rows: DataFrame, paths: Sequence[str], line: Sequence[str], seq: str) -> DataFrame:
    """Lines that at least one path found in the facts and another of ``paths`` lacks: the first example row under the lacking path, status pdf_missing."""
    found = rows.filter(F.col("concept").isNotNull() & (F.col("concept") != "") & ~F.col("status").isin("unmapped", "xbrl_missing", "value_missing"))
    rest = [c for c in rows.columns if c not in (*line, "path")]
    have = found.groupBy(*line).agg(F.min_by(F.struct(*rest), seq).alias("fm_r"), F.min_by("path", seq).alias("fm_by"), F.collect_set("path").alias("fm_have"))
    lacking = have.withColumn("fm_paths", F.array(*[F.lit(n) for n in paths])).select("*", F.explode(F.array_except("fm_paths", "fm_have")).alias("path"))
    out = lacking.select(*line, "path", "fm_by", "fm_r.*").withColumn("value", F.lit(None).cast("double")).withColumn("diff", F.lit(None).cast("double")).withColumn("map_method", F.concat(F.lit("found by "), "fm_by", F.lit(" only"))).withColumn("status", F.lit("pdf_missing"))
    return out.select(*rows.columns)


def summarize(rows: DataFrame) -> DataFrame:
    """path, statement (ALL for the whole path), numbers, mapped, match, match_rate, match_rate_of_mapped (null for none), status_counts."""
    counts = rows.groupBy("path", "statement", "status").agg(F.count(F.lit(1)).alias("n"))
    grouped = counts.groupingSets([["path", "statement"], ["path"]], "path", "statement").agg(
        F.sum("n").alias("numbers"), F.sum(F.when(F.col("status") != "unmapped", F.col("n")).otherwise(0)).alias("mapped"),
        F.sum(F.when(F.col("status").isin("match", "match_negated"), F.col("n")).otherwise(0)).alias("match"),
        F.collect_list(F.struct("status", "n")).alias("fm_counts"), F.grouping("statement").alias("fm_all"),
    )
    pairs = F.aggregate("fm_counts", F.expr("cast(map() as map<string,bigint>)"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["status"]), F.create_map(e["status"], F.coalesce(F.try_element_at(m, e["status"]), F.lit(0).cast("bigint")) + e["n"])))
    return grouped.select("path", F.when(F.col("fm_all") == 1, "ALL").otherwise(F.col("statement")).alias("statement"), "numbers", "mapped", "match", F.round(F.try_divide(F.col("match").cast("double"), F.col("numbers")), 4).alias("match_rate"), F.round(F.try_divide(F.col("match").cast("double"), F.col("mapped")), 4).alias("match_rate_of_mapped"), pairs.alias("status_counts"))


def grid_cells(normalized: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, r, c, label, occurrence, year, value: the numbers under year columns; a label's occurrence counts its rows."""
    from facetmill.operators import grid

    k = list(keys)
    years = grid.column_years(normalized, k, None, header_only=True)
    body = normalized.filter("row_kind <> 'header'")
    rows = body.filter((F.col("c") == 0) & (text.strip(F.col("cell")) != "")).select(*k, "r", text.strip(F.col("cell")).alias("label")).withColumn("fm_lab", text.label_normal(F.col("label")))
    rows = grid.occurrences(rows, [*k, "fm_lab"], ["r"])
    values = body.filter("c > 0 and num is not null").select(*k, "r", "c", F.col("num").alias("value"))
    return values.join(years, [*k, "c"]).join(rows, [*k, "r"]).select(*k, "r", "c", "label", "occurrence", "year", "value")
