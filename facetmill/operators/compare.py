"""Differences between two copies of a dataset (problem 4).

Each side is reduced to its latest version per key by a map-side combined aggregate, so a key that holds a
third of all rows shrinks to one row before the shuffle. The keys are then spread over hash buckets; the two
sides of a bucket meet as Arrow tables, keys are aligned by sorted search, and every compared field becomes
one null-aware mask over the aligned rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Rule:
    """How one field is compared.

    kind ``number``: equal within ``rel`` of the larger magnitude (NaN equals NaN only);
    kind ``label``: equal without letter case and outer white space; kind ``exact``: equal as stored.
    Null equals only null under every kind.
    """

    kind: str = "exact"
    rel: float = 0.0


def bucket_count(*sides: DataFrame, bytes_per_bucket: int = 4 << 20, least: int = 12) -> int:
    """Buckets that keep a bucket small whatever the size of the data, from the planner's size of both sides; nothing is run.

    Where the planner knows no size, ten buckets for each shuffle partition.
    """
    size = sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in sides)
    if size >= 1 << 62:
        return max(least, 10 * int(sides[0].sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(math.ceil(size / bytes_per_bucket), (1 << 31) - 1))


def _latest(df: DataFrame, keys: Sequence[str], fields: Sequence[str], version: str | None, buckets: int) -> DataFrame:
    single = len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, INTEGRAL)
    key = F.col(keys[0]).cast("bigint") if single else F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})
    order = [F.col(version).alias("v")] if version else []
    packed = F.struct(*order, *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    one = df.select(key.alias("fm_key"), packed.alias("fm_row")).groupBy("fm_key").agg(F.max("fm_row").alias("fm_row"))
    bucket = F.coalesce(F.pmod(F.xxhash64("fm_key"), F.lit(buckets)), F.lit(-1)).cast("int")
    return one.select(bucket.alias("fm_bucket"), "fm_key", *[F.col(f"fm_row.f{i}").alias(f"f{i}") for i in range(len(fields))])


def diff_copies(left: DataFrame, right: DataFrame, keys: Sequence[str], rules: Mapping[str, Rule], version: str | None = None, missing_right: str = "missing_in_right", missing_left: str = "missing_in_left", buckets: int | None = None) -> DataFrame:
    """One row per finding: the key as text, the finding, and the two values as text.

    finding is ``missing_right`` or ``missing_left`` for keys on one side only, else the name of a field that
    differs. Per side only the row with the greatest ``version`` counts; among ties (and without ``version``)
    the greatest values count, field by field, null lowest. Rows with a null key form one key of their own.
    Empty sides, repeated rows and further columns of any name are allowed; a one-column integral key is
    compared as bigint, other keys as a JSON text of their parts. Columns: fm_key (bigint or string), finding,
    left_value, right_value.
    """
    import pyarrow as pa

    fields = list(rules)
    ways = [rules[f] for f in fields]
    if buckets is None:
        buckets = bucket_count(left.select(*keys, *fields), right.select(*keys, *fields))
    a, b = (_latest(df, keys, fields, version, buckets) for df in (left, right))
    key_type = a.schema["fm_key"].dataType
    arrow_key = pa.int64() if isinstance(key_type, T.LongType) else pa.string()

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow.compute as pc

        def key_of(t: pa.Table):
            k = t.column("fm_key").combine_chunks()
            k = pc.fill_null(k, 0 if pa.types.is_integer(k.type) else "")
            values = k.to_numpy(zero_copy_only=False)
            order = np.argsort(values, kind="stable")
            return values[order], t.take(pa.array(order))

        (kx, x), (ky, y) = key_of(x), key_of(y)
        at = np.searchsorted(ky, kx)
        hit = at < len(ky)
        hit[hit] = ky[at[hit]] == kx[hit]
        lone_y = np.ones(len(ky), bool)
        lone_y[at[hit]] = False
        parts = []

        def emit(side: pa.Table, rows, finding: str, lv, rv) -> None:
            if len(rows):
                none = pa.nulls(len(rows), pa.string())
                parts.append(pa.table({"fm_key": side.column("fm_key").take(pa.array(rows)), "finding": pa.array([finding]).take(pa.array(np.zeros(len(rows), np.int64))), "left_value": none if lv is None else lv, "right_value": none if rv is None else rv}))

        emit(x, np.flatnonzero(~hit), missing_right, None, None)
        emit(y, np.flatnonzero(lone_y), missing_left, None, None)
        xa, ya = np.flatnonzero(hit), at[hit]
        for i, (name, way) in enumerate(zip(fields, ways, strict=True)):
            p = x.column(f"f{i}").take(pa.array(xa))
            q = y.column(f"f{i}").take(pa.array(ya))
            p_null, q_null = (c.is_null().to_numpy() for c in (p, q))
            if way.kind == "number":
                pv, qv = (pc.fill_null(c.cast(pa.float64()), 0.0).to_numpy() for c in (p, q))
                with np.errstate(invalid="ignore", over="ignore"):
                    same = (pv == qv) | (np.abs(pv - qv) <= way.rel * np.maximum(np.abs(pv), np.abs(qv))) & np.isfinite(pv) & np.isfinite(qv) | (np.isnan(pv) & np.isnan(qv))
            else:
                if way.kind == "label":
                    p, q = (pc.utf8_lower(pc.utf8_trim_whitespace(c.cast(pa.string()))) for c in (p, q))
                same = pc.fill_null(pc.equal(p, q), False).to_numpy()
            differs = (p_null != q_null) | ~p_null & ~q_null & ~np.asarray(same, bool)
            rows = np.flatnonzero(differs)
            if len(rows):
                lv = x.column(f"f{i}").take(pa.array(xa[rows])).cast(pa.string())
                rv = y.column(f"f{i}").take(pa.array(ya[rows])).cast(pa.string())
                emit(x, xa[rows], name, lv, rv)
        schema = pa.schema([("fm_key", arrow_key), ("finding", pa.string()), ("left_value", pa.string()), ("right_value", pa.string())])
        return pa.concat_tables([t.cast(schema) for t in parts]) if parts else schema.empty_table()

    out = T.StructType([T.StructField("fm_key", key_type), T.StructField("finding", T.StringType()), T.StructField("left_value", T.StringType()), T.StructField("right_value", T.StringType())])
    return a.groupBy("fm_bucket").cogroup(b.groupBy("fm_bucket")).applyInArrow(compare, out)
