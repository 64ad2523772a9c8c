"""Numbers of printed cells, scales and comparisons, over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetmill.functions.text import FOOTNOTE_MARK, let, strip

# Dashes that stand for zero, and the named scale factors in the order they are tried.
PLAIN_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
ZERO_DASHES = ("-", "–", "—", "−")
SCALE_WORDS = {"thousand": 1e3, "million": 1e6, "billion": 1e9}
SCALE_FACTORS = ((1e3, "scale_x1000"), (1e6, "scale_x1e+06"), (1e9, "scale_x1e+09"), (1e-3, "scale_x0.001"), (1e-6, "scale_x1e-06"), (1e-9, "scale_x1e-09"))


def to_number(cell: Column) -> Column:
    """struct<value double, unit string> of a printed cell; unit is ``pct`` after a percent sign, else ``num``; value null where there is no number.

    Outer white space of any kind and footnote marks at the end are dropped, a lone dash is 0, a parenthesis or dash in front is a minus even if
    unclosed. Words such as ``nan`` are no numbers here.
    """

    def read(s: Column) -> Column:
        lone = s.isin(*ZERO_DASHES)
        bare = F.regexp_replace(s, r"^[()]+|[()]+$", "")

        def number(u: Column) -> Column:
            dash = F.substring(u, 1, 1).isin(*ZERO_DASHES)
            digits = F.regexp_replace(u, rf"^[{''.join(ZERO_DASHES[1:])}-]|%+$", "")
            value = F.when(digits.rlike(PLAIN_NUMBER), digits.try_cast("double"))
            value = F.when(lone, F.lit(0.0)).when(s.startswith("(") | dash, -value).otherwise(value)
            return let(value, lambda v: F.struct(v.alias("value"), F.when(u.endswith("%") & ~lone & v.isNotNull(), "pct").otherwise("num").alias("unit")))

        return let(bare, number)

    return let(F.translate(F.regexp_replace(strip(cell), FOOTNOTE_MARK, ""), "$, ", ""), read)


def as_number(cell: Column) -> Column:
    """A plain number with commas, null for anything else and for NaN."""
    x = F.replace(strip(cell), F.lit(","), F.lit(""))
    return F.when(x.rlike(PLAIN_NUMBER), x.try_cast("double"))


def plain_value(cell: Column) -> Column:
    """struct<s string, n double>: blank as null, a number as number, else the text."""
    s = strip(cell)
    blank = s == ""
    n = F.when(s.rlike(PLAIN_NUMBER), s.try_cast("double"))
    return F.struct(F.when(~blank & n.isNull(), cell).alias("s"), n.alias("n"))


def caption_scales(text: Column) -> Column:
    """struct<money, shares>: the first ``in thousands/millions/billions`` and the first after ``shares`` in one sentence, by default the money scale."""
    low = F.lower(text)
    factor = F.create_map(*[F.lit(x) for word, k in SCALE_WORDS.items() for x in (word + "s", k)])
    units = "|".join(w + "s" for w in SCALE_WORDS)
    money = F.coalesce(F.try_element_at(factor, F.regexp_extract(low, rf"\bin\s+({units})\b", 1)), F.lit(1.0))
    shares = F.try_element_at(factor, F.regexp_extract(low, rf"shares[^.)]*?\bin\s+({units})\b", 1))
    return F.struct(money.alias("money"), F.coalesce(shares, money).alias("shares"))


def scaled(value: Column, unit: Column, kind: Column, money: Column, shares: Column) -> Column:
    """value x scale of its row kind, rounded to 6 places; percentages and per-share values stay."""
    factor = F.when(unit.eqNullSafe("pct"), 1.0).when(kind == "money", money).when(kind == "shares", shares).otherwise(1.0)
    x = value * factor
    return F.when(x == F.floor(x), x).otherwise(F.round(x, 6))


def tolerance(decimals: Column) -> Column:
    """Half a unit in the last stated decimal; 1e-9 where decimals are infinite or missing."""
    return F.coalesce(F.lit(0.5) * F.pow(F.lit(10.0), -decimals.try_cast("int")), F.lit(1e-9))


def compare_value(value: Column, fact: Column, decimals: Column, may_negate: Column) -> Column:
    """struct<status, diff> of a printed value against a tagged one.

    match, else match_negated or sign (opposite signs; diff is the sum there), else scale_xN for the first factor
    that explains it, else mismatch.
    """
    tol = tolerance(decimals)
    out = F.struct(F.lit("mismatch").alias("status"), (value - fact).alias("diff"))
    for k, name in reversed(SCALE_FACTORS):
        close = (fact != 0) & (F.abs(value - fact * k) <= F.greatest(tol * k, tol))
        out = F.when(close, F.struct(F.lit(name).alias("status"), (value - fact).alias("diff"))).otherwise(out)
    opposite = F.struct(F.when(may_negate, "match_negated").otherwise("sign").alias("status"), (value + fact).alias("diff"))
    out = F.when(F.abs(value + fact) <= tol, opposite).otherwise(out)
    return F.when(F.abs(value - fact) <= tol, F.struct(F.lit("match").alias("status"), (value - fact).alias("diff"))).otherwise(out)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def yearly_cost(seconds_per_page: Column, price_per_hour: float, pages_per_year: float) -> Column:
    """Seconds a page as a cost a year."""
    return seconds_per_page * pages_per_year / 3600.0 * price_per_hour
