"""Column expressions shared by the operators: text, numbers, ratios, bins, hashes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feature-name endings, in the order they are produced.
FEATURE_ENDINGS = ("last", "slope", "mean", "n")


def lenient_number(text: Column, decimal_comma: bool = False) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    t = F.trim(text.cast("string"))
    if decimal_comma:
        t = F.regexp_replace(t, ",", ".")
    return t.try_cast("double")


def split_key(key: Column, pattern: str = r"^(.+)_d(\d+)$") -> tuple[Column, Column]:
    """Id and day out of one text such as ``A12_d7``; NULL where the pattern, two groups, does not match."""
    part = lambda k: F.nullif(F.regexp_extract(key, pattern, k), F.lit(""))
    return part(1), part(2).cast("int")


def clean_name(name: str) -> str:
    """Snake case of any header: each run of characters other than letters and digits is one ``_``, none at the ends."""
    return re.sub(r"[\W_]+", "_", name).strip("_").lower()


def base_variable(name: Column) -> Column:
    return F.regexp_replace(name, "_(" + "|".join(FEATURE_ENDINGS) + ")$", "")


def natural_key(ident: Column) -> Column:
    """Sort key that puts C2 before C10: text parts lower-cased, numbers of any length by length, then by digits."""
    parts = F.regexp_extract_all(F.lower(ident.cast("string")), F.lit(r"(\d+|\D+)"), 1)

    def numbered(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), numbered(p)).otherwise(p))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def safe_ratio(num: Column, den: Column, eps: float = 1e-12) -> Column:
    """NULL unless the denominator is clearly away from zero."""
    return F.when(F.abs(den) > eps, num / den)


def ratio_or_null(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def flag(cond: Column) -> Column:
    """0/1 with unknown counted as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def not_below_zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def saturable(level: Column, half: Column, floor: Column) -> Column:
    """(L-p)+ / (K + (L-p)+); a NULL half-constant stands for the linear form L+."""
    pos = not_below_zero(level)
    above = not_below_zero(pos - floor)
    return F.when(half.isNull(), pos).otherwise(above / (half + above))


def right_closed_bin(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (a, b] holding x; NULL outside."""
    out = F.lit(None).cast("string")
    for lo, hi, lab in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((x > lo) & (x <= hi), lab).otherwise(out)
    return out


def interval_distance(day: Column, lo: Column, hi: Column) -> Column:
    """0 inside [lo, hi], otherwise the distance to the nearer end."""
    return (F.when(day.between(lo, hi), F.lit(0.0))
            .otherwise(F.least(F.abs(day - lo), F.abs(day - hi)).cast("double")))


def hash_int(*parts: Column) -> Column:
    """First 32 bits of the md5 of the parts joined by ``|``, as a long."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def hash_key(*parts: Column) -> Column:
    """md5 text of the parts followed by the last part: a total, reproducible order."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.concat_ws("|", F.md5(joined), parts[-1].cast("string"))
