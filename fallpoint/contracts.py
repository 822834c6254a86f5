"""The series contract: what a long table must look like, and how it is checked.

A series table has one row per (id, day).  Ids may span several columns, days are
whole numbers starting at 1, measures are doubles with NULL as the only missing value.
Because (id, day) is unique, one series never holds more rows than its calendar has days,
whatever the number of raw rows; there is no fixed limit to its length.
Raw tables where one id owns a large share of the rows are first reduced with
:func:`to_daily`, whose partial aggregation runs before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROBLEMS = {
    "day_not_finite": "days contain missing or infinite values",
    "day_not_integer": "days must be whole numbers",
    "day_repeated": "days are repeated",
    "day_below_one": "days start at 1",
}


class SeriesError(ValueError):
    """A series breaks the contract; the message names it."""


def as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def finite(col: str | Column) -> Column:
    """NULL for NaN and infinities (both sort above every number in Spark)."""
    c = F.col(col) if isinstance(col, str) else col
    c = c.cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def by_day(id_col, day_col: str):
    return Window.partitionBy(*as_list(id_col)).orderBy(day_col)


def whole(id_col):
    return Window.partitionBy(*as_list(id_col))


def has_ids(ids: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in ids:
        cond = cond & F.col(c).isNotNull()
    return cond


def clean(data: DataFrame, *, id_col, value_cols: Sequence[str]) -> DataFrame:
    """Contract boundary: drop rows without an id, turn NaN and infinities into NULL."""
    out = data.where(has_ids(as_list(id_col)))
    return out.withColumns({c: finite(c) for c in value_cols}) if value_cols else out


def to_daily(data: DataFrame, *, id_col, day: Column, aggs: Mapping[str, Column],
             day_col: str = "day") -> DataFrame:
    """Reduce raw rows to one row per (id, day); partial aggregates absorb hot ids."""
    ids = as_list(id_col)
    return (data.where(has_ids(ids)).withColumn(day_col, day)
            .groupBy(*ids, day_col).agg(*[c.alias(n) for n, c in aggs.items()]))


def check_parameters(*, drop_threshold: float, n_consecutive: int) -> None:
    if not 0 < drop_threshold < 1:
        raise ValueError("drop_threshold must lie strictly between 0 and 1")
    if n_consecutive < 1:
        raise ValueError("n_consecutive must be at least 1")


def day_problem(day: Column, repeated: Column) -> Column:
    """Problem code of one row, in the order the checks are made; NULL when sound."""
    d = day.cast("double")
    return (F.when(finite(day).isNull(), "day_not_finite")
            .when(d != F.floor(d), "day_not_integer")
            .when(repeated, "day_repeated")
            .when(d < 1, "day_below_one"))


def series_problems(data: DataFrame, *, id_col, day_col: str) -> DataFrame:
    """One row per series that breaks the contract: ids, ``problem``, ``message``.

    Counted per (id, day) first, so a hot id is reduced before it is grouped.
    """
    ids = as_list(id_col)
    d = F.col("_d")
    rows = (data.where(has_ids(ids)).select(*ids, finite(day_col).alias("_d"))
            .groupBy(*ids, "_d").agg(F.count(F.lit(1)).alias("_n")))
    flags = rows.groupBy(*ids).agg(
        F.max(d.isNull()).alias("day_not_finite"),
        F.max(F.coalesce(d != F.floor(d), F.lit(False))).alias("day_not_integer"),
        F.max(d.isNotNull() & (F.col("_n") > 1)).alias("day_repeated"),
        F.max(F.coalesce(d < 1, F.lit(False))).alias("day_below_one"))
    code = F.coalesce(*[F.when(F.col(p), p) for p in PROBLEMS])
    text = F.create_map(*[F.lit(x) for kv in PROBLEMS.items() for x in kv])
    return (flags.select(*ids, code.alias("problem")).where(F.col("problem").isNotNull())
            .withColumn("message", text[F.col("problem")]))


def require_sound(data: DataFrame, *, id_col, day_col: str) -> None:
    """Raise :class:`SeriesError` for the first unsound series in id order."""
    ids = as_list(id_col)
    bad = series_problems(data, id_col=ids, day_col=day_col).orderBy(*ids).first()
    if bad is not None:
        name = bad[ids[0]] if len(ids) == 1 else tuple(bad[c] for c in ids)
        raise SeriesError(f"series {name!r}: {bad['message']}")
