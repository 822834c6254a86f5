"""Early-window features that never look past the window, and schedule summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallpoint.contracts import as_list, clean
from fallpoint.functions.columns import clean_name, ratio_or_null, safe_ratio


def slope(value: Column, day: Column) -> Column:
    """Least-squares slope as an aggregate; NULL with fewer than two points."""
    return F.regr_slope(value, day)


def first_measured(value: Column, day: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), day))


def last_measured(value: Column, day: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), day))


def early_window_features(data: DataFrame, *, id_col, day_col: str, value_cols: Sequence[str],
                          window: int = 4, ratios: Sequence[tuple[str, str]] = (),
                          static_cols: Sequence[str] = (), growth_col: str | None = None) -> DataFrame:
    """One row per series from its first days: last, slope, mean and count per measure.

    Only days 1..window enter; the last value is the latest measured one, nothing is
    imputed.  ``ratios`` divide last values, ``static_cols`` take their first value,
    ``growth_col`` adds last over first measured value.  Series without a row in the
    window survive with NULLs and zero counts.  A single aggregation by id; a repeated
    day inside the window fails in the plan.
    """
    ids, values = as_list(id_col), list(value_cols)
    extra = [growth_col] if growth_col and growth_col not in values else []
    pairs = [c for r in ratios for c in r if c not in values]
    measures = list(dict.fromkeys(values + extra + pairs))
    rows = clean(data.select(*ids, day_col, *dict.fromkeys(measures + list(static_cols))),
                 id_col=ids, value_cols=measures)
    day = F.col(day_col)
    inside = (day >= 1) & (day <= window)
    aggs = [F.count(F.when(day <= window, day)).alias("_rows"),
            F.size(F.collect_set(F.when(day <= window, day))).alias("_days")]
    for c in values:
        v = F.when(inside, F.col(c))
        aggs += [last_measured(v, day).alias(f"{c}_last"), slope(v, day).alias(f"{c}_slope"),
                 F.avg(v).alias(f"{c}_mean"), F.count(v).alias(f"{c}_n")]
    for c in dict.fromkeys(c for r in ratios for c in r):
        aggs.append(last_measured(F.when(inside, F.col(c)), day).alias(f"_l_{c}"))
    for c in static_cols:
        aggs.append(F.min_by(F.col(c), day).alias(c))
    if growth_col:
        v = F.when(day <= window, F.col(growth_col))
        aggs += [first_measured(v, day).alias("_first"), last_measured(v, day).alias("_last")]
    out = rows.groupBy(*ids).agg(*aggs)
    boom = F.raise_error(F.concat(F.lit("series "), F.concat_ws(", ", *[F.col(c).cast("string") for c in ids]),
                                  F.lit(": days are repeated")))
    feats = [F.col(f"{c}_{e}") for c in values for e in ("last", "slope", "mean", "n")]
    feats[0] = (F.when(F.col("_rows") > F.col("_days"), boom.cast("double"))
                .otherwise(F.col(f"{values[0]}_last")).alias(f"{values[0]}_last"))
    feats += [safe_ratio(F.col(f"_l_{a}"), F.col(f"_l_{b}")).alias(f"{a}_over_{b}") for a, b in ratios]
    feats += [F.col(c) for c in static_cols]
    if growth_col:
        feats.append(ratio_or_null(F.col("_last"), F.col("_first")).alias(f"{growth_col}_growth"))
    return out.select(*ids, *feats)


def case_matrix(data: DataFrame, *, id_col, day_col: str, core: Sequence[str],
                extended: Sequence[str], ratios: Sequence[tuple[str, str]], growth_col: str,
                static_col: str, static_name: str = "scale", with_extended: bool = True) -> DataFrame:
    """Feature matrix of the case study: measures, two ratios, a static size, relative growth."""
    cols = list(core) + (list(extended) if with_extended else [])
    out = early_window_features(data, id_col=id_col, day_col=day_col, value_cols=cols,
                                ratios=ratios, static_cols=[static_col], growth_col=growth_col)
    names = {c: static_name if c == static_col else clean_name(c)
             for c in out.columns if c not in as_list(id_col)}
    return out.withColumnsRenamed(names)


def schedule_summary(data: DataFrame, *, id_col, day_col: str, setpoint_col: str,
                     digits: int = 3) -> DataFrame:
    """Initial setpoint, whether it ever changes and the first day it differs."""
    ids = as_list(id_col)
    rows = data.select(*ids, day_col, F.round(setpoint_col, digits).alias("_v"))
    start = rows.groupBy(*ids).agg(
        first_measured(F.col("_v"), F.col(day_col)).alias("initial"),
        F.sort_array(F.collect_list(F.when(F.col("_v").isNotNull(),
                                           F.struct(F.col(day_col).alias("d"), "_v")))).alias("_path"))
    change = F.array_min(F.transform(F.filter("_path", lambda x: x["_v"] != F.col("initial")),
                                     lambda x: x["d"]))
    out = start.withColumn("change_day", change)
    changed = F.when(F.col("initial").isNotNull(), F.col("change_day").isNotNull().cast("int"))
    return out.select(*ids, "initial", changed.alias("changed"), "change_day")
