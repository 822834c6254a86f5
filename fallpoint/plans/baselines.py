"""Median baselines: global, by group with fallback, and out of fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallpoint.operators.ordered import exact_quantiles


def median_lookup(rows: DataFrame, known: DataFrame, *, group: str, value: str,
                  fallback_from: DataFrame | None = None, out: str = "guess") -> DataFrame:
    """Median of the row's group among known rows, else the overall median."""
    own = exact_quantiles(known, by=group, value=value, probs=[0.5], names=["_own"])
    base = known if fallback_from is None else fallback_from
    overall = exact_quantiles(base, value=value, probs=[0.5], names=["_all"]).select("_all").scalar()
    return (rows.join(own, group, "left").withColumn("_all", overall)
            .withColumn(out, F.coalesce("_own", "_all")).drop("_own", "_all"))


def training_quantiles(rows: DataFrame, *, fold_col: str, folds: int, columns, probs, names,
                       by=()) -> DataFrame:
    """Quantiles of each column over all folds but one: (fold, [by], variable, quantiles).

    Values are counted once per fold; the training count of a value is its total minus the
    count in the fold left out, so rows are not copied per training set.
    """
    from fallpoint.operators.ordered import running_totals

    by = [by] if isinstance(by, str) else list(by)
    long = rows.select(*by, fold_col, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [*by, fold_col], list(columns), "variable", "value").where(F.col("value").isNotNull())
    per = long.groupBy(*by, "variable", "value").agg(
        *[F.count_if(F.col(fold_col) != k).alias(f"n{k}") for k in range(folds)])
    keys = [*by, "variable"]
    per = running_totals(per, by=keys, key="value", sums=[f"n{k}" for k in range(folds)])
    out = per.select(*keys, "value", F.inline(F.array(*[F.struct(
        F.lit(k).alias(fold_col), F.col(f"n{k}").alias("n"), F.col(f"before_n{k}").alias("before_n"),
        F.col(f"total_n{k}").alias("total_n")) for k in range(folds)])))
    from fallpoint.operators.ordered import pick_quantiles

    return pick_quantiles(out.where("n > 0"), by=[fold_col, *keys], key="value", count="n", probs=probs, names=names)


def impute_from_training(rows: DataFrame, *, fold_col: str, folds: int, columns) -> DataFrame:
    """Fill missing values with the median of the training folds of the row's own fold."""
    mid = training_quantiles(rows, fold_col=fold_col, folds=folds, columns=columns, probs=[0.5], names=["m"])
    wide = mid.groupBy(fold_col).agg(*[F.max(F.when(F.col("variable") == c, F.col("m"))).alias(f"_m_{c}")
                                       for c in columns])
    out = rows.join(wide, fold_col, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}).drop(
        *[f"_m_{c}" for c in columns])


def standardised(rows: DataFrame, *, columns) -> DataFrame:
    """Subtract the mean and divide by the population sd; a zero sd divides by one."""
    s = rows.agg(F.struct(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
                 .alias("_s")).scalar()
    out = rows.withColumn("_s", s)
    one = lambda c: F.when(F.col(f"_s.s_{c}") > 0, F.col(f"_s.s_{c}")).otherwise(1.0)
    return out.withColumns({c: (F.col(c) - F.col(f"_s.m_{c}")) / one(c) for c in columns}).drop("_s")


def iqr_scaled(rows: DataFrame, *, columns) -> DataFrame:
    """Subtract the median and divide by the interquartile range (one if it is zero)."""
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "variable", "value")
    q = exact_quantiles(long, by="variable", value="value", probs=[0.25, 0.5, 0.75], names=["a", "m", "b"])
    q = q.agg(F.map_from_entries(F.collect_list(F.struct("variable", F.struct("a", "m", "b"))))).scalar()
    out = rows.withColumn("_q", q)
    wide = lambda c: F.col("_q")[c]["b"] - F.col("_q")[c]["a"]
    return out.withColumns({c: (F.col(c) - F.col("_q")[c]["m"]) / F.when(wide(c) > 0, wide(c)).otherwise(1.0)
                            for c in columns}).drop("_q")


def out_of_fold_medians(rows: DataFrame, *, value: str, group: str, fold_col: str, folds: int) -> DataFrame:
    """Training median overall and of the own group (overall where the group is unseen)."""
    args = dict(fold_col=fold_col, folds=folds, columns=[value], probs=[0.5])
    overall = training_quantiles(rows, **args, names=["global_median"]).drop("variable")
    own = training_quantiles(rows, **args, names=["_own"], by=group).drop("variable")
    out = rows.join(overall, fold_col, "left")
    own = own.withColumnsRenamed({fold_col: "_f", group: "_g"})
    out = out.join(own, (out[fold_col] == own["_f"]) & out[group].eqNullSafe(own["_g"]), "left").drop("_f", "_g")
    return out.withColumn("group_median", F.coalesce("_own", "global_median")).drop("_own")
