"""Descriptive tables over series: structure, coverage, peaks, counts, averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallpoint.contracts import as_list, by_day, whole
from fallpoint.functions.columns import base_variable, natural_key
from fallpoint.operators.features import first_measured, last_measured
from fallpoint.operators.ordered import exact_quantiles


def describe_series(data: DataFrame, *, id_col, day_col: str) -> DataFrame:
    """First and last day, rows, and whether every day from 1 is present."""
    out = data.groupBy(*as_list(id_col)).agg(F.min(day_col).alias("first_day"),
                                             F.max(day_col).alias("last_day"),
                                             F.count(day_col).alias("n_rows"))
    return out.withColumn("continuous", F.col("n_rows") == F.col("last_day"))


def value_counts(data: DataFrame, column: str, out: str = "n") -> DataFrame:
    return (data.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias(out)))


def stacked(one_row: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Columns of a short table as (name, value) rows."""
    keep = [c for c in one_row.columns if c not in columns]
    return one_row.unpivot(keep, list(columns), name, value)


def missing_share(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percentage of missing cells per column."""
    one = data.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in columns])
    return stacked(one, columns, "variable", "pct_missing")


def window_coverage(data: DataFrame, *, id_col, day_col: str, columns: Sequence[str],
                    first: int = 1, last: int = 4) -> DataFrame:
    """Measured days per series inside a window; series absent from it count as 0."""
    inside = F.col(day_col).between(first, last)
    per = data.groupBy(*as_list(id_col)).agg(
        *[F.count(F.when(inside, F.col(c))).alias(c) for c in columns])
    long = stacked(per, columns, "variable", "n")
    return long.groupBy("variable").agg(
        F.avg("n").alias("mean_days"), F.count_if(F.col("n") >= 3).alias("ids_3_days"),
        F.count_if(F.col("n") >= 2).alias("ids_2_days"), F.count_if(F.col("n") == 0).alias("ids_0_days"))


def imputed_share(raw: DataFrame, filled: DataFrame, *, id_col, day_col: str,
                  columns: Sequence[str], first: int = 1, last: int = 4) -> DataFrame:
    """Percentage of cells missing in ``raw`` among the rows of both tables, window and overall."""
    keys = as_list(id_col) + [day_col]
    both = raw.select(*keys, *columns).join(filled.select(*keys), keys)
    inside = F.col(day_col).between(first, last)
    miss = lambda c: F.col(c).isNull().cast("double")
    one = both.agg(*[x for c in columns for x in (
        (F.avg(F.when(inside, miss(c))) * 100).alias(f"w_{c}"), (F.avg(miss(c)) * 100).alias(f"a_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"w_{c}").alias("pct_window"),
                              F.col(f"a_{c}").alias("pct_all")) for c in columns])
    return one.select(F.inline(rows))


def joined_observations(raw: DataFrame, filled: DataFrame, *, id_col, day_col: str,
                        columns: Sequence[str], suffixes: tuple[str, str] = ("_r", "_g")) -> DataFrame:
    """Inner join of two observation sets on (id, day), shared columns suffixed."""
    keys = as_list(id_col) + [day_col]
    side = lambda df, s: df.select(*keys, *[F.col(c).alias(c + s) for c in columns])
    return side(raw, suffixes[0]).join(side(filled, suffixes[1]), keys)


def peak_profile(data: DataFrame, *, id_col, day_col: str, value_col: str) -> DataFrame:
    """Duration, first peak day, peak, later minimum and relative fall per series."""
    ids = as_list(id_col)
    top = F.max(F.when(F.col(value_col).isNotNull(),
                       F.struct(F.col(value_col).alias("v"), (-F.col(day_col)).alias("d"))))
    rows = data.withColumn("_top", top.over(whole(ids)))
    out = rows.groupBy(*ids).agg(
        F.max(day_col).alias("duration"), F.first("_top").alias("_top"),
        F.min(F.when(F.col(day_col) > -F.col("_top.d"), F.col(value_col))).alias("min_after"))
    peak, day = F.col("_top.v"), -F.col("_top.d")
    return out.select(*ids, "duration", day.alias("peak_day"),
                      (day / F.col("duration")).alias("peak_share"), peak.alias("peak"), "min_after",
                      F.when(peak > 0, (peak - F.col("min_after")) / peak).alias("fall"))


def columns_agree(left: DataFrame, right: DataFrame, *, keys: Sequence[str], column: str,
                  rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Row-aligned comparison of one column of two tables within tolerances: one row."""
    both = (left.select(*keys, F.col(column).alias("_a"))
            .join(right.select(*keys, F.col(column).alias("_b")), list(keys)))
    gap = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.max(gap).alias("max_gap"),
                    F.coalesce(F.bool_and(gap <= atol + rtol * F.abs(F.col("_b"))), F.lit(True)).alias("agree"))


def pivoted(data: DataFrame, *, index, column: str, levels: Sequence, agg: Column) -> DataFrame:
    """Pivot over a fixed list of levels, so the plan needs no look at the data first."""
    return data.groupBy(*as_list(index)).pivot(column, list(levels)).agg(agg)


def crosstab(data: DataFrame, row: str, column: str, levels: Sequence) -> DataFrame:
    """Counts by two columns and the largest share held by one column level."""
    out = (data.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
           .groupBy(row).pivot(column, list(levels)).agg(F.sum("n")).na.fill(0))
    cells = [F.col(f"`{v}`") for v in levels]
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    return out.withColumn("concentration", F.greatest(*cells) / total)


def weighted_mean(data: DataFrame, *, value: str, weight: str, by=(), out: str = "weighted_mean") -> DataFrame:
    return data.groupBy(*as_list(by)).agg(
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(out))


def edge_values(data: DataFrame, *, id_col, day_col: str, columns: Sequence[str]) -> DataFrame:
    """First and last measured value of each column, in day order."""
    d = F.col(day_col)
    return data.groupBy(*as_list(id_col)).agg(*[x for c in columns for x in (
        first_measured(F.col(c), d).alias(f"{c}_first"), last_measured(F.col(c), d).alias(f"{c}_final"))])


def constant_by_id(data: DataFrame, *, id_col, column: str) -> DataFrame:
    """Ids, and how many hold exactly one distinct value of the column."""
    per = data.groupBy(*as_list(id_col)).agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    return per.agg(F.count(F.lit(1)).alias("ids"),
                   F.count_if(F.col("_a") == F.col("_b")).alias("constant_ids"))


def distinct_counts(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct values per column."""
    long = data.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = stacked(long, columns, "variable", "_v").where(F.col("_v").isNotNull())
    return (long.groupBy("variable", "_v").agg(F.lit(1).alias("_o")).groupBy("variable")
            .agg(F.count(F.lit(1)).alias("n_distinct")))


def most_frequent(data: DataFrame, column: str) -> DataFrame:
    """The level with the most rows; the smaller level on ties."""
    return value_counts(data, column).orderBy(F.col("n").desc(), column).limit(1)


def summary_by(data: DataFrame, *, by, value: str) -> DataFrame:
    """Minimum, exact median and maximum per group."""
    return exact_quantiles(data, by=by, value=value, probs=[0.0, 0.5, 1.0], names=["low", "median", "high"])


def median_by(data: DataFrame, *, by, columns: Sequence[str]) -> DataFrame:
    """Exact median of several columns per group, as (group, variable, median)."""
    by = as_list(by)
    long = stacked(data.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]),
                   columns, "variable", "value")
    return exact_quantiles(long, by=by + ["variable"], value="value", probs=[0.5], names=["median"])


def training_profile(data: DataFrame, *, id_col, day_col: str, value_col: str, fold_col: str,
                     folds: int, ahead: int = 2) -> DataFrame:
    """Mean value and mean ``ahead``-day increment by day, over all folds but one.

    Sums per (fold, day) are taken once; each training mean is the total minus the fold
    left out, so no row is read or copied more than once.
    """
    w = by_day(id_col, day_col)
    inc = F.lead(value_col, ahead).over(w) - F.col(value_col)
    rows = data.withColumn("_inc", inc)
    sums = rows.groupBy(day_col, fold_col).agg(
        *[a for c, n in ((value_col, "v"), ("_inc", "i"))
          for a in (F.sum(c).alias(f"{n}s"), F.count(c).alias(f"{n}n"))])
    per_day = sums.groupBy(day_col).agg(*[F.sum(c).alias(f"all_{c}") for c in ("vs", "vn", "is", "in")])
    base = per_day.withColumn(fold_col, F.explode(F.array(*[F.lit(k) for k in range(folds)])))
    own = sums.withColumn(fold_col, F.col(fold_col).cast("int"))
    out = base.join(own, [day_col, fold_col], "left").na.fill(0, ["vs", "vn", "is", "in"])
    mean = lambda n: F.when(F.col(f"all_{n}n") > F.col(f"{n}n"),
                            (F.col(f"all_{n}s") - F.col(f"{n}s")) / (F.col(f"all_{n}n") - F.col(f"{n}n")))
    return out.select(fold_col, day_col, mean("v").alias("mean_value"), mean("i").alias("mean_increment"))


def rmse_by(data: DataFrame, *, by, error: str, out: str = "rmse") -> DataFrame:
    return data.groupBy(*as_list(by)).agg(F.sqrt(F.avg(F.col(error) * F.col(error))).alias(out))


def importance_by_base(data: DataFrame, *, name: str, value: str, how: str = "sum") -> DataFrame:
    """Importances added (or averaged) over the features of one base variable."""
    agg = F.sum(value) if how == "sum" else F.avg(value)
    return data.groupBy(base_variable(F.col(name)).alias("variable")).agg(agg.alias("importance"))


def minimum_below(data: DataFrame, *, id_col, value_col: str, level: float) -> DataFrame:
    """Median of the series minima and how many fall below a level."""
    per = data.groupBy(*as_list(id_col)).agg(F.min(value_col).alias("low"))
    mid = exact_quantiles(per, value="low", probs=[0.5], names=["median"]).select("median").scalar()
    return per.agg(F.count_if(F.col("low") < level).alias("below"), F.count("low").alias("ids")
                   ).withColumn("median_low", mid)


def median_by_day(data: DataFrame, *, day_col: str, value_col: str) -> DataFrame:
    return exact_quantiles(data, by=day_col, value=value_col, probs=[0.5], names=["median"])


def difference_histogram(data: DataFrame, a: str, b: str) -> DataFrame:
    """How often each difference a - b occurs."""
    return value_counts(data.withColumn("difference", F.col(a) - F.col(b)), "difference")


# --- order, top-k and samples


def natural_order(data: DataFrame, id_col: str) -> DataFrame:
    """Sort so that C2 comes before C10; for output only."""
    return data.orderBy(natural_key(F.col(id_col)), id_col)


def top_k(data: DataFrame, *, value: Column, k: int, tie: str, by=()) -> DataFrame:
    """The k rows with the largest value, per group if asked, ties by a column."""
    by = as_list(by)
    if not by:
        return data.orderBy(value.desc(), tie).limit(k)
    w = Window.partitionBy(*by).orderBy(value.desc(), tie)
    return data.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def typical_examples(data: DataFrame, *, stratum: str, error: str, id_col: str) -> DataFrame:
    """The row of median error (lower middle) in each stratum, found by exact position."""
    from fallpoint.operators.ordered import dense_index

    rows = data.where(F.col(error).isNotNull())
    rows = dense_index(rows, by=stratum, key=F.struct(F.col(error).alias("e"), F.col(id_col).alias("i")))
    return rows.where(F.col("index") == F.floor((F.col("n_group") - 1) / 2)).drop("index", "n_group")


def sample_per_stratum(data: DataFrame, *, stratum: str, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """k reproducible random rows per stratum, in hash order of the id.

    A task keeps its k smallest per stratum before anything is shuffled.
    """
    from fallpoint.functions.columns import hash_int

    w = Window.partitionBy(stratum).orderBy("_h", id_col)
    rows = data.withColumn("_h", hash_int(F.lit(seed), F.col(id_col)))
    return (rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
            .drop("_h", "_r"))
