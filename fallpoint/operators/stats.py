"""Rank and moment statistics, exact and without gathering a group in one task.

Statistics inside one series use windows by id (bounded by its days); statistics over the
whole table or over large groups use the block-wise totals of ``ordered``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallpoint.contracts import as_list, by_day
from fallpoint.functions.tails import exact_interval, normal_two_sided, student_two_sided
from fallpoint.operators.ordered import row_ranks, running_totals


def weighted_corr(x: Column, y: Column, n: Column) -> Column:
    """Correlation of x and y over rows that stand for n observations each."""
    sx, sy, sn = F.sum(n * x), F.sum(n * y), F.sum(n)
    sxx, syy, sxy = F.sum(n * x * x), F.sum(n * y * y), F.sum(n * x * y)
    den = F.sqrt((sn * sxx - sx * sx) * (sn * syy - sy * sy))
    return F.when(den > 0, (sn * sxy - sx * sy) / den)


def spearman(data: DataFrame, *, x: str, y: str, by=(), p_value: bool = False) -> DataFrame:
    """Spearman correlation per group over complete pairs: ``pairs``, ``rho`` (and ``p``).

    Pairs are counted per distinct (x, y) first; each pair then carries its ranks through range
    partitions along x and along y, where the other value parts the pairs of a common one.
    """
    by = as_list(by)
    rows = (data.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
            .where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
            .groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("n")))
    for c, other in (("_x", "_y"), ("_y", "_x")):
        rows = row_ranks(rows, by=by, key=c, salt=F.col(other), weight=F.col("n"))
        rows = rows.withColumn(f"{c}_rank", F.col("before") + (F.col("ties") + 1) / 2).drop("before", "ties", "total")
    out = rows.groupBy(*by).agg(F.sum("n").alias("pairs"),
                                weighted_corr(F.col("_x_rank"), F.col("_y_rank"), F.col("n")).alias("rho"))
    if p_value:
        dof = F.col("pairs") - 2
        t = F.col("rho") * F.sqrt(dof / ((1 - F.col("rho")) * (1 + F.col("rho"))))
        t = F.when(F.abs("rho") >= 1, F.lit(1e300)).otherwise(t)
        out = out.withColumn("p", F.when(dof > 0, student_two_sided(t, dof)))
    return out


def spearman_within(data: DataFrame, *, id_col, x: str, y: str, min_pairs: int = 4) -> DataFrame:
    """Spearman correlation inside each series with at least ``min_pairs`` pairs."""
    ids = as_list(id_col)
    rows = data.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def rank(c: str) -> Column:
        w = Window.partitionBy(*ids)
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*ids, c)) - 1) / 2

    rows = rows.withColumns({"_rx": rank(x), "_ry": rank(y)})
    out = rows.groupBy(*ids).agg(F.count(F.lit(1)).alias("pairs"),
                                 weighted_corr(F.col("_rx"), F.col("_ry"), F.lit(1)).alias("rho"))
    return out.where(F.col("pairs") >= min_pairs)


def daily_changes(data: DataFrame, *, id_col, day_col: str, columns: Sequence[str]) -> DataFrame:
    """Row-to-row change of several columns inside each series."""
    w = by_day(id_col, day_col)
    return data.select(*as_list(id_col), day_col,
                       *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in columns])


def label_correlations(data: DataFrame, *, columns: Sequence[str], label: str) -> DataFrame:
    """Spearman correlation of every column with the label, one pass over stacked columns."""
    long = data.select(F.col(label).cast("double").alias("_label"),
                       *[F.col(c).cast("double").alias(c) for c in columns])
    long = long.unpivot(["_label"], list(columns), "variable", "value")
    return spearman(long, by="variable", x="value", y="_label")


def squared_correlation(data: DataFrame, *, x: str, y: str, by=()) -> DataFrame:
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    return data.where(ok).groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias("n"),
                                                    F.regr_r2(y, x).alias("r2"))


def least_squares(data: DataFrame, *, y: str, x: Sequence[str], by=()) -> DataFrame:
    """Ordinary least squares on one or two regressors from centred moments: coefficients, r2."""
    by, x = as_list(by), list(x)
    rows = data.na.drop(subset=[y, *x])
    v = lambda a, b: F.covar_pop(a, b)
    if len(x) == 1:
        a = x[0]
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_intercept(y, a).alias("intercept"),
                                     F.regr_slope(y, a).alias(f"coef_{a}"), F.regr_r2(y, a).alias("r2"))
    a, b = x
    m = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), v(a, a).alias("aa"), v(b, b).alias("bb"), v(a, b).alias("ab"),
        v(a, y).alias("ay"), v(b, y).alias("by_"), F.var_pop(y).alias("yy"),
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"))
    c = F.col
    det = c("aa") * c("bb") - c("ab") * c("ab")
    ca = F.when(det != 0, (c("bb") * c("ay") - c("ab") * c("by_")) / det)
    cb = F.when(det != 0, (c("aa") * c("by_") - c("ab") * c("ay")) / det)
    m = m.withColumns({f"coef_{a}": ca, f"coef_{b}": cb})
    ca, cb = c(f"coef_{a}"), c(f"coef_{b}")
    return m.select(*by, "n", (c("my") - ca * c("ma") - cb * c("mb")).alias("intercept"),
                    f"coef_{a}", f"coef_{b}", ((ca * c("ay") + cb * c("by_")) / c("yy")).alias("r2"))


def eta_squared(data: DataFrame, *, value: str, group: str) -> DataFrame:
    """Share of the variance of a value that lies between the levels of a group."""
    g = (data.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group)
         .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")))
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    sums = g.agg(F.sum(n).alias("N"), F.sum(n * m).alias("S"), F.sum(n * m * m).alias("Q"),
                 F.sum(n * v).alias("W"))
    between = F.col("Q") - F.col("S") * F.col("S") / F.col("N")
    return sums.select(F.col("N").alias("n"), (between / (between + F.col("W"))).alias("eta2"))


def rank_sum_test(data: DataFrame, *, value: str, second: Column, by=()) -> DataFrame:
    """Two-group rank-sum test per group of rows: sizes, U of the second group, p.

    The p-value is the tie-corrected normal approximation with continuity correction;
    ``approximate`` marks groups with fewer than eight rows on either side.
    """
    by = as_list(by)
    rows = (data.withColumn("_s", second.cast("int")).where(F.col(value).isNotNull() & F.col("_s").isNotNull())
            .groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.sum("_s").alias("s")))
    rows = running_totals(rows, by=by, key=value, sums=["n"])
    rank = F.col("before_n") + (F.col("n") + 1) / 2
    out = rows.groupBy(*by).agg(F.sum("s").alias("n_second"), F.sum("n").alias("_n"),
                                F.sum(rank * F.col("s")).alias("_r"),
                                F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("_ties"))
    n2, n = F.col("n_second"), F.col("_n")
    n1 = n - n2
    out = out.withColumns({"n_first": n1, "u": F.col("_r") - n2 * (n2 + 1) / 2})
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    gap = F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5
    p = F.when(sd > 0, normal_two_sided(F.greatest(gap / sd, F.lit(0.0))))
    return out.select(*by, "n_first", "n_second", "u", p.alias("p"),
                      (F.least(n1, n2) < 8).alias("approximate"))


def hit_rate_interval(data: DataFrame, *, hit: Column, by=(), alpha: float = 0.05) -> DataFrame:
    """Hits, trials, rate and exact binomial interval."""
    out = data.groupBy(*as_list(by)).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    low, high = exact_interval(F.col("hits"), F.col("n"), alpha)
    return (out.withColumn("rate", F.col("hits") / F.col("n"))
            .withColumns({"low": low, "high": high}))


def ranked(data: DataFrame, *, value: str, by=(), out: str = "rank") -> DataFrame:
    """Rows with the tie-averaged descending rank of their value in the group; NULL where the value is."""
    found = row_ranks(data.where(F.col(value).isNotNull()), by=by, key=value, salt=F.monotonically_increasing_id())
    rank = F.col("total") + 1 - (F.col("before") + (F.col("ties") + 1) / 2)
    found = found.select(*data.columns, rank.alias(out))
    return found.unionByName(data.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))
