"""Order statistics over whole tables without a single-task sort.

Ranks, quantiles, dense indexes and rank-sum metrics all need running totals along a
sorted key.  :func:`running_totals` deals its input - already one row per distinct key -
into key ranges with Spark's own range partitioning, stores it with the number of the
range, sums inside each range and adds the totals of the ranges before it.  There is one way for
every size: a small table simply has few ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallpoint.contracts import as_list
from fallpoint.lineage import cut


def running_totals(data: DataFrame, *, by, key: str, sums: Sequence[str]) -> DataFrame:
    """Add ``before_<c>`` (total over smaller keys of the group) and ``total_<c>``.

    ``data`` must hold one row per (by, key); aggregate first, which also removes the
    effect of one key value being very common.  The ranges are sampled, so they are stored
    before two branches use them.
    """
    by = as_list(by)
    rows = cut(data.repartitionByRange(*by, key).withColumn("_range", F.spark_partition_id()))
    # One row per group and range it touches: at most groups plus ranges.
    per = rows.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    allof = Window.partitionBy(*by)
    per = per.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0)).alias(f"_o_{c}") for c in sums],
                     *[F.sum(f"_t_{c}").over(allof).alias(f"total_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    out = null_safe_join(out, per, by + ["_range"])
    out = out.withColumns({f"before_{c}": F.col(f"_o_{c}") + F.col(f"_i_{c}") for c in sums})
    return out.drop("_range", *[f"_{x}_{c}" for x in "io" for c in sums])


def row_ranks(data: DataFrame, *, by=(), key: str, salt: Column, weight: Column | None = None, keep_range: bool = False) -> DataFrame:
    """Rows with ``before`` (weight at smaller keys of the group), ``ties`` (weight at the row's key) and ``total``.

    Rows travel with their key through one range partitioning; ``salt`` parts rows of one value, so a value that
    most rows share spreads over many ranges.  A range knows the smaller keys and the ties inside it; of what
    lies outside only totals and the ties of its first and last key matter, one row per group and range.
    ``salt`` may be drawn row by row, since rows are stored once.  Keys must not be NULL.
    """
    by, k = as_list(by), F.col(key)
    parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = data.withColumns({"_w": F.lit(1).cast("long") if weight is None else weight, "_salt": salt})
    rows = cut(rows.repartitionByRange(parts, *by, key, "_salt").withColumn("_range", F.spark_partition_id()).drop("_salt"))
    inside = Window.partitionBy(*by, "_range").orderBy(key)
    rows = rows.withColumn("_ties", F.sum("_w").over(inside.rangeBetween(Window.currentRow, Window.currentRow)))
    rows = rows.withColumn("_less", F.sum("_w").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_ties"))
    per = rows.groupBy(*by, "_range").agg(F.sum("_w").alias("_n"), F.min(key).alias("_lo"), F.max(key).alias("_hi"),
                                          F.min_by("_ties", key).alias("_lo_n"), F.max_by("_ties", key).alias("_hi_n"))
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = cut(per.withColumns({"_ahead": F.coalesce(F.sum("_n").over(ahead), F.lit(0)), "total": F.sum("_n").over(Window.partitionBy(*by))}))
    # The keys at the ends of ranges: where they begin, and all their ties.
    ends = per.select(*by, F.col("_lo").alias("end"), F.col("_ahead").alias("_from"), F.col("_lo_n").alias("_here")).union(
        per.where("_lo <> _hi").select(*by, "_hi", F.col("_ahead") + F.col("_n") - F.col("_hi_n"), "_hi_n"))
    ends = ends.groupBy(*by, "end").agg(F.min("_from").alias("_before"), F.sum("_here").alias("_all"))
    for side in ("_lo", "_hi"):
        per = null_safe_join(per, ends.select(*by, F.col("end").alias(side), F.col("_before").alias(f"{side}_before"), F.col("_all").alias(f"{side}_all")),
                             [*by, side])
    per = per.select(*by, "_range", "_ahead", "total", "_lo", "_hi", *[f"{s}_{c}" for s in ("_lo", "_hi") for c in ("before", "all")])
    out = null_safe_join(rows, per, [*by, "_range"])
    pick = lambda c, other: F.when(k == F.col("_lo"), F.col(f"_lo_{c}")).when(k == F.col("_hi"), F.col(f"_hi_{c}")).otherwise(other)
    return out.select(*data.columns, *(["_range"] if keep_range else []), pick("before", F.col("_ahead") + F.col("_less")).alias("before"),
                      pick("all", F.col("_ties")).alias("ties"), "total")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which NULL keys meet NULL keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, cond).drop(*[f"_r_{k}" for k in keys])


def counted(data: DataFrame, *, by, key: Column | str, weight: Column | None = None) -> DataFrame:
    """One row per (by, key) with ``n``; NULL keys are dropped."""
    k = F.col(key) if isinstance(key, str) else key
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (data.withColumn("key", k).where(F.col("key").isNotNull())
            .groupBy(*as_list(by), "key").agg(n.alias("n")))


def exact_quantiles(data: DataFrame, *, by=(), value: str, probs: Sequence[float],
                    names: Sequence[str]) -> DataFrame:
    """Interpolated quantiles per group, exact, from counts per distinct value."""
    by = as_list(by)
    rows = running_totals(counted(data, by=by, key=value), by=by, key="key", sums=["n"])
    return pick_quantiles(rows, by=by, key="key", count="n", probs=probs, names=names)


def pick_quantiles(rows: DataFrame, *, by, key: str, count: str, probs: Sequence[float],
                   names: Sequence[str]) -> DataFrame:
    """Quantiles from running counts: the value at rank p (n-1), between neighbours by share."""
    first, n, total = F.col(f"before_{count}"), F.col(count), F.col(f"total_{count}")

    def at(index: Column) -> Column:
        return F.max(F.when((first <= index) & (index < first + n), F.col(key)))

    aggs = []
    for p, name in zip(probs, names):
        pos = F.lit(float(p)) * (total - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}"),
                 F.max(pos - lo).alias(f"_w_{name}")]
    out = rows.groupBy(*as_list(by)).agg(*aggs)
    mid = lambda m: F.col(f"_lo_{m}") + (F.col(f"_hi_{m}") - F.col(f"_lo_{m}")) * F.col(f"_w_{m}")
    return out.select(*as_list(by), *[mid(m).alias(m) for m in names])


def average_ranks(data: DataFrame, *, by=(), key: str, out: str = "rank",
                  descending: bool = False) -> DataFrame:
    """Distinct keys per group with their tie-averaged rank and count ``n``."""
    by = as_list(by)
    rows = running_totals(counted(data, by=by, key=key), by=by, key="key", sums=["n"])
    rank = F.col("before_n") + (F.col("n") + 1) / 2
    if descending:
        rank = F.col("total_n") + 1 - rank
    return rows.select(*by, F.col("key").alias(key), rank.alias(out), "n",
                       F.col("total_n").alias("n_total"))


def dense_index(data: DataFrame, *, by=(), key: Column, out: str = "index") -> DataFrame:
    """0-based position of each row in the order of a unique key, per group; adds ``n_group``."""
    by = as_list(by)
    rows = data.withColumn("_key", key).withColumn("_one", F.lit(1).cast("long"))
    rows = running_totals(rows, by=by, key="_key", sums=["_one"])
    return (rows.withColumnRenamed("before__one", out).withColumnRenamed("total__one", "n_group")
            .drop("_key", "_one"))
