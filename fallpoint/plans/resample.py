"""Folds, bootstrap draws and shuffles as data: hash-ordered, reproducible, distributed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallpoint.contracts import as_list
from fallpoint.functions.columns import hash_int, hash_key
from fallpoint.lineage import cut
from fallpoint.operators.ordered import dense_index, exact_quantiles, null_safe_join
from fallpoint.plans.draws import spread_out, with_donors, with_keys, with_weight


def fold_of(entities: DataFrame, *, id_col: str, k: int = 5, repeats: int = 1, stratum: str | None = None,
            seed: int = 0) -> DataFrame:
    """Fold of every entity per repeat: (repeat, id, fold).

    Entities are numbered in hash order, within the stratum if given, and dealt out in
    turn, so fold sizes differ by at most one.  All rows of an entity share its fold.
    """
    cols = [id_col] + ([stratum] if stratum else [])
    rows = entities.select(*cols).distinct()
    rows = rows.withColumn("repeat", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
    by = ["repeat"] + ([stratum] if stratum else [])
    rows = dense_index(rows, by=by, key=hash_key(F.lit(seed) + F.col("repeat"), F.col(id_col)))
    return rows.select("repeat", id_col, F.pmod(F.col("index"), F.lit(k)).cast("int").alias("fold"))


def with_folds(rows: DataFrame, folds: DataFrame, *, id_col: str, repeats: int = 1) -> DataFrame:
    """Attach ``folds``, the array of an entity's fold in each repeat, to its rows."""
    arr = folds.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("repeat", "fold"))),
                                                lambda s: s["fold"]).alias("folds"))
    return rows.join(arr, id_col)


def exact_draws(rows: DataFrame, *, resamples: int, id_col: str, by, seed: int = 0) -> DataFrame:
    """As many draws in each resample as the group has entities: (by, index, b), spread by the position drawn.

    ``rows`` are numbered entities (``index``, ``n_group``).  Every entity contributes one draw to each resample; it points
    at a position by hash, so the draws travel once, to the rows they meet.
    """
    rows = spread_out(rows.select(*by, id_col, "n_group"), id_col)
    draws = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    at = F.pmod(hash_int(F.lit(seed), F.col("b"), F.col(id_col)), F.col("n_group"))
    return draws.select(*by, at.alias("index"), "b").repartition(*by, "index")


def bootstrap_counts(entities: DataFrame, *, id_col: str, resamples: int, seed: int = 0, by=(), exact: bool = False) -> DataFrame:
    """How often each entity is drawn in each resample: (b, id, times), zero draws left out.

    With ``exact`` a resample holds as many draws as there are entities.  Without, each entity's number is Poisson with mean
    one, keyed by (seed, id, b), so it is formed in the row itself and resamples vary in size around that of the table.
    """
    by = as_list(by)
    if exact:
        rows = entities.select(*by, id_col).distinct()
        rows = cut(dense_index(rows, by=by, key=hash_key(F.lit(seed), F.col(id_col))))
        drawn = exact_draws(rows, resamples=resamples, id_col=id_col, by=by, seed=seed)
        times = drawn.groupBy(*by, "index", "b").agg(F.count(F.lit(1)).alias("times"))
        return null_safe_join(times, rows.select(*by, "index", id_col), [*by, "index"]).select("b", *by, id_col, "times")
    rows = with_keys(entities.select(*by, id_col).distinct(), id_col, seed)
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    return with_weight(rows, F.col("b"), drawn=True).select("b", *by, id_col, "times")


def bootstrap_mean(entities: DataFrame, *, id_col: str, values: Sequence[str], resamples: int = 2000,
                   seed: int = 0, low: float = 0.025, high: float = 0.975, by=(), exact: bool = False) -> DataFrame:
    """Mean of each per-entity value with its percentile interval over entity resamples, per group if given.

    Without ``exact``, weights are formed row by row and added up per resample inside the task that reads the rows: what
    is shuffled are sums per (group, resample).  With it (see ``bootstrap_counts``) the draws meet their rows once; entities
    must then be distinct.
    """
    by = as_list(by)
    if exact:
        rows = cut(dense_index(entities.select(*by, id_col, *values), by=by, key=hash_key(F.lit(seed), F.col(id_col))))
        drawn = exact_draws(rows, resamples=resamples, id_col=id_col, by=by, seed=seed).withColumnRenamed("b", "_b")
        drawn, t = null_safe_join(drawn, rows.select(*by, "index", *values), [*by, "index"]), F.lit(1)
    else:
        rows = spread_out(with_keys(entities.select(*by, id_col, *values), id_col, seed), id_col)
        rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
        drawn, t = with_weight(rows, F.col("_b"), "_t"), F.col("_t")
    means = drawn.groupBy(*by, "_b").agg(*[(F.sum(t * F.col(v)) / F.sum(F.when(F.col(v).isNotNull(), t))).alias(v)
                                          for v in values])
    long = means.unpivot([*by, "_b"], list(values), "variable", "mean")
    ci = exact_quantiles(long, by=[*by, "variable"], value="mean", probs=[low, high], names=["low", "high"])
    seen = entities.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values]).unpivot(by, list(values), "variable", "mean")
    return null_safe_join(seen, ci, [*by, "variable"])


def shuffled(rows: DataFrame, *, id_col: str, value: str, rounds: int, within: str | None = None,
             seed: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """The value of another row for every row, per round: (b, id, [within], value, shuffled, keep).

    Rows are numbered once, in hash order.  A round is a keyed permutation of the numbers, arithmetic on
    the row, and one look-up of the donor's value; ``keep`` names further columns of the receiver to carry.
    """
    by = as_list(within) if within else []
    base = rows.select(*by, id_col, value, *keep)
    base = cut(dense_index(base, by=by, key=hash_key(F.lit(f"{seed}d"), F.col(id_col))))
    donors = base.select(*by, F.col("index").alias("donor"), F.col(value).alias("shuffled"))
    turn = null_safe_join(with_donors(base, rounds, seed=seed), donors, by + ["donor"])
    return turn.select("b", *by, id_col, value, "shuffled", *keep)


def permutation_summary(observed: DataFrame, nulls: DataFrame, *, score: str = "score",
                        lower_is_better: bool = True) -> DataFrame:
    """observed, null mean and sd, p = (k + 1) / (n + 1) and its smallest possible value."""
    seen = nulls.withColumn("_obs", observed.select(score).scalar())
    good = F.col(score) <= F.col("_obs") if lower_is_better else F.col(score) >= F.col("_obs")
    out = seen.agg(F.max("_obs").alias("observed"), F.avg(score).alias("null_mean"),
                   F.stddev_pop(score).alias("null_sd"), F.count_if(good).alias("_k"),
                   F.count(score).alias("n_permutations"))
    return out.select("observed", "null_mean", "null_sd",
                      ((F.col("_k") + 1) / (F.col("n_permutations") + 1)).alias("p_value"),
                      (F.lit(1.0) / (F.col("n_permutations") + 1)).alias("p_min"), "n_permutations")


def permutation_test(score: Callable[[DataFrame], DataFrame], rows: DataFrame, *, id_col: str, label: str,
                     n_permutations: int = 200, seed: int = 0, lower_is_better: bool = True,
                     within: str | None = None) -> DataFrame:
    """Compare a score with its distribution under shuffled labels.

    ``score`` maps a frame with columns ``b`` and the label to (b, score), fitting whatever
    it needs per ``b``; it is called once for the real label (b = -1) and once for all
    shuffles together.
    """
    real = score(rows.withColumn("b", F.lit(-1))).select("score")
    others = [c for c in rows.columns if c not in (label, id_col, within)]
    mixed = shuffled(rows, id_col=id_col, value=label, rounds=n_permutations, within=within, seed=seed, keep=others)
    null_rows = mixed.drop(label).withColumnRenamed("shuffled", label)
    return permutation_summary(real, score(null_rows), lower_is_better=lower_is_better)


def coincidence_test(rows: DataFrame, *, id_col: str, day: str, other_day: str, rounds: int = 5000,
                     tolerance: float = 1.0, within: str | None = None, seed: int = 0) -> DataFrame:
    """Share of ids whose two days coincide against the share under shuffled second days."""
    share = lambda c: F.avg((F.abs(F.col(day) - F.col(c)) <= tolerance).cast("double"))
    keep = rows.where(F.col(day).isNotNull() & F.col(other_day).isNotNull())
    observed = keep.agg(share(other_day).alias("score"))
    mixed = shuffled(keep, id_col=id_col, value=other_day, rounds=rounds, within=within, seed=seed, keep=[day])
    nulls = mixed.groupBy("b").agg(share("shuffled").alias("score"))
    return permutation_summary(observed, nulls, lower_is_better=False)


def group_sizes(rows: DataFrame, *, group: str, min_group_size: int = 1) -> DataFrame:
    """Groups large enough to be left out, with test and training sizes; others dropped."""
    g = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n_test"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    g = g.withColumn("_n", total)
    return (g.where((F.col("n_test") >= min_group_size) & (F.col("_n") > F.col("n_test")))
            .select(group, "n_test", (F.col("_n") - F.col("n_test")).alias("n_train")))


def weighted_score(scores: DataFrame) -> DataFrame:
    """Mean over the groups left out, each counted by its size, with the number of groups and rows."""
    return scores.agg(F.count(F.lit(1)).alias("groups"), F.sum("n_test").alias("n_test"),
                      (F.sum(F.col("score") * F.col("n_test")) / F.sum("n_test")).alias("score"))


def leave_one_group_out(fit_predict: Callable[[DataFrame, DataFrame], DataFrame], rows: DataFrame, *,
                        group: str, metric: Column, min_group_size: int = 1) -> DataFrame:
    """Train without one whole group, predict on it: group, n_test, n_train, score.

    ``fit_predict`` takes (training rows, test rows) and returns the test rows with a
    ``prediction``; ``metric`` is an aggregate over them.  One fit per group.
    """
    rows = cut(rows)
    sizes = group_sizes(rows, group=group, min_group_size=min_group_size)
    out = None
    for r in sizes.orderBy(group).collect():
        test = rows.where(F.col(group) == r[group])
        train = rows.where(~F.col(group).eqNullSafe(F.lit(r[group])))
        one = fit_predict(train, test).agg(metric.alias("score")).select(
            F.lit(r[group]).alias("group"), F.lit(r["n_test"]).cast("long").alias("n_test"),
            F.lit(r["n_train"]).cast("long").alias("n_train"), "score")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return rows.sparkSession.createDataFrame([], "group string, n_test long, n_train long, score double")
    return out
