"""Ranking and error metrics, grouped by any keys and exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallpoint.contracts import as_list
from fallpoint.lineage import cut
from fallpoint.operators.ordered import dense_index, exact_quantiles, null_safe_join, running_totals
from fallpoint.plans.draws import draw_keys, poisson_weights


def auc(rows: DataFrame, *, score: str, y: str = "y", by=(), weight: Column | None = None,
        out: str = "auc") -> DataFrame:
    """Exact area under the ROC curve per group, ties counted half; NULL for a single class.

    Rows are first added up per distinct score, then ranked block-wise.
    """
    by = as_list(by)
    w = F.lit(1) if weight is None else weight
    d = (rows.where(F.col(score).isNotNull())
         .groupBy(*by, F.col(score).alias("_s"))
         .agg(F.sum(w * F.col(y)).alias("pos"), F.sum(w * (1 - F.col(y))).alias("neg")))
    d = running_totals(d, by=by, key="_s", sums=["pos", "neg"])
    win = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    pairs = F.max("total_pos") * F.max("total_neg")
    return d.groupBy(*by).agg(F.when(pairs > 0, win / pairs).alias(out),
                              F.max("total_pos").alias("events"), F.max("total_neg").alias("others"))


def brier(rows: DataFrame, *, p: str, y: str = "y", by=(), out: str = "brier") -> DataFrame:
    gap = F.col(y) - F.col(p)
    return rows.groupBy(*as_list(by)).agg(F.avg(gap * gap).alias(out))


def auc_within_day(rows: DataFrame, *, day_col: str, score: str, y: str = "y", least: int = 5) -> DataFrame:
    """AUC inside each day that has enough events and enough rows without one."""
    d = auc(rows, score=score, y=y, by=day_col)
    return d.where((F.col("events") >= least) & (F.col("others") >= least)).select(
        day_col, "events", (F.col("events") + F.col("others")).alias("at_risk"), "auc")


def mean_abs_error(rows: DataFrame, *, y: str, prediction: str, by=()) -> DataFrame:
    """MAE per group (usually per repeat and fold)."""
    return rows.groupBy(*as_list(by)).agg(F.avg(F.abs(F.col(y) - F.col(prediction))).alias("mae"))


def mae_over_folds(rows: DataFrame, *, y: str, prediction: str, folds, by=()) -> DataFrame:
    """Mean and population sd over folds of the fold MAE."""
    per = mean_abs_error(rows, y=y, prediction=prediction, by=as_list(by) + as_list(folds))
    return per.groupBy(*as_list(by)).agg(F.avg("mae").alias("mae"), F.stddev_pop("mae").alias("sd"))


def concordance(rows: DataFrame, *, time: str, event: str, score: str, by=()) -> DataFrame:
    """Share of comparable pairs ordered as their scores, ties half (larger score = later).

    A pair is comparable when the earlier time is an event; at equal times an event comes
    before a censored row and two events are not compared.  No pairs are formed: the places of
    the distinct (time, event) along the order are split by their binary digits, which puts each
    comparable pair into exactly one node of a tree, and every node is a rank sum along the
    score.  Times may be fractional and as large as doubles go.
    """
    by = as_list(by)
    d = rows.where(F.col(score).isNotNull() & F.col(time).isNotNull()).select(
        *by, F.struct(F.col(time).cast("double").alias("t"), (1 - F.col(event).cast("int")).alias("c")).alias("_t"),
        F.col(event).cast("int").alias("_e"), F.col(score).alias("_s"))
    d = cut(d.groupBy(*by, "_t", "_e", "_s").agg(F.count(F.lit(1)).alias("_n")))
    places = dense_index(d.select(*by, "_t").distinct(), by=by, key=F.col("_t"), out="_p").select(*by, "_t", "_p", "n_group")
    d = null_safe_join(d, places, by + ["_t"])
    # As many digits as the last place of the group has.
    digits = F.length(F.bin(F.col("n_group") - 1))
    d = d.withColumn("_l", F.explode(F.sequence(F.lit(0), digits - 1)))
    bit = F.expr("shiftright(_p, _l) & 1")
    d = d.withColumns({"_node": F.expr("shiftright(shiftright(_p, _l), 1)"),
                       "left": F.when(bit == 0, F.col("_e") * F.col("_n")).otherwise(0),
                       "right": F.when(bit == 1, F.col("_n")).otherwise(0)})
    d = d.where((F.col("left") > 0) | (F.col("right") > 0))
    keys = by + ["_l", "_node"]
    d = d.groupBy(*keys, "_s").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    d = running_totals(d, by=keys, key="_s", sums=["right"])
    good = F.col("total_right") - F.col("before_right") - F.col("right") + F.col("right") / 2
    out = d.groupBy(*by).agg(F.sum(F.col("left") * good).alias("_g"),
                             F.sum(F.col("left") * F.col("total_right")).alias("pairs"))
    return out.select(*by, "pairs", F.when(F.col("pairs") > 0, F.col("_g") / F.col("pairs")).alias("concordance"))


def bootstrap_auc(rows: DataFrame, *, id_col: str, score_a: str, score_b: str, y: str = "y",
                  resamples: int = 1000, seed: int = 0, by=()) -> DataFrame:
    """AUC of b, its gain over a, and percentile intervals over entity resamples, per group if given.

    Resamples are keyed weights of the entities.  Rows are put in the order of the score by one range
    partitioning, whatever the number of resamples; each range forms its rows' weights for all resamples,
    counts its own pairs and hands on totals, which the pairs across ranges need.  Ties count half: rows
    go through once with the others before the events of a tie and once after, so a range
    may end inside a tie.  Resamples with one class only are skipped.
    """
    by = as_list(by)
    k1, k2 = draw_keys(F.col(id_col), seed)
    variant = lambda m, o, s: F.struct(F.lit(m).alias("model"), F.lit(o).alias("turn"), F.col(s).cast("double").alias("score"))
    long = rows.select(*by, k1.alias("k1"), k2.alias("k2"), F.col(y).cast("int").alias("y"), F.inline(F.array(*[
        variant(m, o, s) for m, s in enumerate((score_a, score_b)) for o in (0, 1)]))).where("score is not null")
    long = long.withColumn("late", F.when(F.col("turn") == 0, F.col("y")).otherwise(1 - F.col("y")))
    keys = [*by, "model", "turn"]
    order = [*keys, "score", "late"]
    sorted_ = long.repartitionByRange(*order, "k1").sortWithinPartitions(*order).select(*keys, "k1", "k2", "late")
    count = resamples + 1  # the last one is the table itself

    def ranges(batches):
        import pandas as pd
        from pyspark import TaskContext

        part, held, ahead, win, take = TaskContext.get().partitionId(), None, None, None, None

        def told():
            out = {k: [v] * count for k, v in zip(keys, held)}
            return pd.DataFrame({**out, "part": part, "b": np.arange(count), "win": win, "give": ahead, "take": take})

        for pdf in batches:
            marks = list(pdf[keys].itertuples(index=False, name=None))
            edges = [0] + [i for i in range(1, len(marks)) if not _same(marks[i], marks[i - 1])] + [len(marks)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                if held is None or not _same(marks[lo], held):
                    if held is not None:
                        yield told()
                    held, ahead, win, take = marks[lo], np.zeros(count), np.zeros(count), np.zeros(count)
                for at in range(lo, hi, 1000):
                    some = pdf.iloc[at:min(at + 1000, hi)]
                    w = np.concatenate([poisson_weights(some["k1"], some["k2"], resamples), np.ones((len(some), 1))], axis=1)
                    late = some["late"].to_numpy()[:, None] == 1
                    before = np.cumsum(np.where(late, 0.0, w), axis=0)
                    taken = np.where(late, w, 0.0)
                    win += (taken * (before + ahead)).sum(axis=0)
                    take += taken.sum(axis=0)
                    ahead = ahead + before[-1]
        if held is not None:
            yield told()

    types = {f.name: f.dataType.simpleString() for f in sorted_.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", part int, b int, win double, give double, take double"
    parts = sorted_.mapInPandas(ranges, schema)
    # One row per group, range and resample from here on.
    w = Window.partitionBy(*keys, "b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("give").over(w), F.lit(0.0)))
    d = parts.groupBy(*by, "model", "b", "turn").agg(F.sum(F.col("win") + F.col("take") * F.col("_before")).alias("win"),
                                                     F.sum("give").alias("give"), F.sum("take").alias("take"))
    up = lambda c: F.max(F.when(F.col("turn") == 0, F.col(c)))
    pairs = up("give") * up("take")
    wins = (up("win") + pairs - F.max(F.when(F.col("turn") == 1, F.col("win")))) / 2
    d = d.groupBy(*by, "model", "b").agg(F.when(pairs > 0, wins / pairs).alias("auc"))
    d = cut(d.groupBy(*by, "b").agg(F.max(F.when(F.col("model") == 0, F.col("auc"))).alias("auc_a"),
                                    F.max(F.when(F.col("model") == 1, F.col("auc"))).alias("auc_b")))
    d = d.where(F.col("auc_b").isNotNull()).withColumn("gain", F.col("auc_b") - F.col("auc_a"))
    d = d.unpivot([*by, "b"], ["auc_b", "gain"], "metric", "value")
    ci = exact_quantiles(d.where(F.col("b") < resamples), by=[*by, "metric"], value="value", probs=[0.025, 0.975], names=["low", "high"])
    return null_safe_join(d.where(F.col("b") == resamples).drop("b"), ci, [*by, "metric"])


def _same(a: tuple, b: tuple) -> bool:
    """Equal keys, missing ones too."""
    return all(x == y or (x != x or x is None) and (y != y or y is None) for x, y in zip(a, b))
