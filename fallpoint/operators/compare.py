"""Comparing labels, detections and declared answers; timing accuracy and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallpoint.contracts import as_list
from fallpoint.functions.columns import interval_distance
from fallpoint.functions.tails import exact_interval
from fallpoint.lineage import cut
from fallpoint.operators.ordered import exact_quantiles


class OrphanRows(ValueError):
    """Two tables that must match key by key do not."""


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with ``match``: both, left_only or right_only."""
    a = left.withColumn("_l", F.lit(True))
    b = right.withColumn("_r", F.lit(True))
    out = a.join(b, list(keys), "full")
    state = (F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only")
             .otherwise("both"))
    return out.withColumn("match", state).drop("_l", "_r")


def require_match(left: DataFrame, right: DataFrame, keys: Sequence[str], show: int = 20) -> DataFrame:
    """The joined rows, or :class:`OrphanRows` with the number of keys found on one side only and the first ``show`` of them."""
    both = matched(left, right, keys)
    single = both.where(F.col("match") != "both").select(*keys, "match")
    count = single.count()
    if count:
        bad = single.orderBy(*keys, "match").limit(show).collect()
        raise OrphanRows(f"{count} keys on one side only: " + "; ".join(f"{[r[k] for k in keys]} {r['match']}" for r in bad))
    return both.drop("match")


def compare_labels(a: DataFrame, b: DataFrame, *, id_col) -> DataFrame:
    """Per id: both labels, whether the class changed and the day difference a - b."""
    ids = as_list(id_col)
    pick = lambda df, t: df.select(*ids, F.col("occurred").alias(f"occurred_{t}"), F.col("day").alias(f"day_{t}"))
    out = pick(a, "a").join(pick(b, "b"), ids)
    return out.withColumns({"class_change": F.col("occurred_a") != F.col("occurred_b"),
                            "day_difference": F.col("day_a") - F.col("day_b")})


def comparison_summary(compared: DataFrame) -> DataFrame:
    gap = F.abs("day_difference")
    return compared.agg(F.count(F.lit(1)).alias("ids"), F.count_if("occurred_a").alias("events_a"),
                        F.count_if("occurred_b").alias("events_b"),
                        F.count_if("class_change").alias("class_changes"),
                        F.count_if(F.col("day_difference") == 0).alias("same_day"),
                        F.count_if(gap >= 2).alias("two_days_or_more"), F.max(gap).alias("max_gap"))


def difference_counts(compared: DataFrame) -> DataFrame:
    return (compared.where(F.col("day_difference").isNotNull()).groupBy("day_difference")
            .agg(F.count(F.lit(1)).alias("ids")))


def label_sensitivity(labels: DataFrame, *, by, window: int = 4) -> DataFrame:
    """Per parameter combination: excluded, modelled, events, censored and median event day.

    ``labels`` is one row per (combination, series), as made by ``label_grid``; an event
    inside the early window excludes the series.
    """
    by = as_list(by)
    early = F.col("occurred") & F.coalesce(F.col("day") <= window, F.lit(False))
    rows = cut(labels.withColumns({"_early": early, "_late": F.when(F.col("occurred") & ~early, F.col("day"))})
               .select(*by, "occurred", "_early", "_late"))
    out = rows.groupBy(*by).agg(F.count_if("_early").alias("excluded"), F.count_if(~F.col("_early")).alias("modelled"),
                                F.count("_late").alias("events"), F.count_if(~F.col("occurred")).alias("censored"))
    return out.join(exact_quantiles(rows, by=by, value="_late", probs=[0.5], names=["median_day"]), by, "left")


def detector_accuracy(detected: DataFrame, truth: DataFrame, *, id_col, true_day: str, by=()) -> DataFrame:
    """Detected, exact, within a day, mean bias and false positives per group of runs."""
    ids, by = as_list(id_col), as_list(by)
    rows = detected.join(truth.select(*ids, F.col(true_day).alias("_t")), ids)
    real, got = F.col("_t").isNotNull(), F.col("occurred")
    err = F.when(real & got, F.col("day") - F.col("_t"))
    return rows.withColumn("_e", err).groupBy(*by).agg(
        F.count_if(real).alias("with_event"), F.count("_e").alias("detected"),
        F.count_if(F.col("_e") == 0).alias("exact"), F.count_if(F.abs("_e") <= 1).alias("within_1_day"),
        F.avg("_e").alias("mean_bias"), F.count_if(~real & got).alias("false_positives"))


def accuracy_rollup(accuracy: DataFrame, *, by) -> DataFrame:
    """Average of the per-run biases and shares over the added counts."""
    out = accuracy.groupBy(*as_list(by)).agg(
        F.avg("mean_bias").alias("mean_bias"),
        *[F.sum(c).alias(c) for c in ("exact", "detected", "within_1_day", "with_event", "false_positives")])
    return out.withColumns({"pct_exact": F.col("exact") / F.col("detected") * 100,
                            "pct_detected": F.col("detected") / F.col("with_event") * 100})


def score_declared(detected: DataFrame, declared: DataFrame, *, keys: Sequence[str],
                   tolerance: float = 1.0) -> DataFrame:
    """Detections against declared day intervals: distance, hit and signed error.

    ``detected``: keys, ``occurred``, ``day``; ``declared``: keys, ``day_min``,
    ``day_max``, ``no_event`` (boolean).  A miss is infinitely far away.
    """
    rows = declared.join(detected.select(*keys, "occurred", "day"), list(keys))
    inf = F.lit(float("inf"))
    dist = (F.when(F.col("no_event"), F.when(F.col("occurred"), inf).otherwise(0.0))
            .when(~F.col("occurred"), inf)
            .otherwise(interval_distance(F.col("day"), F.col("day_min"), F.col("day_max"))))
    mid = (F.col("day_min") + F.col("day_max")) / 2
    signed = F.when(~F.col("no_event") & F.col("occurred"), F.col("day") - mid)
    return (rows.withColumn("distance", dist).withColumn("hit", F.col("distance") <= tolerance)
            .withColumn("signed_error", signed))


def declared_summary(scored: DataFrame, *, success: float = 0.80, alpha: float = 0.05, by=()) -> DataFrame:
    """Hits, exact matches, exact interval, mean bias and verdict."""
    out = scored.groupBy(*as_list(by)).agg(
        F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("distance") == 0).alias("exact"), F.avg("signed_error").alias("mean_bias"))
    low, high = exact_interval(F.col("hits"), F.col("n"), alpha)
    return (out.withColumn("rate", F.col("hits") / F.col("n")).withColumns({"low": low, "high": high})
            .withColumn("passes", F.col("rate") >= success))


def first_alarm(rows: DataFrame, *, id_col, day_col: str, p_col: str, threshold: float = 0.5) -> DataFrame:
    """Per series with an event: first alarm day and outcome exact, early or none in time."""
    out = rows.groupBy(*as_list(id_col)).agg(
        F.min(F.when(F.col("y") == 1, F.col(day_col))).alias("event_day"),
        F.min(F.when(F.col(p_col) >= threshold, F.col(day_col))).alias("alarm_day"))
    kind = (F.when(F.col("alarm_day").isNull(), "none_in_time")
            .when(F.col("alarm_day") == F.col("event_day"), "exact").otherwise("early"))
    return out.where(F.col("event_day").isNotNull()).withColumn("outcome", kind)


def alarm_summary(alarms: DataFrame) -> DataFrame:
    return alarms.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("exact", "early", "none_in_time")])


def timing_errors(days: DataFrame, *, truth: str, methods: Sequence[str]) -> DataFrame:
    """Long table (true_day, method, error) over series that have a true day."""
    rows = days.where(F.col(truth).isNotNull()).select(
        F.col(truth).alias("true_day"), *[(F.col(m) - F.col(truth)).cast("double").alias(m) for m in methods])
    return rows.unpivot(["true_day"], list(methods), "method", "error")


def timing_table(days: DataFrame, *, truth: str, methods: Sequence[str], by_day: bool = False) -> DataFrame:
    """Exact and within-a-day shares per method; a missed event counts as wrong."""
    rows = timing_errors(days, truth=truth, methods=methods)
    keys = ["method", "true_day"] if by_day else ["method"]
    hit = lambda cond: F.avg(F.coalesce(cond.cast("double"), F.lit(0.0)))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ids"), F.count("error").alias("detected"),
        hit(F.col("error") == 0).alias("exact"), hit(F.abs("error") <= 1).alias("within_1_day"),
        F.avg(F.abs("error")).alias("mae_detected"))


def top_overlap(importance: DataFrame, *, fold: str, name: str, value: str, k: int = 5) -> DataFrame:
    """Average number of shared names between the top k of two folds.

    A name in the top of c folds is shared by c (c - 1) / 2 pairs, so no pairs are formed.
    """
    w = Window.partitionBy(fold).orderBy(F.col(value).desc(), name)
    top = importance.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    per = top.groupBy(name).agg(F.count(F.lit(1)).alias("_c"))
    folds = importance.agg(F.count_distinct(fold).alias("_f")).scalar()
    shared = F.sum(F.col("_c") * (F.col("_c") - 1) / 2)
    return per.agg(shared.alias("_s")).withColumn("_f", folds).select(
        (F.col("_s") / (F.col("_f") * (F.col("_f") - 1) / 2)).alias("mean_overlap"))


def rank_stability(importance: DataFrame, *, fold: str, name: str, value: str) -> DataFrame:
    """Standard deviation over folds of each name's rank (1 = largest, ties averaged)."""
    w = Window.partitionBy(fold)
    desc = F.rank().over(w.orderBy(F.col(value).desc()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(fold, value))
    return (importance.withColumn("_r", desc + (ties - 1) / 2).groupBy(name)
            .agg(F.stddev_samp("_r").alias("rank_sd"), F.avg("_r").alias("mean_rank")))


# Fixed value: the published margin that counts as a win.
WIN_MARGIN = 0.01


def verdict(low: Column, high: Column, margin: float = WIN_MARGIN) -> Column:
    """Reading of an interval of error differences (rival minus model)."""
    return (F.when(low >= margin, "wins").when(high < 0, "loses")
            .when(low >= 0, "touches zero").otherwise("inconclusive"))


def decision(summary: DataFrame, *, high: str, correct_model: str, correct_rival: str) -> DataFrame:
    """Pre-set rule: interval wholly below zero and more correct days than the rival."""
    return summary.withColumns({"interval_below_zero": F.col(high) < 0,
                                "more_correct": F.col(correct_model) > F.col(correct_rival)}
                               ).withColumn("accepted", F.col("interval_below_zero") & F.col("more_correct"))


def wins_in_groups(groups: DataFrame, *, low: str, need: int = 2) -> DataFrame:
    """Does the gain's interval lie above zero in at least ``need`` groups?"""
    return groups.agg(F.count_if(F.col(low) > 0).alias("wins"), F.count(F.lit(1)).alias("groups")
                      ).withColumn("accepted", F.col("wins") >= need)


def same_direction(effects: DataFrame, *, name: str, group: str, value: str, groups: int) -> DataFrame:
    """Do the log effects of a variable share one sign in all groups?"""
    sign = F.signum(F.ln(value))
    out = effects.groupBy(name).agg(F.count(F.when(F.col(value).isNotNull(), 1)).alias("_n"),
                                    F.min(sign).alias("_a"), F.max(sign).alias("_b"))
    return out.select(name, ((F.col("_n") == groups) & (F.col("_a") == F.col("_b"))).alias("same_direction"))
