"""Job compositions: batch detection on a file, day prediction, hazard and profile comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallpoint.contracts import by_day
from fallpoint.lineage import cut, few_rows
from fallpoint.operators import compare, grid, profile, risk
from fallpoint.operators.ordered import exact_quantiles
from fallpoint.plans import metrics, models, panel, resample
from fallpoint.plans.models import Membership


# ---------------------------------------------------------------- day prediction


def day_errors(rows: DataFrame, columns: Sequence[str], *, y: str, folds: Sequence[str], k: int = 5,
               model: str = "ridge", **forest) -> DataFrame:
    """Out-of-fold error of one model kind: (repeat, fold, n, mae)."""
    if model == "median":
        return models.median_errors(rows, y=y, folds=folds, k=k)
    if model == "ridge":
        return models.ridge_errors(rows, columns, y=y, folds=folds, k=k).select("repeat", "fold", "n", "mae")
    out = None
    for r, f in enumerate(folds):
        got = models.forest_predictions(rows, columns, y=y, fold=f, k=k, seed=r, **forest)
        one = got.groupBy(F.col(f).alias("fold")).agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(y) - F.col("prediction"))).alias("mae"))
        one = one.select(F.lit(r).alias("repeat"), "fold", "n", "mae")
        out = one if out is None else out.unionByName(one)
    return out


def compare_day_models(rows: DataFrame, sets: dict[str, Sequence[str]], *, y: str, folds: Sequence[str], k: int = 5,
                       kinds: Sequence[str] = ("median", "ridge"), **forest) -> DataFrame:
    """MAE mean and sd of every (feature set, model kind) on the same folds."""
    out = None
    for name, cols in sets.items():
        for kind in kinds:
            one = models.summary_of_errors(day_errors(rows, cols, y=y, folds=folds, k=k, model=kind, **forest))
            one = one.select(F.lit(name).alias("feature_set"), F.lit(kind).alias("model"),
                             F.lit(len(cols)).alias("n_columns"), "mae", "sd")
            out = one if out is None else out.unionByName(one)
    return out


def compare_on_subsets(rows: DataFrame, subsets: dict, sets: dict[str, Sequence[str]], *, y: str,
                       folds: Sequence[str], k: int = 5, kinds=("ridge",), **forest) -> DataFrame:
    """The same protocol on subsets of the entities, constant columns dropped in each."""
    from fallpoint.operators.quality import varying_columns

    out = None
    for name, cond in subsets.items():
        sub = cut(rows.where(cond))
        live = {s: varying_columns(sub, list(c)) for s, c in sets.items()}
        if not all(live.values()):
            raise ValueError(f"no column varies in subset {name!r} for: {', '.join(s for s, c in live.items() if not c)}")
        one = compare_day_models(sub, live, y=y, folds=folds, k=k, kinds=kinds, **forest).withColumn("subset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def ridge_permutation(rows: DataFrame, columns: Sequence[str], *, y: str, id_col: str, folds: Sequence[str], k: int = 5,
                      n_permutations: int = 200, within: str | None = None, seed: int = 0) -> DataFrame:
    """Permutation test of the cross-validated ridge error, everything refitted per shuffle.

    The shuffled labels of an entity travel as one array, so all shuffles are fitted in the
    same passes.
    """
    real = models.ridge_errors(rows, columns, y=y, folds=folds, k=k).agg(F.avg("mae").alias("score"))
    mixed = resample.shuffled(rows, id_col=id_col, value=y, rounds=n_permutations, within=within, seed=seed)
    labels = mixed.groupBy(id_col).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("b", F.col("shuffled").cast("double").alias("v")))), lambda s: s["v"]).alias("_labels"))
    data = cut(rows.join(labels, id_col))
    nulls = models.ridge_errors(_array_label(data, "_labels"), columns, y="_labels", folds=folds, k=k, labels=n_permutations)
    nulls = nulls.groupBy("b").agg(F.avg("mae").alias("score"))
    return resample.permutation_summary(real, nulls)


def _array_label(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn(name, F.col(name).cast("array<double>"))


def baseline_comparison(rows: DataFrame, columns: Sequence[str], *, y: str, group: str, id_col: str, folds: Sequence[str],
                        k: int = 5, resamples: int = 5000) -> dict[str, DataFrame]:
    """Ridge against the overall and the own-group training median, entity by entity.

    ``errors``: out-of-fold absolute errors per entity averaged over repeats;
    ``intervals``: mean difference rival - ridge with its interval and reading;
    ``by_day``: mean errors by the true day.
    """
    from fallpoint.plans.baselines import out_of_fold_medians

    rows = cut(models.ridge_entity_errors(rows, columns, y=y, folds=folds, k=k))
    for r, f in enumerate(folds):
        rows = out_of_fold_medians(rows, value=y, group=group, fold_col=f, folds=k).withColumnsRenamed(
            {"global_median": f"_g{r}", "group_median": f"_o{r}"})
    miss = lambda t: sum((F.abs(F.col(y) - F.col(f"_{t}{r}")) for r in range(len(folds))), F.lit(0.0)) / len(folds)
    errors = cut(rows.select(id_col, F.col(y).alias("true_day"), miss("g").alias("overall"), miss("o").alias("own_group"), "ridge"))
    gaps = errors.select(id_col, (F.col("overall") - F.col("ridge")).alias("overall"),
                         (F.col("own_group") - F.col("ridge")).alias("own_group"))
    ci = resample.bootstrap_mean(gaps, id_col=id_col, values=["overall", "own_group"], resamples=resamples)
    ci = ci.withColumnRenamed("variable", "rival").withColumn("verdict", compare.verdict(F.col("low"), F.col("high")))
    by_day = errors.groupBy("true_day").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("overall", "own_group", "ridge")])
    return {"errors": errors, "intervals": ci, "by_day": by_day}


def classifier_auc(rows: DataFrame, sets: dict[str, Sequence[str]], *, y: str, folds: Sequence[str], k: int = 5,
                   **forest) -> DataFrame:
    """Mean and sd over repeats of the out-of-fold forest AUC of each feature set."""
    out = None
    for name, cols in sets.items():
        for r, f in enumerate(folds):
            got = models.forest_predictions(rows, cols, y=y, fold=f, k=k, seed=r, classify=True, **forest).select(
                F.lit(name).alias("feature_set"), F.lit(r).alias("repeat"), F.col(y).alias("y"), "prediction")
            out = got if out is None else out.unionByName(got)
    per = metrics.auc(out, score="prediction", by=["feature_set", "repeat"])
    return per.groupBy("feature_set").agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("auc_sd"))


# ---------------------------------------------------------------- hazard


def hazard_ladder(rows: DataFrame, ladder: dict[str, Sequence[str]], *, folds: Sequence[str], k: int = 5,
                  how: str = "standard") -> DataFrame:
    """Mean and sd over repeats of AUC, and mean Brier score, of each nested column set."""
    out = None
    for name, cols in ladder.items():
        fits = models.fit_logistic(rows, cols, member=Membership(tuple(folds), k), how=how)
        for r, f in enumerate(folds):
            part = models.LinearFits(fits.columns, fits.beta[r * k:(r + 1) * k], fits.intercept[r * k:(r + 1) * k],
                                     models.Scaling(*[v[r * k:(r + 1) * k] for v in (
                                         fits.scaling.median, fits.scaling.center, fits.scaling.scale)]), fits.usable)
            got = models.predict_risk(rows, part, folds=[f], k=k).select(
                F.lit(name).alias("model"), F.lit(r).alias("repeat"), "y", "p")
            out = got if out is None else out.unionByName(got)
    out = cut(out)
    keys = ["model", "repeat"]
    both = metrics.auc(out, score="p", by=keys).join(metrics.brier(out, p="p", by=keys), keys)
    return both.groupBy("model").agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("auc_sd"),
                                     F.avg("brier").alias("brier"))


def hazard_report(rows: DataFrame, base: Sequence[str], full: Sequence[str], *, id_col: str, day_col: str,
                  folds: Sequence[str], k: int = 5, resamples: int = 1000) -> dict[str, DataFrame]:
    """Scores of a base and a full model out of fold: intervals, AUC by day, alarms."""
    scored = models.out_of_fold_risk(rows, base, folds=folds, k=k, out="p0")
    scored = cut(models.out_of_fold_risk(scored, full, folds=folds, k=k, out="p1"))
    return {"scored": scored,
            "auc": metrics.bootstrap_auc(scored, id_col=id_col, score_a="p0", score_b="p1", resamples=resamples),
            "by_day": metrics.auc_within_day(scored, day_col=day_col, score="p1"),
            "alarms": compare.alarm_summary(compare.first_alarm(scored, id_col=id_col, day_col=day_col, p_col="p1"))}


def anticipation(by_lead: dict[int, DataFrame], base: Sequence[str], full: Sequence[str], *, id_col: str,
                 folds: Sequence[str], k: int = 5, resamples: int = 1000) -> DataFrame:
    """AUC and gain over the day-only model at each lead."""
    out = None
    for lead, rows in by_lead.items():
        scored = models.out_of_fold_risk(rows, base, folds=folds, k=k, out="p0")
        scored = models.out_of_fold_risk(scored, full, folds=folds, k=k, out="p1")
        one = scored.select(F.lit(lead).alias("lead"), id_col, "y", "p0", "p1")
        out = one if out is None else out.unionByName(one)
    return metrics.bootstrap_auc(out, id_col=id_col, score_a="p0", score_b="p1", resamples=resamples, by="lead")


def leave_group_out_hazard(rows: DataFrame, base: Sequence[str], full: Sequence[str], *, group: str, id_col: str,
                           min_ids: int = 15, how: str = "robust") -> DataFrame:
    """AUC of base and full model on each large group, trained on the others: all groups in the same passes."""
    tagged, groups = models.numbered_groups(rows, group=group, id_col=id_col, min_ids=min_ids)
    tagged, k = cut(tagged), groups.count()
    if not k:
        return groups.select(F.col(group).alias("group"), "ids", *[F.lit(0.0).alias(c) for c in ("events", "auc_base", "auc_full", "gain")])
    scored = tagged.where("_group >= 0")
    for name, cols in (("p0", base), ("p1", full)):
        fits = models.fit_logistic(tagged, cols, member=Membership(("_group",), k), how=how)
        scored = models.predict_risk(scored, fits, folds=["_group"], k=k, out=name)
    scored = cut(scored.select("_group", "y", "p0", "p1"))
    both = metrics.auc(scored, score="p0", by="_group", out="auc_base").select("_group", "auc_base", "events").join(
        metrics.auc(scored, score="p1", by="_group", out="auc_full").select("_group", "auc_full"), "_group")
    return both.join(groups, "_group").select(F.col(group).alias("group"), "ids", "events", "auc_base", "auc_full",
                                              (F.col("auc_full") - F.col("auc_base")).alias("gain"))


def leave_group_out_errors(rows: DataFrame, columns: Sequence[str] = (), *, y: str, group: str, id_col: str, min_group_size: int = 1,
                           model: str = "median") -> DataFrame:
    """Mean absolute error on each group of ``median`` or ``ridge`` trained on all others: (group, n_test, n_train, score), in one fit."""
    known = rows.where(F.col(y).isNotNull())
    tagged, groups = models.numbered_groups(known, group=group, id_col=id_col, min_ids=min_group_size)
    tagged, k = cut(tagged), groups.count()
    total = tagged.count()
    errors = models.median_errors if model == "median" else lambda d, **kw: models.ridge_errors(d, columns, **kw)
    got = errors(tagged, y=y, folds=["_group"], k=k) if k else None
    if got is None:
        return rows.sparkSession.createDataFrame([], "group string, n_test long, n_train long, score double")
    out = got.join(groups, got["fold"] == groups["_group"]).where(F.col("n") < total)
    return out.select(F.col(group).alias("group"), F.col("n").cast("long").alias("n_test"), (total - F.col("n")).cast("long").alias("n_train"),
                      F.col("mae").alias("score"))


# ---------------------------------------------------------------- profiles


def _observed(window: DataFrame) -> DataFrame:
    return window.withColumn("state", F.coalesce((F.col("day") >= F.col("event_day")).cast("double"), F.lit(0.0)))


def fit_on_folds(window: DataFrame, kin: panel.Kinetics, *, id_col: str, fold: str, folds: int,
                 forms: Sequence[tuple] | None = None) -> panel.PanelFits:
    """Panel fit for every training set, with the observed switch; optionally for every form."""
    rows = _observed(window)
    mean, sd = panel.covariate_scaling(rows, kin, fold=fold, folds=folds)
    if forms is None:
        inter = panel.interval_columns(rows, kin, id_col=id_col)
        mom = panel.series_moments(inter, kin, id_col=id_col, keys=[fold])
        return panel.fit_panel(cut(mom), kin, fold=fold, folds=folds, mean=mean, sd=sd)
    mom = panel.form_moments(panel.interval_columns(rows, kin, id_col=id_col), kin, forms, id_col=id_col, fold=fold)
    return panel.fit_panel(cut(mom), kin, fold=fold, folds=folds, mean=mean, sd=sd, variants=len(forms))


def fit_dilutions(window: DataFrame, kin: panel.Kinetics, dilutions: Sequence[float], *, id_col: str, fold: str, folds: int) -> list[panel.PanelFits]:
    """``fit_on_folds`` for each daily loss: rows are read once, since a loss only adds its share of the level to the response."""
    rows, plain = _observed(window), replace(kin, dilution=0.0)
    mean, sd = panel.covariate_scaling(rows, plain, fold=fold, folds=folds)
    inter = panel.interval_columns(rows, plain, id_col=id_col)
    mom = cut(panel.series_moments(inter, plain, id_col=id_col, keys=[fold], more=[kin.level]))
    shapes = [replace(kin, dilution=d) for d in dilutions]
    return [panel.fit_panel(panel.diluted(mom, k), k, fold=fold, folds=folds, mean=mean, sd=sd) for k in shapes]


def score_profiles(window: DataFrame, fits: panel.PanelFits, kin: panel.Kinetics, *, id_col: str, fold: str = "fold",
                   form: DataFrame | None = None, frozen: str | None = None, name: str = "model") -> DataFrame:
    """Per series: profile error, two-day error and simulated event day under one model.

    ``window`` carries the switch in ``kin.state``; ``form`` (fold, variant, half, floor) holds the
    consumption form per fold.  ``frozen`` names the switch without the measures of its own day: ``rmse2_frozen`` is the
    two-day error whose second step takes it, NULL without.
    """
    spark = window.sparkSession
    rows, half, floor = window, None, None
    choose = None
    if form is not None:
        rows = rows.join(form, fold)
        half, floor = F.col("half"), F.col("floor")
        choose = [r["variant"] for r in form.orderBy(fold).collect()]
    inter = panel.interval_columns(rows, kin, id_col=id_col, half=half, floor=floor)
    inter = panel.with_own_alpha(inter, fits.frame(spark, choose), kin, id_col=id_col, fold=fold)
    if frozen is not None:
        inter = inter.withColumns({"_make": F.col("make"), "_use": F.col("use"), "make": 1 - F.col(frozen), "use": F.col(frozen)})
        inter = panel.step_columns(inter, kin, half=half, floor=floor).withColumns(
            {"gain_frozen": F.col("gain"), "loss_frozen": F.col("loss"), "sat_frozen": F.col("sat"), "make": F.col("_make"), "use": F.col("_use")})
    # All that follows is by series, so rows are dealt by series once and no branch reads them again.
    inter = panel.step_columns(inter, kin, half=half, floor=floor)
    whole, kept = grid.whole([id_col]), ["rmse2"]
    two = lambda rows, out, **second: panel.two_step_errors(rows, id_col=id_col, day_col=kin.day, level_col=kin.level, half=half, floor=floor,
                                                            **second).withColumn(out, panel.root_mean_square("error2", whole)).drop("error2")
    inter = two(inter, "rmse2")
    if frozen is not None:
        inter, kept = two(inter, "rmse2_frozen", second=("gain_frozen", "loss_frozen", "sat_frozen")), ["rmse2", "rmse2_frozen"]
    sim = panel.simulate(inter, id_col=id_col, day_col=kin.day, level_col=kin.level, keep=kept,
                         half="half" if form is not None else None, floor="floor" if form is not None else None)
    sim = sim.withColumn("_e", F.col("simulated") - F.col(kin.level))
    sim = sim.withColumn("rmse", panel.root_mean_square("_e", whole))
    out = panel.profile_event_day(sim, id_col=id_col, day_col=kin.day, value_col="simulated", keep=["rmse", *kept])
    late = F.col("rmse2_frozen") if frozen is not None else F.lit(None).cast("double").alias("rmse2_frozen")
    return out.select(F.lit(name).alias("model"), id_col, "rmse", "rmse2", late, F.col("event_day").alias("simulated_day"))


def chosen_form(fits: panel.PanelFits, forms: Sequence[tuple], spark) -> DataFrame:
    """fold, variant, half, floor: the consumption form with the smallest training error of each fold."""
    rows = [(f, int(v), forms[v][0], float(forms[v][1])) for f, v in enumerate(panel.choose_form(fits))]
    return few_rows(spark, rows, "fold int, variant int, half double, floor double")


def baseline_profiles(window: DataFrame, *, id_col: str, fold: str, folds: int) -> DataFrame:
    """Mean training profile and today's level plus the mean training two-day increment."""
    base = profile.training_profile(window, id_col=id_col, day_col="day", value_col="level", fold_col=fold, folds=folds)
    rows = window.join(base, [fold, "day"], "left")
    ahead = F.lead("level", 2).over(by_day(id_col, "day"))
    rows = rows.withColumns({"_e": F.col("mean_value") - F.col("level"),
                             "_e2": F.col("level") + F.col("mean_increment") - ahead})
    out = rows.groupBy(id_col).agg(panel.root_mean_square("_e").alias("rmse"), panel.root_mean_square("_e2").alias("rmse2"))
    return out.select(F.lit("mean_profile").alias("model"), id_col, "rmse", "rmse2", F.lit(None).cast("double").alias("rmse2_frozen"),
                      F.lit(None).cast("int").alias("simulated_day"))


def hazard_switch(window: DataFrame, at_risk: DataFrame, blind: DataFrame, columns: Sequence[str], measures: Sequence[str],
                  *, id_col: str, fold: str = "fold", folds: int = 5) -> DataFrame:
    """The window with ``state`` and ``state_frozen`` predicted by the hazard trained without the fold."""
    fits = models.fit_logistic(at_risk, columns, member=Membership((fold,), folds))
    rows = models.predict_risk(blind, fits, folds=[fold], k=folds, out="h")
    w = by_day(id_col, "day")
    known = [c for c in measures if c in columns]
    old = rows.withColumns({c: F.lag(c).over(w) for c in known})
    old = models.predict_risk(old, fits, folds=[fold], k=folds, out="hz").select(id_col, "day", "h", "hz")
    both = panel.predicted_switch(old, id_col=id_col, day_col="day", hazard="h", frozen_hazard="hz")
    both = both.select(id_col, "day", "state", "state_frozen")
    out = window.drop("state").join(both, [id_col, "day"], "left")
    return out.na.fill(0.0, ["state", "state_frozen"])


def true_forecast(window: DataFrame, fits: panel.PanelFits, kin: panel.Kinetics, *, id_col: str, fold: str = "fold",
                  first_day: int = 4, name: str = "model") -> DataFrame:
    """Two-day forecasts from day ``first_day`` on without future measurements.

    The exposure of the next two days continues the last step in a straight line (never
    below zero); the second step uses the frozen switch where the window has one.
    """
    w = by_day(id_col, kin.day)
    inter = panel.interval_columns(window, kin, id_col=id_col)
    inter = panel.with_own_alpha(inter, fits.frame(window.sparkSession), kin, id_col=id_col, fold=fold)
    x = F.col(kin.exposure)
    trend = x - F.lag(kin.exposure).over(w)
    inter = inter.withColumns({"_x1": panel.not_below_zero(x + trend), "_x2": panel.not_below_zero(x + 2 * trend),
                               "_alpha": F.col("alpha")})
    frozen = "state_frozen" if "state_frozen" in window.columns else kin.state
    nxt = {f"_n_{c}": F.lead(c).over(w) for c in [*kin.covariates, *([frozen] if kin.state else [])]}
    inter = inter.withColumns({**nxt, "_obs": F.lead(kin.level, 2).over(w)})
    one = inter.withColumns({"grow": panel.not_below_zero(F.col("_x1") - x), "area": (x + F.col("_x1")) / 2})
    one = panel.step_columns(one, kin).withColumn("_s1", panel.one_step(F.col(kin.level), F.col("gain"), F.col("loss"), F.col("sat")))
    two = one.withColumns({"grow": panel.not_below_zero(F.col("_x2") - F.col("_x1")), "area": (F.col("_x1") + F.col("_x2")) / 2,
                           **{c: F.col(f"_n_{c}") for c in kin.covariates}})
    if kin.state:
        two = two.withColumns({"make": 1 - F.col(f"_n_{frozen}"), "use": F.col(f"_n_{frozen}")})
    two = panel.step_columns(two, kin)
    ahead = panel.one_step(F.col("_s1"), F.col("gain"), F.col("loss"), F.col("sat"))
    ok = (F.col(kin.day) >= first_day) & F.col("_obs").isNotNull()
    out = two.withColumn("_e", F.when(ok, ahead - F.col("_obs"))).groupBy(id_col).agg(panel.root_mean_square("_e").alias("rmse2"))
    return out.select(F.lit(name).alias("model"), id_col, "rmse2")


def paired_difference(scores: DataFrame, *, id_col: str, metric: str, model: str, rival: str,
                      resamples: int = 2000) -> DataFrame:
    """Mean paired difference model - rival with its interval over entity resamples."""
    wide = scores.groupBy(id_col).agg(*[F.max(F.when(F.col("model") == m, F.col(metric))).alias(f"_{i}")
                                        for i, m in enumerate((model, rival))])
    rows = wide.select(id_col, (F.col("_0") - F.col("_1")).alias("difference")).where(F.col("difference").isNotNull())
    ci = resample.bootstrap_mean(rows, id_col=id_col, values=["difference"], resamples=resamples)
    return ci.select(F.lit(model).alias("model"), F.lit(rival).alias("rival"), F.lit(metric).alias("metric"), "mean", "low", "high")


# ---------------------------------------------------------------- detection on a file


def detect_file(spark, path: str, out_path: str | None = None, *, id_col: str = "culture", day_col: str = "day",
                value_col: str = "lactate", **options) -> DataFrame:
    """Read, check and detect on a delimited file; natural id order, optional CSV output."""
    from fallpoint.operators.detect import detect_shift_batch, isolated_low_points
    from fallpoint.sources.tables import load_series, write_csv

    data = load_series(spark, path, id_col=id_col, day_col=day_col, value_col=value_col)
    options.setdefault("on_error", "raise")
    found = detect_shift_batch(data, id_col=id_col, day_col=day_col, value_col=value_col, **options)
    low = isolated_low_points(data, id_col=id_col, day_col=day_col, value_col=value_col).groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.col(day_col).cast("int"))).alias("suspect_days"))
    out = found.select(id_col, "occurred", "day", "time", "drop_fraction", "reason").join(low, id_col, "left")
    out = profile.natural_order(out, id_col)
    if out_path:
        write_csv(out.withColumn("suspect_days", F.concat_ws(" ", F.transform("suspect_days", lambda d: d.cast("string")))),
                  out_path, digits=3)
    return out
