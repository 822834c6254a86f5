"""Queries that fit and validate models; iterative, so mostly without check SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from fallpoint.lineage import cut
from fallpoint.operators import compare, features, grid, profile, risk, stats
from fallpoint.operators.ordered import exact_quantiles
from fallpoint.plans import jobs, metrics, models, panel, resample
from fallpoint.plans.models import Membership
from workload.basics import found
from workload.bindings import KINDS, daily, table, user_days
from workload.ctes import detect as detect_sql
from workload.ctes import with_ctes
from workload.registry import query, r6
from workload.ctes import labels as labels_sql
from workload.series import KEY, LX, MEASURES, _scores, pp, rate_table, scored_rows, shared_tables, window_rows

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
BASE = list(risk.DAY_FLAGS)
HAZARD = BASE + risk.SCHEDULE + MEASURES + ["d_exposure"]
FEATURES = ["level_last", "level_slope", "level_mean", "exposure_last", "exposure_slope", "click_mean", "view_mean"]


def folded(rows, repeats=1, k=5, stratum=None):
    """Fold columns f0.. on rows keyed by id."""
    folds = resample.fold_of(rows, id_col="id", k=k, repeats=repeats, stratum=stratum)
    wide = folds.groupBy("id").agg(*[F.max(F.when(F.col("repeat") == r, F.col("fold"))).alias(f"f{r}")
                                     for r in range(repeats)])
    return rows.join(wide, "id")


def day_table(spark, sf, repeats=1, k=5):
    """Early-window features with the event day of series that have one, and folds."""
    d = daily(spark, sf)
    x = features.early_window_features(d, **KEY, value_cols=["level", "exposure", "click", "view"], window=4,
                                       static_cols=["segment"])
    lab = found(spark, sf).select("id", "occurred", F.col("day").alias("event_day"), "time")
    return cut(folded(cut(x.join(lab, "id").where("occurred")), repeats, k))


def hazard_rows(spark, sf, repeats=1, lead=1, shared=None):
    rows = cut(pp(spark, sf, lead=lead, shared=shared))
    return cut(folded(rows.withColumn("_has", F.max("y").over(grid.whole("id"))), repeats, stratum="_has").drop("_has"))


@query("j7_ridge_errors")
def _(spark, sf):
    return models.ridge_errors(day_table(spark, sf, 2), FEATURES, y="event_day", folds=["f0", "f1"])


@query("j8_forest_predictions")
def _(spark, sf):
    d = models.forest_predictions(day_table(spark, sf), FEATURES, y="event_day", fold="f0", k=5, trees=20, depth=8)
    return d.select("id", "f0", "event_day", "prediction")


@query("j9_hazard_coefficients")
def _(spark, sf):
    rows = pp(spark, sf)
    fits = models.fit_logistic(cut(rows), HAZARD)
    out = [(c, float(b)) for c, b in zip(fits.columns, fits.beta[0])]
    return spark.createDataFrame(out, "variable string, coefficient double")


@query("j10_least_squares_by_group", with_ctes(detect_sql("ud", "t") | {"v": "select id, exposure from dy where day = 3",
    "x": """select t.id, t.day, exposure, c_mktsegment as segment from t join v on v.id = t.id left join customer on c_custkey = t.id
    where occurred"""}, """select segment, count(*) as n, round(regr_intercept(day, exposure), 6) as intercept,
    round(regr_slope(day, exposure), 6) as coef_exposure, round(regr_r2(day, exposure), 6) as r2 from x group by 1"""))
def _(spark, sf):
    day3 = daily(spark, sf).where("day = 3").select("id", "exposure", "segment")
    rows = found(spark, sf).where("occurred").select("id", "day").join(day3, "id")
    d = stats.least_squares(rows, y="day", x=["exposure"], by="segment")
    return d.select("segment", "n", r6("intercept"), r6("coef_exposure"), r6("r2"))


def survival_rows(spark, sf):
    x = features.early_window_features(daily(spark, sf), **KEY, value_cols=["level", "exposure", "click", "view"], window=4)
    lab = rate_table(spark, sf).select("id", "time", F.col("event").cast("int").alias("happened"))
    return cut(folded(cut(x.join(lab, "id")), 1))


@query("j11_cox_concordance")
def _(spark, sf):
    return models.cox_concordance(survival_rows(spark, sf), FEATURES, time="time", event="happened", folds=["f0"])


@query("j11_cox_permutation")
def _(spark, sf):
    return models.cox_permutation(survival_rows(spark, sf), FEATURES, time="time", event="happened", id_col="id", folds=["f0"])


@query("j12_components")
def _(spark, sf):
    m = cut(risk.trajectory_matrix(daily(spark, sf), **KEY, variables=["level", "exposure", "click"]))
    scores, _, _ = models.components(m, [c for c in m.columns if c != "id"], id_col="id")
    return scores


@query("j12_component_shares")
def _(spark, sf):
    m = cut(risk.trajectory_matrix(daily(spark, sf), **KEY, variables=["level", "exposure", "click"]))
    scores, loads, shares = models.components(m, [c for c in m.columns if c != "id"], id_col="id")
    seg = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    eta = stats.eta_squared(scores.join(seg, "id"), value="pc1", group="segment").select("eta2").scalar()
    return shares.withColumn("eta2_first_by_group", eta)


@query("j12_loadings_by_variable")
def _(spark, sf):
    m = cut(risk.trajectory_matrix(daily(spark, sf), **KEY, variables=["level", "exposure", "click"]))
    _, loads, _ = models.components(m, [c for c in m.columns if c != "id"], id_col="id")
    base = F.regexp_replace("variable", r"_d\d+$", "")
    return loads.groupBy(base.alias("variable")).agg(F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"))


@query("j13_error_by_model")
def _(spark, sf):
    sets = {"core": FEATURES[:5], "all": FEATURES}
    return jobs.compare_day_models(day_table(spark, sf, 2), sets, y="event_day", folds=["f0", "f1"])


@query("j13_median_error_by_fold", with_ctes(detect_sql("ud", "t") | {
    "f": """select r::int as repeat, id, day, cast((row_number() over (partition by r order by md5(r || '|' || id) || '|' || id) - 1) % 5 as int)
    as fold from t, generate_series(0, 1) g(r) where occurred""",
    "m": """select a.repeat, k::int as fold, median(day) as guess from f a, generate_series(0, 4) g(k) where a.fold <> k group by 1, 2"""},
    """select f.repeat, f.fold, cast(count(*) as int) as n, round(avg(abs(day - guess)), 6) as mae from f join m on m.repeat = f.repeat
    and m.fold = f.fold group by 1, 2"""))
def _(spark, sf):
    d = models.median_errors(day_table(spark, sf, 2), y="event_day", folds=["f0", "f1"])
    return d.select("repeat", "fold", F.col("n").cast("int").alias("n"), r6("mae"))


@query("j14_out_of_fold_risk")
def _(spark, sf):
    rows = hazard_rows(spark, sf, 2)
    return models.out_of_fold_risk(rows, HAZARD, folds=["f0", "f1"]).select("id", "day", "y", "p")


@query("j17_odds_ratios")
def _(spark, sf):
    return models.odds_ratios(cut(pp(spark, sf)), HAZARD, variables=risk.SCHEDULE + MEASURES, id_col="id", resamples=300)


@query("j17_odds_ratios_group_effects")
def _(spark, sf):
    from fallpoint.operators.quality import group_indicators

    rows = pp(spark, sf)
    ind = group_indicators(F.col("segment"), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"])
    rows = cut(rows.withColumns(ind))
    return models.odds_ratios(rows, HAZARD + list(ind), variables=MEASURES, id_col="id", resamples=300, how="standard")


def _group_effects(spark, sf):
    return models.group_effects(cut(pp(spark, sf)), BASE + MEASURES, variables=MEASURES, group="segment", id_col="id", resamples=300)


@query("j17_group_intervals")
def _(spark, sf):
    return _group_effects(spark, sf)


@query("j17_direction_by_group")
def _(spark, sf):
    out = cut(_group_effects(spark, sf))
    return compare.same_direction(out, name="variable", group="segment", value="odds_ratio", groups=out.select("segment").distinct().count())


COV = ("click_prev", "view_prev")


def folded_window(spark, sf, keep=0.85, shared=None):
    w = cut(window_rows(spark, sf, keep, shared))
    return cut(w.join(resample.fold_of(w, id_col="id").drop("repeat"), "id"))


KIN = panel.Kinetics(covariates=COV)
KIN2 = panel.Kinetics(covariates=COV, state="state")
KINH = panel.Kinetics(covariates=COV, inhibitor="level")


def _fit_frame(spark, fits):
    kin = fits.kinetics
    rows = [(v, f, *map(float, fits.theta[v, f]), float(fits.mse[v, f]), float(fits.shrink[v, f]))
            for v in range(fits.theta.shape[0]) for f in range(fits.theta.shape[1])]
    return spark.createDataFrame(rows, "variant int, fold int, " + ", ".join(f"{n} double" for n in kin.names)
                                 + ", mse double, shrink double")


@query("j18_panel_fit")
def _(spark, sf):
    return _fit_frame(spark, jobs.fit_on_folds(folded_window(spark, sf), KIN, id_col="id", fold="fold", folds=5))


@query("j18_panel_fit_two_states")
def _(spark, sf):
    return _fit_frame(spark, jobs.fit_on_folds(folded_window(spark, sf), KIN2, id_col="id", fold="fold", folds=5))


@query("j18_own_fits")
def _(spark, sf):
    kin = panel.Kinetics(state="state")
    w = cut(window_rows(spark, sf))
    inter = panel.interval_columns(w, kin, id_col="id")
    busy = inter.groupBy("id").agg(F.count_if(F.col("u_eat") != 0).alias("eat"), F.count_if(F.col("u_area") != 0).alias("make"))
    mom = panel.series_moments(inter, kin, id_col="id").join(busy.where("eat >= 2 and make >= 3"), "id")
    return panel.fit_own(mom, size=3)


@query("j18_pooled_against_within")
def _(spark, sf):
    w = cut(window_rows(spark, sf).withColumn("fold", F.lit(-1)))
    mean, sd = panel.covariate_scaling(w, KINH, fold="fold", folds=1)
    mom = cut(panel.series_moments(panel.interval_columns(w, KINH, id_col="id"), KINH, id_col="id", keys=["fold"]))
    pooled = panel.fit_pooled(mom, KINH, mean=mean[0], sd=sd[0])
    free = panel.fit_panel(mom, KINH, fold="fold", folds=1, mean=mean, sd=sd)
    return spark.createDataFrame([(float(pooled[-1]), float(free.theta[0, 0, -1]))], "c_pooled double, c_within double")


@query("j19_simulated_profiles")
def _(spark, sf):
    w = folded_window(spark, sf)
    fits = jobs.fit_on_folds(w, KIN, id_col="id", fold="fold", folds=5)
    inter = panel.with_own_alpha(panel.interval_columns(w, KIN, id_col="id"), fits.frame(spark), KIN, id_col="id")
    return panel.simulate(panel.step_columns(inter, KIN), id_col="id", day_col="day", level_col="level")


@query("j19_recurrence", """with recursive rows_ as (select user_id as id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) + 1 as int) as day,
    count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as double) / count(*) / 100 as level from events group by 1, 2),
    k as (select *, row_number() over (partition by id order by day) as i from rows_),
    r as (select id, day, i, level, level as simulated, n from k where i = 1 union all
    select k.id, k.day, k.i, k.level, greatest(r.simulated + 0.5 * r.n - 0.05 * r.simulated, 0), k.n from r join k on k.id = r.id and k.i = r.i + 1)
    select id, day, round(level, 6) as level, round(simulated, 9) as simulated from r""")
def _(spark, sf):
    d = user_days(spark, sf).withColumns({"gain": 0.5 * F.col("n_events"), "loss": F.lit(0.05), "sat": F.lit(0.0)})
    return panel.simulate(d, id_col="id", day_col="day", level_col="level").select("id", "day", r6("level"), F.round("simulated", 9).alias("simulated"))


@query("j20_shrinkage")
def _(spark, sf):
    w = folded_window(spark, sf)
    fits = jobs.fit_on_folds(w, KIN, id_col="id", fold="fold", folds=5)
    inter = panel.with_own_alpha(panel.interval_columns(w, KIN, id_col="id"), fits.frame(spark), KIN, id_col="id")
    return inter.groupBy("id").agg(F.max("fold").alias("fold"), F.max("p0").alias("mean_alpha"),
                                   F.max("shrink").alias("shrink"), F.max("alpha").alias("alpha"))


def switched(spark, sf, columns=HAZARD):
    shared = shared_tables(spark, sf)
    w = folded_window(spark, sf, shared=shared)
    folds = w.select("id", "fold").distinct()
    tag = lambda df: df.join(folds, "id")
    return cut(jobs.hazard_switch(w, cut(tag(pp(spark, sf, shared=shared))), cut(tag(pp(spark, sf, blind=True, shared=shared))), columns,
                                  MEASURES + ["d_exposure"], id_col="id")), w


@query("j21_predicted_switch")
def _(spark, sf):
    s, _ = switched(spark, sf)
    return s.select("id", "day", "state", "state_frozen")


@query("j23_model_comparison")
def _(spark, sf):
    s, w = switched(spark, sf)
    one = jobs.fit_on_folds(w, KIN, id_col="id", fold="fold", folds=5)
    two = jobs.fit_on_folds(w, KIN2, id_col="id", fold="fold", folds=5)
    out = jobs.baseline_profiles(w, id_col="id", fold="fold", folds=5)
    out = out.unionByName(jobs.score_profiles(w, one, KIN, id_col="id", name="always_on"))
    out = out.unionByName(jobs.score_profiles(s, two, KIN2, id_col="id", frozen="state_frozen", name="two_state"))
    for name, kin, rows in (("inhibited", KINH, w), ("inhibited_two_state", replace(KIN2, inhibitor="level"), s)):
        fits = jobs.fit_on_folds(w, kin, id_col="id", fold="fold", folds=5)
        out = out.unionByName(jobs.score_profiles(rows, fits, kin, id_col="id", name=name))
    forms = panel.consumption_forms()
    shaped = jobs.fit_on_folds(w, KIN2, id_col="id", fold="fold", folds=5, forms=forms)
    out = out.unionByName(jobs.score_profiles(s, shaped, KIN2, id_col="id", form=jobs.chosen_form(shaped, forms, spark), frozen="state_frozen", name="chosen_form"))
    return out.unionByName(jobs.score_profiles(w, two, KIN2, id_col="id", name="true_event"))


@query("j23_true_forecast")
def _(spark, sf):
    s, w = switched(spark, sf)
    one = jobs.fit_on_folds(w, KIN, id_col="id", fold="fold", folds=5)
    two = jobs.fit_on_folds(w, KIN2, id_col="id", fold="fold", folds=5)
    return jobs.true_forecast(w, one, KIN, id_col="id", name="always_on").unionByName(
        jobs.true_forecast(s, two, KIN2, id_col="id", name="two_state"))


@query("j24_consumption_forms")
def _(spark, sf):
    forms = panel.consumption_forms()
    w = folded_window(spark, sf)
    fits = jobs.fit_on_folds(w, KIN2, id_col="id", fold="fold", folds=5, forms=forms)
    best = panel.choose_form(fits)
    rows = [(f, int(v), forms[v][0], float(forms[v][1]), float(fits.mse[v, f])) for f, v in enumerate(best)]
    return spark.createDataFrame(rows, "fold int, variant int, half double, floor double, mse double")


@query("j26_ridge_permutation")
def _(spark, sf):
    return jobs.ridge_permutation(day_table(spark, sf), FEATURES, y="event_day", id_col="id", folds=["f0"], n_permutations=200)


@query("j28_ridge_against_medians")
def _(spark, sf):
    return jobs.baseline_comparison(day_table(spark, sf, 2), FEATURES, y="event_day", group="segment", id_col="id",
                                    folds=["f0", "f1"], resamples=2000)["intervals"]


@query("j30_permutation_importance")
def _(spark, sf):
    return models.permutation_importance(day_table(spark, sf, k=3), FEATURES[:5], y="event_day", fold="f0", id_col="id", k=3,
                                         repeats=2, trees=10, depth=6)


@query("j31_sampled_attribution")
def _(spark, sf):
    return models.sampled_attribution(day_table(spark, sf, k=3), FEATURES[:4], y="event_day", fold="f0", id_col="id", k=3,
                                      orderings=2, trees=10, depth=6)


@query("j32_ablation")
def _(spark, sf):
    from fallpoint.operators.quality import prefixed

    own = prefixed(FEATURES, ["level"])
    sets = {"all": FEATURES, "only": own, "without": [c for c in FEATURES if c not in own]}
    return jobs.compare_day_models(day_table(spark, sf), sets, y="event_day", folds=["f0"], kinds=("ridge",))


@query("j33_anticipation")
def _(spark, sf):
    shared = shared_tables(spark, sf)
    by_lead = {n: hazard_rows(spark, sf, lead=n, shared=shared) for n in (1, 2)}
    return jobs.anticipation(by_lead, BASE, HAZARD, id_col="id", folds=["f0"], resamples=300)


@query("j34_expected_trajectory")
def _(spark, sf):
    s, w = switched(spark, sf, BASE)
    fits = jobs.fit_on_folds(w, KIN2, id_col="id", fold="fold", folds=5)
    return panel.expected_trajectory(s, fits.frame(spark), KIN2, id_col="id").select("id", "day", "level", "expected", "modal_day")


@query("j34_expected_literal", with_ctes({
    "k": """select *, row_number() over w as i, lead(level) over w - level as dy, greatest(lead(exposure) over w - exposure, 0) as grow,
        (exposure + lead(exposure) over w) / 2 as area, day / (day + 6.3::double) as risk from (select id, day, level, exposure from dy) window w as (partition by id order by day)""",
    "q": "select *, greatest(risk - coalesce(lag(risk) over (partition by id order by day), 0), 0) as w from k",
    "cand": """select id, day as tau, w from q union all select id, 2147483647, greatest(1 - arg_max(risk, day), 0) from q group by id""",
    "own": """select c.id, c.tau, any_value(c.w) as w, greatest((coalesce(sum(grow * (dy - 0.01 * area)) filter (q.day < 4 and q.day < c.tau and dy is not null), 0) + 2 * 0.3)
        / (coalesce(sum(grow * grow) filter (q.day < 4 and q.day < c.tau and dy is not null), 0) + 2), 0) as a,
        count(*) filter (q.day < 4 and dy is not null) as n from cand c join q on q.id = c.id group by 1, 2""",
    "al": "select id, tau, w, case when n = 0 then 0.3 else a end as a from own",
    "r": """select al.id, al.tau, al.w, al.a, q.i, q.day, q.level, q.grow, q.area, q.level as s from al join q on q.id = al.id and q.i = 1 union all
        select r.id, r.tau, r.w, r.a, q.i, q.day, q.level, q.grow, q.area,
               greatest(r.s + case when r.day >= r.tau then 0 else r.a * r.grow + 0.01 * r.area end - case when r.day >= r.tau then 0.02 * r.area else 0 end * r.s, 0)
        from r join q on q.id = r.id and q.i = r.i + 1""",
    "top": "select id, arg_max(day, (w, -day)) as d, max(w) as w from q group by id"},
    """select r.id, r.day, round(any_value(r.level), 6) as level, round(sum(r.w * s) / greatest(sum(r.w), 1e-9), 6) as expected,
        any_value(case when top.w >= n.w then top.d end) as modal_day from r join top on top.id = r.id join cand n on n.id = r.id and n.tau = 2147483647 group by 1, 2"""))
def _(spark, sf):
    rows = daily(spark, sf).select("id", "day", "level", "exposure", (F.col("day") / (F.col("day") + 6.3)).alias("state"), F.lit(0).alias("fold"))
    params = spark.createDataFrame([(0, 0.3, 0.01, 0.02, 2.0)], "fold int, p0 double, p1 double, p2 double, shrink double")
    d = panel.expected_trajectory(rows, params, panel.Kinetics(state="state"), id_col="id")
    return d.select("id", "day", r6("level"), r6("expected"), "modal_day")


@query("j35_rebound_auc")
def _(spark, sf):
    rows = day_table(spark, sf, k=3)
    ev = rows.select("id", "event_day")
    back = grid.rebound(user_days(spark, sf), ev, id_col="id", day_col="day", value_col="level", event_col="event_day")
    rows = cut(rows.join(back.withColumn("rebound", F.col("rebound").cast("int")), "id"))
    return jobs.classifier_auc(rows, {"level": FEATURES[:3], "all": FEATURES}, y="rebound", folds=["f0"], k=3, trees=10,
                               min_leaf=2, depth=6)


@query("j36_hazard_ladder")
def _(spark, sf):
    rows = hazard_rows(spark, sf, 2)
    ladder = {"day": BASE, "day_schedule": BASE + risk.SCHEDULE, "full": HAZARD}
    return jobs.hazard_ladder(rows, ladder, folds=["f0", "f1"])


@query("j36_leave_group_out")
def _(spark, sf):
    return jobs.leave_group_out_hazard(pp(spark, sf), BASE, HAZARD, group="segment", id_col="id")


@query("j37_subset_protocol")
def _(spark, sf):
    rows = day_table(spark, sf)
    subsets = {"all": F.lit(True), "late": F.col("event_day") > 4, "building": F.col("segment") == "BUILDING"}
    return jobs.compare_on_subsets(rows, subsets, {"core": FEATURES[:5], "all": FEATURES}, y="event_day", folds=["f0"])


@query("j38_within_largest_group")
def _(spark, sf):
    rows = day_table(spark, sf)
    top = profile.most_frequent(rows, "segment").first()["segment"]
    sub = cut(rows.where(F.col("segment") == top))
    out = jobs.ridge_permutation(sub, FEATURES[:5], y="event_day", id_col="id", folds=["f0"], n_permutations=200)
    return out.withColumn("segment", F.lit(top))


@query("j38_median_split", with_ctes(detect_sql("ud", "t") | {"x": """select t.id, c_mktsegment as segment,
    arg_max(level, u.day) filter (where u.day <= 4 and level is not null) as l from t join ud u on u.id = t.id
    left join customer on c_custkey = t.id where occurred group by 1, 2""", "h": """select case when l > (select median(l) from x)
    then 'upper' else 'lower' end as half, segment from x"""}, "select half, " + ", ".join(
    f"count(*) filter (where segment = '{g}') as \"{g}\"" for g in SEGMENTS) + """, round(greatest(""" + ", ".join(
    f"count(*) filter (where segment = '{g}')" for g in SEGMENTS) + """) / count(segment), 6) as concentration from h group by 1"""))
def _(spark, sf):
    rows = day_table(spark, sf)
    mid = exact_quantiles(rows, value="level_last", probs=[0.5], names=["m"]).select("m").scalar()
    rows = rows.withColumn("_m", mid).withColumn("half", F.when(F.col("level_last") > F.col("_m"), "upper").otherwise("lower"))
    out = profile.crosstab(rows, "half", "segment", SEGMENTS)
    return out.withColumn("concentration", F.round("concentration", 6))


@query("j39_decision")
def _(spark, sf):
    s, w = switched(spark, sf)
    scores = jobs.score_profiles(w, jobs.fit_on_folds(w, KIN, id_col="id", fold="fold", folds=5), KIN, id_col="id", name="always_on")
    scores = cut(scores.unionByName(jobs.score_profiles(
        s, jobs.fit_on_folds(w, KIN2, id_col="id", fold="fold", folds=5), KIN2, id_col="id", name="two_state")))
    ci = jobs.paired_difference(scores, id_col="id", metric="rmse2", model="two_state", rival="always_on", resamples=2000)
    truth = w.groupBy("id").agg(F.max(F.when(F.col("event_day") < F.col("end_day"), F.col("event_day"))).alias("truth"))
    wide = scores.groupBy("id").agg(*[F.max(F.when(F.col("model") == m, F.col("simulated_day"))).alias(m)
                                      for m in ("two_state", "always_on")])
    tt = compare.timing_table(wide.join(truth, "id"), truth="truth", methods=["two_state", "always_on"])
    right = tt.agg(*[F.max(F.when(F.col("method") == m, F.col("within_1_day"))).alias(f"right_{m}")
                     for m in ("two_state", "always_on")]).withColumn("model", F.lit("two_state"))
    return compare.decision(ci.join(right, "model"), high="high", correct_model="right_two_state", correct_rival="right_always_on")


@query("j40_window_and_dilution_sensitivity")
def _(spark, sf):
    out, shared = None, shared_tables(spark, sf)
    for keep in (0.85, 0.75, None):
        w = folded_window(spark, sf, keep, shared)
        grid_ = (0.0, 0.01, 0.02, 0.03) if keep == 0.85 else (0.0, 0.02)  # fixed values: the published grid
        for d, fits in zip(grid_, jobs.fit_dilutions(w, KIN, grid_, id_col="id", fold="fold", folds=5)):
            kin = fits.kinetics
            one = jobs.score_profiles(w, fits, kin, id_col="id", name="always_on").agg(
                F.avg("rmse").alias("rmse"), F.avg("rmse2").alias("rmse2"), F.count(F.lit(1)).alias("ids"))
            one = one.select(F.lit(keep).cast("double").alias("keep"), F.lit(d).alias("dilution"), "ids", "rmse", "rmse2")
            out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- fits with one column, which SQL can follow step by step

_STEPS = 30  # Newton steps of the check; both fits settle long before


@query("j9_hazard_one_column", with_ctes(_scores | {
    "st": "select avg(s0) as m, stddev_pop(s0) as s from sx", "xy": "select (s0 - m) / s as x, y from sx, st",
    "nt": f"""select 0 as k, 0.0::double as a, 0.0::double as b union all
        select k + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
        from (select k, any_value(a) as a, any_value(b) as b, sum(p - y) as g0, sum(x * (p - y)) + any_value(b) as g1, sum(p * (1 - p)) as h00,
                     sum(p * (1 - p) * x) as h01, sum(p * (1 - p) * x * x) + 1 as h11
              from (select k, a, b, x, y, 1 / (1 + exp(-(a + b * x))) as p from nt, xy where k < {_STEPS}) group by k)"""},
    f"select round(a, 6) as intercept, round(b, 6) as coefficient from nt where k = {_STEPS}"))
def _(spark, sf):
    fits = models.fit_logistic(cut(scored_rows(spark, sf).select("s0", "y")), ["s0"], how="standard")
    return spark.createDataFrame([(float(fits.intercept[0]), float(fits.beta[0, 0]))], "intercept double, coefficient double").select(
        r6("intercept"), r6("coefficient"))


@query("j11_cox_one_column", with_ctes(labels_sql("dy", "lab") | {
    "xx": "select id, max(level) filter (where day <= 4) as x from dy group by id",
    "ts": "select lab.time as t, cast(lab.event as int) as e, x from lab join xx on xx.id = lab.id where x is not null and lab.time is not null",
    "st": "select avg(x) as m, stddev_samp(x) as s, count(*) as n from ts", "zs": "select t, e, (x - m) / s as z from ts, st",
    "hits": "select t as u, count(*) as d from zs where e = 1 group by t", "ej": "select u, d, unnest(generate_series(0, d - 1)) as j from hits",
    "nt": f"""select 0 as k, 0.0::double as b union all
        select k + 1, b + ((select sum(z) from zs where e = 1) - g - 0.5 * n * b) / (h + 0.5 * n)
        from (select k, any_value(b) as b, sum(s1 / s0) as g, sum(s2 / s0 - (s1 / s0) * (s1 / s0)) as h
              from (select k, any_value(b) as b, u, j, sum(r * w) as s0, sum(r * w * z) as s1, sum(r * w * z * z) as s2
                    from (select k, b, u, j, z, exp(b * z) as r, case when t = u and e = 1 then 1 - j / d when t >= u then 1.0 else 0.0 end as w
                          from nt, ej, zs where k < {_STEPS}) group by k, u, j) group by k), st"""},
    f"select round(b, 6) as coefficient from nt where k = {_STEPS}"))
def _(spark, sf):
    early = daily(spark, sf).groupBy("id").agg(F.max(F.when(F.col("day") <= 4, F.col("level"))).alias("x"))
    lab = rate_table(spark, sf).select("id", "time", F.col("event").cast("int").alias("happened"))
    rows = cut(early.join(lab, "id").where("x is not null and time is not null"))
    fits = models.fit_cox(rows, ["x"], time="time", event="happened")
    return spark.createDataFrame([(float(fits.beta[0, 0]),)], "coefficient double").select(r6("coefficient"))
