"""Queries over event rules, features, person-period rows, resamples and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fallpoint.contracts import whole
from fallpoint.functions import columns as fx
from fallpoint.lineage import cut
from fallpoint.operators import compare, detect, features, grid, profile, rates, risk, stats
from fallpoint.operators.ordered import exact_quantiles, null_safe_join
from fallpoint.plans import baselines, jobs, metrics, resample
from fallpoint.plans.draws import P, poisson_thresholds, round_keys
from workload.basics import _hash, _rank, _seg, found
from workload.bindings import KINDS, daily, filled, months, table, user_days
from workload.ctes import detect as detect_sql
from workload.ctes import grid as grid_sql
from workload.ctes import labels as labels_sql
from workload.ctes import person_period as pp_sql
from workload.ctes import rate_label as rate_label_sql
from workload.ctes import rates as rates_sql
from workload.ctes import with_ctes
from workload.registry import query, r6

KEY = dict(id_col="id", day_col="day")
UD = dict(**KEY, value_col="level")
LX = dict(**KEY, level_col="level", exposure_col="exposure")
MEASURES = [*KINDS, "exposure"]

_det_cols = """id, occurred, day, round(drop_fraction, 6) as drop_fraction, round(peak_value, 6) as peak_value,
    censoring_day, reason_code, time"""


def _det(df):
    return df.select("id", "occurred", "day", r6("drop_fraction"), r6("peak_value"), "censoring_day", "reason_code", "time")


def rate_rows(spark, sf, dilutions=(0.0,)):
    return rates.interval_rates(daily(spark, sf), **LX, dilutions=dilutions, on_error="assert")


def rate_table(spark, sf, d=None):
    return rates.label_table(daily(spark, sf) if d is None else d, **LX, on_error="assert")


def stored_daily(spark, sf):
    """The daily table written once: it is far smaller than the raw rows and read several times."""
    return cut(daily(spark, sf))


def daily_and_labels(spark, sf):
    """The stored daily table and the labels on it."""
    d = stored_daily(spark, sf)
    return d, rate_table(spark, sf, d)


def shared_tables(spark, sf):
    """Daily table and labels for a query that makes several tables from them: both are formed once."""
    d, labels = daily_and_labels(spark, sf)
    return d, cut(labels)


# ---------------------------------------------------------------- event rules


@query("i1_detect_shift", with_ctes(detect_sql("ud", "t"), f"select {_det_cols} from t"))
def _(spark, sf):
    return _det(detect.detect_shift_batch(user_days(spark, sf), **UD))


@query("i1_detect_months", with_ctes(detect_sql("mo", "t", width=5, n=3, threshold=0.15), f"select {_det_cols} from t"))
def _(spark, sf):
    return _det(detect.detect_shift_batch(months(spark, sf), **UD, smooth_window=5, n_consecutive=3, drop_threshold=0.15))


@query("i2_detect_strict", with_ctes(detect_sql("ud", "t", n=3, threshold=0.5, refine=False, min_peak=40), f"select {_det_cols} from t"))
def _(spark, sf):
    return _det(found(spark, sf, n_consecutive=3, drop_threshold=0.5, refine_peak=False, min_peak=40))


@query("i2_detect_min_day", with_ctes(detect_sql("ud", "t"), """select id, occurred and not coalesce(day < 6, false) as occurred,
    case when day >= 6 then day end as day, round(drop_fraction, 6) as drop_fraction, round(peak_value, 6) as peak_value, censoring_day,
    case when day < 6 then 'before_min_day' else reason_code end as reason_code,
    case when day >= 6 then day else censoring_day end as time from t"""))
def _(spark, sf):
    return _det(found(spark, sf, min_day=6))


@query("i3_event_time", with_ctes(detect_sql("ud", "t"), "select id, time from t"))
def _(spark, sf):
    d = found(spark, sf)
    return d.select("id", detect.event_time(F.col("occurred"), F.col("day"), F.col("censoring_day")).alias("time"))


@query("i4_global_peak_rule", with_ctes(grid_sql("ud", "g") | {"s": """select id, day, avg(level) over (partition by id order by day
    rows between 1 preceding and 1 following) as s from g""", "c": """select *, coalesce(lead(s) over w < s, false)
    and coalesce(lead(s, 2) over w < lead(s) over w, false) as falls from s window w as (partition by id order by day)""",
    "p": "select id, arg_max(day, struct_pack(v := s, d := -day)) as pd, max(s) as ps from s group by id"},
    """select p.id, cast(pd as double) as peak_day, round(ps, 6) as peak_value, round((ps - low) / ps, 6) as drop_fraction,
    coalesce(falls and (ps - low) / ps >= 0.3, false) as occurred from p join c on c.id = p.id and c.day = pd
    left join (select p.id, min(s) as low from p join s on s.id = p.id and s.day > pd group by 1) l on l.id = p.id"""))
def _(spark, sf):
    d = detect.global_peak_rule(user_days(spark, sf), **UD)
    return d.select("id", "peak_day", r6("peak_value"), r6("drop_fraction"), "occurred")


_low = {"n": """select id, day, level, lag(level) over w as b, lead(level) over w as a, max(level) over (partition by id) as m
    from ud where level is not null window w as (partition by id order by day)""",
        "low": """select id, day, level, b, a from n where b is not null and a is not null and level < least(b, a)
    and level < 0.5 * ((b + a) / 2) and (b + a) / 2 > 0.2 * m"""}


@query("i5_isolated_low_points", with_ctes(_low, """select id, day, round(level, 6) as level, round(b, 6) as before,
    round(a, 6) as after from low"""))
def _(spark, sf):
    d = detect.isolated_low_points(user_days(spark, sf), **UD)
    return d.select("id", "day", r6("level"), r6("before"), r6("after"))


@query("i6_recheck_without_low_points", with_ctes(_low | {"o": """select ud.id, ud.day, case when low.id is null then ud.level end
    as level from ud left join low on low.id = ud.id and low.day = ud.day"""} | detect_sql("ud", "t") | detect_sql("o", "u"),
    """select t.id, suspect_days, t.occurred as occurred_before, t.day as day_before, u.occurred as occurred_after, u.day as day_after,
    not (t.occurred = u.occurred and t.day is not distinct from u.day) as changed from t join u on u.id = t.id
    join (select id, string_agg(cast(day as varchar), ' ' order by day) as suspect_days from low group by id) l on l.id = t.id"""))
def _(spark, sf):
    return detect.recheck_without_low_points(user_days(spark, sf), **UD, on_error="assert")


_feat = lambda c: f"""round(arg_max("{c}", day) filter (where day between 1 and 4 and "{c}" is not null), 6) as {c}_last,
    round(case when count("{c}") filter (where day between 1 and 4) > 1 then regr_slope("{c}", day) filter (where day between 1 and 4) end, 6) as {c}_slope,
    round(avg("{c}") filter (where day between 1 and 4), 6) as {c}_mean, count("{c}") filter (where day between 1 and 4) as {c}_n"""
_lastv = lambda c: f"""(arg_max("{c}", day) filter (where day between 1 and 4 and "{c}" is not null))"""


@query("i7_early_window", with_ctes({}, f"""select id, {_feat('level')}, {_feat('purchase')}, round(case when abs({_lastv('purchase')}) > 1e-12
    then {_lastv('level')} / {_lastv('purchase')} end, 6) as level_over_purchase, arg_min(segment, day) as segment from dy group by id"""))
def _(spark, sf):
    d = features.early_window_features(daily(spark, sf), **KEY, value_cols=["level", "purchase"], window=4,
                                       ratios=[("level", "purchase")], static_cols=["segment"])
    keep = ("id", "segment", "level_n", "purchase_n")
    return d.select(*[c if c in keep else r6(c) for c in d.columns])


@query("i8_slopes", with_ctes({}, """select id, round(regr_slope(level, day), 6) as level_slope, round(case when count(purchase) filter (where day <= 4) > 1
    then regr_slope(purchase, day) filter (where day <= 4) end, 6) as purchase_slope from ud group by id"""))
def _(spark, sf):
    d = user_days(spark, sf)
    early = F.when(F.col("day") <= 4, F.col("purchase"))
    return d.groupBy("id").agg(r6(features.slope(F.col("level"), F.col("day")), "level_slope"),
                               r6(features.slope(early, F.col("day")), "purchase_slope"))


@query("i9_case_matrix", with_ctes({}, f"""select id, {_feat('level')}, {_feat('click')}, {_feat('view')}, round(case when
    abs({_lastv('click')}) > 1e-12 then {_lastv('level')} / {_lastv('click')} end, 6) as level_over_click, round(case when
    abs({_lastv('exposure')}) > 1e-12 then {_lastv('level')} / {_lastv('exposure')} end, 6) as level_over_exposure,
    arg_min(segment, day) as scale, round({_lastv('exposure')} / (arg_min(exposure, day) filter (where day <= 4)), 6)
    as exposure_growth from dy group by id"""))
def _(spark, sf):
    d = features.case_matrix(daily(spark, sf), **KEY, core=["level", "click"], extended=["view"],
                             ratios=[("level", "click"), ("level", "exposure")], growth_col="exposure", static_col="segment")
    return d.select(*[c if c in ("id", "scale") or c.endswith("_n") else r6(c) for c in d.columns])


_sched = """select id, 1.0::double as initial, max(case when setpoint <> s0 then 1 else 0 end) as changed,
    min(day) filter (where setpoint <> s0) as change_day from (select *, first_value(setpoint) over
    (partition by id order by day) as s0 from dy) group by id"""


@query("i10_schedule_summary", with_ctes({"x": """select *, first_value(setpoint) over (partition by id order by day) as s0 from dy"""},
    """select id, max(s0) as initial, max(case when setpoint <> s0 then 1 else 0 end) as changed,
    min(day) filter (where setpoint <> s0) as change_day from x group by id"""))
def _(spark, sf):
    return features.schedule_summary(daily(spark, sf), **KEY, setpoint_col="setpoint")


_r3 = rates_sql("dy", "r", (0.0, 0.02, 0.05))
_hit = """select *, coalesce(rate < 0 and lead(rate) over w < 0 and best > 0 and abs(rate) >= {u} * best
    and abs(lead(rate) over w) >= {u} * best, false) as hit from (select *, max(rate) over (partition by id, dilution order by day
    rows between unbounded preceding and 1 preceding) as best from r) window w as (partition by id, dilution order by day)"""


@query("i11_rate_rule", with_ctes(_r3 | {"h": _hit.format(u="0.0")}, "select dilution, id, min(day) filter (where hit) as rate_day from h group by 1, 2"))
def _(spark, sf):
    return rates.rate_event(rate_rows(spark, sf, (0.0, 0.02, 0.05)), **KEY)


@query("i11_rate_rule_magnitude", with_ctes(_r3 | {"h": _hit.format(u="0.05")}, "select dilution, id, min(day) filter (where hit) as rate_day from h group by 1, 2"))
def _(spark, sf):
    return rates.rate_event(rate_rows(spark, sf, (0.0, 0.02, 0.05)), **KEY, magnitude=0.05)


@query("i11_magnitude_sensitivity", with_ctes(_r3 | detect_sql("ud", "t") | {"h": _hit.format(u="0.02"), "h5": _hit.format(u="0.05"),
    "e": """select 0.02::double as magnitude, dilution, id, min(day) filter (where hit) as d from h group by 1, 2, 3
    union all select 0.05::double, dilution, id, min(day) filter (where hit) from h5 group by 1, 2, 3"""},
    """select magnitude, dilution, count(d) as with_event, count(*) filter (where occurred and d is not null and abs(d - t.day) <= 1)
    as within_1_day, count(*) filter (where occurred and d is not null) as comparable from e left join t on t.id = e.id group by 1, 2"""))
def _(spark, sf):
    return rates.magnitude_sensitivity(rate_rows(spark, sf, (0.0, 0.02, 0.05)), found(spark, sf), **KEY)


@query("i11_rate_vs_level_days", with_ctes(_r3 | detect_sql("ud", "t") | {"h": _hit.format(u="0.0"),
    "e": "select dilution, id, min(day) filter (where hit) as d from h group by 1, 2",
    "x": "select e.*, occurred, t.day as ld, case when occurred then d - t.day end as gap from e left join t on t.id = e.id"},
    """select dilution, count(d) as with_event, count(*) filter (where (d is not null) = occurred) as agree,
    count(*) filter (where gap = 0) as same_day, count(*) filter (where abs(gap) <= 1) as within_1_day,
    count(*) filter (where d <= 4) as inside_window, median(gap) as median_gap from x group by 1"""))
def _(spark, sf):
    ev = rates.rate_event(rate_rows(spark, sf, (0.0, 0.02, 0.05)), **KEY)
    return rates.compare_rate_days(ev, found(spark, sf), id_col="id")


@query("i12_rate_label", with_ctes(_r3 | rate_label_sql("r", "k"), "select dilution, id, day from k"))
def _(spark, sf):
    return rates.rate_labels(rate_rows(spark, sf, (0.0, 0.02, 0.05)), **KEY, level_col="level")


_lab = labels_sql("dy", "lab")
_lab_cols = "id, last_day, day_d0, day_d2, day_d5, day, event, time, never_accumulates, excluded"


@query("i13_label_table", with_ctes(_lab, f"select {_lab_cols} from lab"))
def _(spark, sf):
    return rate_table(spark, sf).select(*_lab_cols.split(", "))


def pp(spark, sf, lead=1, blind=False, shared=None):
    d, labels = shared or daily_and_labels(spark, sf)
    return risk.person_period(d, labels, **KEY, measures=MEASURES, exposure_col="exposure",
                              setpoint_col="setpoint", group_col="segment", lead=lead, blind=blind)


_ppc = [*MEASURES, "d_exposure", "setpoint"]
_pp_sel = "select id, day, segment, " + ", ".join(f'round("{c}", 6) as "{c}"' for c in _ppc) + (
    ", low_today, drops_tomorrow, " + ", ".join(risk.DAY_FLAGS) + ", y from p")


def _pp_out(d):
    return d.select("id", "day", "segment", *[r6(c) for c in _ppc], "low_today", "drops_tomorrow", *risk.DAY_FLAGS, "y")


@query("i14_person_period_lead1", with_ctes(_lab | pp_sql("dy", "lab", "p"), _pp_sel))
def _(spark, sf):
    return _pp_out(pp(spark, sf))


@query("i14_person_period_lead2", with_ctes(_lab | pp_sql("dy", "lab", "p", lead=2), _pp_sel))
def _(spark, sf):
    return _pp_out(pp(spark, sf, lead=2))


@query("i15_person_period_blind", with_ctes(_lab | pp_sql("dy", "lab", "p", blind=True), _pp_sel))
def _(spark, sf):
    return _pp_out(pp(spark, sf, blind=True))


_again = {"b": """select r.*, k.day as ev, lead(rate) over w as q1, max(smoothed) over (partition by r.id) - min(smoothed) over (partition by r.id) as rng,
    min(case when r.day > k.day then smoothed end) over (partition by r.id order by r.day rows between unbounded preceding and current row) as low,
    min(case when r.day > k.day then r.level end) over (partition by r.id order by r.day rows between unbounded preceding and current row) as rlow,
    max(smoothed) over (partition by r.id order by r.day rows between 1 following and 2 following) as top,
    max(r.level) over (partition by r.id order by r.day rows between 1 following and 2 following) as rtop
    from r join k on k.id = r.id and k.day is not null window w as (partition by r.id order by r.day)""",
          "z": """select id, max(ev) as event_day, min(day) filter (where t and top - low >= 0.15 * rng and rtop - rlow >= 0.15 * rng) as rule_0,
    min(day) filter (where t and low > 0 and (top - low) / greatest(low, 1e-9) >= 0.15) as rule_1,
    min(day) filter (where t and (top - low) / greatest(low, 1e-9) >= 0) as rule_2
    from (select *, day > ev and rate > 0 and q1 > 0 as t from b) group by id"""}
_rk = rates_sql("dy", "r") | rate_label_sql("r", "k")


def _events(spark, sf):
    return rates.rate_labels(rate_rows(spark, sf), **KEY, level_col="level").drop("dilution")


@query("i16_renewed_production", with_ctes(_rk | _again, "select * from z"))
def _(spark, sf):
    return rates.renewed_production(rate_rows(spark, sf), _events(spark, sf), **KEY, level_col="level")


@query("i17_reversal_table", with_ctes(_rk | _again, """select z.id, event_day, m - event_day as days_after, rule_0, rule_1, rule_2,
    round(x / mx, 6) as exposure_vs_max from z join (select dy.id, max(dy.day) as m, arg_max(exposure, dy.day) filter (where dy.day <= rule_0) as x,
    max(exposure) filter (where dy.day <= rule_0) as mx from dy join z on z.id = dy.id where level is not null group by 1) d on d.id = z.id"""))
def _(spark, sf):
    d = rates.reversal_table(daily(spark, sf), rate_rows(spark, sf), _events(spark, sf), **LX)
    return d.select("id", "event_day", "days_after", "rule_0", "rule_1", "rule_2", r6("exposure_vs_max"))


_f0 = "(row_number() over (order by md5('0|' || id) || '|' || id) - 1) % 5"


@query("i18_low_level_by_fold", with_ctes(_lab | pp_sql("dy", "lab", "p") | {"f": f"select id, cast({_f0} as int) as fold from (select distinct id from p)",
    "q": """select k::int as fold, quantile_cont(view, 0.1) as thr from (select p."view", fold as f from p join f on f.id = p.id), generate_series(0, 4) t(k)
    where f <> k group by 1"""}, """select p.id, day, f.fold, round(thr, 6) as threshold, cast(coalesce("view" <= thr, false) as int) as low_level
    from p join f on f.id = p.id join q on q.fold = f.fold"""))
def _(spark, sf):
    rows = pp(spark, sf).select("id", "day", "view")
    rows = rows.join(resample.fold_of(rows, id_col="id").drop("repeat"), "id")
    thr = baselines.training_quantiles(rows, fold_col="fold", folds=5, columns=["view"], probs=[0.1], names=["threshold"])
    out = rows.join(thr.drop("variable"), "fold")
    out = risk.low_level_event(out, value_col="view", threshold=F.col("threshold"))
    return out.select("id", "day", "fold", r6("threshold"), "low_level")


_mw = {"mi": """select dy.*, case when level is not null and exposure is not null then level end as l2 from dy
    join (select id from lab where not excluded) k on k.id = dy.id
    qualify count(case when level is not null and exposure is not null then 1 end) over (partition by dy.id) >= 5"""} | grid_sql(
    "mi", "mg", ("level", "exposure")) | {
    "mc": """select g.id, g.day, g.level, g.exposure, d.click, d."view" from mg g left join dy d on d.id = g.id and d.day = g.day""",
    "mf": """select id, day, level, exposure, coalesce(last_value(click ignore nulls) over a, first_value(click ignore nulls) over b) as click,
    coalesce(last_value("view" ignore nulls) over a, first_value("view" ignore nulls) over b) as vw from mc
    window a as (partition by id order by day rows between unbounded preceding and current row),
    b as (partition by id order by day rows between current row and unbounded following)""",
    "mp": """select *, coalesce(lag(click) over w, click) as click_prev, coalesce(lag(vw) over w, vw) as view_prev,
    case when exposure < 0.85 * max(exposure) over (partition by id order by day rows between unbounded preceding and current row) then day end as cut
    from mf window w as (partition by id order by day)""",
    "me": "select *, coalesce(min(cut) over (partition by id), max(day) over (partition by id)) as end_day from mp",
    "mw": """select me.id, me.day, level, exposure, click_prev, view_prev, case when lab.event then lab.day end as event_day, end_day,
    cast(coalesce(me.day >= case when lab.event then lab.day end, false) as int)::double as state from me join lab on lab.id = me.id where me.day <= end_day"""}


def window_rows(spark, sf, keep=0.85, shared=None):
    d, labels = shared or daily_and_labels(spark, sf)
    return risk.modelling_window(d, labels, **LX, covariates=["click", "view"], keep=keep)


@query("i19_modelling_window", with_ctes(_lab | _mw, """select id, day, round(level, 6) as level, round(exposure, 6) as exposure,
    round(click_prev, 6) as click_prev, round(view_prev, 6) as view_prev, event_day, end_day, state from mw"""))
def _(spark, sf):
    d = window_rows(spark, sf)
    return d.select("id", "day", r6("level"), r6("exposure"), r6("click_prev"), r6("view_prev"), "event_day", "end_day", "state")


@query("i20_observed_state", with_ctes(_lab, """select dy.id, dy.day, cast(lab.event and dy.day >= lab.day as int)::double as state
    from dy join lab on lab.id = dy.id where lab.event union all select dy.id, dy.day, 0.0::double from dy join lab on lab.id = dy.id
    where not lab.event"""))
def _(spark, sf):
    lab = rate_table(spark, sf).select("id", "event", F.col("day").alias("event_day"))
    d = daily(spark, sf).select("id", "day").join(lab, "id")
    return d.select("id", "day", risk.observed_state(F.col("day"), F.col("event"), F.col("event_day")).alias("state"))


@query("i21_design_rows", with_ctes(_lab | _mw | {"x": """select *, lead(level) over w as l1, lead(exposure) over w as x1 from mw
    window w as (partition by id order by day)""", "g": """select *, greatest(x1 - exposure, 0) as gr, (exposure + x1) / 2 as ar from x where l1 is not null"""},
    """select id, day, round((1 - state) * gr, 9) as a0, round((1 - state) * ar, 9) as a1, round(-state * level * ar, 9) as a2,
    round((1 - state) * gr * coalesce(click_prev, 0), 9) as a3, round((1 - state) * gr * coalesce(view_prev, 0), 9) as a4,
    round(-(1 - state) * gr * level, 9) as a5, round(l1 - level, 9) as dy from g"""))
def _(spark, sf):
    d = risk.design_rows(window_rows(spark, sf), **LX, covariates=["click_prev", "view_prev"], state="state", inhibitor="level")
    return d.select("id", "day", *[F.round(f"a{i}", 9).alias(f"a{i}") for i in range(6)], F.round("dy", 9).alias("dy"))


_tm = ["level", "click", "view"]
_tms = {}
for _c in _tm:
    _tms |= grid_sql("dy", f"g{_c}", (_c,))
    _tms[f"i{_c}"] = (f"""select id, day, case when p_{_c} is null or n_{_c} is null then null when "{_c}" is not null then "{_c}"
        else (nv_{_c} - pv_{_c}) / (n_{_c} - p_{_c}) * (day - p_{_c}) + pv_{_c} end as v from g{_c}_l""")
    _tms[f"w{_c}"] = "select id, " + ", ".join(f"max(v) filter (where day = {k}) as {_c}_d{k}" for k in range(1, 10)) + f" from i{_c} group by id"


@query("i22_trajectory_matrix", with_ctes(_tms, "select wlevel.id, " + ", ".join(
    f"round(coalesce({c}_d{k}, median({c}_d{k}) over ()), 6) as {c}_d{k}" for c in _tm for k in range(1, 10))
    + " from wlevel join wclick on wclick.id = wlevel.id join wview on wview.id = wlevel.id"))
def _(spark, sf):
    d = risk.trajectory_matrix(daily(spark, sf), **KEY, variables=_tm)
    return d.select("id", *[r6(c) for c in d.columns if c != "id"])


_cons = {"c": """select w.id, w.day, level / mx as rl, -(l1 - level) / ((exposure + x1) / 2) as q from (select *, lead(level) over v as l1,
    lead(exposure) over v as x1, max(level) over (partition by id) as mx from mw window v as (partition by id order by day)) w
    where event_day is not null and day >= event_day and (exposure + x1) / 2 > 0 and mx > 0 and l1 is not null"""}


def consumption(spark, sf):
    w = cut(window_rows(spark, sf))
    ev = w.groupBy("id").agg(F.max("event_day").alias("day"))
    return rates.consumption_after_event(w, ev, **LX)


@query("i23_consumption_bins", with_ctes(_lab | _mw | _cons, """select case when rl <= 0 then null when rl <= 0.25 then '0-25%' when rl <= 0.5
    then '25-50%' when rl <= 0.75 then '50-75%' else '75-100%' end as bin, count(*) as n, round(median(q), 6) as median from c group by 1"""))
def _(spark, sf):
    d = consumption(spark, sf)
    b = fx.right_closed_bin(F.col("relative_level"), [0, .25, .5, .75, 1.0001], ["0-25%", "25-50%", "50-75%", "75-100%"])
    d = cut(d.withColumn("bin", b))
    n = d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))  # levels of zero or less lie in no bin and are counted as such
    mid = exact_quantiles(d, by="bin", value="consumption", probs=[0.5], names=["median"])
    return null_safe_join(n, mid, ["bin"]).select("bin", "n", r6("median"))


@query("i23_consumption_spearman", with_ctes(_lab | _mw | _cons | {"k": f"""select id, {_rank('q', 'partition by id')} as x,
    {_rank('rl', 'partition by id')} as y from c""", "r": "select id, corr(x, y) as rho from k group by id having count(*) >= 4"},
    "select count(*) as ids, round(median(rho), 6) as median_rho from r"))
def _(spark, sf):
    w = stats.spearman_within(consumption(spark, sf), id_col="id", x="consumption", y="relative_level")
    mid = exact_quantiles(w, value="rho", probs=[0.5], names=["median_rho"]).select("median_rho").scalar()
    return w.agg(F.count(F.lit(1)).alias("ids")).withColumn("median_rho", F.round(mid, 6))


_grid_sql: dict = {}
_grid_union = []
for _w in (1, 3, 5):
    for _n in (2, 3):
        for _t in (0.2, 0.3, 0.4, 0.5):
            _nm = f"t{_w}{_n}{int(_t * 10)}"
            _grid_sql |= detect_sql("ud", _nm, width=_w, n=_n, threshold=_t)
            _grid_union.append(f"select {_w} as smooth_window, {_n} as n_consecutive, {_t}::double as drop_threshold, occurred, day from {_nm}")


@query("i24_label_sensitivity", with_ctes(_grid_sql | {"u": " union all ".join(_grid_union)}, """select smooth_window, n_consecutive, drop_threshold,
    count(*) filter (where occurred and day <= 4) as excluded, count(*) filter (where not (occurred and coalesce(day <= 4, false))) as modelled,
    count(*) filter (where occurred and day > 4) as events, count(*) filter (where not occurred) as censored,
    median(day) filter (where occurred and day > 4) as median_day from u group by 1, 2, 3"""))
def _(spark, sf):
    g = detect.label_grid(user_days(spark, sf), **UD, on_error="assert")
    return compare.label_sensitivity(g, by=["smooth_window", "n_consecutive", "drop_threshold"])


@query("i25_detector_accuracy", with_ctes(detect_sql("ud", "t") | detect_sql("ud", "u", refine=False) | _rk | {"a": """select 1 as refined, t.*, k.day as tr
    from t join k on k.id = t.id union all select 0, u.*, k.day from u join k on k.id = u.id""", "b": """select *, case when occurred then day - tr end as e from a"""},
    """select refined, count(tr) as with_event, count(e) as detected, count(*) filter (where e = 0) as exact,
    count(*) filter (where abs(e) <= 1) as within_1_day, round(avg(e), 6) as mean_bias,
    count(*) filter (where tr is null and occurred) as false_positives, round(count(*) filter (where e = 0) / count(e) * 100, 6) as pct_exact,
    round(count(e) / count(tr) * 100, 6) as pct_detected from b group by 1"""))
def _(spark, sf):
    truth = _events(spark, sf).select("id", F.col("day").alias("true_day"))
    both = found(spark, sf).withColumn("refined", F.lit(1)).unionByName(
        found(spark, sf, refine_peak=False).withColumn("refined", F.lit(0)))
    acc = compare.detector_accuracy(both, truth, id_col="id", true_day="true_day", by="refined")
    out = compare.accuracy_rollup(acc, by="refined")
    return out.select("refined", "with_event", "detected", "exact", "within_1_day", r6("mean_bias"), "false_positives",
                      r6("pct_exact"), r6("pct_detected"))


_decl = {"dc": "select id, day as lo, day + 1 as hi, day is null as none from k",
         "sc": """select t.id, occurred, t.day, lo, hi, none, case when none then case when occurred then 'inf'::double else 0 end
    when not occurred then 'inf'::double when t.day between lo and hi then 0 else least(abs(t.day - lo), abs(t.day - hi)) end as distance
    from dc join t on t.id = dc.id"""}


def _scored(spark, sf):
    d = _events(spark, sf).select("id", F.col("day").alias("day_min"), (F.col("day") + 1).alias("day_max"),
                                  F.col("day").isNull().alias("no_event"))
    return compare.score_declared(found(spark, sf), d, keys=["id"])


@query("i26_declared_hits", with_ctes(detect_sql("ud", "t") | _rk | _decl, """select id, case when distance = 'inf'::double then null else distance end as distance, distance <= 1 as hit,
    case when not none and occurred then day - (lo + hi) / 2 end as signed_error from sc"""))
def _(spark, sf):
    d = _scored(spark, sf)
    return d.select("id", F.when(F.col("distance") < float("inf"), F.col("distance")).alias("distance"), "hit", "signed_error")


@query("i26_declared_verdict", with_ctes(detect_sql("ud", "t") | _rk | _decl, """select count(*) filter (where distance <= 1) as hits, count(*) as n,
    count(*) filter (where distance = 0) as exact, round(avg(case when not none and occurred then day - (lo + hi) / 2 end), 6) as mean_bias,
    round(count(*) filter (where distance <= 1) / count(*), 6) as rate, count(*) filter (where distance <= 1) / count(*) >= 0.8 as passes from sc"""))
def _(spark, sf):
    d = compare.declared_summary(_scored(spark, sf))
    return d.select("hits", "n", "exact", r6("mean_bias"), r6("rate"), "passes")


# ---------------------------------------------------------------- folds, resamples, metrics


def _ids(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("id"))


@query("j1_repeated_folds", """select repeat::int as repeat, id, cast((row_number() over (partition by repeat order by md5(repeat || '|' || id) || '|' || id) - 1)
    % 5 as int) as fold from (select distinct user_id as id from events), generate_series(0, 2) t(repeat)""")
def _(spark, sf):
    return resample.fold_of(_ids(spark, sf), id_col="id", k=5, repeats=3)


@query("j2_stratified_group_folds", with_ctes(detect_sql("ud", "t"), """select 0 as repeat, id, cast((row_number() over (partition by day > 4
    order by md5('0|' || id) || '|' || id) - 1) % 5 as int) as fold from t"""))
def _(spark, sf):
    rows = found(spark, sf).select("id", (F.col("day") > 4).alias("late"))
    return resample.fold_of(rows, id_col="id", stratum="late")


_early = """select id, max(level) filter (where day <= 4) as x from ud group by id"""


_group_out = detect_sql("ud", "t") | {"x": _seg, "e": "select segment, day from x where occurred",
    "m": """select a.segment, median(b.day) as guess, count(b.day) as n_train from (select distinct segment from e) a join e b
    on b.segment <> a.segment group by 1""", "go": """select e.segment as "group", count(*) as n_test, n_train, avg(abs(day - guess)) as score
    from e join m on m.segment = e.segment group by 1, 3 having count(*) >= 5"""}


def _groups_left_out(spark, sf):
    rows = found(spark, sf).where("occurred").join(table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), "id", "left").select("id", "segment", "day")

    return jobs.leave_group_out_errors(rows, y="day", group="segment", id_col="id", min_group_size=5)


@query("j3_leave_one_group_out", with_ctes(_group_out, 'select "group", n_test, n_train, round(score, 6) as score from go'))
def _(spark, sf):
    return _groups_left_out(spark, sf).select("group", "n_test", "n_train", r6("score"))


@query("j3_weighted_mean", with_ctes(_group_out, """select count(*) as groups, cast(sum(n_test) as bigint) as n_test,
    round(sum(score * n_test) / sum(n_test), 6) as score from go"""))
def _(spark, sf):
    return resample.weighted_score(_groups_left_out(spark, sf)).select("groups", "n_test", r6("score"))


_wf = {"w": "select id, max(purchase) filter (where day <= 4) as purchase, max(click) filter (where day <= 4) as click from ud group by id",
       "f": f"select id, cast({_f0} as int) as fold from w"}


def _wide_folds(spark, sf):
    d = user_days(spark, sf)
    w = d.groupBy("id").agg(*[F.max(F.when(F.col("day") <= 4, F.col(c))).alias(c) for c in ("purchase", "click")])
    return w.join(resample.fold_of(w, id_col="id").drop("repeat"), "id")


@query("j4_fold_medians", with_ctes(_wf | {"q": """select k::int as fold, median(purchase) as p, median(click) as c from (select w.*, fold as f from w
    join f on f.id = w.id), generate_series(0, 4) t(k) where f <> k group by 1"""}, """select w.id, f.fold, round(coalesce(purchase, p), 6) as purchase,
    round(coalesce(click, c), 6) as click from w join f on f.id = w.id join q on q.fold = f.fold"""))
def _(spark, sf):
    d = baselines.impute_from_training(_wide_folds(spark, sf), fold_col="fold", folds=5, columns=["purchase", "click"])
    return d.select("id", "fold", r6("purchase"), r6("click"))


@query("j5_scaling", with_ctes(_wf, """select id, round((purchase - avg(purchase) over ()) / stddev_pop(purchase) over (), 6) as standard,
    round((click - quantile_cont(click, 0.5) over ()) / (quantile_cont(click, 0.75) over () - quantile_cont(click, 0.25) over ()), 6) as robust from w"""))
def _(spark, sf):
    d = baselines.standardised(_wide_folds(spark, sf), columns=["purchase"])
    d = baselines.iqr_scaled(d, columns=["click"])
    return d.select("id", r6("purchase", "standard"), r6("click", "robust"))


_base_rows = {"x": _seg, "fx": f"""select id, day, segment, cast({_f0} as int) as fold from x where occurred""",
              "gm": "select k::int as fold, median(day) as g from (select day, fold as f from fx), generate_series(0, 4) t(k) where f <> k group by 1",
              "sm": "select k::int as fold, segment, median(day) as s from (select day, segment, fold as f from fx), generate_series(0, 4) t(k) where f <> k group by 1, 2"}


def _day_rows(spark, sf):
    rows = found(spark, sf).where("occurred").join(table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), "id", "left").select("id", "segment", "day")
    return rows.join(resample.fold_of(rows, id_col="id").drop("repeat"), "id")


@query("j6_median_baselines", with_ctes(detect_sql("ud", "t") | _base_rows, """select fx.id, fx.fold, g as global_median, coalesce(s, g) as group_median
    from fx join gm on gm.fold = fx.fold left join sm on sm.fold = fx.fold and sm.segment is not distinct from fx.segment"""))
def _(spark, sf):
    d = baselines.out_of_fold_medians(_day_rows(spark, sf), value="day", group="segment", fold_col="fold", folds=5)
    return d.select("id", "fold", "global_median", "group_median")


_scores = _lab | pp_sql("dy", "lab", "p") | {"sx": """select id, day, y, segment, round(coalesce(exposure, 0) * 0.01 + coalesce("view", 50) * 0.001, 9) as s0,
    round(1 / (1 + exp(-(coalesce(exposure, 0) * 0.05 - 2))), 9) as s1 from p"""}


def scored_rows(spark, sf):
    d = pp(spark, sf)
    x, v = F.coalesce("exposure", F.lit(0)), F.coalesce("view", F.lit(50))
    return d.select("id", "day", "y", "segment", F.round(x * 0.01 + v * 0.001, 9).alias("s0"),
                    F.round(1 / (1 + F.exp(-(x * 0.05 - 2))), 9).alias("s1"))


_auc = lambda s: f"(sum(r) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0) / (count(*) filter (where y = 1) * count(*) filter (where y = 0))"


@query("j15_auc_by_day", with_ctes(_scores | {"k": f"select day, y, {_rank('s0', 'partition by day')} as r from sx"}, f"""select day,
    count(*) filter (where y = 1) as events, count(*) as at_risk, round({_auc('')}, 6) as auc from k group by day
    having count(*) filter (where y = 1) >= 5 and count(*) filter (where y = 0) >= 5"""))
def _(spark, sf):
    return metrics.auc_within_day(scored_rows(spark, sf), day_col="day", score="s0").select("day", "events", "at_risk", r6("auc"))


@query("j15_auc_brier", with_ctes(_scores | {"k": f"select segment, y, s1, {_rank('s1', 'partition by segment')} as r from sx"}, f"""select segment,
    round({_auc('')}, 6) as auc, round(avg(power(y - s1, 2)), 6) as brier from k group by segment"""))
def _(spark, sf):
    d = scored_rows(spark, sf)
    a = metrics.auc(d, score="s1", by="segment").select("segment", r6("auc"))
    return a.join(metrics.brier(d, p="s1", by="segment").select("segment", r6("brier")), "segment")


@query("j16_first_alarm", with_ctes(_scores | {"a": """select id, min(day) filter (where y = 1) as ev, min(day) filter (where s1 >= 0.5) as al from sx group by id"""},
    """select count(*) filter (where al = ev) as exact, count(*) filter (where al <> ev) as early, count(*) filter (where al is null) as none_in_time
    from a where ev is not null"""))
def _(spark, sf):
    return compare.alarm_summary(compare.first_alarm(scored_rows(spark, sf), **KEY, p_col="s1"))


@query("j22_profile_event_day", with_ctes({}, """select id, min(day) filter (where coalesce(l1 < level and l2 < l1 and up > 0, false)) as event_day from (select *,
    max(case when d > 0 then 1 else 0 end) over (partition by id order by day rows between unbounded preceding and 1 preceding) as up from (select id, day, level,
    lead(level) over w as l1, lead(level, 2) over w as l2, lead(level) over w - level as d from ud window w as (partition by id order by day))) group by id"""))
def _(spark, sf):
    from fallpoint.plans.panel import profile_event_day

    return profile_event_day(user_days(spark, sf), **UD)


# The published numbers of resamples and shuffles.
RESAMPLES, PAIRED, SHUFFLES, COINCIDENCES = 1000, 5000, 200, 5000

_x5 = lambda u: f"((({u}) * ({u}) % {P}) * (({u}) * ({u}) % {P}) % {P} * ({u}) % {P})"
_key = lambda at: f"('0x' || substr(md5('0|' || id), {at}, 8))::bigint"

# Poisson weights of mean one, from the keys of an id: table "ct" (b, id, times) for the ids of "e0".
_boot = lambda n: {
    "i": f"select id, {_key(1)} % {P} as k1, 1 + {_key(9)} % {P - 1} as k2 from (select distinct id from e0)",
    "dr": f"select id, b, (k1 + b * k2) % {P} as u from i, generate_series(0, {n - 1}) t(b)",
    "ct": "select * from (select b, id, " + " + ".join(f"case when {_x5('u')} >= {t} then 1 else 0 end" for t in poisson_thresholds())
          + " as times from dr) where times > 0"}


# Exactly as many draws in each resample as there are ids, from hashed positions: the same table "ct".
_draws = lambda n: {"i": "select *, row_number() over (order by md5('0|' || id) || '|' || id) - 1 as ix, count(*) over () as n from (select distinct id from e0)",
                    "dr": f"select b, {_hash(chr(39) + '0' + chr(39), 'b', 'id')} % n as ix from i, generate_series(0, {n - 1}) t(b)",
                    "ct": "select b, i.id, count(*) as times from dr join i on i.ix = dr.ix group by 1, 2"}


@query("j25_bootstrap_counts", with_ctes({"e0": "select distinct user_id as id from events"} | _draws(RESAMPLES), "select cast(b as int) as b, id, times from ct"))
def _(spark, sf):
    return resample.bootstrap_counts(_ids(spark, sf), id_col="id", resamples=RESAMPLES, exact=True)


@query("j25_bootstrap_mean", with_ctes(detect_sql("ud", "t") | detect_sql("ud", "u", refine=False) | {"e0": """select t.id, t.day - u.day as gap
    from t join u on u.id = t.id where t.day is not null and u.day is not null"""} | _draws(RESAMPLES) | {"mm": """select b, sum(times * gap) / sum(times) as m
    from ct join e0 on e0.id = ct.id group by b"""}, """select 'gap' as variable, (select round(avg(gap), 6) from e0) as mean,
    round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from mm"""))
def _(spark, sf):
    d = compare.compare_labels(found(spark, sf), found(spark, sf, refine_peak=False), id_col="id")
    d = d.where(F.col("day_difference").isNotNull()).select("id", F.col("day_difference").alias("gap"))
    return resample.bootstrap_mean(d, id_col="id", values=["gap"], resamples=RESAMPLES, exact=True).select("variable", r6("mean"), r6("low"), r6("high"))


@query("j25_bootstrap_auc", with_ctes(_scores | {"e0": "select distinct id from p"} | _boot(RESAMPLES) | {
    "lg": "select id, 'a' as m, s0 as s, y from sx union all select id, 'b', s1, y from sx",
    "wt": "select b, m, s, sum(times * y) as pos, sum(times * (1 - y)) as neg from lg join ct on ct.id = lg.id group by 1, 2, 3",
    "cm": "select *, coalesce(sum(neg) over (partition by b, m order by s rows between unbounded preceding and 1 preceding), 0) as bn from wt",
    "au": "select b, m, sum(pos * (bn + neg / 2)) / (sum(pos) * sum(neg)) as auc from cm group by 1, 2",
    "gn": "select b, max(auc) filter (where m = 'b') as auc_b, max(auc) filter (where m = 'b') - max(auc) filter (where m = 'a') as gain from au group by b",
    "k": f"select y, {_rank('s1')} as r from sx", "k0": f"select y, {_rank('s0')} as r from sx"},
    f"""select 'auc_b' as metric, (select round({_auc('')}, 6) from k) as value, round(quantile_cont(auc_b, 0.025), 6) as low, round(quantile_cont(auc_b, 0.975), 6) as high
    from gn union all select 'gain', round((select {_auc('')} from k) - (select {_auc('')} from k0), 6), round(quantile_cont(gain, 0.025), 6), round(quantile_cont(gain, 0.975), 6) from gn"""))
def _(spark, sf):
    d = metrics.bootstrap_auc(scored_rows(spark, sf), id_col="id", score_a="s0", score_b="s1", resamples=RESAMPLES)
    return d.select("metric", r6("value"), r6("low"), r6("high"))


def _perm(rounds: int, within: str = "") -> dict[str, str]:
    """Shuffles of "e" as "sh" (b, id, own, v): the keyed network over all cells of a square, then walks until a cell is inside."""
    part = "partition by segment " if within else ""
    keys = round_keys(0)
    out = {"ix": f"select *, row_number() over ({part}order by md5('0d|' || id) || '|' || id) - 1 as ix, count(*) over ({part}) as n from e",
           "kb": "select b, " + ", ".join(f"{_x5(f'({k[0]} + b * {k[1]}) % {P}')} as c{t}, 1 + {_x5(f'({k[2]} + b * {k[3]}) % {P}')} % {P - 1} as d{t}"
                                         for t, k in enumerate(keys)) + f" from generate_series(0, {rounds - 1}) g(b)",
           "n0": """select n, m, x, kb.*, x // m as l, x % m as r from (select n, m, unnest(generate_series(0, m * m - 1)) as x
               from (select distinct n, ceil(sqrt(n))::bigint as m from ix)), kb"""}
    for t in range(len(keys)):
        out[f"u{t}"] = f"select *, (c{t} + r * d{t}) % {P} as u from n{t}"
        out[f"n{t + 1}"] = f"select * exclude (l, r, u), r as l, (l + {_x5('u')}) % m as r from u{t}"
    return out | {"net": f"select n, b, x, l * m + r as y from n{len(keys)}",
                  "wk": """select n, b, x, y from net where x < n union all
                      select wk.n, wk.b, wk.x, net.y from wk join net on net.n = wk.n and net.b = wk.b and net.x = wk.y where wk.y >= wk.n""",
                  "sh": f"""select wk.b, i.id, i.v as own, d.v as v from wk join ix i on i.n = wk.n and i.ix = wk.x join ix d on d.n = wk.n and d.ix = wk.y
                      {'and d.segment is not distinct from i.segment' if within else ''} where wk.y < wk.n"""}


@query("j26_permutation_test", with_ctes(detect_sql("ud", "t") | {"x": f"select t.id, day as v, fs.x from t join ({_early}) fs on fs.id = t.id where occurred and x is not null",
    "e": "select * from x"} | _perm(SHUFFLES) | {"nl": """select b, round(abs(corr(sh.v, x.x)), 9) as score from sh join x on x.id = sh.id group by b""",
    "ob": "select round(abs(corr(v, x)), 9) as score from x"}, """select round(max(ob.score), 6) as observed, round(avg(nl.score), 6) as null_mean,
    round(stddev_pop(nl.score), 6) as null_sd, round((count(*) filter (where nl.score >= ob.score) + 1) / (count(*) + 1), 6) as p_value,
    round(1 / (count(*) + 1), 6) as p_min, count(*) as n_permutations from nl, ob"""))
def _(spark, sf):
    early = user_days(spark, sf).groupBy("id").agg(F.max(F.when(F.col("day") <= 4, F.col("level"))).alias("x"))
    rows = found(spark, sf).where("occurred").select("id", "day").join(early, "id").where("x is not null")
    out = resample.permutation_test(lambda d: d.groupBy("b").agg(F.round(F.abs(F.corr("day", "x")), 9).alias("score")), rows,
                                    id_col="id", label="day", n_permutations=SHUFFLES, lower_is_better=False)
    return out.select(*[r6(c) for c in ("observed", "null_mean", "null_sd", "p_value", "p_min")], "n_permutations")


_coin = detect_sql("ud", "t") | {"cd": "select id, min(day) filter (where setpoint = 0) as cd, any_value(segment) as segment from dy group by id",
    "e": "select t.id, t.day, cd as v, segment from t join cd on cd.id = t.id where occurred and cd is not null"}
_coin_end = {"nl": """select b, avg(case when abs(e.day - sh.v) <= 1 then 1.0 else 0.0 end) as score from sh join e on e.id = sh.id group by b""",
             "ob": "select avg(case when abs(day - v) <= 1 then 1.0 else 0.0 end) as score from e"}
_coin_fin = """select round(max(ob.score), 6) as observed, round(avg(nl.score), 6) as null_mean,
    round((count(*) filter (where nl.score >= ob.score - 1e-12) + 1) / (count(*) + 1), 6) as p_value, count(*) as n_permutations from nl, ob"""


def _coincide(spark, sf, within):
    sched = features.schedule_summary(daily(spark, sf), **KEY, setpoint_col="setpoint").select("id", "change_day")
    seg = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    rows = found(spark, sf).where("occurred").select("id", "day").join(sched, "id").join(seg, "id", "left")
    d = resample.coincidence_test(rows, id_col="id", day="day", other_day="change_day", rounds=COINCIDENCES, within=within)
    return d.select(r6("observed"), r6("null_mean"), r6("p_value"), "n_permutations")


_coin["cd"] = """select id, min(day) filter (where setpoint <> s0) as cd, any_value(segment) as segment from (select *, first_value(setpoint) over
    (partition by id order by day) as s0 from dy) group by id"""


@query("j27_coincidence", with_ctes(_coin | _perm(COINCIDENCES) | _coin_end, _coin_fin))
def _(spark, sf):
    return _coincide(spark, sf, None)


@query("j27_coincidence_within_group", with_ctes(_coin | _perm(COINCIDENCES, "segment") | _coin_end, _coin_fin))
def _(spark, sf):
    return _coincide(spark, sf, "segment")


@query("j28_paired_baselines", with_ctes(detect_sql("ud", "t") | _base_rows | {"e0": """select fx.id, abs(day - g) - abs(day - coalesce(s, g)) as gap
    from fx join gm on gm.fold = fx.fold left join sm on sm.fold = fx.fold and sm.segment is not distinct from fx.segment"""} | _boot(PAIRED) | {
    "mm": "select b, sum(times * gap) / sum(times) as m from ct join e0 on e0.id = ct.id group by b",
    "ci": "select (select avg(gap) from e0) as mean, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from mm"},
    """select round(mean, 6) as mean, round(low, 6) as low, round(high, 6) as high, case when low >= 0.01 then 'wins' when high < 0 then 'loses'
    when low >= 0 then 'touches zero' else 'inconclusive' end as verdict from ci"""))
def _(spark, sf):
    d = baselines.out_of_fold_medians(_day_rows(spark, sf), value="day", group="segment", fold_col="fold", folds=5)
    d = d.select("id", (F.abs(F.col("day") - F.col("global_median")) - F.abs(F.col("day") - F.col("group_median"))).alias("gap"))
    ci = resample.bootstrap_mean(d, id_col="id", values=["gap"], resamples=PAIRED)
    return ci.select(r6("mean"), r6("low"), r6("high"), compare.verdict(F.col("low"), F.col("high")).alias("verdict"))


@query("j39_wins_in_groups", with_ctes(detect_sql("ud", "t") | _base_rows | {"e0": """select fx.id, fx.segment, abs(day - g) - abs(day - coalesce(s, g)) as gap
    from fx join gm on gm.fold = fx.fold left join sm on sm.fold = fx.fold and sm.segment is not distinct from fx.segment"""} | _boot(PAIRED) | {
    "mm": "select b, segment, sum(times * gap) / sum(times) as m from ct join e0 on e0.id = ct.id group by 1, 2",
    "ci": "select segment, quantile_cont(m, 0.025) as low from mm group by 1"},
    "select count(*) filter (where low > 0) as wins, count(*) as groups, count(*) filter (where low > 0) >= 2 as accepted from ci"))
def _(spark, sf):
    d = baselines.out_of_fold_medians(_day_rows(spark, sf), value="day", group="segment", fold_col="fold", folds=5)
    d = d.select("id", "segment", (F.abs(F.col("day") - F.col("global_median")) - F.abs(F.col("day") - F.col("group_median"))).alias("gap"))
    return compare.wins_in_groups(resample.bootstrap_mean(d, id_col="id", values=["gap"], resamples=PAIRED, by="segment"), low="low")


@query("j28_error_by_true_day", with_ctes(detect_sql("ud", "t") | _base_rows, """select day, count(*) as n, round(avg(abs(day - g)), 6) as global_error,
    round(avg(abs(day - coalesce(s, g))), 6) as group_error from fx join gm on gm.fold = fx.fold left join sm on sm.fold = fx.fold
    and sm.segment is not distinct from fx.segment group by day"""))
def _(spark, sf):
    d = baselines.out_of_fold_medians(_day_rows(spark, sf), value="day", group="segment", fold_col="fold", folds=5)
    err = lambda c: F.avg(F.abs(F.col("day") - F.col(c)))
    return d.groupBy("day").agg(F.count(F.lit(1)).alias("n"), r6(err("global_median"), "global_error"), r6(err("group_median"), "group_error"))


_time = detect_sql("ud", "t") | detect_sql("ud", "u", refine=False) | detect_sql("ud", "v", n=3, threshold=0.5) | _rk | {
    "tm": " union all ".join(f"select k.day as true_day, '{n}' as method, {s}.day - k.day as error from k join {s} on {s}.id = k.id where k.day is not null"
                             for n, s in (("refined", "t"), ("plain", "u"), ("strict", "v")))}


def _timing(spark, sf):
    pick = lambda df, n: df.select("id", F.col("day").alias(n))
    return (_events(spark, sf).select("id", F.col("day").alias("truth")).join(pick(found(spark, sf), "refined"), "id")
            .join(pick(found(spark, sf, refine_peak=False), "plain"), "id")
            .join(pick(found(spark, sf, n_consecutive=3, drop_threshold=0.5), "strict"), "id"))


_tsel = """count(*) as ids, count(error) as detected, round(avg(case when error = 0 then 1.0 else 0.0 end), 6) as exact,
    round(avg(case when abs(error) <= 1 then 1.0 else 0.0 end), 6) as within_1_day, round(avg(abs(error)), 6) as mae_detected from tm"""


def _timing_out(d, keys):
    return d.select(*keys, "ids", "detected", r6("exact"), r6("within_1_day"), r6("mae_detected"))


@query("j29_timing_table", with_ctes(_time, f"select method, {_tsel} group by 1"))
def _(spark, sf):
    d = compare.timing_table(_timing(spark, sf), truth="truth", methods=["refined", "plain", "strict"])
    return _timing_out(d, ["method"])


@query("j29_timing_by_day", with_ctes(_time, f"select method, true_day, {_tsel} group by 1, 2"))
def _(spark, sf):
    d = compare.timing_table(_timing(spark, sf), truth="truth", methods=["refined", "plain", "strict"], by_day=True)
    return _timing_out(d, ["method", "true_day"])
