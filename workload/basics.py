"""Queries over scans, filters, joins, aggregates, windows, order, sets and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from fallpoint.contracts import series_problems
from fallpoint.functions import columns as fx
from fallpoint.operators import compare, detect, features, grid, ordered, profile, quality, rates, stats
from fallpoint.plans import metrics, resample
from workload.bindings import KINDS, daily, filled, months, table, user_days
from workload.ctes import detect as detect_sql
from workload.ctes import grid as grid_sql
from workload.ctes import labels as labels_sql
from workload.ctes import rates as rates_sql
from workload.ctes import with_ctes
from workload.registry import query, r6

UD = dict(id_col="id", day_col="day", value_col="level")
KEY = dict(id_col="id", day_col="day")
COVS = list(KINDS)


def found(spark, sf, src=user_days, **kw):
    return detect.detect_shift_batch(src(spark, sf), **UD, on_error="assert", **kw)


# ---------------------------------------------------------------- scans


@query("a1_series_scan", with_ctes({}, "select id, day, round(level, 6) as level, n_events from ud"))
def _(spark, sf):
    return user_days(spark, sf).select("id", "day", r6("level"), "n_events")


@query("a3_header_names", """select c_custkey as custkey, c_name as name, c_mktsegment as mkt_segment from customer""")
def _(spark, sf):
    raw = table(spark, sf, "customer").select(F.col("c_custkey").alias(" CustKey "), F.col("c_name").alias("Name"),
                                              F.col("c_mktsegment").alias("[Mkt Segment]"))
    return raw.toDF(*[fx.clean_name(c.strip()) for c in raw.columns])


@query("a4_composite_key", with_ctes({}, "select 'C' || id as id, day, round(level, 6) as level from ud"))
def _(spark, sf):
    keyed = user_days(spark, sf).select(F.concat(F.lit("C"), "id", F.lit("_d"), "day").alias("key"), "level")
    ident, day = fx.split_key(F.col("key"))
    return keyed.select(ident.alias("id"), day.alias("day"), r6("level"))


@query("a8_shared_column_agrees", with_ctes({}, """select count(*) as n_rows, max(abs(ud.level - fl.level)) as max_gap,
    true as agree from ud join fl on ud.id = fl.id and ud.day = fl.day"""))
def _(spark, sf):
    return profile.columns_agree(user_days(spark, sf), filled(spark, sf), keys=["id", "day"], column="level")


# ---------------------------------------------------------------- filters and checks

_broken = """select id, case when n_events > 6 then day - 1 when level < 3 then null else day end as day, level from ud"""


@query("b2_series_problems", with_ctes({"br": _broken}, """select id, case
    when bool_or(day is null) then 'day_not_finite'
    when max(n) filter (where day is not null) > 1 then 'day_repeated'
    when min(day) < 1 then 'day_below_one' end as problem
    from (select id, day, count(*) as n from br group by 1, 2) group by id
    having bool_or(day is null) or coalesce(max(n) filter (where day is not null) > 1, false) or coalesce(min(day) < 1, false)"""))
def _(spark, sf):
    d = user_days(spark, sf).withColumn("day", F.when(F.col("n_events") > 6, F.col("day") - 1)
                                        .when(F.col("level") < 3, None).otherwise(F.col("day")))
    return series_problems(d, **KEY).select("id", "problem")


@query("b4_drop_incomplete", with_ctes({}, """select id, day, round(click, 6) as click, round(view, 6) as "view" from ud
    where click is not null and "view" is not null qualify count(*) over (partition by id) >= 5"""))
def _(spark, sf):
    d = quality.drop_incomplete(user_days(spark, sf), id_col="id", need=["click", "view"], min_rows=5)
    return d.select("id", "day", r6("click"), r6("view"))


@query("b5_day_range", with_ctes({}, "select id, day, round(level, 6) as level from ud where day between 2 and 9"))
def _(spark, sf):
    return quality.day_range(user_days(spark, sf), day_col="day", first=2, last=9).select("id", "day", r6("level"))


@query("b6_exclusion_flags", with_ctes(detect_sql("ud", "t"), """select t.id, occurred, t.day,
    coalesce(peak < 90, false) as never_accumulates,
    (occurred and coalesce(t.day <= 4, false)) or coalesce(peak < 90, false) as excluded
    from t left join (select id, max(level) as peak from ud group by id) p on p.id = t.id"""))
def _(spark, sf):
    d = user_days(spark, sf)
    peaks = d.groupBy("id").agg(F.max("level").alias("peak"))
    out = quality.exclusion(found(spark, sf), window=4, peaks=peaks, id_col="id", min_peak=90)
    return out.select("id", "occurred", "day", "never_accumulates", "excluded")


@query("b7_rename_columns", with_ctes({}, "select id, day, round(level, 6) as signal, n_events as readings from ud"))
def _(spark, sf):
    d = user_days(spark, sf).select("id", "day", r6("level"), "n_events")
    return quality.rename(d, {"level": "signal", "n_events": "readings"})


@query("b8_indicators", with_ctes({}, "select id, day, " + ", ".join(
    f"cast(day = {k} as int) as d{k}" for k in range(3, 12)) + """, cast(day > 11 as int) as d12p,
    cast(coalesce(segment = 'BUILDING', false) as int) as "g_BUILDING",
    cast(coalesce(segment = 'MACHINERY', false) as int) as "g_MACHINERY",
    cast(coalesce(segment not in ('AUTOMOBILE', 'BUILDING', 'MACHINERY'), false) as int) as g_other from dy"""))
def _(spark, sf):
    d = daily(spark, sf)
    groups = quality.group_indicators(F.col("segment"), ["AUTOMOBILE", "BUILDING", "MACHINERY"])
    return d.select("id", "day", *[c.alias(n) for n, c in {**quality.day_indicators(F.col("day")), **groups}.items()])


@query("b9_negative_ids", "select distinct c_custkey as id from customer where c_acctbal < 0")
def _(spark, sf):
    return detect.negative_ids(table(spark, sf, "customer").withColumnRenamed("c_custkey", "id"), id_col="id",
                               value_col="c_acctbal")


_fence = """select quantile_cont(click, 0.25) as q1, quantile_cont(click, 0.75) as q3 from ud"""


@query("b10_mask_outliers", with_ctes({"q": _fence, "h": """select id, day, click, error, purchase,
    coalesce(click < q1 - 1.0 * (q3 - q1) or click > q3 + 1.0 * (q3 - q1), false) as hit, setpoint from dy, q"""},
    """select id, day, round(case when not hit then click end, 6) as click, round(case when not hit then error end, 6) as error,
    hit as fence_hit, case when setpoint <> 0 then setpoint end as setpoint from h"""))
def _(spark, sf):
    d = quality.mask_outliers(daily(spark, sf), value_col="click", mask_cols=["click", "error"],
                              zero_cols=["setpoint"], spread=1.0)
    return d.select("id", "day", r6("click"), r6("error"), "fence_hit", "setpoint")


@query("b10_outlier_log", with_ctes({"q": _fence}, """select id, day, round(click, 6) as click from ud, q
    where click < q1 - 1.0 * (q3 - q1) or click > q3 + 1.0 * (q3 - q1)"""))
def _(spark, sf):
    d = quality.outlier_log(user_days(spark, sf), keep=["id", "day", "click"], value_col="click", spread=1.0)
    return d.select("id", "day", r6("click"))


@query("b11_zero_summary", with_ctes({}, """select 'setpoint' as variable, count(*) filter (where setpoint = 0) as zeros,
    count(distinct id) filter (where setpoint = 0) as ids,
    count(*) filter (where setpoint = 0 and purchase is null) as companion_missing from dy"""))
def _(spark, sf):
    return quality.zero_summary(daily(spark, sf), id_col="id", zero_cols=["setpoint"], companion="purchase")


@query("b12_varying_columns", with_ctes({}, "select id, day, round(level, 6) as level, setpoint from dy"))
def _(spark, sf):
    d = daily(spark, sf).select("id", "day", r6("level"), "setpoint", F.lit(1.0).alias("scale"))
    return d.select(quality.varying_columns(d, d.columns))


@query("b13_mask_days", with_ctes({}, """select ud.id, ud.day, round(case when x.id is null then level end, 6) as level
    from ud left join (select id, day from ud where n_events = 1) x on x.id = ud.id and x.day = ud.day"""))
def _(spark, sf):
    d = user_days(spark, sf)
    return detect.mask_days(d.select("id", "day", "level"), d.where("n_events = 1"), **UD
                            ).select("id", "day", r6("level"))


@query("b14_select_by_prefix", "select l_orderkey, l_linenumber, l_linestatus from lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", *quality.prefixed(li.columns, ["l_line"]))


@query("b15_right_closed_bins", with_ctes({}, """select id, day, case when x > 0 and x <= 0.25 then '0-25%'
    when x > 0.25 and x <= 0.5 then '25-50%' when x > 0.5 and x <= 0.75 then '50-75%'
    when x > 0.75 and x <= 1.0001 then '75-100%' end as bin
    from (select id, day, level / max(level) over (partition by id) as x from ud)"""))
def _(spark, sf):
    d = user_days(spark, sf).withColumn("x", F.col("level") / F.max("level").over(grid.whole("id")))
    bins = fx.right_closed_bin(F.col("x"), [0, 0.25, 0.5, 0.75, 1.0001], ["0-25%", "25-50%", "50-75%", "75-100%"])
    return d.select("id", "day", bins.alias("bin"))


@query("b16_whole_days", with_ctes({}, """select id, cast(round_even(f, 0) as int) + 1 as day, round(avg(value), 6) as value,
    1 as shift from (select id, value, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 86400000000.0::double as f from ev)
    group by 1, 2"""))
def _(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("id"), "value", "ts")
    micros = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    d = ev.withColumn("day", micros / F.lit(86400000000.0))
    out = quality.whole_days(d, **KEY, value_col="value", starts_at_zero=F.lit(True))
    return out.select("id", "day", r6("value"), "shift")


# ---------------------------------------------------------------- joins


@query("c1_two_observation_sets", with_ctes({}, """select ud.id, ud.day, round(ud.click, 6) as click_r,
    round(fl.click, 6) as click_g from ud join fl on fl.id = ud.id and fl.day = ud.day"""))
def _(spark, sf):
    d = profile.joined_observations(user_days(spark, sf), filled(spark, sf), **KEY, columns=["click"])
    return d.select("id", "day", r6("click_r"), r6("click_g"))


@query("c2_label_join", with_ctes(detect_sql("ud", "t"), """select d.id, d.day, round(level, 6) as level, t.day as event_day,
    occurred from ud d left join t on t.id = d.id"""))
def _(spark, sf):
    lab = found(spark, sf).select("id", F.col("day").alias("event_day"), "occurred")
    return user_days(spark, sf).join(lab, "id", "left").select("id", "day", r6("level"), "event_day", "occurred")


@query("c3_full_join_match", with_ctes({"a": "select distinct id from ud where purchase > 60",
                                        "b": "select distinct id from ud where click > 60"},
    """select coalesce(a.id, b.id) as id, case when a.id is null then 'right_only' when b.id is null then 'left_only'
    else 'both' end as match from a full join b on a.id = b.id"""))
def _(spark, sf):
    d = user_days(spark, sf)
    pick = lambda c: d.where(F.col(c) > 60).select("id").distinct()
    return compare.matched(pick("purchase"), pick("click"), ["id"])


@query("c4_two_key_join", """select l_suppkey as s, l_partkey as p, count(*) as n from lineitem join
    (select l_suppkey as s, l_partkey as p, max(l_quantity) as q from lineitem group by 1, 2) x
    on x.s = l_suppkey and x.p = l_partkey and l_quantity = x.q group by 1, 2""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), "l_quantity")
    top = li.groupBy("s", "p").agg(F.max("l_quantity").alias("l_quantity"))
    return li.join(top, ["s", "p", "l_quantity"]).groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"))


@query("c5_calendar", with_ctes({"d": """select id, cast(unnest(generate_series(1, m)) as int) as day
    from (select id, max(day) as m from ud group by id)"""}, """select d.id, d.day, round(level, 6) as level from d
    left join ud u on u.id = d.id and u.day = d.day"""))
def _(spark, sf):
    return grid.calendar(user_days(spark, sf).select("id", "day", "level"), **KEY).select("id", "day", r6("level"))


_t = detect_sql("ud", "t")
_seg = "select t.*, c_mktsegment as segment from t left join customer on c_custkey = id"


@query("c6_group_median_fallback", with_ctes(_t | {"x": _seg, "m": """select segment, median(day) as m from x
    where occurred and segment <> 'MACHINERY' group by 1"""}, """select id, coalesce(m,
    (select median(day) from x where occurred)) as guess from x left join m on m.segment = x.segment"""))
def _(spark, sf):
    from fallpoint.plans.baselines import median_lookup

    lab = found(spark, sf).join(table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), "id", "left")
    known = lab.where("occurred and segment <> 'MACHINERY'")
    return median_lookup(lab, known, group="segment", value="day", fallback_from=lab.where("occurred"),
                         out="guess").select("id", "guess")


@query("c7_semi_anti", with_ctes(_t, """select id, day, round(level, 6) as level,
    id in (select id from t where occurred and day > 4) as late from ud"""))
def _(spark, sf):
    d = user_days(spark, sf).select("id", "day", r6("level"))
    late = found(spark, sf).where("occurred and day > 4").select("id")
    return (d.join(late, "id", "left_semi").withColumn("late", F.lit(True))
            .unionByName(d.join(late, "id", "left_anti").withColumn("late", F.lit(False))))


@query("c9_fall_before_recovery", with_ctes(_t, """select id, day as pos, round(s, 6) as value, round(low, 6) as low from t_f"""))
def _(spark, sf):
    p = detect.smoothed_paths(user_days(spark, sf), **UD, smooth_window=3, max_run=2, on_error="assert")
    p = p.withColumn("f", detect.first_deep_fall("path", "x.run >= 2", "0.3D")).where("f is not null")
    return p.select("id", F.col("f.pos").alias("pos"), r6("f.val", "value"), r6("f.low", "low"))


@query("c10_concordance", with_ctes(_t | {"x": """select t.id, time, occurred, f.l from t join
    (select id, max(level) filter (where day <= 4) as l from ud group by id) f on f.id = t.id where l is not null"""},
    """select count(*) as pairs, round(sum(case when a.l < b.l then 1.0 when a.l = b.l then 0.5 else 0 end) / count(*), 6)
    as concordance from x a join x b on a.occurred and (a.time < b.time or (a.time = b.time and not b.occurred))"""))
def _(spark, sf):
    early = user_days(spark, sf).groupBy("id").agg(F.max(F.when(F.col("day") <= 4, F.col("level"))).alias("l"))
    rows = found(spark, sf).join(early, "id")
    out = metrics.concordance(rows, time="time", event="occurred", score="l")
    return out.select(F.col("pairs").cast("long").alias("pairs"), r6("concordance"))


@query("c10_concordance_fractional", """with x as (select user_id, max(epoch_us(ts)) / 8.64e10 as time, bool_or(event_type = 'purchase') as occurred,
    count(*) as l from events group by user_id) select count(*) as pairs,
    round(sum(case when a.l < b.l then 1.0 when a.l = b.l then 0.5 else 0 end) / count(*), 6) as concordance
    from x a join x b on a.occurred and (a.time < b.time or (a.time = b.time and not b.occurred))""")
def _(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_type")
    rows = ev.groupBy("user_id").agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 8.64e10).alias("time"),
                                     F.max(F.col("event_type") == "purchase").alias("occurred"), F.count(F.lit(1)).alias("l"))
    out = metrics.concordance(rows, time="time", event="occurred", score="l")
    return out.select(F.col("pairs").cast("long").alias("pairs"), r6("concordance"))


@query("b1_first_faults", """with n as (select row_number() over () as row, o_orderpriority as p, o_orderstatus as s, o_orderdate as d from orders)
    select min(row) filter (where try_cast(split_part(p, '-', 2) as double) is null) as priority_row,
    arg_min(split_part(p, '-', 2), row) filter (where try_cast(split_part(p, '-', 2) as double) is null) as priority_cell,
    min(row) filter (where s = 'P') as status_row, min(row) filter (where d is null) as no_day from n""")
def _(spark, sf):
    text = table(spark, sf, "orders").select(F.split("o_orderpriority", "-")[1].alias("p"), F.when(F.col("o_orderstatus") == "P", "P").otherwise("0").alias("s"), "o_orderdate")
    got = quality.first_faults(text, numeric=["p", "s"], day_col="o_orderdate")
    return got.select(F.col("bad_0.row").alias("priority_row"), F.col("bad_0.cell").alias("priority_cell"), F.col("bad_1.row").alias("status_row"), "no_day")


@query("d17_label_correlations", with_ctes(_t | {"x": """select t.day as y, max(level) filter (where ud.day <= 4) as level,
    max(n_events) filter (where ud.day <= 4) as n_events from t join ud on ud.id = t.id where t.occurred group by t.id, t.day""",
    "l": "select 'level' as variable, level as v, y from x where level is not null union all select 'n_events', n_events, y from x where n_events is not null",
    "r": """select variable, rank() over (partition by variable order by v) + (count(*) over (partition by variable, v) - 1) / 2.0 as rv,
    rank() over (partition by variable order by y) + (count(*) over (partition by variable, y) - 1) / 2.0 as ry from l"""},
    "select variable, count(*) as pairs, round(corr(rv, ry), 6) as rho from r group by 1"))
def _(spark, sf):
    early = user_days(spark, sf).where("day <= 4").groupBy("id").agg(F.max("level").alias("level"), F.max("n_events").alias("n_events"))
    rows = found(spark, sf).where("occurred").select("id", F.col("day").alias("y")).join(early, "id")
    return stats.label_correlations(rows, columns=["level", "n_events"], label="y").select("variable", "pairs", r6("rho"))


@query("c11_wide_join", with_ctes(_t | detect_sql("ud", "u", refine=False) | detect_sql("fl", "v", n=3),
    """select t.id, t.day as base_day, u.day as raw_day, v.day as strict_day from t left join u on u.id = t.id
    left join v on v.id = t.id"""))
def _(spark, sf):
    pick = lambda df, n: df.select("id", F.col("day").alias(n))
    return (pick(found(spark, sf), "base_day").join(pick(found(spark, sf, refine_peak=False), "raw_day"), "id", "left")
            .join(pick(found(spark, sf, n_consecutive=3), "strict_day"), "id", "left"))


@query("c12_aligned_mean", with_ctes(grid_sql("ud", "g"), """select day, round(avg(level), 6) as level, count(*) as ids
    from g group by day"""))
def _(spark, sf):
    g = grid.regularize(user_days(spark, sf), **KEY, value_cols=["level"], on_error="assert")
    return g.groupBy("day").agg(r6(F.avg("level"), "level"), F.count(F.lit(1)).alias("ids"))


# ---------------------------------------------------------------- aggregates


@query("d1_series_structure", with_ctes({}, """select id, min(day) as first_day, max(day) as last_day, count(*) as n_rows,
    count(*) = max(day) as continuous from ud group by id"""))
def _(spark, sf):
    return profile.describe_series(user_days(spark, sf), **KEY)


@query("d2_value_counts", with_ctes(_t, "select day, count(*) as n from t where day is not null group by day"))
def _(spark, sf):
    return profile.value_counts(found(spark, sf), "day")


@query("d3_missing_share", with_ctes({}, " union all ".join(
    f"""select '{k}' as variable, round(avg(case when "{k}" is null then 1.0 else 0.0 end) * 100, 6) as pct_missing from ud"""
    for k in KINDS)))
def _(spark, sf):
    return profile.missing_share(user_days(spark, sf), COVS).select("variable", r6("pct_missing"))


@query("d4_window_coverage", with_ctes({"w": "select id, " + ", ".join(
    f'count("{k}") filter (where day between 1 and 4) as "{k}"' for k in KINDS) + " from ud group by id",
    "l": " union all ".join(f"""select '{k}' as variable, "{k}" as n from w""" for k in KINDS)},
    """select variable, round(avg(n), 6) as mean_days, count(*) filter (where n >= 3) as ids_3_days,
    count(*) filter (where n >= 2) as ids_2_days, count(*) filter (where n = 0) as ids_0_days from l group by 1"""))
def _(spark, sf):
    d = profile.window_coverage(user_days(spark, sf), **KEY, columns=COVS)
    return d.select("variable", r6("mean_days"), "ids_3_days", "ids_2_days", "ids_0_days")


@query("d5_imputed_share", with_ctes({}, " union all ".join(
    f"""select '{k}' as variable, round(avg(case when ud."{k}" is null then 1.0 else 0.0 end)
    filter (where ud.day between 1 and 4) * 100, 6) as pct_window,
    round(avg(case when ud."{k}" is null then 1.0 else 0.0 end) * 100, 6) as pct_all
    from ud join fl on fl.id = ud.id and fl.day = ud.day""" for k in KINDS)))
def _(spark, sf):
    d = profile.imputed_share(user_days(spark, sf), filled(spark, sf), **KEY, columns=COVS)
    return d.select("variable", r6("pct_window"), r6("pct_all"))


@query("d6_peak_profile", with_ctes({"p": """select id, arg_max(day, struct_pack(v := level, d := -day)) as pd,
    max(level) as peak, max(day) as duration from ud group by id"""}, """select p.id, duration, pd as peak_day,
    round(pd / duration, 6) as peak_share, round(peak, 6) as peak, round(m, 6) as min_after,
    round((peak - m) / peak, 6) as fall from p left join (select p.id, min(level) as m from p join ud on ud.id = p.id
    and ud.day > pd group by 1) x on x.id = p.id"""))
def _(spark, sf):
    d = profile.peak_profile(user_days(spark, sf), **UD)
    return d.select("id", "duration", "peak_day", *[r6(c) for c in ("peak_share", "peak", "min_after", "fall")])


@query("d7_pivot_by_day", with_ctes({}, "select id, " + ", ".join(
    f'round(max(level) filter (where day = {k}), 6) as "{k}"' for k in range(1, 31)) + " from ud group by id"))
def _(spark, sf):
    return profile.pivoted(user_days(spark, sf), index="id", column="day", levels=range(1, 31),
                           agg=F.round(F.max("level"), 6))


_lateq = "select segment, case when day <= 4 then 'early' else 'late' end as t, count(*) as n from x where occurred group by 1, 2"


@query("d8_crosstab", with_ctes(_t | {"x": _seg, "n": _lateq, "c": """select segment,
    coalesce(sum(n) filter (where t = 'early'), 0)::bigint as early,
    coalesce(sum(n) filter (where t = 'late'), 0)::bigint as late from n group by 1"""},
    "select *, round(greatest(early, late) / (early + late), 6) as concentration from c"))
def _(spark, sf):
    lab = found(spark, sf).where("occurred").join(table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), "id", "left")
    lab = lab.withColumn("t", F.when(F.col("day") <= 4, "early").otherwise("late"))
    d = profile.crosstab(lab, "segment", "t", ["early", "late"])
    return d.select("segment", "early", "late", r6("concentration"))


@query("d9_quantiles", """select l_returnflag as flag, round(quantile_cont(l_extendedprice, 0.25), 6) as q25,
    round(quantile_cont(l_extendedprice, 0.5), 6) as q50, round(quantile_cont(l_extendedprice, 0.9), 6) as q90
    from lineitem group by 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    q = ordered.exact_quantiles(li, by="flag", value="l_extendedprice", probs=[.25, .5, .9], names=["q25", "q50", "q90"])
    return q.select("flag", r6("q25"), r6("q50"), r6("q90"))


@query("d10_weighted_mean", """select l_returnflag as flag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6)
    as weighted_mean from lineitem group by 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return profile.weighted_mean(li, value="l_discount", weight="l_quantity", by="flag").select("flag", r6("weighted_mean"))


@query("d11_first_last_measured", with_ctes({}, """select id, round(arg_min(purchase, day) filter (where purchase is not null), 6)
    as purchase_first, round(arg_max(purchase, day) filter (where purchase is not null), 6) as purchase_final from ud group by id"""))
def _(spark, sf):
    d = profile.edge_values(user_days(spark, sf), **KEY, columns=["purchase"])
    return d.select("id", r6("purchase_first"), r6("purchase_final"))


@query("d12_constant_by_id", with_ctes({}, """select count(*) as ids, count(*) filter (where n = 1) as constant_ids
    from (select id, count(distinct segment) as n from dy group by id)"""))
def _(spark, sf):
    return profile.constant_by_id(daily(spark, sf), id_col="id", column="segment")


@query("d12_distinct_counts", """select 'o_orderpriority' as variable, count(distinct o_orderpriority) as n_distinct from orders
    union all select 'o_custkey', count(distinct o_custkey) from orders""")
def _(spark, sf):
    return profile.distinct_counts(table(spark, sf, "orders"), ["o_orderpriority", "o_custkey"])


@query("d13_most_frequent", """select c_mktsegment, count(*) as n from customer group by 1 order by n desc, 1 limit 1""")
def _(spark, sf):
    return profile.most_frequent(table(spark, sf, "customer"), "c_mktsegment")


@query("d14_summary_by_group", with_ctes({}, """select segment, round(min(level), 6) as low, round(median(level), 6) as median,
    round(max(level), 6) as high from dy group by 1"""))
def _(spark, sf):
    return profile.summary_by(daily(spark, sf), by="segment", value="level").select(
        "segment", r6("low"), r6("median"), r6("high"))


_hash = lambda *p: "('0x' || substr(md5(" + " || '|' || ".join(p) + "), 1, 8))::bigint"
_fold = """select id, cast((row_number() over (order by md5('0|' || id) || '|' || id) - 1) % 5 as int) as fold
    from (select distinct id from ud)"""


@query("d15_training_profile", with_ctes(grid_sql("ud", "g") | {"f": _fold, "x": """select g.id, day, level, fold,
    lead(level, 2) over (partition by g.id order by day) - level as inc from g join f on f.id = g.id"""},
    """select k::int as fold, day, round(avg(level) filter (where fold <> k), 6) as mean_value,
    round(avg(inc) filter (where fold <> k), 6) as mean_increment from x, generate_series(0, 4) t(k) group by 1, 2"""))
def _(spark, sf):
    g = grid.regularize(user_days(spark, sf), **KEY, value_cols=["level"], on_error="assert")
    folds = resample.fold_of(g, id_col="id").drop("repeat")
    d = profile.training_profile(g.join(folds, "id"), **UD, fold_col="fold", folds=5)
    return d.select("fold", "day", r6("mean_value"), r6("mean_increment"))


@query("d16_rmse_by_series", with_ctes({}, """select id, round(sqrt(avg(power(level - m, 2))), 6) as rmse from
    (select id, level, avg(level) over (partition by day) as m from ud) group by id"""))
def _(spark, sf):
    d = user_days(spark, sf)
    m = d.groupBy("day").agg(F.avg("level").alias("m"))
    d = d.join(m, "day").withColumn("e", F.col("level") - F.col("m"))
    return profile.rmse_by(d, by="id", error="e").select("id", r6("rmse"))


_rank = lambda c, by="": (f"(rank() over ({by} order by {c}) + (count(*) over ({('partition by ' + c) if not by else by + ', ' + c}) - 1) / 2.0)")


@query("d17_spearman_pooled", with_ctes({"d": """select level - lag(level) over w as a, click - lag(click) over w as b
    from ud window w as (partition by id order by day)""", "k": f"""select {_rank('a')} as x, {_rank('b')} as y from d
    where a is not null and b is not null"""}, "select count(*) as pairs, round(corr(x, y), 6) as rho from k"))
def _(spark, sf):
    d = stats.daily_changes(user_days(spark, sf), **KEY, columns=["level", "click"])
    return stats.spearman(d, x="level", y="click").select("pairs", r6("rho"))


@query("d17_spearman_by_group_p")
def _(spark, sf):
    d = daily(spark, sf)
    return stats.spearman(d, x="level", y="exposure", by="segment", p_value=True)


@query("d17_spearman_within", with_ctes({"k": f"""select id, {_rank('exposure', 'partition by id')} as x,
    {_rank('level', 'partition by id')} as y from dy"""}, """select id, count(*) as pairs, round(corr(x, y), 6) as rho
    from k group by id having count(*) >= 4"""))
def _(spark, sf):
    d = stats.spearman_within(daily(spark, sf), id_col="id", x="exposure", y="level")
    return d.select("id", "pairs", r6("rho"))


@query("d18_squared_correlation", """select l_returnflag as flag, count(*) as n,
    round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return stats.squared_correlation(li, x="l_quantity", y="l_extendedprice", by="flag").select("flag", "n", r6("r2"))


@query("d18_least_squares", """with m as (select count(*) as n, var_pop(l_quantity) as aa, var_pop(l_discount) as bb,
    covar_pop(l_quantity, l_discount) as ab, covar_pop(l_quantity, l_extendedprice) as ay,
    covar_pop(l_discount, l_extendedprice) as by_, var_pop(l_extendedprice) as yy, avg(l_quantity) as ma, avg(l_discount) as mb,
    avg(l_extendedprice) as my from lineitem), k as (select *, (bb * ay - ab * by_) / (aa * bb - ab * ab) as ca,
    (aa * by_ - ab * ay) / (aa * bb - ab * ab) as cb from m) select n, round(my - ca * ma - cb * mb, 3) as intercept,
    round(ca, 3) as coef_l_quantity, round(cb, 3) as coef_l_discount, round((ca * ay + cb * by_) / yy, 6) as r2 from k""")
def _(spark, sf):
    d = stats.least_squares(table(spark, sf, "lineitem"), y="l_extendedprice", x=["l_quantity", "l_discount"])
    return d.select("n", *[F.round(c, 3).alias(c) for c in ("intercept", "coef_l_quantity", "coef_l_discount")], r6("r2"))


@query("d19_eta_squared", with_ctes({}, """select count(*) as n, round(sum(power(m - g, 2)) / sum(power(level - g, 2)), 6) as eta2
    from (select level, avg(level) over (partition by segment) as m, avg(level) over () as g from dy where segment is not null)"""))
def _(spark, sf):
    return stats.eta_squared(daily(spark, sf), value="level", group="segment").select("n", r6("eta2"))


@query("d20_rank_sum", with_ctes({"k": f"select segment = 'BUILDING' as s, {_rank('level')} as r from dy where segment is not null"},
    """select count(*) filter (where not s) as n_first, count(*) filter (where s) as n_second, round(sum(r) filter (where s)
    - count(*) filter (where s) * (count(*) filter (where s) + 1) / 2.0, 6) as u from k"""))
def _(spark, sf):
    d = stats.rank_sum_test(daily(spark, sf), value="level", second=F.col("segment") == "BUILDING")
    return d.select("n_first", F.col("n_second").cast("long").alias("n_second"), r6("u"))


@query("d20_rank_sum_p")
def _(spark, sf):
    return stats.rank_sum_test(daily(spark, sf), value="level", second=F.col("setpoint") == 1.0, by="segment")


@query("d21_group_medians", with_ctes({}, " union all ".join(
    f"""select segment, '{k}' as variable, round(median("{k}"), 6) as median from dy where "{k}" is not null group by 1"""
    for k in KINDS)))
def _(spark, sf):
    return profile.median_by(daily(spark, sf), by="segment", columns=COVS).select("segment", "variable", r6("median"))


@query("d22_importance_by_base", with_ctes({"x": " union all ".join(
    f"""select '{k}_{e}' as variable, {a}("{k}") as v from ud""" for k in KINDS for e, a in (("mean", "avg"), ("last", "max")))},
    "select split_part(variable, '_', 1) as variable, round(sum(v), 3) as importance from x group by 1"))
def _(spark, sf):
    names = {f"{k}_{e}": a(k) for k in KINDS for e, a in (("mean", F.avg), ("last", F.max))}
    one = user_days(spark, sf).agg(*[c.alias(n) for n, c in names.items()])
    long = profile.stacked(one, list(names), "name", "v")
    d = profile.importance_by_base(long, name="name", value="v")
    return d.select("variable", F.round("importance", 3).alias("importance"))


@query("d23_hit_rate_interval")
def _(spark, sf):
    return stats.hit_rate_interval(table(spark, sf, "lineitem"), hit=F.col("l_discount") > 0.05, by="l_returnflag")


@query("d24_minimum_below", with_ctes({"m": "select id, min(level) as low from ud group by id"},
    """select count(*) filter (where low < 12) as below, count(low) as ids, round(median(low), 6) as median_low from m"""))
def _(spark, sf):
    d = profile.minimum_below(user_days(spark, sf), id_col="id", value_col="level", level=12)
    return d.select("below", "ids", r6("median_low"))


@query("d24_median_by_day", with_ctes({}, "select day, round(median(level), 6) as median from ud group by day"))
def _(spark, sf):
    return profile.median_by_day(user_days(spark, sf), day_col="day", value_col="level").select("day", r6("median"))


# ---------------------------------------------------------------- windows


@query("e1_regularize", with_ctes(grid_sql("ud", "g"), "select id, day, round(level, 6) as level, last_day from g"))
def _(spark, sf):
    g = grid.regularize(user_days(spark, sf), **KEY, value_cols=["level"], on_error="assert")
    return g.select("id", "day", r6("level"), "last_day")


@query("e1_regularize_months", with_ctes(grid_sql("mo", "g"), "select id, day, round(level, 6) as level, last_day from g"))
def _(spark, sf):
    g = grid.regularize(months(spark, sf), **KEY, value_cols=["level"], on_error="assert")
    return g.select("id", "day", r6("level"), "last_day")


@query("e2_smooth", with_ctes(grid_sql("ud", "g"), """select id, day, round(avg(level) over (partition by id order by day
    rows between 2 preceding and 1 following), 9) as smoothed from g"""))
def _(spark, sf):
    g = grid.regularize(user_days(spark, sf), **KEY, value_cols=["level"], on_error="assert")
    return grid.smooth(g, **UD, window=4).select("id", "day", F.round("smoothed", 9).alias("smoothed"))


@query("e3_falling_runs", with_ctes(grid_sql("ud", "g"), """select id, day, cast(case when not coalesce(lead(level, 1) over w < level, false)
    then 0 when not coalesce(lead(level, 2) over w < lead(level, 1) over w, false) then 1
    when not coalesce(lead(level, 3) over w < lead(level, 2) over w, false) then 2 else 3 end as int) as run from g
    window w as (partition by id order by day)"""))
def _(spark, sf):
    g = grid.regularize(user_days(spark, sf), **KEY, value_cols=["level"], on_error="assert")
    return grid.falling_runs(g, **UD, n=3).select("id", "day", "run")


@query("e4_fill_forward", with_ctes({}, "select id, day, " + ", ".join(f'round("{k}", 6) as "{k}"' for k in KINDS) + " from fl"))
def _(spark, sf):
    return filled(spark, sf).select("id", "day", *[r6(k) for k in KINDS])


@query("e4_fill_both_ways", with_ctes({}, """select id, day, round(coalesce(last_value(purchase ignore nulls) over (partition by id
    order by day rows between unbounded preceding and current row), first_value(purchase ignore nulls) over (partition by id
    order by day rows between current row and unbounded following)), 6) as purchase from ud"""))
def _(spark, sf):
    d = grid.fill_forward(user_days(spark, sf), **KEY, value_cols=["purchase"], then_back=True)
    return d.select("id", "day", r6("purchase"))


@query("e5_steps", with_ctes({}, """select id, day, round(lag(level, 2) over w, 6) as lag, round(lead(level, 2) over w, 6) as lead,
    round(level - lag(level, 2) over w, 6) as diff, round(lead(level, 2) over w - level, 6) as ahead from ud
    window w as (partition by id order by day)"""))
def _(spark, sf):
    d = grid.steps(user_days(spark, sf), **UD, k=2)
    return d.select("id", "day", *[r6(c) for c in ("lag", "lead", "diff", "ahead")])


@query("e6_cumulative_risk", with_ctes({}, """select id, day, round(1 - exp(sum(ln(1 - level / 1000)) over (partition by id
    order by day rows between unbounded preceding and current row)), 6) as cum_risk from ud"""))
def _(spark, sf):
    d = user_days(spark, sf).withColumn("h", F.col("level") / 1000)
    return grid.cumulative_risk(d, **KEY, hazard_col="h").select("id", "day", r6("cum_risk"))


@query("e7_cut_at_decline", with_ctes({"x": """select id, day, case when level < 0.6 * max(level) over (partition by id order by day
    rows between unbounded preceding and current row) then day end as cut from ud"""}, """select id, day,
    coalesce(min(cut) over (partition by id), max(day) over (partition by id)) as end_day from x"""))
def _(spark, sf):
    return grid.cut_at_decline(user_days(spark, sf), **UD, keep=0.6).select("id", "day", "end_day")


@query("e8_running_exposure", with_ctes({"x": """select id, day, coalesce((lag(exposure) over (partition by id order by day)
    + exposure) / 2, 0) as a from dy"""}, """select id, day, round(sum(a) over (partition by id order by day
    rows between unbounded preceding and current row), 6) as cum_exposure from x"""))
def _(spark, sf):
    return grid.running_exposure(daily(spark, sf), **KEY, exposure_col="exposure").select("id", "day", r6("cum_exposure"))


@query("e9_interval_rates", with_ctes(rates_sql("dy", "r", (0.0, 0.02)), """select dilution, id, day, round(smoothed, 6) as smoothed,
    round(rate, 6) as rate from r"""))
def _(spark, sf):
    d = rates.interval_rates(daily(spark, sf), **KEY, level_col="level", exposure_col="exposure",
                             dilutions=[0.0, 0.02], on_error="assert")
    return d.select("dilution", "id", "day", r6("smoothed"), r6("rate"))


@query("e10_max_earlier", with_ctes({}, """select id, day, round(max(level) over (partition by id order by day
    rows between unbounded preceding and 1 preceding), 6) as earlier from ud"""))
def _(spark, sf):
    return user_days(spark, sf).select("id", "day", r6(grid.earlier(F.col("level"), "id", "day"), "earlier"))


@query("e11_first_day_where", with_ctes({}, "select id, min(day) filter (where purchase > 40) as first_day from ud group by id"))
def _(spark, sf):
    return grid.first_day_where(user_days(spark, sf), **KEY, cond=F.col("purchase") > 40)


@query("e12_measured_neighbours", with_ctes({}, """select id, day, round(purchase, 6) as purchase, round(lag(purchase) over w, 6) as before,
    round(lead(purchase) over w, 6) as after from ud where purchase is not null window w as (partition by id order by day)"""))
def _(spark, sf):
    d = grid.measured_neighbours(user_days(spark, sf), **KEY, value_col="purchase")
    return d.select("id", "day", r6("purchase"), r6("before"), r6("after"))


@query("e13_descending_rank", f"""select l_orderkey, l_linenumber, rank() over (order by l_quantity desc)
    + (count(*) over (partition by l_quantity) - 1) / 2.0 as rank from lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return stats.ranked(li, value="l_quantity").select("l_orderkey", "l_linenumber", "rank")


@query("e14_local_argmax", with_ctes(grid_sql("ud", "g"), """select a.id, a.day, arg_max(b.day, struct_pack(v := b.level, d := -b.day))
    as peak_day from g a join g b on b.id = a.id and b.day between a.day - 2 and a.day + 2 group by 1, 2"""))
def _(spark, sf):
    g = grid.regularize(user_days(spark, sf), **KEY, value_cols=["level"], on_error="assert")
    return grid.local_argmax(g, **UD, reach=2).select("id", "day", "peak_day")


@query("e15_deepest_fall", with_ctes({"l": """select a.id, a.day, a.level, min(b.level) as low,
    arg_min(b.day, struct_pack(v := b.level, d := b.day)) as to_day from ud a join ud b on b.id = a.id and b.day >= a.day
    group by 1, 2, 3""", "f": """select id, day, to_day, 1 - low / level as fall from l where level > 0 and 1 - low / level > 0""",
    "b": "select id, max(fall) as fall, arg_max(day, struct_pack(v := fall, d := -day)) as from_day, arg_max(to_day, struct_pack(v := fall, d := -day)) as to_day from f group by id"},
    """select i.id, round(coalesce(fall, 0), 6) as fall, from_day, to_day, last_day from
    (select id, max(day) as last_day from ud group by id) i left join b on b.id = i.id"""))
def _(spark, sf):
    d = grid.deepest_fall(user_days(spark, sf), **UD)
    return d.select("id", r6("fall"), "from_day", "to_day", "last_day")


@query("e16_rebound", with_ctes(_t, """select t.id, coalesce(max(level) filter (where ud.day > t.day)
    > max(level) filter (where ud.day <= t.day), false) as rebound from t join ud on ud.id = t.id where occurred group by 1"""))
def _(spark, sf):
    ev = found(spark, sf).where("occurred").select("id", F.col("day").alias("event_day"))
    return grid.rebound(user_days(spark, sf), ev, **UD, event_col="event_day")


@query("e17_inner_interpolation", with_ctes({k: v for k, v in grid_sql("ud", "g", ("purchase",)).items()}, """select id, day,
    round(case when p_purchase is null or n_purchase is null then null when purchase is not null then purchase
    else (nv_purchase - pv_purchase) / (n_purchase - p_purchase) * (day - p_purchase) + pv_purchase end, 6) as purchase from g_l"""))
def _(spark, sf):
    c = grid.calendar(user_days(spark, sf).select("id", "day", "purchase"), **KEY)
    return grid.interpolate(c, **KEY, value_cols=["purchase"], edges=False).select("id", "day", r6("purchase"))


# ---------------------------------------------------------------- order, samples, sets, scalars


@query("f1_sorted_rows", with_ctes({}, "select id, day, round(level, 6) as level from ud order by id, day"))
def _(spark, sf):
    return user_days(spark, sf).select("id", "day", r6("level")).orderBy("id", "day")


@query("f2_natural_order", with_ctes({}, "select 'C' || id as name from (select distinct id from ud) order by id"))
def _(spark, sf):
    ids = user_days(spark, sf).select(F.concat(F.lit("C"), "id").alias("name")).distinct()
    return profile.natural_order(ids, "name")


@query("f3_top_k", "select p_partkey, p_retailprice from part order by abs(p_retailprice) desc, p_partkey limit 25")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return profile.top_k(p, value=F.abs("p_retailprice"), k=25, tie="p_partkey")


@query("f3_top_k_per_group", """select l_returnflag, l_orderkey, l_linenumber, l_extendedprice from lineitem
    qualify row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey * 100 + l_linenumber) <= 10""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    li = li.withColumn("tie", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return profile.top_k(li, value=F.col("l_extendedprice"), k=10, tie="tie", by="l_returnflag").drop("tie")


@query("f4_typical_examples", with_ctes({"e": """select ud.id, any_value(c_mktsegment) as segment, round(stddev_pop(level), 6) as err
    from ud left join customer on c_custkey = ud.id group by ud.id"""}, """select segment, id, err from e qualify
    row_number() over (partition by segment order by err, id) - 1 = (count(*) over (partition by segment) - 1) // 2"""))
def _(spark, sf):
    d = daily(spark, sf).groupBy("id").agg(F.any_value("segment").alias("segment"), r6(F.stddev_pop("level"), "err"))
    return profile.typical_examples(d, stratum="segment", error="err", id_col="id").select("segment", "id", "err")


@query("f5_sample_per_stratum", with_ctes({}, f"""select c_mktsegment as segment, c_custkey as id from customer qualify row_number()
    over (partition by c_mktsegment order by {_hash("'0'", "c_custkey")}, c_custkey) <= 6"""))
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"))
    return profile.sample_per_stratum(c, stratum="segment", id_col="id", k=6)


@query("g1_row_union", with_ctes({}, """select id, day, round(level, 6) as level from ud union all by name
    select id, day, round(level, 6) as level from mo"""))
def _(spark, sf):
    return (user_days(spark, sf).select("id", "day", r6("level"))
            .unionByName(months(spark, sf).select("id", "day", r6("level"))))


_imp = """select segment, variable, v from (""" + " union all ".join(
    f"""select segment, '{k}' as variable, round(stddev_pop("{k}"), 6) as v from dy where segment is not null group by 1"""
    for k in (*KINDS, "level", "exposure")) + ")"


def _importance(spark, sf):
    names = [*KINDS, "level", "exposure"]
    one = daily(spark, sf).where("segment is not null").groupBy("segment").agg(
        *[r6(F.stddev_pop(k), k) for k in names])
    return profile.stacked(one, names, "variable", "v")


@query("g3_top_overlap", with_ctes({"i": _imp, "k": """select * from i qualify row_number() over
    (partition by segment order by v desc, variable) <= 5"""}, """select round(avg(n), 6) as mean_overlap from (select a.segment,
    b.segment as other, (select count(*) from k x join k y on x.variable = y.variable and x.segment = a.segment and y.segment = b.segment) as n
    from (select distinct segment from k) a join (select distinct segment from k) b on a.segment < b.segment)"""))
def _(spark, sf):
    return compare.top_overlap(_importance(spark, sf), fold="segment", name="variable", value="v").select(r6("mean_overlap"))


@query("g3_rank_stability", with_ctes({"i": _imp, "k": f"""select variable, rank() over (partition by segment order by v desc)
    + (count(*) over (partition by segment, v) - 1) / 2.0 as r from i"""}, """select variable, round(stddev_samp(r), 6) as rank_sd,
    round(avg(r), 6) as mean_rank from k group by 1"""))
def _(spark, sf):
    return compare.rank_stability(_importance(spark, sf), fold="segment", name="variable", value="v").select(
        "variable", r6("rank_sd"), r6("mean_rank"))


@query("g4_label_agreement", with_ctes(_t | detect_sql("ud", "u", width=5), """select t.id, t.occurred as occurred_a, t.day as day_a,
    u.occurred as occurred_b, u.day as day_b, t.occurred <> u.occurred as class_change, t.day - u.day as day_difference
    from t join u on u.id = t.id"""))
def _(spark, sf):
    return compare.compare_labels(found(spark, sf), found(spark, sf, smooth_window=5), id_col="id")


@query("g4_agreement_summary", with_ctes(_t | detect_sql("ud", "u", refine=False), """select count(*) as ids,
    count(*) filter (where t.occurred) as events_a, count(*) filter (where u.occurred) as events_b,
    count(*) filter (where t.occurred <> u.occurred) as class_changes, count(*) filter (where t.day = u.day) as same_day,
    count(*) filter (where abs(t.day - u.day) >= 2) as two_days_or_more, max(abs(t.day - u.day)) as max_gap
    from t join u on u.id = t.id"""))
def _(spark, sf):
    return compare.comparison_summary(compare.compare_labels(found(spark, sf), found(spark, sf, refine_peak=False), id_col="id"))


@query("g4_refinement_shift", with_ctes(_t | detect_sql("ud", "u", refine=False), """select t.day - u.day as day_difference, count(*) as ids
    from t join u on u.id = t.id where t.occurred and u.occurred group by 1"""))
def _(spark, sf):
    return compare.difference_counts(compare.compare_labels(found(spark, sf), found(spark, sf, refine_peak=False), id_col="id"))


@query("h1_text_parts", """select s_suppkey, regexp_extract(s_name, '#0*(\\d+)$', 1) as number,
    split_part(s_name, '#', 1) as kind, lower(trim(replace(s_name, '#', ' '))) as plain from supplier""")
def _(spark, sf):
    n = F.col("s_name")
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.regexp_extract(n, r"#0*(\d+)$", 1).alias("number"), F.split(n, "#")[0].alias("kind"),
        F.lower(F.trim(F.replace(n, F.lit("#"), F.lit(" ")))).alias("plain"))


@query("h3_lenient_number", """select o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) as double) as level,
    try_cast(o_orderstatus as double) as status from orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", fx.lenient_number(F.split("o_orderpriority", "-")[0]).alias("level"),
                    fx.lenient_number(F.col("o_orderstatus")).alias("status"))


@query("h4_rounding", """select l_orderkey, l_linenumber, round_even(l_quantity / 4, 0) as even, round(l_extendedprice / 1000, 5) as key
    from lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fx.half_even(F.col("l_quantity") / 4).alias("even"),
                                               F.round(F.col("l_extendedprice") / 1000, 5).alias("key"))


@query("h5_math", """select c_custkey, round(exp(c_acctbal / 10000), 6) as e, round(ln(abs(c_acctbal) + 1), 6) as l,
    cast(sign(c_acctbal) as double) as s, round(sqrt(abs(c_acctbal)), 6) as r, greatest(c_acctbal, 0) as c from customer""")
def _(spark, sf):
    a = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", r6(F.exp(a / 10000), "e"), r6(F.ln(F.abs(a) + 1), "l"),
                                               F.signum(a).alias("s"), r6(F.sqrt(F.abs(a)), "r"), fx.not_below_zero(a).alias("c"))


@query("h6_safe_ratio", """select l_orderkey, l_linenumber, round(case when abs(l_tax) > 1e-12 then l_discount / l_tax end, 6) as ratio,
    round(case when l_discount <> 0 then l_tax / l_discount end, 6) as back from lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(fx.safe_ratio(F.col("l_discount"), F.col("l_tax")), "ratio"),
        r6(fx.ratio_or_null(F.col("l_tax"), F.col("l_discount")), "back"))


@query("h7_missing_to_zero", with_ctes({}, "select id, day, round(coalesce(purchase, 0), 6) as purchase, cast(coalesce(purchase > 50, false) as int) as high from ud"))
def _(spark, sf):
    return user_days(spark, sf).select("id", "day", r6(fx.zero_if_null(F.col("purchase")), "purchase"),
                                       fx.flag(F.col("purchase") > 50).alias("high"))


@query("h8_saturable", with_ctes({}, """select id, day, round(greatest(level - 20, 0) / (30 + greatest(level - 20, 0)), 6) as saturated,
    round(greatest(level, 0), 6) as linear from ud"""))
def _(spark, sf):
    x = F.col("level")
    return user_days(spark, sf).select("id", "day", r6(fx.saturable(x, F.lit(30.0), F.lit(20.0)), "saturated"),
                                       r6(fx.saturable(x, F.lit(None).cast("double"), F.lit(0.0)), "linear"))


@query("h9_interval_distance", with_ctes(_t, """select id, case when day between 4 and 6 then 0.0::double
    else least(abs(day - 4), abs(day - 6)) end as distance from t where occurred"""))
def _(spark, sf):
    return found(spark, sf).where("occurred").select("id", fx.interval_distance(F.col("day"), F.lit(4.0), F.lit(6.0)).alias("distance"))
