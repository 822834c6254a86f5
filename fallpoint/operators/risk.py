"""At-risk person-period rows, modelling windows and design rows of the panel models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallpoint.contracts import as_list, by_day, clean, whole
from fallpoint.functions.columns import flag, not_below_zero, saturable, zero_if_null
from fallpoint.operators import grid
from fallpoint.operators.features import first_measured
from fallpoint.operators.ordered import exact_quantiles
from fallpoint.operators.quality import day_indicators

DAY_FLAGS = [*(f"d{k}" for k in range(3, 12)), "d12p"]
SCHEDULE = ["setpoint", "low_today", "drops_tomorrow"]


def person_period(data: DataFrame, labels: DataFrame, *, id_col, day_col: str,
                  measures: Sequence[str], exposure_col: str, setpoint_col: str,
                  group_col: str, lead: int = 1, blind: bool = False) -> DataFrame:
    """One row per series and day at risk, from day 2 to the event or the last day.

    Measures and setpoint are carried forward only.  ``lead=2`` shows what was known a day
    earlier, except the schedule, which is planned: a drop tomorrow or the day after.
    ``blind`` ignores the events and keeps every day, for scoring.  ``labels`` needs
    ``event, day, time, last_day, excluded``; excluded or unlabelled series are left out.
    """
    ids, measures = as_list(id_col), list(measures)
    need = list(dict.fromkeys([*measures, exposure_col, setpoint_col]))
    rows = clean(data.select(*ids, day_col, *need, group_col), id_col=ids, value_cols=need)
    last = F.when(F.col("event") & ~F.lit(blind), F.col("day")).otherwise(
        F.col("last_day") if blind else F.col("time"))
    lab = (labels.where(~F.col("excluded"))
           .select(*ids, last.cast("int").alias("_end"),
                   (F.col("event") & ~F.lit(blind)).alias("_event")))
    rows = rows.withColumn(group_col, first_measured(F.col(group_col), F.col(day_col)).over(whole(ids)))
    rows = rows.join(lab, ids)
    rows = grid.calendar(rows, id_col=ids, day_col=day_col)
    rows = grid.fill_forward(rows, id_col=ids, day_col=day_col, value_cols=need)
    w = by_day(ids, day_col)
    for c in (group_col, "_end", "_event"):
        rows = rows.withColumn(c, F.max(c).over(whole(ids)))
    temp = F.col(setpoint_col)
    now, nxt = F.lag(temp).over(w), F.lead(temp).over(w)
    drop = f"d_{exposure_col}"
    rows = rows.withColumns({drop: F.col(exposure_col) - F.lag(exposure_col).over(w),
                             "setpoint": temp, "low_today": flag(temp < now),
                             "drops_tomorrow": flag(nxt < temp)})
    if lead == 2:
        soon = F.greatest(F.col("low_today"), F.col("drops_tomorrow"))
        known = [*measures, drop, "setpoint", "low_today"]
        rows = rows.withColumns({"drops_tomorrow": soon,
                                 **{c: F.lag(c).over(w) for c in dict.fromkeys(known)}})
    day = F.col(day_col)
    rows = rows.where(day.between(2, F.col("_end")))
    rows = rows.withColumns({**day_indicators(day),
                             "y": flag(F.col("_event") & (day == F.col("_end")))})
    return rows.select(*ids, day_col, group_col, *dict.fromkeys([*measures, drop, *SCHEDULE]),
                       *DAY_FLAGS, "y")


def modelling_window(data: DataFrame, labels: DataFrame, *, id_col, day_col: str, level_col: str,
                     exposure_col: str, covariates: Sequence[str], keep: float | None = 0.85,
                     min_rows: int = 5) -> DataFrame:
    """Daily level and exposure with yesterday's covariates, cut where the exposure declines.

    Only rows with both measures count; gaps are interpolated.  Covariates are carried
    forward, then backward for the head; the first day uses its own value.  Ends on the
    first day the exposure is below ``keep`` of its running maximum (never, if None).
    Adds ``event_day`` and ``state`` (1 from the event day on).
    """
    ids, cov = as_list(id_col), list(covariates)
    rows = clean(data.select(*ids, day_col, level_col, exposure_col, *cov), id_col=ids,
                 value_cols=[level_col, exposure_col, *cov])
    both = F.col(level_col).isNotNull() & F.col(exposure_col).isNotNull()
    rows = rows.withColumns({"_n": F.count_if(both).over(whole(ids)),
                             "_to": F.max(F.when(both, F.col(day_col))).over(whole(ids)),
                             level_col: F.when(both, F.col(level_col)),
                             exposure_col: F.when(both, F.col(exposure_col))})
    lab = labels.where(~F.col("excluded")).select(
        *ids, F.when(F.col("event"), F.col("day")).alias("event_day"), F.lit(True).alias("_in"))
    rows = rows.where(F.col("_n") >= min_rows).join(lab, ids)
    rows = grid.calendar(rows, id_col=ids, day_col=day_col, until=F.col("_to"))
    rows = rows.withColumn("event_day", F.max("event_day").over(whole(ids)))
    rows = grid.interpolate(rows, id_col=ids, day_col=day_col, value_cols=[level_col, exposure_col])
    if cov:
        rows = grid.fill_forward(rows, id_col=ids, day_col=day_col, value_cols=cov, then_back=True)
        w = by_day(ids, day_col)
        rows = rows.withColumns({f"{c}_prev": F.coalesce(F.lag(c).over(w), F.col(c)) for c in cov})
    rows = grid.cut_at_decline(rows, id_col=ids, day_col=day_col, value_col=exposure_col, keep=keep)
    state = F.coalesce((F.col(day_col) >= F.col("event_day")).cast("double"), F.lit(0.0))
    return (rows.where(F.col(day_col) <= F.col("end_day")).withColumn("state", state)
            .select(*ids, day_col, level_col, exposure_col, *[f"{c}_prev" for c in cov],
                    "event_day", "end_day", "state"))


def observed_state(day: Column, event: Column, event_day: Column) -> Column:
    """1 from the event day on, 0 before it and for censored series."""
    return F.coalesce((event & (day >= event_day)).cast("double"), F.lit(0.0))


def design_rows(window: DataFrame, *, id_col, day_col: str, level_col: str, exposure_col: str,
                covariates: Sequence[str] = (), state: str | None = None, dilution: float = 0.0,
                inhibitor: str | None = None, half: Column | None = None, floor: Column | None = None,
                signed_growth: bool = False) -> DataFrame:
    """Regression columns of every one-day interval: ``a0..`` and the response ``dy``.

    a0 growth of the exposure, a1 exposure area, a2 minus level times area, then growth
    times each standardised covariate column, then minus growth times the inhibitor.  With
    a ``state`` column the producing terms are weighted by 1 - F and the consuming one by
    F.  ``half``/``floor`` replace the level in a2 by the saturable form.  ``inhibitor`` is
    ``level``, ``day`` (tenths) or ``exposure`` (running area).
    """
    ids = as_list(id_col)
    w = by_day(ids, day_col)
    rows = window
    if inhibitor == "exposure":
        rows = grid.running_exposure(rows, id_col=ids, day_col=day_col, exposure_col=exposure_col, out="_z")
    elif inhibitor == "day":
        rows = rows.withColumn("_z", F.col(day_col) / 10.0)
    elif inhibitor == "level":
        rows = rows.withColumn("_z", F.col(level_col))
    rows = rows.withColumns({"_l1": F.lead(level_col).over(w), "_x1": F.lead(exposure_col).over(w)})
    level, x = F.col(level_col), F.col(exposure_col)
    growth = F.col("_x1") - x
    grow = growth if signed_growth else not_below_zero(growth)
    area = (x + F.col("_x1")) / 2
    make = F.lit(1.0) if state is None else 1 - F.col(state)
    use = F.lit(1.0) if state is None else F.col(state)
    eaten = level if floor is None and half is None else saturable(level, half, floor)
    cols = [make * grow, make * area, -use * eaten * area]
    cols += [make * grow * zero_if_null(F.col(c)) for c in covariates]
    if inhibitor:
        cols.append(-make * grow * F.col("_z"))
    rows = rows.where(F.col("_l1").isNotNull())
    return (rows.withColumns({f"a{i}": c for i, c in enumerate(cols)})
            .withColumn("dy", F.col("_l1") - level + dilution * level)
            .drop("_l1", "_x1", "_z"))


def trajectory_matrix(data: DataFrame, *, id_col, day_col: str, variables: Sequence[str],
                      days: Sequence[int] = range(1, 10), fill: bool = True) -> DataFrame:
    """One row per series with ``<variable>_d<day>``: inner gaps interpolated, the rest
    replaced by the column median over series."""
    ids, variables, days = as_list(id_col), list(variables), list(days)
    rows = clean(data.select(*ids, day_col, *variables), id_col=ids, value_cols=variables)
    rows = grid.calendar(rows, id_col=ids, day_col=day_col)
    rows = grid.interpolate(rows, id_col=ids, day_col=day_col, value_cols=variables, edges=False)
    names = [f"{v}_d{d}" for v in variables for d in days]
    wide = rows.groupBy(*ids).agg(*[F.max(F.when(F.col(day_col) == d, F.col(v))).alias(f"{v}_d{d}")
                                    for v in variables for d in days])
    if not fill:
        return wide
    long = wide.select(*names).unpivot([], names, "variable", "value")
    mid = exact_quantiles(long, by="variable", value="value", probs=[0.5], names=["median"])
    lookup = mid.agg(F.map_from_entries(F.collect_list(F.struct("variable", "median")))).scalar()
    wide = wide.withColumn("_mid", lookup)
    return wide.select(*ids, *[F.coalesce(F.col(n), F.col("_mid")[n]).alias(n) for n in names])


def low_level_event(rows: DataFrame, *, value_col: str, threshold: Column, out: str = "low_level") -> DataFrame:
    """0/1: value at or below a threshold; missing counts as not seen low."""
    return rows.withColumn(out, flag(F.col(value_col) <= threshold))
