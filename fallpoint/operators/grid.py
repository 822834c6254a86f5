"""Calendar and window operators along the days of a series.

Everything is partitioned by the id columns only, so consecutive operators reuse one
hash exchange.  Windows that look ahead without limit run as running windows in
descending day order, which keeps them linear in the length of the series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallpoint.contracts import (PROBLEMS, as_list, by_day, clean, day_problem, finite, has_ids,
                                 require_sound, whole)


def backwards(id_col, day_col: str):
    return Window.partitionBy(*as_list(id_col)).orderBy(F.col(day_col).desc())


def up_to_now(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before_now(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _checked(data: DataFrame, ids: list[str], day_col: str, measured: Column,
             on_error: str) -> DataFrame:
    """Add ``_m``, true on measured rows; an unsound day fails there, naming its series.

    The check rides on ``_m`` so that an integer day column, and with it the sort order
    of the first window, passes through untouched.
    """
    if on_error == "raise":
        require_sound(data, id_col=ids, day_col=day_col)
    if on_error == "assert":
        w = by_day(ids, day_col)
        code = day_problem(F.col(day_col), F.lag(finite(day_col)).over(w) == finite(day_col))
        text = F.create_map(*[F.lit(x) for kv in PROBLEMS.items() for x in kv])
        name = F.concat_ws(", ", *[F.col(c).cast("string") for c in ids])
        boom = F.raise_error(F.concat(F.lit("series "), name, F.lit(": "), text[F.col("_problem")]))
        data = data.withColumn("_problem", code)
        measured = (F.when(F.col("_problem").isNotNull(), boom.cast("boolean"))
                    .otherwise(measured))
    data = data.withColumn("_m", measured)
    if dict(data.dtypes)[day_col] != "int":
        data = data.withColumn(day_col, F.col(day_col).cast("int"))
    return data


def regularize(data: DataFrame, *, id_col, day_col: str, value_cols: Sequence[str],
               interpolate: bool = True, on_error: str = "assert") -> DataFrame:
    """Daily grid 1..last day per series, gaps filled by straight lines.

    Rows count as measured when every value column is present.  Before the first
    measured day its value is used, after the last one the last value.  Each measured
    row spells out the days up to the next one, so there is no join and no second
    shuffle.  Returns ids, day, values and ``last_day``; a series with no measured row
    keeps its grid with NULL values.  ``on_error``: ``assert`` fails inside the plan,
    ``raise`` checks first and names the first bad series, ``trust`` skips the check.
    """
    ids, values = as_list(id_col), list(value_cols)
    base = clean(data.select(*ids, day_col, *values), id_col=ids, value_cols=values)
    w, every = by_day(ids, day_col), whole(ids)
    measured = F.lit(True)
    for c in values:
        measured = measured & F.col(c).isNotNull()
    base = _checked(base, ids, day_col, measured, on_error)
    rows = (base
            .withColumns({"last_day": F.max(day_col).over(every),
                          "_n": F.count(F.when(F.col("_m"), 1)).over(every),
                          "_i": F.row_number().over(w)})
            .where(F.col("_m") | ((F.col("_n") == 0) & (F.col("_i") == 1))))
    rows = rows.withColumns({"_next": F.lead(day_col).over(w), "_i": F.row_number().over(w),
                             **{f"_next_{c}": F.lead(c).over(w) for c in values}})
    start = F.when(F.col("_i") == 1, F.lit(1)).otherwise(F.col(day_col))
    stop = F.when(F.col("_next").isNull(), F.col("last_day")).otherwise(F.col("_next") - 1)
    rows = rows.withColumn("_day", F.explode(F.sequence(start, stop)))

    def value(c: str) -> Column:
        if not interpolate:
            return F.when(F.col("_day") == F.col(day_col), F.col(c))
        slope = (F.col(f"_next_{c}") - F.col(c)) / (F.col("_next") - F.col(day_col))
        inside = slope * (F.col("_day") - F.col(day_col)) + F.col(c)
        return (F.when((F.col("_day") <= F.col(day_col)) | F.col("_next").isNull(), F.col(c))
                .otherwise(inside))

    return rows.select(*ids, F.col("_day").alias(day_col), *[value(c).alias(c) for c in values],
                       "last_day")


def calendar(data: DataFrame, *, id_col, day_col: str, until: Column | None = None) -> DataFrame:
    """Every day 1..last day (or ``until``) per series; unmeasured days carry NULLs.

    Columns other than the ids and the day are kept on measured days.
    """
    ids = as_list(id_col)
    w, every = by_day(ids, day_col), whole(ids)
    rest = [c for c in data.columns if c not in ids + [day_col]]
    rows = data.where(has_ids(ids)).withColumns({
        "_next": F.lead(day_col).over(w), "_i": F.row_number().over(w),
        "_last": F.max(day_col).over(every) if until is None else until})
    start = F.when(F.col("_i") == 1, F.lit(1)).otherwise(F.col(day_col))
    stop = F.when(F.col("_next").isNull(), F.col("_last")).otherwise(F.col("_next") - 1)
    stop = F.least(stop, F.col("_last"))
    days = F.when(stop >= start, F.sequence(start.cast("int"), stop.cast("int")))
    rows = rows.withColumn("_day", F.explode(days))
    here = F.col("_day") == F.col(day_col)
    return rows.select(*ids, F.col("_day").alias(day_col),
                       *[F.when(here, F.col(c)).alias(c) for c in rest])


def interpolate(data: DataFrame, *, id_col, day_col: str, value_cols: Sequence[str],
                edges: bool = True) -> DataFrame:
    """Fill each column on its own by straight lines between its measured days.

    ``edges=False`` leaves days outside the measured range NULL.
    """
    ids = as_list(id_col)
    fwd, back = up_to_now(by_day(ids, day_col)), up_to_now(backwards(ids, day_col))
    point = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(day_col).alias("d"), F.col(c).alias("v")))
             for c in value_cols}
    out = data.withColumns({f"_p_{c}": F.last(point[c], True).over(fwd) for c in value_cols})
    out = out.withColumns({f"_q_{c}": F.last(point[c], True).over(back) for c in value_cols})

    def value(c: str) -> Column:
        p, q = F.col(f"_p_{c}"), F.col(f"_q_{c}")
        slope = (q["v"] - p["v"]) / (q["d"] - p["d"])
        mid = slope * (F.col(day_col) - p["d"]) + p["v"]
        outside = F.coalesce(p["v"], q["v"]) if edges else F.lit(None).cast("double")
        return (F.when(F.col(c).isNotNull(), F.col(c))
                .when(p.isNull() | q.isNull(), outside).otherwise(mid))

    out = out.withColumns({f"_f_{c}": value(c) for c in value_cols})
    return out.select(*[F.col(f"_f_{c}").alias(c) if c in value_cols else F.col(c)
                        for c in data.columns])


def smooth(data: DataFrame, *, id_col, day_col: str, value_col: str, window: int = 3,
           out: str = "smoothed") -> DataFrame:
    """Centred moving mean over rows, narrower at the ends, NULLs skipped."""
    return data.withColumn(out, smoothed(F.col(value_col), by_day(id_col, day_col), window))


def smoothed(value: Column, w, window: int) -> Column:
    if window <= 1:
        return value
    return F.avg(value).over(w.rowsBetween(-(window // 2), (window - 1) // 2))


def falling_runs(data: DataFrame, *, id_col, day_col: str, value_col: str, n: int,
                 out: str = "run") -> DataFrame:
    """Length of the unbroken run of falling steps that starts here, capped at n."""
    w = by_day(id_col, day_col)
    step = F.coalesce((F.lead(value_col).over(w) < F.col(value_col)).cast("int"), F.lit(0))
    data = data.withColumn("_step", step)
    runs = [F.when(F.sum("_step").over(w.rowsBetween(0, k - 1)) == k, 1).otherwise(0)
            for k in range(1, n + 1)]
    total = runs[0]
    for r in runs[1:]:
        total = total + r
    return data.withColumn(out, total).drop("_step")


def fill_forward(data: DataFrame, *, id_col, day_col: str, value_cols: Sequence[str],
                 then_back: bool = False) -> DataFrame:
    """Carry the last measured value forward; optionally fill the head from the future."""
    fwd = up_to_now(by_day(id_col, day_col))
    out = data.withColumns({c: F.last(c, True).over(fwd) for c in value_cols})
    if then_back:
        back = up_to_now(backwards(id_col, day_col))
        out = out.withColumns({c: F.coalesce(F.col(c), F.last(c, True).over(back))
                               for c in value_cols})
    return out


def steps(data: DataFrame, *, id_col, day_col: str, value_col: str, k: int = 1) -> DataFrame:
    """``lag``, ``lead``, backward ``diff`` and ``ahead`` (value k steps on minus now)."""
    w, c = by_day(id_col, day_col), F.col(value_col)
    return data.withColumns({"lag": F.lag(c, k).over(w), "lead": F.lead(c, k).over(w),
                             "diff": c - F.lag(c, k).over(w), "ahead": F.lead(c, k).over(w) - c})


def cumulative_risk(data: DataFrame, *, id_col, day_col: str, hazard_col: str,
                    out: str = "cum_risk") -> DataFrame:
    """Probability that the event has happened by each day: 1 - prod(1 - h)."""
    w = up_to_now(by_day(id_col, day_col))
    return data.withColumn(out, 1 - F.product(1 - F.col(hazard_col)).over(w))


def cut_at_decline(data: DataFrame, *, id_col, day_col: str, value_col: str,
                   keep: float | None, out: str = "end_day") -> DataFrame:
    """``end_day``: first day the value is below ``keep`` times its running maximum."""
    w, every = up_to_now(by_day(id_col, day_col)), whole(id_col)
    last = F.max(day_col).over(every)
    if keep is None:
        return data.withColumn(out, last)
    out_df = data.withColumn("_cut", F.when(F.col(value_col) < keep * F.max(value_col).over(w),
                                            F.col(day_col)))
    return out_df.withColumn(out, F.coalesce(F.min("_cut").over(every), last)).drop("_cut")


def running_exposure(data: DataFrame, *, id_col, day_col: str, exposure_col: str,
                     out: str = "cum_exposure") -> DataFrame:
    """Trapezoid area under the exposure up to each day; 0 on the first."""
    w = by_day(id_col, day_col)
    area = (F.lag(exposure_col).over(w) + F.col(exposure_col)) / 2
    return (data.withColumn("_area", F.coalesce(area, F.lit(0.0)))
            .withColumn(out, F.sum("_area").over(up_to_now(w))).drop("_area"))


def earlier(value: Column, id_col, day_col: str) -> Column:
    """Largest value on strictly earlier rows of the series."""
    return F.max(value).over(before_now(by_day(id_col, day_col)))


def first_day_where(data: DataFrame, *, id_col, day_col: str, cond: Column,
                    out: str = "first_day") -> DataFrame:
    """First day meeting a condition, one row per id (NULL when never met)."""
    return data.groupBy(*as_list(id_col)).agg(F.min(F.when(cond, F.col(day_col))).alias(out))


def measured_neighbours(data: DataFrame, *, id_col, day_col: str, value_col: str) -> DataFrame:
    """Measured rows with the previous and next measured value of the series."""
    w = by_day(id_col, day_col)
    return (data.where(finite(value_col).isNotNull())
            .withColumns({"before": F.lag(value_col).over(w), "after": F.lead(value_col).over(w)}))


def local_argmax(data: DataFrame, *, id_col, day_col: str, value_col: str, reach: int,
                 out: str = "peak_day") -> DataFrame:
    """Day of the largest value within ``reach`` rows either side, earliest on ties."""
    w = by_day(id_col, day_col).rowsBetween(-reach, reach)
    best = F.max(F.when(F.col(value_col).isNotNull(),
                        F.struct(F.col(value_col).alias("v"), (-F.col(day_col)).alias("d")))).over(w)
    return data.withColumn(out, -best["d"])


def deepest_fall(data: DataFrame, *, id_col, day_col: str, value_col: str) -> DataFrame:
    """Largest relative fall from any positive point to a later minimum, per series.

    Earliest start on ties, first later minimum; no fall at all gives 0 and NULL days.
    """
    ids = as_list(id_col)
    back = up_to_now(backwards(ids, day_col))
    low = F.min(F.struct(F.col(value_col).alias("v"), F.col(day_col).alias("d"))).over(back)
    rows = data.where(F.col(value_col).isNotNull()).withColumn("_low", low)
    fall = F.when(F.col(value_col) > 0, 1 - F.col("_low")["v"] / F.col(value_col))
    rows = rows.withColumn("_fall", F.when(fall > 0, fall))
    best = F.max(F.when(F.col("_fall").isNotNull(),
                        F.struct(F.col("_fall").alias("f"), (-F.col(day_col)).alias("d"),
                                 F.col("_low")["d"].alias("to"))))
    return (rows.groupBy(*ids).agg(best.alias("_b"), F.max(day_col).alias("last_day"))
            .select(*ids, F.coalesce(F.col("_b")["f"], F.lit(0.0)).alias("fall"),
                    (-F.col("_b")["d"]).alias("from_day"), F.col("_b")["to"].alias("to_day"),
                    "last_day"))


def rebound(data: DataFrame, events: DataFrame, *, id_col, day_col: str, value_col: str,
            event_col: str, out: str = "rebound") -> DataFrame:
    """Does any value after the event day exceed the maximum up to it?  One row per event id."""
    ids = as_list(id_col)
    after = F.max(F.when(F.col(day_col) > F.col(event_col), F.col(value_col)))
    upto = F.max(F.when(F.col(day_col) <= F.col(event_col), F.col(value_col)))
    return (data.join(events.where(F.col(event_col).isNotNull()).select(*ids, event_col), ids)
            .groupBy(*ids).agg(F.coalesce(after > upto, F.lit(False)).alias(out)))
