"""Per-exposure rates, the event defined on them, and what happens after it.

q = (change + dilution * mean level) / trapezoid of the exposure, per one-day interval.
Dilutions are attached to the rows as data, so every sensitivity runs in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallpoint.contracts import as_list, by_day
from fallpoint.lineage import cut
from fallpoint.operators import grid
from fallpoint.operators.detect import first_deep_fall, gather_paths, peak_near
from fallpoint.operators.quality import drop_incomplete

# The published rule of the rate label.
MIN_FALL = 0.15      # fall below the smoothed point that the rate label requires
SMOOTH = 3


def interval_rates(data: DataFrame, *, id_col, day_col: str, level_col: str, exposure_col: str,
                   dilutions: Sequence[float] = (0.0,), min_rows: int = 4,
                   smooth_window: int = SMOOTH, on_error: str = "assert") -> DataFrame:
    """Daily grid with raw and smoothed level and the rate of the interval that starts here.

    Rows lacking either measure are dropped first; series left with fewer than
    ``min_rows`` disappear.  Keyed by (dilution, id, day); the last day has no interval.
    """
    ids = as_list(id_col)
    rows = drop_incomplete(data.select(*ids, day_col, level_col, exposure_col), id_col=ids,
                           need=[level_col, exposure_col], min_rows=min_rows)
    rows = grid.regularize(rows, id_col=ids, day_col=day_col, value_cols=[level_col, exposure_col],
                           on_error=on_error)
    w = by_day(ids, day_col)
    rows = rows.withColumn("smoothed", grid.smoothed(F.col(level_col), w, smooth_window))
    rows = rows.withColumns({"_s1": F.lead("smoothed").over(w), "_x1": F.lead(exposure_col).over(w)})
    rows = rows.withColumn("dilution", F.explode(F.array(*[F.lit(float(d)) for d in dilutions])))
    area = (F.col(exposure_col) + F.col("_x1")) / 2
    mean = (F.col("smoothed") + F.col("_s1")) / 2
    q = ((F.col("_s1") - F.col("smoothed")) + F.col("dilution") * mean) / area
    return rows.withColumn("rate", F.when(area > 0, q)).select(
        "dilution", *ids, day_col, level_col, exposure_col, "smoothed", "rate", "last_day")


def _starts(rates: DataFrame, ids: list[str], day_col: str, n: int, magnitude: float) -> DataFrame:
    """Add ``_cand``: n falling-rate intervals start here after some positive rate."""
    w = Window.partitionBy(*ids, "dilution").orderBy(day_col)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = w.rowsBetween(0, n - 1)
    best = F.max("rate").over(past)
    small = F.coalesce((F.col("rate") < 0) & (F.abs("rate") >= magnitude * F.col("_best")), F.lit(False))
    rows = rates.withColumn("_best", best)
    rows = rows.withColumn("_neg", small.cast("int"))
    return rows.withColumn("_cand", (F.sum("_neg").over(ahead) == n) & F.coalesce(F.col("_best") > 0, F.lit(False)))


def rate_event(rates: DataFrame, *, id_col, day_col: str, n_consecutive: int = 2,
               magnitude: float = 0.0) -> DataFrame:
    """First interval with n negative rates after any positive one: (dilution, id, rate_day).

    With a magnitude, every rate of the run must reach that share of the largest earlier rate.
    """
    ids = as_list(id_col)
    if magnitude == 0.0:
        rows = _starts(rates, ids, day_col, n_consecutive, 0.0)
        return rows.groupBy("dilution", *ids).agg(F.min(F.when(F.col("_cand"), F.col(day_col))).alias("rate_day"))
    w = Window.partitionBy(*ids, "dilution").orderBy(day_col)
    ref = F.max("rate").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ok = F.lit(True)
    for k in range(n_consecutive):
        q = F.col("rate") if k == 0 else F.col(f"_q{k}")
        ok = ok & (q < 0) & (F.abs(q) >= magnitude * F.col("_ref"))
    rows = rates.withColumns({"_ref": ref, **{f"_q{k}": F.lead("rate", k).over(w)
                                              for k in range(1, n_consecutive)}})
    hit = F.coalesce((F.col("_ref") > 0) & ok, F.lit(False))
    return rows.groupBy("dilution", *ids).agg(F.min(F.when(hit, F.col(day_col))).alias("rate_day"))


def rate_labels(rates: DataFrame, *, id_col, day_col: str, level_col: str, n_consecutive: int = 2,
                min_fall: float = MIN_FALL) -> DataFrame:
    """Final label: negative rates followed by a real fall, placed on the raw maximum nearby.

    The smoothed level must fall by ``min_fall`` before it exceeds the starting point; the
    day is the raw maximum within one day.  One row per (dilution, id) with ``day``.
    """
    ids = as_list(id_col)
    rows = _starts(rates, ids, day_col, n_consecutive, 0.0)
    paths = gather_paths(rows, id_col=["dilution", *ids], order=day_col,
                         fields={"day": F.col(day_col).cast("double"), "v": F.col(level_col),
                                 "s": F.col("smoothed"), "cand": F.col("_cand")})
    out = paths.withColumn("_f", first_deep_fall("path", "x.cand", f"{float(min_fall)!r}D"))
    day = F.when(F.col("_f").isNotNull(), peak_near("path", "_f.pos", 1))
    return out.select("dilution", *ids, day.alias("day"))


def label_table(data: DataFrame, *, id_col, day_col: str, level_col: str, exposure_col: str,
                dilutions: Sequence[float] = (0.0, 0.02, 0.05), window: int = 4,
                min_level: float = 0.03, min_rows: int = 4, on_error: str = "assert") -> DataFrame:
    """One row per series: event day under each dilution, event, time and exclusion flags.

    The event is the one without dilution.  Excluded are series that fall visibly inside
    the early window and series whose level never accumulates.  Series too short for the
    rate rule stay as censored.
    """
    ids = as_list(id_col)
    rates = interval_rates(data, id_col=ids, day_col=day_col, level_col=level_col,
                           exposure_col=exposure_col, dilutions=dilutions, min_rows=min_rows,
                           on_error=on_error)
    days = rate_labels(rates, id_col=ids, day_col=day_col, level_col=level_col)
    wide = days.groupBy(*ids).agg(*[
        F.max(F.when(F.col("dilution") == float(d), F.col("day"))).alias(f"day_d{round(d * 100)}")
        for d in dilutions])
    seen = data.groupBy(*ids).agg(F.max(day_col).cast("double").alias("last_day"),
                                  F.max(level_col).alias("_peak"))
    out = seen.join(wide, ids, "left").withColumn("day", F.col(f"day_d{round(dilutions[0] * 100)}"))
    never = F.coalesce(F.col("_peak") < min_level, F.lit(False))
    early = F.coalesce(F.col("day") <= window - 1, F.lit(False))
    return (out.withColumns({"event": F.col("day").isNotNull(),
                             "time": F.coalesce("day", "last_day"),
                             "never_accumulates": never, "excluded": early | never})
            .drop("_peak"))


def compare_rate_days(rate_days: DataFrame, labels: DataFrame, *, id_col, window: int = 4) -> DataFrame:
    """Per dilution: events, agreement with the level-based labels, day differences."""
    from fallpoint.operators.ordered import exact_quantiles

    ids = as_list(id_col)
    rows = rate_days.join(labels.select(*ids, F.col("occurred"), F.col("day").alias("level_day")), ids, "left")
    gap = F.when(F.col("occurred") & F.col("rate_day").isNotNull(), F.col("rate_day") - F.col("level_day"))
    rows = cut(rows.withColumn("gap", gap))
    out = rows.groupBy("dilution").agg(
        F.count("rate_day").alias("with_event"),
        F.count_if(F.col("rate_day").isNotNull() == F.col("occurred")).alias("agree"),
        F.count_if(F.col("gap") == 0).alias("same_day"),
        F.count_if(F.abs("gap") <= 1).alias("within_1_day"),
        F.count_if(F.col("rate_day") <= window).alias("inside_window"))
    mid = exact_quantiles(rows, by="dilution", value="gap", probs=[0.5], names=["median_gap"])
    return out.join(mid, "dilution", "left")


def magnitude_sensitivity(rates: DataFrame, labels: DataFrame, *, id_col, day_col: str,
                          magnitudes: Sequence[float] = (0.02, 0.05)) -> DataFrame:
    """Events and agreement within a day for each (magnitude, dilution)."""
    ids = as_list(id_col)
    parts = None
    for u in magnitudes:
        one = rate_event(rates, id_col=ids, day_col=day_col, magnitude=u).withColumn("magnitude", F.lit(float(u)))
        parts = one if parts is None else parts.unionByName(one)
    rows = parts.join(labels.select(*ids, "occurred", F.col("day").alias("level_day")), ids, "left")
    both = F.col("occurred") & F.col("rate_day").isNotNull()
    return rows.groupBy("magnitude", "dilution").agg(
        F.count("rate_day").alias("with_event"),
        F.count_if(both & (F.abs(F.col("rate_day") - F.col("level_day")) <= 1)).alias("within_1_day"),
        F.count_if(both).alias("comparable"))


# The published rules of renewed production, as (base, share).
RULES = (("amplitude", 0.15), ("minimum", 0.15), ("minimum", 0.0))


def renewed_production(rates: DataFrame, events: DataFrame, *, id_col, day_col: str, level_col: str,
                       event_col: str = "day", rules: Sequence[tuple[str, float]] = RULES) -> DataFrame:
    """First day after the event on which production resumes, under each rule.

    Two positive rates in a row starting the day after the event or later.  Base
    ``amplitude``: the rise over the two days after it, from the minimum since the event,
    reaches a share of the series' range in the smoothed and the raw level.  Base
    ``minimum``: the smoothed rise reaches a share of that minimum (a zero minimum only
    passes when no rise is asked for).  One row per event series with ``rule_<i>``.
    """
    ids = as_list(id_col)
    base = rates.where(F.col("dilution") == 0.0)
    rows = base.join(events.where(F.col(event_col).isNotNull())
                     .select(*ids, F.col(event_col).alias("_ev")), ids)
    w = by_day(ids, day_col)
    every, past = grid.whole(ids), w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(1, 2)
    since = lambda c: F.when(F.col(day_col) > F.col("_ev"), F.col(c))
    rows = rows.withColumns({
        "_q1": F.lead("rate").over(w), "_range": F.max("smoothed").over(every) - F.min("smoothed").over(every),
        "_low": F.min(since("smoothed")).over(past), "_rawlow": F.min(since(level_col)).over(past),
        "_top": F.max("smoothed").over(after), "_rawtop": F.max(level_col).over(after)})
    two = (F.col(day_col) > F.col("_ev")) & (F.col("rate") > 0) & (F.col("_q1") > 0)
    rise, low = F.col("_top") - F.col("_low"), F.col("_low")
    aggs = []
    for i, (kind, share) in enumerate(rules):
        if kind == "amplitude":
            need = share * F.col("_range")
            ok = (rise >= need) & (F.col("_rawtop") - F.col("_rawlow") >= need)
        else:
            ok = rise / F.greatest(low, F.lit(1e-9)) >= share
            if share > 0:
                ok = ok & (low > 0)
        aggs.append(F.min(F.when(two & ok, F.col(day_col))).alias(f"rule_{i}"))
    return rows.groupBy(*ids).agg(F.max("_ev").alias("event_day"), *aggs)


def reversal_table(data: DataFrame, rates: DataFrame, events: DataFrame, *, id_col, day_col: str,
                   level_col: str, exposure_col: str) -> DataFrame:
    """Renewed production plus follow-up days and exposure relative to its maximum so far."""
    ids = as_list(id_col)
    back = renewed_production(rates, events, id_col=ids, day_col=day_col, level_col=level_col)
    seen = data.na.drop(subset=[level_col, exposure_col]).select(*ids, day_col, exposure_col)
    rows = seen.join(back, ids)
    upto = F.col(day_col) <= F.col("rule_0")
    out = rows.groupBy(*ids).agg(
        F.max("event_day").alias("event_day"), *[F.max(f"rule_{i}").alias(f"rule_{i}") for i in range(3)],
        F.max(day_col).alias("_last"),
        F.max_by(exposure_col, F.when(upto, F.col(day_col))).alias("_now"),
        F.max(F.when(upto, F.col(exposure_col))).alias("_top"))
    return out.select(*ids, "event_day", (F.col("_last") - F.col("event_day")).alias("days_after"),
                      "rule_0", "rule_1", "rule_2",
                      F.when(F.col("rule_0").isNotNull() & (F.col("_top") != 0),
                             F.col("_now") / F.col("_top")).alias("exposure_vs_max"))


def consumption_after_event(data: DataFrame, events: DataFrame, *, id_col, day_col: str,
                            level_col: str, exposure_col: str, event_col: str = "day") -> DataFrame:
    """Intervals from the event on: level relative to the series maximum and consumption rate."""
    ids = as_list(id_col)
    w = by_day(ids, day_col)
    area = (F.col(exposure_col) + F.lead(exposure_col).over(w)) / 2
    rows = data.withColumns({"_area": area, "_step": F.lead(level_col).over(w) - F.col(level_col),
                             "_max": F.max(level_col).over(grid.whole(ids))})
    rows = rows.join(events.where(F.col(event_col).isNotNull())
                     .select(*ids, F.col(event_col).alias("_ev")), ids)
    ok = (F.col(day_col) >= F.col("_ev")) & (F.col("_area") > 0) & (F.col("_max") > 0)
    return rows.where(ok).select(*ids, day_col, (F.col(level_col) / F.col("_max")).alias("relative_level"),
                                 (-F.col("_step") / F.col("_area")).alias("consumption"))


def first_low_level(data: DataFrame, *, id_col, day_col: str, value_col: str, level: Column) -> DataFrame:
    """First day the carried-forward value is at or below a level."""
    rows = grid.fill_forward(data, id_col=id_col, day_col=day_col, value_cols=[value_col])
    return grid.first_day_where(rows, id_col=id_col, day_col=day_col, cond=F.col(value_col) <= level)
