"""Detection of the day a series turns from rising to a sustained, deep fall.

The whole batch is one hash exchange by id: regularise, smooth and count falling steps
with windows, gather each series as an ordered array (bounded by its calendar days) and
scan it once.  The scan needs no pairs of days: while a starting point is still standing,
every later starting point is no higher, falls no deeper and is overtaken no later, so
only the earliest standing point has to be remembered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallpoint.contracts import as_list, by_day, check_parameters, clean, has_ids
from fallpoint.operators import grid

# Reason codes and their texts.
REASONS = {
    "no_data": "series without data",
    "too_short": "series too short",
    "no_fall": "no sufficient sustained fall",
    "event": "event",
    "before_min_day": "event on day {day}, before min_day={min_day}",
}

RESULT = ("occurred", "day", "drop_fraction", "peak_value", "censoring_day", "reason_code",
          "reason", "time")


def gather_paths(rows: DataFrame, *, id_col, order: str, fields: dict[str, Column],
                 extra: dict[str, Column] | None = None, out: str = "path") -> DataFrame:
    """One row per id holding its days as an array of structs in day order."""
    item = F.struct(F.col(order).alias("pos"), *[c.alias(n) for n, c in fields.items()])
    aggs = [F.sort_array(F.collect_list(item)).alias(out)]
    aggs += [c.alias(n) for n, c in (extra or {}).items()]
    return rows.groupBy(*as_list(id_col)).agg(*aggs)


def first_deep_fall(path: str, cand: str, threshold: str) -> Column:
    """Scan one ordered path for its first candidate whose fall is deep enough.

    ``path`` items carry ``pos`` and ``s``; ``cand`` and ``threshold`` are SQL text, the
    former may use the item ``x``.  Returns ``struct(val, pos, low)``, NULL when none:
    ``low`` is the minimum reached before the path rises above ``val`` again.
    """
    begin = "named_struct('val', x.s, 'pos', x.pos, 'low', x.s, 'hit', false, 'done', false)"
    nothing = ("named_struct('val', cast(null as double), 'pos', cast(null as int), "
               "'low', cast(null as double), 'hit', false, 'done', false)")
    closed = "named_struct('val', a.val, 'pos', a.pos, 'low', a.low, 'hit', true, 'done', true)"
    going = ("named_struct('val', a.val, 'pos', a.pos, 'low', least(a.low, x.s), 'hit', "
             f"a.hit OR (a.val - least(a.low, x.s)) / a.val >= {threshold}, 'done', false)")
    start = f"IF(x.s > 0 AND ({cand}), {begin}, {nothing})"
    return F.expr(f"""
        aggregate({path}, {nothing},
          (a, x) -> CASE WHEN a.done THEN a
                         WHEN a.val IS NULL THEN {start}
                         WHEN x.s > a.val THEN IF(a.hit, {closed}, {start})
                         ELSE {going} END,
          a -> IF(a.hit, named_struct('val', a.val, 'pos', a.pos, 'low', a.low), NULL))""")


def peak_near(path: str, pos: str, reach: int | str) -> Column:
    """Day of the largest raw value within ``reach`` items of ``pos``, earliest on ties."""
    return F.expr(f"""
        (-array_max(transform(filter(
            slice({path}, cast(greatest({pos} - ({reach}), 1) as int),
                  cast({pos} + ({reach}) - greatest({pos} - ({reach}), 1) + 1 as int)),
            x -> x.v IS NOT NULL), x -> struct(x.v, -x.day as neg))).neg)""")


def _grid_rows(data: DataFrame, ids: list[str], day_col: str, value_col: str, regularize_grid: bool,
               on_error: str) -> DataFrame:
    if regularize_grid:
        return grid.regularize(data, id_col=ids, day_col=day_col, value_cols=[value_col], on_error=on_error)
    rows = clean(data.select(*ids, day_col, value_col), id_col=ids, value_cols=[value_col])
    return rows.withColumn("last_day", F.max(day_col).over(grid.whole(ids)))


def smoothed_paths(data: DataFrame, *, id_col, day_col: str, value_col: str, smooth_window: int,
                   max_run: int, regularize_grid: bool = True, on_error: str = "assert") -> DataFrame:
    """One row per id: ``path`` of (pos, day, v, s, run), ``last_day``, ``n_values``."""
    ids = as_list(id_col)
    rows = _grid_rows(data, ids, day_col, value_col, regularize_grid, on_error)
    w = by_day(ids, day_col)
    rows = rows.withColumns({"_pos": F.row_number().over(w),
                             "_s": grid.smoothed(F.col(value_col), w, smooth_window)})
    rows = grid.falling_runs(rows, id_col=ids, day_col=day_col, value_col="_s", n=max_run, out="_run")
    return gather_paths(rows, id_col=ids, order="_pos",
                        fields={"day": F.col(day_col).cast("double"), "v": F.col(value_col),
                                "s": F.col("_s"), "run": F.col("_run")},
                        extra={"last_day": F.max("last_day").cast("double"),
                               "n_values": F.count(value_col)})


def judge_paths(paths: DataFrame, *, n: str, threshold: str, reach: str | None,
                min_peak: float | None = None, min_day: float | None = None) -> DataFrame:
    """Add the detection result to gathered paths.

    ``n``, ``threshold`` and ``reach`` (days searched around the point for the raw maximum,
    None to keep the point) are SQL text: literals or columns of the paths.
    """
    cand = f"x.run >= {n}"
    if min_peak is not None:
        cand += f" AND x.s >= {float(min_peak)!r}D"
    out = paths.withColumn("_f", F.when(F.expr(f"size(path) > {n}"),
                                        first_deep_fall("path", cand, threshold)))
    at = F.expr("element_at(path, _f.pos).day")
    if reach is not None:
        at = F.coalesce(peak_near("path", "_f.pos", reach), at)
    found = F.col("_f").isNotNull()
    out = out.withColumn("_day", F.when(found, at))
    early = found & (F.col("_day") < min_day) if min_day is not None else F.lit(False)
    code = (F.when(F.col("n_values") == 0, "no_data")
            .when(F.expr(f"size(path) <= {n}"), "too_short")
            .when(~found, "no_fall").when(early, "before_min_day").otherwise("event"))
    val, low = F.col("_f")["val"], F.col("_f")["low"]
    out = out.withColumn("reason_code", code).withColumns({
        "occurred": F.col("reason_code") == "event",
        "day": F.when(F.col("reason_code") == "event", F.col("_day")),
        "drop_fraction": (val - low) / val, "peak_value": val,
        "censoring_day": F.col("last_day")})
    text = F.lit(None).cast("string")
    for k, v in REASONS.items():
        if k == "before_min_day":
            v = F.format_string(v.format(day="%.0f", min_day=f"{min_day or 0:.0f}"), F.col("_day"))
        text = F.when(F.col("reason_code") == k, v).otherwise(text)
    return (out.withColumn("reason", text)
            .withColumn("time", F.coalesce(F.col("day"), F.col("censoring_day")))
            .drop("_f", "_day"))


def detect_shift_batch(data: DataFrame, *, id_col, day_col: str, value_col: str,
                       smooth_window: int = 3, n_consecutive: int = 2,
                       drop_threshold: float = 0.30, min_day: float | None = None,
                       regularize_grid: bool = True, refine_peak: bool = True,
                       min_peak: float | None = None, on_error: str = "assert") -> DataFrame:
    """First day each series turns into a sustained, deep fall; one row per id.

    The day is the first point of the smoothed series followed by ``n_consecutive``
    falling steps and by a fall of at least ``drop_threshold`` of its value before the
    series rises above it again.  ``refine_peak`` moves it to the raw maximum within
    ``smooth_window // 2`` days.  ``min_day`` turns an earlier first event into a
    non-event that keeps its drop and peak.  Series without an event are censored on
    their last day.
    """
    check_parameters(drop_threshold=drop_threshold, n_consecutive=n_consecutive)
    paths = smoothed_paths(data, id_col=id_col, day_col=day_col, value_col=value_col,
                           smooth_window=smooth_window, max_run=n_consecutive,
                           regularize_grid=regularize_grid, on_error=on_error)
    reach = str(smooth_window // 2) if refine_peak and smooth_window > 1 else None
    out = judge_paths(paths, n=str(int(n_consecutive)), threshold=f"{float(drop_threshold)!r}D",
                      reach=reach, min_peak=min_peak, min_day=min_day)
    return out.select(*as_list(id_col), *RESULT)


def detect_shift(spark, days: Sequence[float], values: Sequence[float], **options) -> dict:
    """Detection on one short series given as two sequences; returns its result row."""
    if len(days) == 0:
        raise ValueError("the series is empty")
    if len(days) != len(values):
        raise ValueError("days and values must have the same length")
    rows = [("series", None if d is None else float(d), None if v is None else float(v), )
            for d, v in zip(days, values)]
    df = spark.createDataFrame(rows, "id string, day double, value double")
    options.setdefault("on_error", "raise")
    got = detect_shift_batch(df, id_col="id", day_col="day", value_col="value", **options).first()
    return {k: got[k] for k in RESULT}


def label_grid(data: DataFrame, *, id_col, day_col: str, value_col: str,
               windows: Sequence[int] = (1, 3, 5), runs: Sequence[int] = (2, 3),
               thresholds: Sequence[float] = (0.20, 0.30, 0.40, 0.50), refine_peak: bool = True,
               on_error: str = "assert") -> DataFrame:
    """Detection under every parameter combination, keyed by (smooth_window, n, threshold, id).

    Each series is gathered once with all its smoothed versions; the combinations are data
    attached to it, so they cost scans of its array and no further pass over the rows.
    """
    ids, widths = as_list(id_col), list(windows)
    w = by_day(ids, day_col)
    rows = _grid_rows(data, ids, day_col, value_col, True, on_error)
    rows = rows.withColumns({"_pos": F.row_number().over(w),
                             **{f"_s{i}": grid.smoothed(F.col(value_col), w, k) for i, k in enumerate(widths)}})
    for i in range(len(widths)):
        rows = grid.falling_runs(rows, id_col=ids, day_col=day_col, value_col=f"_s{i}", n=max(runs), out=f"_r{i}")
    each = range(len(widths))
    paths = gather_paths(rows, id_col=ids, order="_pos", out="_all",
                         fields={"day": F.col(day_col).cast("double"), "v": F.col(value_col),
                                 "s": F.array(*[F.col(f"_s{i}") for i in each]),
                                 "run": F.array(*[F.col(f"_r{i}") for i in each])},
                         extra={"last_day": F.max("last_day").cast("double"), "n_values": F.count(value_col)})
    combos = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("w"), F.lit(n).alias("n"), F.lit(float(t)).alias("t"))
                       for i, k in enumerate(widths) for n in runs for t in thresholds])
    paths = paths.withColumn("_c", F.explode(combos)).withColumns(
        {"smooth_window": F.col("_c.w"), "n_consecutive": F.col("_c.n"), "drop_threshold": F.col("_c.t")})
    paths = paths.withColumn("path", F.expr(
        "transform(_all, x -> named_struct('pos', x.pos, 'day', x.day, 'v', x.v, 's', x.s[_c.i], 'run', x.run[_c.i]))"))
    out = judge_paths(paths.drop("_all"), n="n_consecutive", threshold="drop_threshold",
                      reach="smooth_window div 2" if refine_peak else None)
    return out.select("smooth_window", "n_consecutive", "drop_threshold", *ids, *RESULT)


def global_peak_rule(data: DataFrame, *, id_col, day_col: str, value_col: str,
                     smooth_window: int = 3, n_consecutive: int = 2,
                     drop_threshold: float = 0.30) -> DataFrame:
    """Rival rule: only the global maximum of the smoothed series may be the event."""
    check_parameters(drop_threshold=drop_threshold, n_consecutive=n_consecutive)
    paths = smoothed_paths(data, id_col=id_col, day_col=day_col, value_col=value_col,
                           smooth_window=smooth_window, max_run=n_consecutive)
    top = F.expr("array_max(transform(filter(path, x -> x.s IS NOT NULL), "
                 "x -> struct(x.s as s, -x.pos as neg)))")
    out = paths.withColumn("_t", top).withColumn("_p", -F.col("_t")["neg"])
    low = F.expr("array_min(transform(filter(path, x -> x.pos > _p), x -> x.s))")
    out = out.withColumns({"peak_value": F.col("_t")["s"],
                           "peak_day": F.expr("element_at(path, _p).day"), "_low": low})
    drop = (F.col("peak_value") - F.col("_low")) / F.col("peak_value")
    run = F.expr("element_at(path, _p).run")
    return out.select(*as_list(id_col), "peak_day", "peak_value", drop.alias("drop_fraction"),
                      F.coalesce((run >= n_consecutive) & (drop >= drop_threshold),
                                 F.lit(False)).alias("occurred"))


def isolated_low_points(data: DataFrame, *, id_col, day_col: str, value_col: str,
                        factor: float = 0.5, min_rel: float = 0.2) -> DataFrame:
    """Measured days far below both neighbours; likely misreadings, never the ends.

    A day is listed when it is below both measured neighbours, below ``factor`` times
    their mean, and that mean exceeds ``min_rel`` times the maximum of the series.
    """
    ids = as_list(id_col)
    rows = clean(data.select(*ids, day_col, value_col), id_col=ids, value_cols=[value_col])
    rows = grid.measured_neighbours(rows, id_col=ids, day_col=day_col, value_col=value_col)
    rows = rows.withColumn("_max", F.max(value_col).over(grid.whole(ids)))
    x, mean = F.col(value_col), (F.col("before") + F.col("after")) / 2
    low = (x < F.least("before", "after")) & (x < factor * mean) & (mean > min_rel * F.col("_max"))
    return (rows.where(F.col("before").isNotNull() & F.col("after").isNotNull() & low)
            .select(*ids, day_col, value_col, "before", "after"))


def mask_days(data: DataFrame, flagged: DataFrame, *, id_col, day_col: str,
              value_col: str) -> DataFrame:
    """NULL the value on the listed days."""
    keys = as_list(id_col) + [day_col]
    marks = flagged.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return (data.join(marks, keys, "left")
            .withColumn(value_col, F.when(F.col("_hit").isNull(), F.col(value_col))).drop("_hit"))


def recheck_without_low_points(data: DataFrame, *, id_col, day_col: str, value_col: str,
                               **options) -> DataFrame:
    """Series with isolated low points: their days, the result with and without them."""
    ids = as_list(id_col)
    low = isolated_low_points(data, id_col=ids, day_col=day_col, value_col=value_col)
    named = low.groupBy(*ids).agg(F.concat_ws(" ", F.transform(
        F.sort_array(F.collect_list(F.col(day_col).cast("int"))), lambda d: d.cast("string"))
    ).alias("suspect_days"))
    only = data.select(*ids, day_col, value_col).join(named.select(*ids), ids, "left_semi")
    kw = dict(id_col=ids, day_col=day_col, value_col=value_col, **options)
    before = detect_shift_batch(only, **kw)
    after = detect_shift_batch(mask_days(only, low, id_col=ids, day_col=day_col,
                                         value_col=value_col), **kw)
    pick = lambda df, tag: df.select(*ids, F.col("occurred").alias(f"occurred_{tag}"),
                                     F.col("day").alias(f"day_{tag}"))
    out = named.join(pick(before, "before"), ids).join(pick(after, "after"), ids)
    same = ((F.col("occurred_before") == F.col("occurred_after"))
            & F.col("day_before").eqNullSafe(F.col("day_after")))
    return out.withColumn("changed", ~same)


def event_time(occurred: Column, day: Column, censoring_day: Column) -> Column:
    return F.when(occurred, day).otherwise(censoring_day)


def negative_ids(data: DataFrame, *, id_col, value_col: str) -> DataFrame:
    """Ids with a negative measurement; a warning, not an error."""
    ids = as_list(id_col)
    return data.where(has_ids(ids) & (F.col(value_col) < 0)).select(*ids).distinct()
