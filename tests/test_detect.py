import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fallpoint.contracts import SeriesError, series_problems
from fallpoint.operators import detect, grid

ARGS = dict(id_col="id", day_col="day", value_col="v")


PAIRS = """
    with s as (select * from smooth),
    steps as (select id, day, sm, lead(sm) over (partition by id order by day) < sm as falls from s),
    starts as (select a.id, a.day, a.sm from steps a join steps b on a.id = b.id and b.day between a.day and a.day + {n} - 1
               where a.sm > 0 group by a.id, a.day, a.sm having count(*) filter (b.falls) = {n}),
    risen as (select a.id, a.day, min(b.day) as again from starts a join s b on a.id = b.id and b.day > a.day and b.sm > a.sm group by a.id, a.day),
    deep as (select a.id, a.day, a.sm, 1 - min(b.sm) / a.sm as drop
             from starts a left join risen r using (id, day) join s b on a.id = b.id and b.day > a.day and b.day < coalesce(r.again, 1e9)
             group by a.id, a.day, a.sm having 1 - min(b.sm) / a.sm >= {thr}),
    first as (select id, min(day) as day from deep group by id)
    select f.id, d.drop, d.sm,
           (select arg_max(p.day, (p.raw, -p.day)) from smooth p where p.id = f.id and abs(p.day - f.day) <= {near}) as day
    from first f join deep d on d.id = f.id and d.day = f.day"""


def by_pairs(series, width=3, n=2, thr=0.30):
    """The rule said as relations: all pairs of a start and a later day, for checking only."""
    duckdb = pytest.importorskip("duckdb")
    parts = []
    for k, v in series.items():
        raw = pd.Series(v, dtype=float).interpolate(limit_direction="both")
        around = pd.concat([raw.shift(d) for d in range(-((width - 1) // 2), width // 2 + 1)], axis=1)
        parts.append(pd.DataFrame({"id": k, "day": range(1, len(v) + 1), "raw": raw, "sm": around.mean(axis=1)}).dropna())
    con = duckdb.connect()
    con.register("smooth", pd.concat(parts))
    got = con.execute(PAIRS.format(n=n, thr=thr, near=width // 2 if width > 1 else 0)).df()
    return {r.id: (r.day, r.drop, r.sm) for r in got.itertuples()}


def run(df, **kw):
    return {r["id"]: r for r in detect.detect_shift_batch(df, **ARGS, **kw).collect()}


def course(up, down, rate=1.5, fall=0.7, start=1.0):
    """``up`` days of growth by ``rate``, then ``down`` days of fall by ``fall``: the top is day ``up``."""
    rise = [start * rate ** i for i in range(up)]
    return rise + [rise[-1] * fall ** (j + 1) for j in range(down)]


def spike_and_slow_fall(days=12):
    """A jump to day 7 with a slow fall after it: the raw top is day 7, the smoothed one day 8."""
    return course(6, 0, rate=1.1) + [3 * 0.95 ** j for j in range(days)]


def test_series_of_known_course(long_frame):
    shallow = course(5, 3, fall=0.9)  # less than the threshold, and overtaken later
    holed = course(6, 5)
    holed[2] = None
    series = {"clean": course(6, 5), "rising": course(9, 0), "level": [4.0] * 7, "overtaken": shallow + course(4, 0, start=shallow[-1] * 1.6),
              "second": shallow + course(4, 4, rate=1.6, start=shallow[-1] * 1.6) + [100.0], "holed": holed, "short": course(2, 0),
              "empty": [None] * 5, "tiny": [v / 1000 for v in course(6, 5)], "spike": spike_and_slow_fall()}
    got = run(long_frame(series))
    assert {k for k, r in got.items() if r["occurred"]} == {"clean", "second", "holed", "tiny", "spike"}
    assert {k: got[k]["day"] for k in ("clean", "second", "holed", "tiny", "spike")} == {"clean": 6, "second": 12, "holed": 6, "tiny": 6, "spike": 7}
    assert 0.5 < got["clean"]["drop_fraction"] < 0.9 and abs(got["clean"]["drop_fraction"] - got["tiny"]["drop_fraction"]) < 1e-12
    assert got["rising"]["time"] == 9 and got["level"]["time"] == 7
    assert [got[k]["reason_code"] for k in ("level", "overtaken", "short", "empty")] == ["no_fall", "no_fall", "too_short", "no_data"]


def test_options(long_frame):
    gentle = long_frame({"a": course(5, 5, fall=0.93)})
    assert not run(gentle, drop_threshold=0.5)["a"]["occurred"] and run(gentle, drop_threshold=0.1)["a"]["occurred"]
    assert not run(long_frame({"a": [v / 1000 for v in course(6, 5)]}), min_peak=0.02)["a"]["occurred"]
    assert run(long_frame({"a": course(4, 4)}), smooth_window=1)["a"]["day"] == 4
    dent = course(5, 1, fall=0.4)
    dent = long_frame({"a": dent + course(5, 0, start=dent[-1] * 1.5)})
    assert run(dent, smooth_window=1, n_consecutive=1)["a"]["day"] == 5
    assert not run(dent, smooth_window=1, n_consecutive=3)["a"]["occurred"]
    assert run(long_frame({"a": spike_and_slow_fall()}), refine_peak=False)["a"]["day"] == 8
    early = run(long_frame({"a": course(2, 7)}), min_day=6)["a"]
    assert not early["occurred"] and early["drop_fraction"] is not None and "min_day=6" in early["reason"]


def test_days_far_out(long_frame):
    far = run(long_frame({"a": course(5, 4)}, {"a": range(150_001, 150_010)}))["a"]
    assert far["occurred"] and far["day"] == 150_005


def test_parameters_and_bad_days(spark, long_frame):
    df = long_frame({"a": [1, 2, 3]})
    for kw in (dict(drop_threshold=0), dict(drop_threshold=1), dict(n_consecutive=0)):
        with pytest.raises(ValueError):
            detect.detect_shift_batch(df, **ARGS, **kw)
    bad = {"A": ([1, 2, 3], [1, 2, 3]), "B": ([1, 1.5, 3], [1, 2, 3]), "C": ([1, 2, 3], [1, 1, 2]),
           "D": ([0, 1, 2], [1, 2, 3])}
    cases = {"B": ("day_not_integer", [1, 1.5, 3]), "C": ("day_repeated", [1, 1, 2]), "D": ("day_below_one", [0, 1, 2]),
             "E": ("day_not_finite", [1, None, 2])}
    df = long_frame({k: [1, 2, 3] for k in ["A", *cases]}, {k: c[1] for k, c in cases.items()})
    got = {r["id"]: r["problem"] for r in series_problems(df, id_col="id", day_col="day").collect()}
    assert got == {k: c[0] for k, c in cases.items()} and "A" in bad
    with pytest.raises(SeriesError, match="'B'"):
        detect.detect_shift_batch(df, **ARGS, on_error="raise")
    with pytest.raises(Exception, match="series"):
        detect.detect_shift_batch(df, **ARGS).collect()
    with pytest.raises(ValueError):
        detect.detect_shift(spark, [], [])
    with pytest.raises(ValueError):
        detect.detect_shift(spark, [1, 2], [1])


@pytest.mark.parametrize("width,n,thr", [(3, 2, 0.30), (1, 2, 0.2), (5, 3, 0.4), (3, 1, 0.1), (4, 2, 0.3)])
def test_random_series_against_all_pairs(long_frame, width, n, thr):
    rng = np.random.default_rng(width * 100 + n)
    series = {}
    for i in range(150):
        v = np.round(np.abs(np.cumsum(rng.normal(0, 1, rng.integers(2, 30)))) + rng.integers(0, 2), 2).tolist()
        series[f"s{i}"] = [None if rng.random() < 0.15 else x for x in v[:-1]] + [v[-1]]
    got = run(long_frame(series), smooth_window=width, n_consecutive=n, drop_threshold=thr)
    want = by_pairs(series, width, n, thr)
    assert {k for k, r in got.items() if r["occurred"]} == set(want)
    for k, (day, drop, peak) in want.items():
        assert got[k]["day"] == day
        assert got[k]["drop_fraction"] == pytest.approx(drop) and got[k]["peak_value"] == pytest.approx(peak)


def test_order_partitions_and_other_series_change_nothing(long_frame):
    a = long_frame({"a": [1, 2, 4, 7, 9, 6, 3, 2], "b": [3, 2, 1, 5, 9, 1, 1, 0.5]})
    more = a.unionByName(long_frame({"z": [9, 8, 7, 1]}))
    base = run(a)
    for df in (a.orderBy(F.rand(1)), a.repartition(1), a.repartition(7), more):
        got = run(df)
        assert all(got[k] == base[k] for k in base)


def test_label_grid_matches_single_runs(long_frame):
    df = long_frame({"a": [1, 2, 4, 7, 9, 6, 3, 2], "b": [3, 2, 1, 5, 9, 1, 1, 0.5], "c": [1, 2, 3, 4, 5, 6, 5, 4]})
    rows = detect.label_grid(df, **ARGS).collect()
    for r in rows:
        single = run(df, smooth_window=r["smooth_window"], n_consecutive=r["n_consecutive"],
                     drop_threshold=r["drop_threshold"]) if r["id"] == "a" else None
        if single:
            assert single["a"]["day"] == r["day"]
    assert len(rows) == 24 * 3


def test_low_points(long_frame):
    df = long_frame({
        "flagged": [.45, .7, 1.1, 1.5, 2, 2.5, 3, 3.5, 4, 3.9, 3.75, 3.2, .7, 4.3],
        "real": [.5, 1.2, 2.5, 3.8, 4.6, 3.5, 2, 1.5, 1.2, 1, .8, .6, .5, .4],
        "bottom": [.5, 1.5, 2.8, 3.9, 4.5, 2.5, 1.5, 1.2, 1.8, 2.5, 3.5, 4.2, 4.8, 4.9],
        "noise": [.5, 1.5, 3, 4, 2, 1, .5, .1, .02, .12, .1, .1, .1, .1],
        "null": [1, 2, 3, None, .5, 3.2, 3.3]})
    low = detect.isolated_low_points(df, **ARGS).collect()
    assert sorted((r["id"], r["day"]) for r in low) == [("flagged", 13.0), ("null", 5.0)]
    again = {r["id"]: r for r in detect.recheck_without_low_points(df, **ARGS).collect()}
    assert again["flagged"]["changed"] and again["flagged"]["suspect_days"] == "13"
    assert again["flagged"]["occurred_before"] and not again["flagged"]["occurred_after"]


def test_grid_and_deepest_fall(long_frame):
    df = long_frame({"a": [1, 2, 5]}, {"a": [1, 2, 5]})
    got = grid.regularize(df, id_col="id", day_col="day", value_cols=["v"]).orderBy("day").collect()
    assert [r["v"] for r in got] == [1, 2, 3, 4, 5]
    ends = long_frame({"a": [None, 2, None, 4, None]})
    got = grid.regularize(ends, id_col="id", day_col="day", value_cols=["v"]).orderBy("day").collect()
    assert [r["v"] for r in got] == [2, 2, 3, 4, 4]
    fall = grid.deepest_fall(long_frame({"a": [2, 4, 1, 3, 1], "b": [1, 2, 3]}), **ARGS).orderBy("id").collect()
    assert (fall[0]["fall"], fall[0]["from_day"], fall[0]["to_day"]) == (0.75, 2.0, 3.0)
    assert fall[1]["fall"] == 0 and fall[1]["from_day"] is None


def test_plan_has_no_python_and_one_series_shuffle(long_frame):
    out = detect.detect_shift_batch(long_frame({"a": [1, 2, 4, 7, 9, 6, 3, 2]}), **ARGS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
