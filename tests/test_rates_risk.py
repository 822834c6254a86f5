import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fallpoint.operators import rates, risk

ARGS = dict(id_col="id", day_col="day", level_col="level", exposure_col="exposure")
KEY = dict(id_col="id", day_col="day")


@pytest.fixture(scope="module")
def rows(spark):
    up = [1, 2, 4, 7, 9, 6, 3, 2, 3, 5, 8]
    flat = [1.0, 1.2, 1.1, 1.3, 1.25, 1.35, 1.3, 1.4]
    never = [0.01, 0.02, 0.01, 0.02, 0.01]
    out = [(k, d, float(v), float(d), 37.0 if d < 5 else 33.0, "g" if d > 1 else None)
           for k, vs in (("a", up), ("b", flat), ("c", never)) for d, v in enumerate(vs, 1)]
    return spark.createDataFrame(out, "id string, day int, level double, exposure double, t double, g string").where("not (id = 'b' and day = 3)")


@pytest.fixture(scope="module")
def labels(rows):
    return rates.label_table(rows, **ARGS)


def test_rate_has_the_sign_of_the_change_without_dilution(rows):
    r = rates.interval_rates(rows, **ARGS, dilutions=[0.0, 0.5]).toPandas()
    a = r[(r.id == "a") & (r.dilution == 0)].sort_values("day")
    assert (np.sign(a.rate[:-1]) == np.sign(np.diff(a.smoothed))).all() and np.isnan(a.rate.iloc[-1])
    assert (r[r.dilution == 0.5].rate.dropna().to_numpy() >= r[r.dilution == 0].rate.dropna().to_numpy()).all()


def test_label_table(labels):
    got = {r["id"]: r.asDict() for r in labels.collect()}
    assert got["a"]["event"] and got["a"]["day"] == 5 and not got["a"]["excluded"]
    assert not got["b"]["event"] and got["b"]["time"] == 8
    assert got["c"]["never_accumulates"] and got["c"]["excluded"]


def test_magnitude_rule(rows):
    r = rates.interval_rates(rows, **ARGS)
    plain = {x["id"]: x["rate_day"] for x in rates.rate_event(r, **KEY).collect()}
    strict = {x["id"]: x["rate_day"] for x in rates.rate_event(r, **KEY, magnitude=0.99).collect()}
    assert plain["a"] is not None and (strict["a"] is None or strict["a"] >= plain["a"])


def test_renewed_production(rows, labels):
    r = rates.interval_rates(rows, **ARGS)
    ev = labels.where("event and not excluded").select("id", "day")
    got = {x["id"]: x for x in rates.renewed_production(r, ev, **KEY, level_col="level").collect()}
    assert set(got) == {"a"} and got["a"]["rule_0"] in (8, 9) and got["a"]["rule_2"] <= got["a"]["rule_0"]


def test_person_period(rows, labels):
    kw = dict(**KEY, measures=["level"], exposure_col="exposure", setpoint_col="t", group_col="g")
    one = risk.person_period(rows, labels, **kw).toPandas()
    assert set(one.id) == {"a", "b"} and one[one.id == "a"].day.tolist() == [2, 3, 4, 5]
    assert one[one.id == "a"].y.tolist() == [0, 0, 0, 1] and one[one.id == "b"].y.sum() == 0
    assert one[(one.id == "a")].drops_tomorrow.tolist() == [0, 0, 1, 0] and (one.g == "g").all()
    b3 = one[(one.id == "b") & (one.day == 3)].iloc[0]
    assert b3.level == 1.2 and b3.d_exposure == 0
    two = risk.person_period(rows, labels, **kw, lead=2).toPandas()
    a = two[two.id == "a"].set_index("day")
    assert a.loc[3, "level"] == 2 and np.isnan(a.loc[2, "d_exposure"])
    assert a.drops_tomorrow.tolist() == [0, 0, 1, 1]
    blind = risk.person_period(rows, labels, **kw, blind=True).toPandas()
    assert blind[blind.id == "a"].day.max() == 11 and blind.y.sum() == 0


def test_later_days_do_not_change_early_rows(spark, rows, labels):
    kw = dict(**KEY, measures=["level"], exposure_col="exposure", setpoint_col="t", group_col="g")
    more = rows.unionByName(spark.createDataFrame([("a", 12, 99.0, 99.0, 20.0, "g")], rows.schema))
    cols = ["id", "day", "level", "d_exposure", "low_today", "y"]
    a = risk.person_period(rows, labels, **kw).select(cols).toPandas().sort_values(["id", "day"]).reset_index(drop=True)
    b = risk.person_period(more, labels, **kw).select(cols).toPandas().sort_values(["id", "day"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_modelling_window_cut_and_lag(spark, labels):
    out = [("a", d, float(d), x, c) for d, (x, c) in enumerate([(1.0, None), (4.0, 5.0), (5.0, None), (4.0, 7.0), (6.0, 8.0), (9.0, 9.0)], 1)]
    df = spark.createDataFrame(out, "id string, day int, level double, exposure double, c double")
    got = risk.modelling_window(df, labels, **ARGS, covariates=["c"], keep=0.85).toPandas().sort_values("day")
    assert got.day.tolist() == [1, 2, 3, 4] and got.c_prev.tolist() == [5, 5, 5, 5]
    assert risk.modelling_window(df, labels, **ARGS, covariates=["c"], keep=None).count() == 6
    d = risk.design_rows(risk.modelling_window(df, labels, **ARGS, covariates=["c"], keep=None), **ARGS, covariates=["c_prev"],
                         inhibitor="exposure").toPandas().sort_values("day")
    assert d.a0.tolist() == [3, 1, 0, 2, 3] and d.dy.tolist() == [1] * 5 and d.a4.tolist() == [0, -2.5, 0, -23, -49.5]
