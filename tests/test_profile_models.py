"""Variants of the profile models against each other."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fallpoint.lineage import cut
from fallpoint.plans import jobs, panel
from workload.modelling import KIN2, folded_window

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    w = cut(jobs._observed(folded_window(spark, DATA)))
    return w, jobs.fit_on_folds(w, KIN2, id_col="id", fold="fold", folds=5)


def scores(spark, data, **more):
    return {r["id"]: r for r in jobs.score_profiles(data, *more.pop("model"), id_col="id", **more).collect()}


def test_frozen_error(spark, fitted):
    w, fits = fitted
    same = scores(spark, w.withColumn("late", F.col("state")), model=(fits, KIN2), frozen="late")
    other = scores(spark, w.withColumn("late", 1 - F.col("state")), model=(fits, KIN2), frozen="late")
    plain = scores(spark, w, model=(fits, KIN2))
    assert len(plain) > 5 and all(r["rmse2_frozen"] is None for r in plain.values())
    for k, r in plain.items():
        assert same[k]["rmse2_frozen"] == pytest.approx(r["rmse2"]) and same[k]["rmse"] == pytest.approx(r["rmse"]) and other[k]["rmse2"] == pytest.approx(r["rmse2"])
    assert any(other[k]["rmse2_frozen"] != pytest.approx(r["rmse2"]) for k, r in plain.items())


def test_first_order_form_is_the_plain_model(spark, fitted):
    w, fits = fitted
    shaped = jobs.fit_on_folds(w, KIN2, id_col="id", fold="fold", folds=5, forms=[(None, 0.0), (0.5, 0.01)])
    first = spark.createDataFrame([(f, 0, None, 0.0) for f in range(5)], "fold int, variant int, half double, floor double")
    got, plain = scores(spark, w, model=(shaped, KIN2), form=first), scores(spark, w, model=(fits, KIN2))
    assert all(got[k][c] == pytest.approx(r[c], rel=1e-6) for k, r in plain.items() for c in ("rmse", "rmse2"))
    best = jobs.chosen_form(shaped, [(None, 0.0), (0.5, 0.01)], spark).collect()
    assert [r["variant"] for r in best] == shaped.mse.argmin(axis=0).tolist()


def test_form_moments_are_those_of_multiplied_rows(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows = [(f"s{i}", d, i % 3, float(rng.normal(0.1, 0.2)), float(d + rng.random()), float(rng.random()) if d % 4 else None, float(d > 5))
            for i in range(9) for d in range(1, 4 + 2 * i)]
    data = spark.createDataFrame(rows, "id string, day int, fold int, level double, exposure double, c double, state double")
    kin, forms = panel.Kinetics(covariates=("c",), state="state"), [(None, 0.0), (0.5, 0.01), (0.02, -0.05)]
    inter = panel.interval_columns(data, kin, id_col="id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # series go on from one batch to the next
    try:
        got = panel.form_moments(inter, kin, forms, id_col="id", fold="fold").toPandas().set_index("id")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n, eat = len(kin.raw) + 2, kin.raw.index("u_eat")
    assert got.index.is_unique and len(got) == 9
    for i, (half, floor) in enumerate(forms):
        shaped = panel.saturable(F.col("level"), F.lit(half).cast("double"), F.lit(floor))
        one = panel.series_moments(inter.withColumn("u_eat", -F.col("state") * shaped * F.col("area")), kin, id_col="id", keys=["fold"]).collect()
        for r in one:
            g = np.array(got.loc[r["id"], "g"]).reshape(n, n)
            g[eat, :] = g[:, eat] = np.array(got.loc[r["id"], "e"]).reshape(len(forms), n)[i]
            assert np.allclose(g, np.array(r["g"]).reshape(n, n)) and got.loc[r["id"], "fold"] == r["fold"]


@pytest.mark.parametrize("make", [lambda w, f, **k: jobs.score_profiles(w, f, KIN2, frozen="state", **k), lambda w, f, **k: jobs.true_forecast(w, f, KIN2, **k),
                                  lambda w, f, **k: panel.expected_trajectory(w, f.frame(w.sparkSession), KIN2, **k)])
def test_rows_are_dealt_by_series_once(fitted, make):
    """Parameters go to the rows: rows are neither sorted nor sent by fold, nor stored or joined with themselves on the way."""
    plan = make(*fitted, id_col="id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "BuildLeft" not in plan and plan.count("FileScan") == 1


def test_dilutions_share_their_moments(spark, fitted, monkeypatch):
    w, _ = fitted
    loss = [0.0, 0.02]
    one = [jobs.fit_on_folds(w, replace(KIN2, dilution=d), id_col="id", fold="fold", folds=5) for d in loss]
    read, whole = [], panel.interval_columns
    monkeypatch.setattr(panel, "interval_columns", lambda *a, **k: read.append(1) or whole(*a, **k))
    both = jobs.fit_dilutions(w, KIN2, loss, id_col="id", fold="fold", folds=5)
    assert len(read) == 1 and [f.kinetics.dilution for f in both] == loss
    for a, b in zip(one, both):
        np.testing.assert_allclose(a.theta, b.theta, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(a.mse, b.mse, rtol=1e-9)
