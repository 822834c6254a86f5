"""Groups as training sets: one pass over the rows gives what a fit per group gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fallpoint.plans import jobs, metrics, models

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"id": np.arange(n) % 120, "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf["g"] = np.array(["u", "v", "w", None], dtype=object)[pdf["id"] % 4]
    pdf.loc[pdf["g"] == "w", "b"] = 2.0
    pdf["y"] = (rng.random(n) < 1 / (1 + np.exp(-pdf["a"] + 0.5 * pdf["b"]))).astype(int)
    pdf["t"] = pdf["a"] * 2 + rng.normal(size=n)
    pdf.loc[::19, "a"] = np.nan
    clean = pdf.astype({"a": object}).where(pdf.notna(), None)
    return spark.createDataFrame([tuple(None if v is None or v != v else v for v in r) for r in clean.itertuples(index=False)],
                                 "id long, a double, b double, g string, y int, t double").repartition(4).cache()


def test_leaving_groups_out_equals_fits_without_them(rows):
    got = {r["group"]: r for r in jobs.leave_group_out_hazard(rows, ["b"], COLS, group="g", id_col="id", min_ids=5).collect()}
    assert set(got) == {"u", "v", "w"} and all(r["ids"] == 30 for r in got.values())
    for g in got:
        train, test = rows.where(~F.col("g").eqNullSafe(g)), rows.where(F.col("g") == g)
        scored = models.predict_risk(test, models.fit_logistic(train, COLS), out="p")
        assert abs(metrics.auc(scored, score="p").first()["auc"] - got[g]["auc_full"]) < 1e-12
    none = jobs.leave_group_out_hazard(rows, ["b"], COLS, group="g", id_col="id", min_ids=500)
    assert none.count() == 0 and none.columns == ["group", "ids", "events", "auc_base", "auc_full", "gain"]


@pytest.mark.parametrize("model", ["median", "ridge"])
def test_errors_without_a_group(rows, model):
    got = {r["group"]: r for r in jobs.leave_group_out_errors(rows, COLS, y="t", group="g", id_col="id", model=model).collect()}
    pdf = rows.toPandas()
    assert set(got) == {"u", "v", "w"} and got["u"]["n_test"] + got["u"]["n_train"] == len(pdf)
    for g, r in got.items():
        test, train = pdf[pdf["g"] == g], pdf[pdf["g"] != g]
        assert r["n_test"] == len(test)
        if model == "median":
            assert abs(r["score"] - (test["t"] - train["t"].median()).abs().mean()) < 1e-9
        else:
            alone = models.ridge_errors(rows.withColumn("f", F.when(F.col("g") == g, 0).otherwise(-1)), COLS, y="t", folds=["f"], k=1)
            assert abs(alone.first()["mae"] - r["score"]) < 1e-9


def test_effects_of_groups_equal_fits_on_their_rows(rows):
    got = models.group_effects(rows, COLS, variables=COLS, group="g", id_col="id", resamples=40)
    found = {(r["g"], r["variable"]): r for r in got.collect()}
    assert set(found) == {("u", "a"), ("u", "b"), ("v", "a"), ("v", "b"), ("w", "a")}
    for (g, v), r in found.items():
        cols = ["a"] if g == "w" else COLS
        fit = models.fit_logistic(rows.where(F.col("g") == g), cols, how="standard")
        assert abs(np.log(r["odds_ratio"]) - fit.beta[0][cols.index(v)]) < 1e-6
        assert r["low"] < r["odds_ratio"] < r["high"]


def test_a_subset_without_a_varying_column_is_told(rows):
    with pytest.raises(ValueError, match="no column varies"):
        jobs.compare_on_subsets(rows.withColumn("f", F.col("id") % 5), {"w": F.col("g") == "w"}, {"only": ["b"]}, y="t", folds=["f"])


def test_resamples_begin_at_the_fit_of_all_rows_and_end_alike(spark, monkeypatch):
    from fallpoint.lineage import cut
    from fallpoint.plans import draws

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    rows = [(int(i), float(a), None if i % 11 == 0 else float(b), int(rng.random() < 1 / (1 + np.exp(-a)))) for i, (a, b) in enumerate(x)]
    data = cut(draws.with_keys(spark.createDataFrame(rows, "id long, a double, b double, y int"), "id", 0))
    member = models.Membership(draws=("_k1", "_k2"), count=20)
    passes, plain = [], models._summed
    monkeypatch.setattr(models, "_summed", lambda *a: passes.append(1) or plain(*a))
    full = models.fit_logistic(data, ["a", "b"])
    same = models.Scaling(*[np.repeat(v, 20, axis=0) for v in (full.scaling.median, full.scaling.center, full.scaling.scale)])
    passes.clear()
    cold = models.fit_logistic(data, ["a", "b"], member=member, scaling=same, tol=1e-4)
    n_cold = len(passes)
    assert np.allclose(cold.beta, models.fit_logistic(data, ["a", "b"], member=member, scaling=same, start=models._begin(full, 20)).beta, atol=1e-6)
    passes.clear()
    models.fit_logistic(data, ["a", "b"], member=member, scaling=same, tol=1e-4, start=np.concatenate([cold.intercept[:, None], cold.beta], axis=1))
    assert len(passes) == 1 < n_cold


def test_few_training_sets_need_no_products_of_columns(spark, monkeypatch):
    """A pass over rows in folds holds tables of rows by columns, not of rows by pairs of columns."""
    import tracemalloc

    cols = [f"c{i}" for i in range(30)]
    small = spark.createDataFrame([(0, 0.0, *[0.0] * 30)], "f long, y double, " + ", ".join(f"{c} double" for c in cols))
    caught = []
    monkeypatch.setattr(models, "_summed", lambda rows, sums, m: caught.append(sums) or np.zeros((m, 0)))
    flat = np.zeros((5, 30))
    models.fit_logistic(small, cols, member=models.Membership(("f",), 5), scaling=models.Scaling(flat, flat, flat + 1.0))
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(2000, 30)), columns=cols).assign(f=np.arange(2000) % 5, y=rng.integers(0, 2, 2000).astype(float))
    pdf.loc[::7, "c3"] = np.nan
    tracemalloc.start()
    got = caught[0](pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x = np.concatenate([np.ones((2000, 1)), np.nan_to_num(pdf[cols].to_numpy())], axis=1)
    for j in range(5):
        on = (pdf["f"] != j).to_numpy()
        np.testing.assert_allclose(got[j, 34:], (0.25 * x[on].T @ x[on])[np.triu_indices(31)], rtol=1e-12, atol=1e-9)
    assert peak < 8_000_000
