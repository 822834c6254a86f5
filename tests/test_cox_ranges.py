"""Cox fits over ranges of times: ties that several ranges share, very many distinct times, shuffled labels as sets of one fit."""

import time as clock

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fallpoint.plans import models
from fallpoint.plans.models import Membership


def efron_newton(x, t, e, penalizer, steps=25):
    """Plain Efron fit of one column: sums over the rows at risk, time by time."""
    x = (x - x.mean()) / x.std(ddof=1)
    b = 0.0
    for _ in range(steps):
        g, h = e @ x - penalizer * len(x) * b, penalizer * len(x)
        for u in np.unique(t[e == 1]):
            at, hit = t >= u, (t == u) & (e == 1)
            r = np.exp(b * x)
            for j in range(hit.sum()):
                w = r * at - j / hit.sum() * r * hit
                mean = (w @ x) / w.sum()
                g, h = g - mean, h + (w @ (x * x)) / w.sum() - mean * mean
        b += g / h
    return b


def table(n=900, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    t = np.where(rng.random(n) < 0.4, 7.0, np.round(rng.exponential(np.exp(-0.7 * x)) * 6) + 1)
    return pd.DataFrame({"id": np.arange(n), "x": x, "z": rng.normal(size=n), "t": t, "e": (rng.random(n) < 0.7).astype(int), "f0": np.arange(n) % 3})


def test_a_time_of_four_rows_in_ten_over_many_ranges(spark):
    pdf = table()
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        fit = models.fit_cox(spark.createDataFrame(pdf).repartition(5), ["x"], time="t", event="e", penalizer=0.1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    want = efron_newton(pdf["x"].to_numpy(), pdf["t"].to_numpy(), pdf["e"].to_numpy(), 0.1)
    assert abs(fit.beta[0, 0] - want) < 1e-7


def test_shuffled_sets_equal_fits_of_their_own(spark):
    pdf = table(300, 5)
    sets = [pdf.assign(b=s, **pdf[["t", "e"]].sample(frac=1.0, random_state=s).reset_index(drop=True).to_dict("series")) for s in range(3)]
    whole = spark.createDataFrame(pd.concat(sets))
    fits = models.fit_cox(whole, ["x", "z"], time="t", event="e", member=Membership(("f0",), 3), sets="b", count=3)
    for s in range(3):
        alone = models.fit_cox(spark.createDataFrame(sets[s]), ["x", "z"], time="t", event="e", member=Membership(("f0",), 3))
        assert np.allclose(fits.beta[3 * s:3 * s + 3], alone.beta, atol=1e-9)
    got = models.cox_permutation(spark.createDataFrame(pdf), ["x", "z"], time="t", event="e", id_col="id", folds=["f0"], k=3, n_permutations=9).first()
    assert got["observed"] > got["null_mean"] and got["p_value"] == 0.1 and got["n_permutations"] == 9


def test_a_million_distinct_times(spark):
    n = 1_000_000
    x = (F.pmod(F.xxhash64("id"), F.lit(2001)) - 1000) / 577.0
    u = (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10 ** 9)) + 1) / 1e9
    rows = spark.range(n).select(x.alias("x"), (-F.log(u) * F.exp(-0.5 * x) + F.col("id") * 1e-12).alias("t"), F.lit(1).alias("e"))
    start = clock.time()
    fit = models.fit_cox(rows, ["x"], time="t", event="e", penalizer=0.0)
    assert abs(fit.beta[0, 0] / rows.agg(F.stddev("x")).first()[0] - 0.5) < 0.01
    assert clock.time() - start < 600


@pytest.mark.parametrize("run", [1, 40, 500])
def test_sums_by_time_either_way(monkeypatch, run):
    rng = np.random.default_rng(run)
    n, p = 1000, 3
    x, r, e, w = rng.normal(size=(n, p)), rng.random(n), (rng.random(n) < 0.4).astype(float), rng.integers(0, 3, n).astype(float)
    begin = np.arange(0, n, run)
    laid_out = []
    for least in (0, n + 1):
        monkeypatch.setattr(models, "COX_RUN", least)
        laid_out.append(models.time_sums(x, r, e, w, begin))
    assert laid_out[0].shape == (len(begin), 2 * (1 + p + p * p) + 1 + p)
    np.testing.assert_allclose(laid_out[0], laid_out[1], rtol=1e-12, atol=1e-12)


def test_products_of_rows_are_not_laid_out_for_large_times():
    """Memory of one time with many rows: 2 q + 1 + p numbers a row before, some p + 1 now."""
    import tracemalloc

    n, p = 20_000, 12
    x, r = np.ones((n, p)), np.ones(n)
    tracemalloc.start()
    models.time_sums(x, r, r, r, np.array([0]))
    assert tracemalloc.get_traced_memory()[1] < n * 8 * 60
    tracemalloc.stop()


def test_few_times_are_summed_in_one_pass_with_the_same_result(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 600
    rows = pd.DataFrame({"id": range(n), "x": rng.normal(size=n) * 30, "z": np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n)),
                         "t": rng.integers(1, 9, n).astype(float), "e": rng.integers(0, 2, n), "f0": rng.integers(0, 3, n), "s": rng.integers(0, 2, n)})
    data = spark.createDataFrame(rows)
    fit = lambda: models.fit_cox(data, ["x", "z"], time="t", event="e", member=Membership(("f0",), 3), sets="s", count=2).beta
    one = fit()
    monkeypatch.setattr(models, "COX_CELLS", 0)
    np.testing.assert_allclose(one, fit(), rtol=1e-8, atol=1e-10)
