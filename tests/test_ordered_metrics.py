import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fallpoint.operators import compare, ordered, stats
from fallpoint.plans import metrics, resample


@pytest.fixture(scope="module", params=[1, 40])
def path(request, spark):
    """Few and many key ranges must agree with brute force."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], str(request.param))
    spark.conf.set(names[1], "false")
    yield request.param
    for n, v in zip(names, old):
        spark.conf.set(n, v)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    n = 4000
    return pd.DataFrame({"i": range(n), "g": rng.choice(["a", "b", "c"], n, p=[.7, .2, .1]), "x": np.round(rng.normal(size=n), 1),
                         "y": rng.integers(0, 2, n)})


def test_quantiles_ranks_index(spark, path, points):
    df = spark.createDataFrame(points)
    q = ordered.exact_quantiles(df, by="g", value="x", probs=[.1, .5, .75], names=["a", "b", "c"]).toPandas().set_index("g")
    want = points.groupby("g")["x"].quantile([.1, .5, .75]).unstack()
    assert np.allclose(q.loc[want.index, ["a", "b", "c"]].to_numpy(dtype=float), want.to_numpy())
    r = ordered.average_ranks(df, key="x").toPandas().set_index("x")["rank"]
    assert np.allclose(points["x"].map(r), points["x"].rank())
    d = ordered.dense_index(df, by="g", key=F.struct("x", "i")).toPandas().sort_values(["g", "x", "i"])
    assert (d["index"] == d.groupby("g").cumcount()).all()


def test_auc_and_rank_sum(spark, path, points):
    df = spark.createDataFrame(points)
    got = metrics.auc(df, score="x", by="g").toPandas().set_index("g")["auc"]
    for g, part in points.groupby("g"):
        p, n = part.x[part.y == 1].to_numpy(), part.x[part.y == 0].to_numpy()
        want = ((p[:, None] > n).mean() + (p[:, None] == n).mean() / 2)
        assert got[g] == pytest.approx(want)
    u = stats.rank_sum_test(df, value="x", second=F.col("y") == 1).first()
    p, n = points.x[points.y == 1].to_numpy(), points.x[points.y == 0].to_numpy()
    assert u["u"] == pytest.approx((p[:, None] > n).sum() + (p[:, None] == n).sum() / 2) and 0 <= u["p"] <= 1


def test_single_class_auc_is_null(spark, path):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert metrics.auc(df, score="s").first()["auc"] is None


def test_concordance(spark, path):
    rng = np.random.default_rng(5)
    n = 250
    t, e, s = rng.integers(1, 15, n), rng.integers(0, 2, n), np.round(rng.normal(size=n), 1)
    df = spark.createDataFrame(pd.DataFrame({"t": t.astype(float), "e": e, "s": s}))
    good = pairs = 0
    for i in range(n):
        for j in range(n):
            if e[i] == 1 and (t[i] < t[j] or (t[i] == t[j] and e[j] == 0)):
                pairs += 1
                good += 1.0 if s[i] < s[j] else 0.5 if s[i] == s[j] else 0.0
    got = metrics.concordance(df, time="t", event="e", score="s").first()
    assert got["pairs"] == pairs and got["concordance"] == pytest.approx(good / pairs)


def test_concordance_of_large_and_fractional_times(spark, path):
    both = spark.createDataFrame([(1.0, 1, 0.1), (3_000_000.0, 1, 0.2)], "t double, e int, s double")
    got = metrics.concordance(both, time="t", event="e", score="s").first()
    assert got["pairs"] == 1 and got["concordance"] == 1
    close = spark.createDataFrame([(1.2, 1, 0.5), (1.8, 1, 0.2), (1.8, 0, 0.9)], "t double, e int, s double")
    got = metrics.concordance(close, time="t", event="e", score="s").first()
    assert got["pairs"] == 3 and got["concordance"] == pytest.approx(2 / 3)


def test_spearman(spark, path, points):
    pdf = points.assign(z=lambda d: np.round(d.x + np.random.default_rng(1).normal(size=len(d)), 1))
    got = stats.spearman(spark.createDataFrame(pdf), x="x", y="z", by="g", p_value=True).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert got.loc[g, "rho"] == pytest.approx(np.corrcoef(part.x.rank(), part.z.rank())[0, 1])


def test_folds_cover_and_balance(spark):
    ids = spark.range(103).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("s"))
    f = resample.fold_of(ids, id_col="id", k=5, repeats=2).toPandas()
    assert len(f) == 206 and (f.groupby(["repeat", "fold"]).size().agg(["min", "max"]).tolist() == [20, 21])
    s = resample.fold_of(ids, id_col="id", k=5, stratum="s").toPandas().merge(ids.toPandas(), on="id")
    assert s.groupby(["s", "fold"]).size().max() - s.groupby(["s", "fold"]).size().min() <= 1


def test_bootstrap_and_shuffle(spark):
    ids = spark.range(50).select(F.col("id").cast("string").alias("id"), F.col("id").cast("double").alias("v"))
    c = resample.bootstrap_counts(ids, id_col="id", resamples=20).toPandas()
    # Weights are Poisson: the size of a resample varies around the number of entities.
    assert 45 < c.groupby("b")["times"].sum().mean() < 55 and c["b"].nunique() == 20 and (c["times"] > 0).all()
    s = resample.shuffled(ids, id_col="id", value="v", rounds=5).toPandas()
    for _, part in s.groupby("b"):
        assert sorted(part["shuffled"]) == sorted(part["v"]) and (part["shuffled"] != part["v"]).any()


def test_permutation_floor_and_group_out(spark):
    rows = spark.createDataFrame([(str(i), float(i), float(i)) for i in range(30)], "id string, y double, x double")
    score = lambda d: d.groupBy("b").agg((-F.abs(F.corr("x", "y"))).alias("score"))
    got = resample.permutation_test(score, rows, id_col="id", label="y", n_permutations=49).first()
    assert got["p_value"] == pytest.approx(1 / 50) and got["p_min"] == pytest.approx(1 / 50)
    rows = spark.createDataFrame([(i, "a" if i < 5 else "b", float(i)) for i in range(10)], "id int, g string, y double")
    seen = []

    def fit(train, test):
        seen.append((set(r["g"] for r in train.collect()), set(r["g"] for r in test.collect())))
        return test.withColumn("prediction", F.lit(train.agg(F.avg("y")).first()[0]))

    out = resample.leave_one_group_out(fit, rows, group="g", metric=F.avg(F.abs(F.col("y") - F.col("prediction")))).toPandas()
    assert len(out) == 2 and all(not (a & b) for a, b in seen) and out["score"].tolist() == [5.0, 5.0]


def test_overlap_and_verdict(spark):
    rows = [(f, v, float(s)) for f, top in enumerate((["a", "b"], ["a", "c"], ["a", "b"])) for s, v in enumerate(reversed(top))]
    got = compare.top_overlap(spark.createDataFrame(rows, "f int, v string, s double"), fold="f", name="v", value="s", k=2)
    assert got.first()["mean_overlap"] == pytest.approx((1 + 2 + 1) / 3)
    df = spark.createDataFrame([(0.02, 0.1), (-0.2, -0.1), (0.0, 0.1), (-0.1, 0.1)], "l double, h double")
    v = [r[0] for r in df.select(compare.verdict(F.col("l"), F.col("h"))).collect()]
    assert v == ["wins", "loses", "touches zero", "inconclusive"]


def hot_rows(spark, n=4000):
    """One value in nine rows of ten, ties elsewhere, missing keys and values."""
    import random

    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "b", None]), None if i % 50 == 0 else 5.0 if rnd.random() < 0.9 else float(rnd.randrange(12)), float(rnd.randrange(4)))
            for i in range(n)]
    return spark.createDataFrame(rows, "i long, g string, x double, y double"), rows


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranks_of_a_very_common_value(spark, by):
    import pandas as pd

    data, rows = hot_rows(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = stats.ranked(data, value="x", by=by).toPandas().set_index("i").sort_index()
        spread = ordered.row_ranks(data.where("x is not null"), by=by, key="x", salt=F.col("i"), keep_range=True).groupBy("_range").count().toPandas()["count"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    pdf = pd.DataFrame(rows, columns=["i", "g", "x", "y"]).set_index("i")
    parts = pdf.groupby(pdf["g"].fillna("-"))["x"] if by else pdf["x"]
    want = parts.rank(ascending=False)
    assert len(got) == len(rows) and got["rank"].isna().equals(want.isna())
    assert (got["rank"].dropna() == want.dropna()).all()
    assert len(spread) >= 12 and spread.max() < 3 * spread.mean()


@pytest.mark.parametrize("by", [[], ["g"]])
def test_spearman_of_a_very_common_value(spark, by):
    import pandas as pd

    data, rows = hot_rows(spark)
    got = stats.spearman(data, x="x", y="y", by=by).toPandas()
    pdf = pd.DataFrame(rows, columns=["i", "g", "x", "y"]).dropna(subset=["x", "y"])
    for _, r in got.iterrows():
        part = pdf if not by else pdf[pdf["g"].isna()] if r["g"] is None else pdf[pdf["g"] == r["g"]]
        assert r["pairs"] == len(part) and abs(r["rho"] - part["x"].rank().corr(part["y"].rank())) < 1e-9
    plan = stats.ranked(data, value="x", by=by)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Join" in line and "x#" in line.split("Join")[1]]
