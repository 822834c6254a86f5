import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fallpoint.plans import models, panel
from fallpoint.plans.models import Membership

COLS = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 240
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 3, 1]
    z = x[:, 0] + 0.3 * x[:, 1] - 1.2
    pdf = pd.DataFrame(x, columns=COLS).assign(y=(rng.random(n) < 1 / (1 + np.exp(-z))).astype(int), t=2 * x[:, 0] + x[:, 1] + rng.normal(size=n),
                                               f0=np.arange(n) % 4, f1=rng.permutation(np.arange(n) % 4), id=np.arange(n) // 3)
    pdf.loc[rng.random(n) < 0.1, "x1"] = np.nan
    pdf["time"] = np.maximum(1, np.round(12 - z + rng.normal(size=n))).astype(float)
    pdf["e"] = (rng.random(n) < 0.8).astype(int)
    return pdf


def frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("x1", F.when(~F.isnan("x1"), F.col("x1"))).repartition(5)


def robust(pdf, train):
    x = pdf[COLS].fillna(train[COLS].median())
    q = train[COLS].quantile([.25, .75])
    return ((x - train[COLS].median()) / (q.loc[.75] - q.loc[.25])).to_numpy()


def newton(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    b, r = np.zeros(x.shape[1]), np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        h = 1 / (1 + np.exp(-x @ b))
        b = b - np.linalg.solve((x * (h * (1 - h))[:, None]).T @ x + r, x.T @ (h - y) + r @ b)
    return b


def test_logistic_per_fold(spark, data):
    fits = models.fit_logistic(frame(spark, data), COLS, member=Membership(("f0", "f1"), 4))
    for r, f in ((0, 1), (1, 3)):
        train = data[data[f"f{r}"] != f]
        want = newton(robust(train, train), train.y.to_numpy())
        i = r * 4 + f
        assert np.allclose([fits.intercept[i], *fits.beta[i]], want, atol=1e-6)
    got = models.predict_risk(frame(spark, data), fits, folds=["f0", "f1"], k=4).toPandas()
    assert got["p"].between(0, 1).all() and len(got) == len(data)
    row = got.iloc[0]
    p = []
    for r in (0, 1):
        train = data[data[f"f{r}"] != row[f"f{r}"]]
        b = newton(robust(train, train), train.y.to_numpy())
        xi = robust(pd.DataFrame([row[COLS]]).astype(float), train)[0]
        p.append(1 / (1 + np.exp(-(b[0] + xi @ b[1:]))))
    assert row["p"] == pytest.approx(np.mean(p), abs=1e-6)


def test_odds_ratios_bracket(spark, data):
    df = frame(spark, data)
    got = models.odds_ratios(df, COLS, variables=COLS, id_col="id", resamples=25).toPandas().set_index("variable")
    assert (got.low <= got.odds_ratio * 1.5).all() and got.loc["x0", "excludes_1"] and got.loc["x0", "odds_ratio"] > 1


def test_ridge_leave_one_out(spark, data):
    alphas = [0.01, 1.0, 30.0, 1000.0]
    got = models.ridge_errors(frame(spark, data), COLS, y="t", folds=["f0"], k=4, alphas=alphas).toPandas().set_index("fold")
    for f in range(4):
        tr, te = data[data.f0 != f], data[data.f0 == f]
        med = tr[COLS].median()
        a, b = tr[COLS].fillna(med), te[COLS].fillna(med)
        mu, sd = a.mean(), a.std(ddof=0)
        a, b, y = ((a - mu) / sd).to_numpy(), ((b - mu) / sd).to_numpy(), tr.t.to_numpy()
        loo = []
        for alpha in alphas:
            h = 1 / len(a) + np.einsum("ij,jk,ik->i", a, np.linalg.inv(a.T @ a + alpha * np.eye(3)), a)
            w = np.linalg.solve(a.T @ a + alpha * np.eye(3), a.T @ (y - y.mean()))
            loo.append(np.mean(((y - y.mean() - a @ w) / (1 - h)) ** 2))
        alpha = alphas[int(np.argmin(loo))]
        w = np.linalg.solve(a.T @ a + alpha * np.eye(3), a.T @ (y - y.mean()))
        assert got.loc[f, "alpha"] == alpha
        assert got.loc[f, "mae"] == pytest.approx(np.mean(np.abs(te.t - y.mean() - b @ w)))
    many = frame(spark, data.assign(labels=[[t, -t] for t in data.t]))
    two = models.ridge_errors(many, COLS, y="labels", folds=["f0"], k=4, alphas=alphas, labels=2).toPandas()
    assert np.allclose(two[two.b == 0].sort_values("fold")["mae"], got.sort_index()["mae"])
    assert np.allclose(two[two.b == 1].sort_values("fold")["mae"], got.sort_index()["mae"])


def test_median_errors(spark, data):
    got = models.median_errors(frame(spark, data), y="t", folds=["f0"], k=4).toPandas().set_index("fold")
    for f in range(4):
        tr, te = data[data.f0 != f], data[data.f0 == f]
        assert got.loc[f, "mae"] == pytest.approx((te.t - tr.t.median()).abs().mean())


def test_cox_score_is_zero_at_the_fit(spark, data):
    fits = models.fit_cox(frame(spark, data), COLS, time="time", event="e", penalizer=0.1)
    x = data[COLS].fillna(data[COLS].median())
    x = ((x - x.mean()) / x.std(ddof=1)).to_numpy()
    t, e, b = data.time.to_numpy(), data.e.to_numpy(), fits.beta[0]

    def loglik(b):
        out, r = -0.5 * 0.1 * len(x) * b @ b, np.exp(x @ b)
        for u in np.unique(t[e == 1]):
            tied = (t == u) & (e == 1)
            d = tied.sum()
            out += (x[tied] @ b).sum() - sum(np.log(r[t >= u].sum() - j / d * r[tied].sum()) for j in range(d))
        return out

    for j in range(3):
        h = np.eye(3)[j] * 1e-4
        assert abs(loglik(b + h) - loglik(b - h)) / 2e-4 < 1e-3
    c = models.cox_concordance(frame(spark, data), COLS, time="time", event="e", folds=["f0"], k=4).toPandas()
    assert c["concordance"].mean() > 0.7


def test_forest_components_attribution(spark, data):
    df = frame(spark, data.assign(id=np.arange(len(data))))
    got = models.forest_predictions(df, COLS, y="t", fold="f0", k=4, trees=8, depth=5).toPandas()
    assert len(got) == len(data) and np.corrcoef(got.t, got.prediction)[0, 1] > 0.5
    full = df.na.fill(3.0, COLS)
    scores, loads, shares = models.components(full, COLS, id_col="id", k=2)
    assert scores.count() == len(data) and loads.count() == 3 and 0 < shares.toPandas()["explained"].sum() <= 1
    att = models.sampled_attribution(df, COLS, y="t", fold="f0", id_col="id", k=4, orderings=2, trees=8, depth=5).toPandas()
    assert len(att) == 3 * len(data)
    imp = models.permutation_importance(df, COLS, y="t", fold="f0", id_col="id", k=4, repeats=1, trees=8, depth=5)
    top = imp.groupBy("variable").agg(F.avg("importance").alias("v")).orderBy(F.col("v").desc()).first()
    assert top["variable"] == "x1"


# ---------------------------------------------------------------- panel


def panel_table(kin, alphas, theta, days=14, seed=1, noise=0.0):
    """Series that follow the step equation exactly (one covariate ``c``)."""
    rng = np.random.default_rng(seed)
    rows = []
    for i, a in enumerate(alphas):
        x = np.cumsum(np.abs(rng.normal(0.6, 0.3, days))) + 1
        c = rng.normal(size=days)
        level, ev = 5.0, (8 if kin.state else None)
        for d in range(days):
            f = 1.0 if (ev and d + 1 >= ev) else 0.0
            rows.append((f"s{i}", d + 1, level, float(x[d]), float(c[d]), f, i % 3))
            if d + 1 < days:
                grow, area = max(x[d + 1] - x[d], 0), (x[d] + x[d + 1]) / 2
                make, use = (1 - f, f) if kin.state else (1.0, 1.0)
                level = level + make * (a * grow + theta[0] * area + theta[2] * grow * c[d]) - use * theta[1] * level * area
                level = max(level + noise * rng.normal(), 0.0)
    return pd.DataFrame(rows, columns=["id", "day", "level", "exposure", "c", "state", "fold"])


@pytest.mark.parametrize("state", [None, "state"])
def test_panel_fit_recovers_parameters_and_profiles(spark, state):
    kin = panel.Kinetics(covariates=("c",), state=state)
    alphas, theta = [2.0, 3.0, 4.0, 2.5, 3.5, 1.0], (0.2, 0.05, 0.4)
    df = spark.createDataFrame(panel_table(kin, alphas, theta))
    mean, sd = np.zeros((3, 1)), np.ones((3, 1))
    inter = panel.interval_columns(df, kin, id_col="id")
    mom = panel.series_moments(inter, kin, id_col="id", keys=["fold"])
    fits = panel.fit_panel(mom, kin, fold="fold", folds=3, mean=mean, sd=sd)
    for f in range(3):
        train = [a for i, a in enumerate(alphas) if i % 3 != f]
        assert np.allclose(fits.theta[0, f], [np.mean(train), *theta], atol=1e-5)
    params = fits.frame(spark).withColumn("shrink", F.lit(0.0))
    own = panel.with_own_alpha(inter, params, kin, id_col="id")
    got = {r["id"]: r["alpha"] for r in own.groupBy("id").agg(F.max("alpha").alias("alpha")).collect()}
    assert all(got[f"s{i}"] == pytest.approx(a, abs=1e-4) for i, a in enumerate(alphas))
    steps = panel.step_columns(own, kin)
    sim = panel.simulate(steps, id_col="id", day_col="day", level_col="level").toPandas()
    assert np.allclose(sim["level"], sim["simulated"], atol=1e-4)
    two = panel.two_step_errors(steps, id_col="id", day_col="day", level_col="level").toPandas()["error2"].dropna()
    assert len(two) == 6 * 12 and np.abs(two).max() < 1e-4


def test_negative_own_coefficient_is_clamped(spark):
    kin = panel.Kinetics()
    pdf = panel_table(panel.Kinetics(covariates=("c",)), [2.0, -1.0, 3.0], (0.0, 0.05, 0.0), noise=0.01)
    df = spark.createDataFrame(pdf.assign(fold=-1))
    mom = panel.series_moments(panel.interval_columns(df, kin, id_col="id"), kin, id_col="id", keys=["fold"])
    fits = panel.fit_panel(mom, kin, fold="fold", folds=1, mean=np.zeros((1, 0)), sd=np.ones((1, 0)))
    assert (fits.theta[0, 0] >= 0).all() and fits.mse[0, 0] > 0


def test_simulate_restart_saturable_and_floor(spark):
    df = spark.createDataFrame([("a", d, lv, 0.0, 0.1, 2.0, 1.0, 0.5, 3) for d, lv in enumerate([9.0, 5.0, 4.0, 2.0, 9.0], 1)],
                               "id string, day int, level double, gain double, loss double, sat double, half double, floor double, start int")
    sim = panel.simulate(df, id_col="id", day_col="day", level_col="level", half="half", floor="floor", start_day="start").toPandas()
    want, s = [None, None, 4.0], 4.0
    for _ in range(2):
        above = max(s - 0.5, 0)
        s = max(s - 0.1 * s - 2.0 * above / (1.0 + above), 0)
        want.append(s)
    got = sim.sort_values("day")["simulated"].tolist()
    assert np.isnan(got[:2]).all() and np.allclose(got[2:], want[2:])


def test_simulate_long_series(spark):
    n = 1000
    df = spark.range(n).selectExpr("'a' as id", "cast(id + 1 as int) as day", "10.0D as level", "1.0D as gain", "0.01D as loss", "0.0D as sat")
    sim = panel.simulate(df, id_col="id", day_col="day", level_col="level").toPandas().sort_values("day")["simulated"].to_numpy()
    want = 100 - 90 * 0.99 ** np.arange(n)
    assert len(sim) == n and np.allclose(sim, want)


def test_bounded_minimum():
    a, b = np.array([[2.0, 0.5], [0.5, 1.0]]), np.array([-1.0, 2.0])
    assert np.allclose(panel.bounded_minimum(a, b, [0.0, 0.0]), [0.0, 2.0])
    assert np.allclose(panel.bounded_minimum(a, b, [-np.inf, -np.inf]), np.linalg.solve(a, b))


def test_expected_trajectory_of_a_sure_switch_is_the_sharp_profile(spark):
    kin = panel.Kinetics(covariates=("c",), state="state")
    pdf = panel_table(kin, [2.0, 3.0, 4.0], (0.2, 0.05, 0.4))
    df = spark.createDataFrame(pdf.assign(fold=-1))
    one = (np.zeros((1, 1)), np.ones((1, 1)))
    mom = panel.series_moments(panel.interval_columns(df, kin, id_col="id"), kin, id_col="id", keys=["fold"])
    fits = panel.fit_panel(mom, kin, fold="fold", folds=1, mean=one[0], sd=one[1])
    params = fits.frame(spark).withColumn("fold", F.lit(-1)).withColumn("shrink", F.lit(0.0))
    found = panel.expected_trajectory(df, params, kin, id_col="id")
    got = found.toPandas()
    assert "Generate explode" not in found._jdf.queryExecution().executedPlan().toString()
    assert np.allclose(got["level"], got["expected"], atol=1e-4) and (got["modal_day"] == 8).all()


def test_ridge_entity_errors_average_to_the_fold_errors(spark, data):
    from fallpoint.plans import jobs

    df = frame(spark, data.assign(id=np.arange(len(data)), g=np.where(data.x0 > 0, "a", "b")))
    one = models.ridge_entity_errors(df, COLS, y="t", folds=["f0"], k=4).toPandas()
    per = models.ridge_errors(df, COLS, y="t", folds=["f0"], k=4).toPandas().set_index("fold")["mae"]
    assert np.allclose(one.groupby("f0")["ridge"].mean(), per.sort_index())
    got = jobs.baseline_comparison(df, COLS, y="t", group="g", id_col="id", folds=["f0"], k=4, resamples=20)
    ci = got["intervals"].toPandas().set_index("rival")
    assert (ci["low"] <= ci["mean"]).all() and (ci["verdict"] == "wins").all()
    assert got["errors"].count() == len(data)
