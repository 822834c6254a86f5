"""Keyed weights and shuffles: the same numbers everywhere, permutations of every size, nothing multiplied before a shuffle."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fallpoint.plans import draws, metrics, resample


def test_shuffle_is_a_permutation_of_every_size():
    for n in range(1, 1001):
        got = draws.donor_positions(np.arange(n), np.full(n, n), np.arange(4), seed=n)
        assert (np.sort(got, axis=0) == np.arange(n)[:, None]).all(), n


def test_shuffles_spread_like_random_ones():
    n, rounds = 300, 4000
    got = draws.donor_positions(np.arange(n), np.full(n, n), np.arange(rounds))
    fixed = (got == np.arange(n)[:, None]).sum(axis=0)
    x = np.arange(n) - (n - 1) / 2
    r = x @ x[got] / (x @ x) * np.sqrt(n - 1)
    assert abs(fixed.mean() - 1) < 0.06 and abs(r.mean()) < 0.06 and abs(r.std() - 1) < 0.05


def test_weights_are_poisson_and_the_same_in_spark_and_numpy(spark):
    ids = draws.with_keys(spark.range(400), "id", seed=3)
    long = draws.with_weight(ids.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(299)))), F.col("b")).toPandas()
    keys = ids.toPandas().sort_values("id")
    want = draws.poisson_weights(keys["_k1"], keys["_k2"], 300)
    assert (long.pivot(index="id", columns="b", values="times").sort_index().to_numpy() == want).all()
    assert abs(want.mean() - 1) < 0.02 and abs(want.var() - 1) < 0.03
    assert (draws.poisson_weights(keys["_k1"], keys["_k2"], 10, start=50) == want[:, 50:60]).all()


def rows_of(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    out = [(i % 40, ["u", "v", None][i % 3], int(rng.random() < 0.4), float(rng.integers(0, 4)), float(np.round(rng.random(), 1)) if i % 17 else None)
           for i in range(n)]
    return spark.createDataFrame(out, "id long, grp string, y int, a double, b double"), out


@pytest.mark.parametrize("by", [(), ("grp",)])
def test_bootstrap_auc_is_that_of_all_pairs(spark, by):
    data, rows = rows_of(spark)
    got = metrics.bootstrap_auc(data, id_col="id", score_a="a", score_b="b", resamples=50, seed=2, by=list(by)).toPandas()
    keys = {r["id"]: (r["_k1"], r["_k2"]) for r in draws.with_keys(data.select("id").distinct(), "id", 2).collect()}
    weight = {i: np.append(draws.poisson_weights([k[0]], [k[1]], 50)[0], 1.0) for i, k in keys.items()}

    def auc(part, s, b):
        pos = [(r[s], weight[r[0]][b]) for r in part if r[2] == 1 and r[s] is not None]
        neg = [(r[s], weight[r[0]][b]) for r in part if r[2] == 0 and r[s] is not None]
        total = sum(w for _, w in pos) * sum(w for _, w in neg)
        return sum(v * w * ((x > z) + (x == z) / 2) for x, v in pos for z, w in neg) / total if total else None

    groups = sorted({r[1] for r in rows}, key=str) if by else [()]
    assert len(got) == 2 * len(groups)
    for g in groups:
        part = [r for r in rows if not by or r[1] == g]
        both = [(auc(part, 3, b), auc(part, 4, b)) for b in range(51)]
        boot = [(q, q - p) for p, q in both[:50] if q is not None]
        for k, name in enumerate(("auc_b", "gain")):
            mine = got[(got["metric"] == name) & ((got["grp"].isna() if g is None else got["grp"] == g) if by else True)].iloc[0]
            want = both[50][1] - (both[50][0] if k else 0)
            assert abs(mine["value"] - want) < 1e-12
            assert np.allclose([mine["low"], mine["high"]], np.percentile([v[k] for v in boot], [2.5, 97.5]))


def test_intervals_per_group(spark):
    data, rows = rows_of(spark)
    got = resample.bootstrap_mean(data, id_col="id", values=["a", "b"], resamples=60, by="grp")
    alone = resample.bootstrap_mean(data.where("grp = 'u'"), id_col="id", values=["a", "b"], resamples=60)
    assert got.count() == 6
    assert {tuple(r) for r in got.where("grp = 'u'").drop("grp").collect()} == {tuple(r) for r in alone.collect()}


def test_no_exchange_holds_rows_times_resamples(spark):
    data, _ = rows_of(spark)
    counts = resample.bootstrap_counts(data, id_col="id", resamples=100)
    mean = resample.bootstrap_mean(data, id_col="id", values=["a"], resamples=100)
    null = resample.shuffled(data.dropDuplicates(["id"]), id_col="id", value="a", rounds=100).groupBy("b").agg(F.avg("shuffled"))
    for frame in (counts, mean, null):
        plan = frame._jdf.queryExecution().executedPlan().toString().split("\n")
        depth = lambda line: len(re.match(r"[\s:+\-*()\d]*", line).group())
        for i, line in enumerate(plan):
            if "Generate" not in line:
                continue
            level, above = depth(line), []
            for up in reversed(plan[:i]):
                if depth(up) < level:
                    above.append(up)
                    level = depth(up)
            first = next((u for u in above if "Exchange" in u and "Broadcast" not in u), None)
            assert first is None or any("Aggregate" in u for u in above[:above.index(first)]), "\n".join(plan)


def test_exact_draws_are_as_many_as_entities(spark):
    data, rows = rows_of(spark)
    for by in ((), ("grp",)):
        counts = resample.bootstrap_counts(data, id_col="id", resamples=30, by=list(by), exact=True)
        sizes = {tuple(r) for r in counts.groupBy("b", *by).agg(F.sum("times")).collect()}
        assert sizes == {(b, *g, n) for b in range(30) for g, n in ([((), 40)] if not by else [(("u",), 40), (("v",), 40), ((None,), 40)])}
    one = data.dropDuplicates(["id"]).select("id", "a")
    mean = resample.bootstrap_mean(one, id_col="id", values=["a"], resamples=30, exact=True).first()
    times = resample.bootstrap_counts(one, id_col="id", resamples=30, exact=True).join(one, "id").toPandas()
    per = (times["times"] * times["a"]).groupby(times["b"]).sum() / 40
    assert np.allclose([mean["low"], mean["high"]], np.percentile(per, [2.5, 97.5]))


def test_positions_are_formed_in_pieces(spark):
    """A task hands on at most PIECE rows of positions at a time, whatever the size of its batches."""
    rows = spark.range(0, 1000, 1, 1).select(F.col("id").alias("index"), F.lit(1000).cast("long").alias("n_group"), F.when(F.col("id") % 2 == 0, "a").alias("g"))
    plan = draws.with_donors(rows, 1200)
    assert "MapInArrow" in plan._jdf.queryExecution().executedPlan().toString() and draws.PIECE * draws.STRETCH <= 100_000
    got = plan.toPandas()
    want = draws.donor_positions(np.arange(1000), np.full(1000, 1000), np.arange(1200))
    assert (got.pivot(index="index", columns="b", values="donor").to_numpy() == want).all()
    assert set(got[got["index"] % 2 == 0]["g"]) == {"a"} and got[got["index"] % 2 == 1]["g"].isna().all()
