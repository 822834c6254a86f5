"""Fits of the co-training settle on every input, in a number of steps that does not grow with the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fallpoint.llm import cotraining


def passes_of(d, y, w):
    count = [0]

    def evaluate(betas):
        count[0] += 1
        return np.concatenate([cotraining.logistic_cells(d, y, w, b) for b in betas])

    beta, = cotraining.settled([np.zeros(d.shape[1])], [np.zeros(d.shape[1])], cotraining.RIDGE, evaluate)
    return beta, count[0]


@pytest.mark.parametrize("case", ["one class", "separable", "mixed", "rare"])
def test_steps_do_not_grow_with_the_rows(case):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(200, 3)), 1)
    d = np.column_stack((x, np.ones(200)))
    y = {"one class": np.ones(200), "separable": (x[:, 0] > 0) * 1.0, "mixed": (x[:, 0] + rng.normal(size=200) > 0) * 1.0,
         "rare": (np.arange(200) == 3) * 1.0}[case]
    steps = []
    for copies in (1, 2_000, 5_000_000, 50_000_000_000):
        beta, n = passes_of(d, y, np.full(200, float(copies)))
        steps.append(n)
        gradient = cotraining.logistic_cells(d, y, np.full(200, float(copies)), beta)[2:6] + max(cotraining.RIDGE, cotraining.PRIOR_SHARE * 200 * copies) * beta
        assert np.abs(gradient).max() < 1e-2 * 200 * copies
    assert max(steps) <= 15 and steps[-1] == steps[-2] == steps[-3]


def test_combine_raises_instead_of_returning_an_unsettled_fit(monkeypatch):
    monkeypatch.setattr(cotraining, "NEWTON", 1)
    with pytest.raises(RuntimeError, match="settle"):
        passes_of(np.ones((4, 1)), np.array([0.0, 1.0, 1.0, 1.0]), np.ones(4))


def test_one_text_four_hundred_thousand_times(spark):
    hot = F.col("id") < 400_000
    docs = spark.range(400_600).select(F.col("id").alias("doc_id"), F.when(hot, "the same good text again").when(
        F.col("id") % 2 == 0, F.concat(F.lit("fine words number "), F.col("id").cast("string"))).otherwise(F.lit("#### !!!! $$$$")).alias("text"),
        F.when(hot, "web").otherwise("other").alias("source"), F.lit("en").alias("lang"), F.lit(10).cast("long").alias("n_chars"))
    labels = docs.where((F.col("doc_id") % 3 == 0) | ~hot).select("doc_id", F.when(F.col("text").startswith("#"), 0).otherwise(1).alias("quality"))
    got = cotraining.classify_quality(docs, labels).join(docs.select("doc_id", "text"), "doc_id").groupBy("text").agg(F.avg(F.col("kept").cast("double")).alias("kept"), F.count("*").alias("n"))
    kept = {r["text"]: r["kept"] for r in got.where("n > 1").collect()}
    assert kept == {"the same good text again": 1.0, "#### !!!! $$$$": 0.0}
