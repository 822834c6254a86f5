"""Tail probabilities that Spark has no function for; applied to short summary tables.

Each is a pandas UDF over already aggregated rows (one per test), never over data rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def _udf(kind: str):
    """Self-contained worker function, so executors need nothing but the standard library."""

    def compute(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        import math

        def inc_beta(p, q, x):
            """Regularised incomplete beta function by its continued fraction."""
            if x <= 0 or x >= 1:
                return 0.0 if x <= 0 else 1.0
            if x > (p + 1) / (p + q + 2):
                return 1.0 - inc_beta(q, p, 1 - x)
            front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q)
                             + p * math.log(x) + q * math.log1p(-x)) / p
            up, down, value = 1.0, 0.0, 1.0
            for i in range(500):
                m = i // 2
                if i == 0:
                    num = 1.0
                elif i % 2 == 0:
                    num = m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m))
                else:
                    num = -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))
                down = 1.0 / ((1 + num * down) or 1e-300)
                up = (1 + num / up) or 1e-300
                value *= up * down
                if abs(up * down - 1) < 1e-15:
                    break
            return front * (value - 1)

        def solve(p, q, target):
            lo, hi = 0.0, 1.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if inc_beta(p, q, mid) < target else (lo, mid)
            return (lo + hi) / 2

        def one(x, y, z):
            if x is None or y is None or any(map(math.isnan, (x, y, z))):
                return None
            if kind == "normal":
                return min(1.0, math.erfc(abs(x) / math.sqrt(2)))
            if kind == "student":
                return inc_beta(y / 2, 0.5, y / (y + x * x)) if y > 0 else None
            if kind == "lower":
                return 0.0 if x == 0 else solve(x, y - x + 1, z / 2)
            return 1.0 if x == y else solve(x + 1, y - x, 1 - z / 2)

        return pd.Series([one(*t) for t in zip(a, b, c)], dtype="float64")

    return F.pandas_udf(compute, "double")


def normal_two_sided(z):
    """P(|Z| >= |z|) under the standard normal."""
    return _udf("normal")(z.cast("double"), F.lit(0.0), F.lit(0.0))


def student_two_sided(t, dof):
    """P(|T| >= |t|) under Student's t."""
    return _udf("student")(t.cast("double"), dof.cast("double"), F.lit(0.0))


def exact_interval(k, n, alpha: float = 0.05):
    """Clopper-Pearson bounds for k hits out of n, as two columns."""
    args = (k.cast("double"), n.cast("double"), F.lit(float(alpha)))
    return _udf("lower")(*args), _udf("upper")(*args)
