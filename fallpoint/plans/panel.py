"""Panel kinetics: an own growth coefficient per series, shared bounded parameters.

Design rows of one-day intervals are reduced to one small moment matrix per series.  The
fit never sees rows again: series are independent given the shared parameters, so each
step adds up p x p tables over series, for all training folds and model shapes together.
Simulated profiles are folds over the ordered days of a series, inside Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from fallpoint.contracts import as_list, by_day
from fallpoint.functions.columns import not_below_zero, saturable
from fallpoint.lineage import few_rows
from fallpoint.operators import grid
from fallpoint.plans.models import _summed

# Half-saturation constants and level floors of the consumption forms.
HALVES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0)
FLOORS = (-0.05, -0.02, 0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.07)


@dataclass(frozen=True)
class Kinetics:
    """Shape of a panel model.

    ``state`` names the column of the switch (None: always on), ``inhibitor`` is None,
    ``level``, ``day`` or ``exposure``; ``dilution`` is a constant daily loss.
    """

    level: str = "level"
    exposure: str = "exposure"
    day: str = "day"
    covariates: tuple[str, ...] = ()
    state: str | None = None
    inhibitor: str | None = None
    dilution: float = 0.0

    @property
    def raw(self) -> list[str]:
        """Moment columns: growth, area, consumption, per covariate its product and presence."""
        out = ["u_grow", "u_area", "u_eat"]
        for i in range(len(self.covariates)):
            out += [f"u_c{i}", f"u_h{i}"]
        return out + (["u_inh"] if self.inhibitor else [])

    @property
    def names(self) -> list[str]:
        return (["alpha", "beta", "k"] + [f"a_{c}" for c in self.covariates] + (["c"] if self.inhibitor else []))

    @property
    def lower(self) -> list[float]:
        free = [-np.inf] * len(self.covariates)
        return [0.0, 0.0] + free + ([0.0] if self.inhibitor else [])

    def to_model(self, mean, sd) -> np.ndarray:
        """Linear map from moment columns to model columns, given covariate scaling."""
        q, p = len(self.raw), len(self.names)
        t = np.zeros((q, p))
        t[0, 0] = t[1, 1] = t[2, 2] = 1.0
        for i in range(len(self.covariates)):
            t[3 + 2 * i, 3 + i] = 1 / sd[i]
            t[4 + 2 * i, 3 + i] = -mean[i] / sd[i]
        if self.inhibitor:
            t[q - 1, p - 1] = 1.0
        return t


def profile_event_day(data: DataFrame, *, id_col, day_col: str, value_col: str, out: str = "event_day",
                      keep: Sequence[str] = ()) -> DataFrame:
    """First day of two falling steps after any rising one, on a given or simulated profile."""
    ids = as_list(id_col)
    w = by_day(ids, day_col)
    rows = data.withColumns({"_a": F.lead(value_col, 1).over(w), "_b": F.lead(value_col, 2).over(w)})
    rows = rows.withColumn("_up", F.max((F.col("_a") > F.col(value_col)).cast("int")).over(grid.before_now(w)))
    hit = (F.col("_a") < F.col(value_col)) & (F.col("_b") < F.col("_a")) & (F.col("_up") > 0)
    return rows.groupBy(*ids).agg(F.min(F.when(F.coalesce(hit, F.lit(False)), F.col(day_col))).alias(out),
                                  *[F.max(c).alias(c) for c in keep])


def interval_columns(rows: DataFrame, kin: Kinetics, *, id_col, half: Column | None = None,
                     floor: Column | None = None) -> DataFrame:
    """Rows of one-day intervals with the moment columns, the response and what a step needs."""
    ids = as_list(id_col)
    w = by_day(ids, kin.day)
    if kin.inhibitor == "exposure":
        rows = grid.running_exposure(rows, id_col=ids, day_col=kin.day, exposure_col=kin.exposure, out="_z")
    level, x = F.col(kin.level), F.col(kin.exposure)
    rows = rows.withColumns({"_l1": F.lead(kin.level).over(w), "_x1": F.lead(kin.exposure).over(w)})
    rows = rows.withColumns({"grow": not_below_zero(F.col("_x1") - x), "area": (x + F.col("_x1")) / 2})
    make = F.lit(1.0) if kin.state is None else 1 - F.col(kin.state)
    use = F.lit(1.0) if kin.state is None else F.col(kin.state)
    eaten = level if half is None and floor is None else saturable(level, half, floor)
    new = {"make": make, "use": use, "u_grow": make * F.col("grow"), "u_area": make * F.col("area"),
           "u_eat": -use * eaten * F.col("area"), "dy": F.col("_l1") - level + kin.dilution * level}
    for i, c in enumerate(kin.covariates):
        new[f"u_c{i}"] = make * F.col("grow") * F.coalesce(F.col(c), F.lit(0.0))
        new[f"u_h{i}"] = make * F.col("grow") * F.col(c).isNotNull().cast("double")
    if kin.inhibitor:
        z = {"level": level, "day": F.col(kin.day) / 10.0, "exposure": F.col("_z") if kin.inhibitor == "exposure" else level}
        new["z"] = z[kin.inhibitor]
        new["u_inh"] = -make * F.col("grow") * z[kin.inhibitor]
    return rows.withColumns(new).drop("_l1", "_x1", "_z")


def series_moments(intervals: DataFrame, kin: Kinetics, *, id_col, keys: Sequence[str] = (),
                   where: Column | None = None, more: Sequence[str] = ()) -> DataFrame:
    """One row per series with ``g``: all sums of products of (moment columns, 1, response, ``more`` columns)."""
    cols = [F.col(c) for c in kin.raw] + [F.lit(1.0), F.col("dy"), *map(F.col, more)]
    rows = intervals.where(F.col("dy").isNotNull() if where is None else (F.col("dy").isNotNull() & where))
    n = len(cols)
    aggs = [F.sum(cols[i] * cols[j]).alias(f"_{i}_{j}") for i in range(n) for j in range(i, n)]
    out = rows.groupBy(*as_list(id_col), *keys).agg(*aggs)
    cell = lambda i, j: F.col(f"_{min(i, j)}_{max(i, j)}")
    return out.select(*as_list(id_col), *keys, F.array(*[cell(i, j) for i in range(n) for j in range(n)]).alias("g"))


def diluted(moments: DataFrame, kin: Kinetics) -> DataFrame:
    """The moments of a model with a daily loss, from those of one without that hold the level behind the response (``more``)."""
    q, d = len(kin.raw), kin.dilution
    n = q + 3
    cell = lambda i, j: F.col("g")[i * n + j]
    row = lambda i: [cell(i, j) for j in range(q + 1)] + [cell(i, q + 1) + d * cell(i, q + 2)]
    last = [cell(q + 1, j) + d * cell(q + 2, j) for j in range(q + 1)] + [
        cell(q + 1, q + 1) + 2 * d * cell(q + 1, q + 2) + d * d * cell(q + 2, q + 2)]
    return moments.withColumn("g", F.array(*[c for i in range(q + 1) for c in row(i)], *last))


def form_moments(intervals: DataFrame, kin: Kinetics, forms: Sequence[tuple], *, id_col: str, fold: str) -> DataFrame:
    """One row per series with ``g`` as in ``series_moments`` and ``e``: for every consumption form (half, floor) the row of g that holds
    the sums of products with its consumption.  All else is alike in all forms, and rows are not multiplied by them.
    """
    q = len(kin.raw)
    n, place = q + 2, kin.raw.index("u_eat")
    use = F.lit(1.0) if kin.state is None else F.col(kin.state)
    rows = intervals.where(F.col("dy").isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(fold).cast("int").alias("_fold"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(kin.raw)],
        F.col("dy").cast("double").alias("_dy"), F.col(kin.level).cast("double").alias("_level"), (-use * F.col("area")).cast("double").alias("_unit"))
    rows = rows.repartition("_id").sortWithinPartitions("_id", "_fold")

    def run(batches):
        import numpy as np
        import pandas as pd

        held = None  # sums of the last series, which the next batch may go on with

        def told(ids, f, g, e):
            return pd.DataFrame({id_col: ids, fold: f, "g": list(g.reshape(len(g), -1)), "e": list(e.reshape(len(e), -1))})

        for pdf in batches:
            if not len(pdf):
                continue
            known = pdf[[f"_{i}" for i in range(q)] + ["_dy", "_level", "_unit"]].fillna(0.0)  # a missing cell adds nothing
            x = np.concatenate([known.to_numpy()[:, :q], np.ones((len(pdf), 1)), known[["_dy"]].to_numpy()], axis=1)
            level, unit = np.maximum(known["_level"].to_numpy(), 0.0), known["_unit"].to_numpy()
            ids, f = pdf["_id"].to_numpy(), pdf["_fold"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (f[1:] != f[:-1])]))
            add = lambda v: np.add.reduceat(v, first, axis=0)
            g = add(x[:, :, None] * x[:, None, :])
            e = np.empty((len(first), len(forms), n))
            for i, (half, floor) in enumerate(forms):
                above = np.maximum(level - (floor or 0.0), 0.0)
                eat = unit * (level if half is None else above / (half + above))
                e[:, i] = add(eat[:, None] * x)
                e[:, i, place] = add(eat * eat)
            key, who, of = (ids[-1], f[-1]), ids[first], f[first]
            if held is not None:
                if held[0] == (who[0], of[0]):
                    g[0] += held[1]
                    e[0] += held[2]
                else:
                    yield told([held[0][0]], [held[0][1]], held[1][None], held[2][None])
            held = key, g[-1].copy(), e[-1].copy()
            for lo in range(0, len(first) - 1, 1000):
                hi = min(lo + 1000, len(first) - 1)
                yield told(who[lo:hi], of[lo:hi], g[lo:hi], e[lo:hi])
        if held is not None:
            yield told([held[0][0]], [held[0][1]], held[1][None], held[2][None])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"`{id_col}` {kind}, `{fold}` int, g array<double>, e array<double>")


def covariate_scaling(rows: DataFrame, kin: Kinetics, *, fold: str, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample sd of each covariate over the training folds: two (folds, c) arrays.

    Rows of a fold outside 0 .. folds - 1 train every model, so -1 everywhere trains on all rows.
    """
    if not kin.covariates:
        return np.zeros((folds, 0)), np.ones((folds, 0))
    aggs = [a for i, c in enumerate(kin.covariates) for a in (
        F.count(c).alias(f"n{i}"), F.sum(c).alias(f"s{i}"), F.sum(F.col(c) * F.col(c)).alias(f"q{i}"))]
    every = rows.groupBy(fold).agg(*aggs).toPandas().set_index(fold).fillna(0.0)
    got = every.reindex(range(folds)).fillna(0.0)
    mean, sd = [], []
    for i in range(len(kin.covariates)):
        n, s, q = (every[f"{x}{i}"].sum() - got[f"{x}{i}"].to_numpy(dtype=float) for x in "nsq")
        m = s / np.maximum(n, 1)
        mean.append(m)
        v = np.maximum((q - n * m * m) / np.maximum(n - 1, 1), 0)
        sd.append(np.where(v > 0, np.sqrt(v), 1.0))
    return np.array(mean).T, np.array(sd).T


def bounded_minimum(a: np.ndarray, b: np.ndarray, lower: Sequence[float]) -> np.ndarray:
    """Minimise x'ax/2 - b'x with the finite bounds at zero, over every active set (few bounds)."""
    p, best, value = len(b), None, np.inf
    tied = [j for j in range(p) if np.isfinite(lower[j])]
    for pick in product((False, True), repeat=len(tied)):
        off = {j for j, z in zip(tied, pick) if z}
        on = [j for j in range(p) if j not in off]
        x = np.zeros(p)
        if on:
            x[on] = np.linalg.lstsq(a[np.ix_(on, on)], b[on], rcond=None)[0]
        if any(x[j] < -1e-12 for j in tied):
            continue
        got = 0.5 * x @ a @ x - b @ x
        if got < value - 1e-15:
            best, value = np.maximum(x, [lo if np.isfinite(lo) else -np.inf for lo in lower]), got
    return best if best is not None else np.zeros(p)


@dataclass(frozen=True)
class PanelFits:
    """Parameters per (variant, fold): ``theta[v, f]`` = mean alpha, then the shared ones."""

    kinetics: Kinetics
    theta: np.ndarray
    mse: np.ndarray
    shrink: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def frame(self, spark, choose=None) -> DataFrame:
        """One row per fold: p0.., shrink, covariate scaling; at most folds rows."""
        kin, rows = self.kinetics, []
        for f in range(self.theta.shape[1]):
            v = 0 if choose is None else int(choose[f])
            rows.append((f, *map(float, self.theta[v, f]), float(self.shrink[v, f]), *map(float, self.mean[f]),
                         *map(float, self.sd[f])))
        c = range(len(kin.covariates))
        cols = [f"p{i} double" for i in range(len(kin.names))] + ["shrink double"]
        cols += [f"m{i} double" for i in c] + [f"s{i} double" for i in c]
        return few_rows(spark, rows, "fold int, " + ", ".join(cols))


def fit_panel(moments: DataFrame, kin: Kinetics, *, fold: str, folds: int, mean: np.ndarray, sd: np.ndarray,
              variants: int = 1, rounds: int = 200, tol: float = 1e-10) -> PanelFits:
    """Least squares with alpha_i >= 0 per series and bounded shared parameters.

    For given shared parameters the best alpha_i is max(0, .), so the profiled objective is
    convex and piecewise quadratic; each step solves it on the current active series.  A
    fold column set to -1 trains on everything (``folds`` = 1).  Moments with ``e`` (``form_moments``) stand for ``variants`` consumption forms.
    """
    maps = [kin.to_model(mean[f], sd[f]) for f in range(folds)]
    q, p = len(kin.raw), len(kin.names)
    m, lower = variants * folds, kin.lower
    shaped, eat = "e" in moments.columns, kin.raw.index("u_eat")
    data = moments.select(F.col(fold).cast("int").alias("_fold"), "g", *(["e"] if shaped else []))

    def split(pdf):
        """Per (variant, fold): training series' moments in model columns."""
        import numpy as np

        g = np.stack(pdf["g"].to_numpy()).reshape(len(pdf), q + 2, q + 2)
        f = pdf["_fold"].to_numpy()
        e = np.stack(pdf["e"].to_numpy()).reshape(len(pdf), variants, q + 2) if shaped else None
        for j in range(folds):
            on = np.flatnonzero(f != j)
            part = g[on]
            t = np.zeros((q + 2, p + 2))
            t[:q, :p], t[q, p], t[q + 1, p + 1] = maps[j], 1.0, 1.0
            for i in range(variants):
                if shaped:
                    part[:, eat, :] = part[:, :, eat] = e[on, i]
                half = (part.reshape(-1, q + 2) @ t).reshape(len(on), q + 2, p + 2)
                yield i * folds + j, np.matmul(t.T, half)

    theta, old, prev = np.zeros((m, p - 1)), np.full(m, np.inf), np.zeros((m, p - 1))
    for _ in range(rounds):

        def sums(pdf, theta=theta.copy()):
            import numpy as np

            out = np.zeros((m, (p - 1) ** 2 + (p - 1) + 4))
            for i, g in split(pdf):
                xx, xz, xy = g[:, 0, 0], g[:, 0, 1:p], g[:, 0, p + 1]
                zz, zy, yy, n = g[:, 1:p, 1:p], g[:, 1:p, p + 1], g[:, p + 1, p + 1], g[:, p, p]
                safe = np.where(xx > 0, xx, 1.0)
                alpha = np.where(xx > 0, np.maximum((xy - xz @ theta[i]) / safe, 0.0), 0.0)
                on = (alpha > 0).astype(float) / safe
                a = zz - on[:, None, None] * xz[:, :, None] * xz[:, None, :]
                b = zy - on[:, None] * xz * xy[:, None]
                r = (yy + alpha ** 2 * xx - 2 * alpha * xy - 2 * zy @ theta[i] + 2 * alpha * (xz @ theta[i])
                     + np.einsum("i,nij,j->n", theta[i], zz, theta[i]))
                out[i] = np.concatenate([a.sum(0).ravel(), b.sum(0),
                                         [r.sum(), n.sum(), alpha[xx > 0].sum(), (xx > 0).sum()]])
            return out

        s = _summed(data, sums, m)
        if s.shape[1] == 0:
            break
        k, worst = (p - 1) ** 2, 0.0
        for i in range(m):
            if s[i, k + p - 1] > old[i] * (1 + 1e-12) + 1e-15:
                theta[i] = (theta[i] + prev[i]) / 2
                worst = max(worst, np.abs(theta[i] - prev[i]).max())
                continue
            new = bounded_minimum(s[i, :k].reshape(p - 1, p - 1), s[i, k:k + p - 1], lower)
            old[i], prev[i] = s[i, k + p - 1], theta[i].copy()
            worst = max(worst, np.abs(new - theta[i]).max() / (1 + np.abs(new).max()))
            theta[i] = new
        if worst < tol:
            break
    else:
        raise RuntimeError(f"the fit did not settle: the last step was {worst}")
    tail = s[:, (p - 1) ** 2 + p - 1:]
    mse = tail[:, 0] / np.maximum(tail[:, 1], 1)
    alpha = tail[:, 2] / np.maximum(tail[:, 3], 1)
    full = np.concatenate([alpha[:, None], theta], axis=1)

    def spread(pdf):
        import numpy as np

        out = np.zeros((m, 8))
        for i, g in split(pdf):
            th = full[i, 1:]
            xx = g[:, 0, 0]
            g = g[xx > 1e-10]
            if not len(g):
                continue
            a = (g[:, 0, p + 1] - g[:, 0, 1:p] @ th) / g[:, 0, 0]
            coef = np.concatenate([a[:, None], np.tile(th, (len(g), 1))], axis=1)
            n = g[:, p, p]
            total = g[:, p, p + 1] - np.einsum("na,na->n", coef, g[:, p, :p])
            square = (g[:, p + 1, p + 1] - 2 * np.einsum("na,na->n", coef, g[:, p + 1, :p])
                      + np.einsum("na,nab,nb->n", coef, g[:, :p, :p], coef))
            var = np.maximum(square / n - (total / n) ** 2, 0)
            se2 = var / g[:, 0, 0]
            ok = n > 1
            out[i] = [n.sum(), total.sum(), square.sum(), len(a), a.sum(), (a * a).sum(), ok.sum(), se2[ok].sum()]
        return out

    d = _summed(data, spread, m)
    sigma2 = np.maximum(d[:, 2] / np.maximum(d[:, 0], 1) - (d[:, 1] / np.maximum(d[:, 0], 1)) ** 2, 0)
    na = np.maximum(d[:, 3], 1)
    tau2 = np.maximum(d[:, 5] / na - (d[:, 4] / na) ** 2 - d[:, 7] / np.maximum(d[:, 6], 1), 1e-6)
    shape = (variants, folds)
    return PanelFits(kin, full.reshape(*shape, p), mse.reshape(shape), (sigma2 / tau2).reshape(shape), mean, sd)


def fit_own(moments: DataFrame, *, columns: Sequence[int] = (0, 1, 2), size: int, lower=(-np.inf, -np.inf, 0.0),
            id_col: str = "id") -> DataFrame:
    """Separate bounded fit of every series from its own moments: (id, alpha, beta, k).

    Series with fewer than two consuming or three producing intervals should be left out
    by the caller, they do not determine their parameters.
    """
    pick, tied = list(columns), [j for j, low in enumerate(lower) if np.isfinite(low)]

    def per_batch(batches):
        """All series of a batch at once: the free minimum under every choice of parameters held at zero, the best sound one kept."""
        import numpy as np
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                g = np.stack(pdf["g"].to_numpy()).reshape(len(pdf), size + 2, size + 2)
                a, b = g[:, pick][:, :, pick], g[:, pick, size + 1]
                x, least = np.zeros(b.shape), np.full(len(b), np.inf)
                for choice in range(1 << len(tied)):
                    on = [j for j in range(len(pick)) if not (j in tied and choice >> tied.index(j) & 1)]
                    y = np.zeros(b.shape)
                    if on:
                        y[:, on] = np.einsum("nij,nj->ni", np.linalg.pinv(a[:, on][:, :, on]), b[:, on])
                    value = 0.5 * np.einsum("ni,nij,nj->n", y, a, y) - np.einsum("ni,ni->n", b, y)
                    better = (value < least - 1e-15) & (y[:, tied] >= -1e-12).all(axis=1)
                    x[better], least[better] = y[better], value[better]
                x[:, tied] = np.maximum(x[:, tied], 0.0)
                yield pd.DataFrame({id_col: pdf[id_col], "alpha": x[:, 0], "beta": x[:, 1], "k": x[:, 2]})

    kind = dict(moments.dtypes)[id_col]
    return moments.select(id_col, "g").mapInPandas(per_batch, f"{id_col} {kind}, alpha double, beta double, k double")


def fit_pooled(moments: DataFrame, kin: Kinetics, *, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """One bounded fit over all series with common parameters: (alpha, shared parameters) in model columns."""
    q, p = len(kin.raw), len(kin.names)
    n = q + 2
    row = moments.agg(*[F.sum(F.col("g")[i]).alias(f"_{i}") for i in range(n * n)]).first()
    g = np.array([row[f"_{i}"] or 0.0 for i in range(n * n)]).reshape(n, n)
    to_model = kin.to_model(mean, sd)
    moved = to_model.T @ g[:q, :q] @ to_model
    return bounded_minimum(moved[:p, :p], to_model.T @ g[:q, q + 1], [0.0, *kin.lower])


# ---------------------------------------------------------------- scoring


def _standardised(i: int, c: str) -> Column:
    return F.coalesce((F.col(c) - F.col(f"m{i}")) / F.col(f"s{i}"), F.lit(0.0))


def with_own_alpha(intervals: DataFrame, params: DataFrame, kin: Kinetics, *, id_col, fold: str = "fold",
                   until: int = 4, keys: Sequence[str] = ()) -> DataFrame:
    """Attach fold parameters and ``alpha``: estimated on days 1..until, shrunk to the mean, >= 0."""
    ids = [*as_list(id_col), *keys]
    rows = intervals.join(params.withColumnRenamed("fold", fold), fold)
    x, xr = _early_products(kin, until)
    whole = grid.whole(ids)
    return rows.withColumn("alpha", _shrunk(F.sum(xr).over(whole), F.sum(x * x).over(whole), F.count(x).over(whole)))


def _early_products(kin: Kinetics, until: int) -> tuple[Column, Column]:
    """Growth of the early days and its product with what the shared parameters leave of the response."""
    base = F.col("p1") * F.col("u_area") + F.col("p2") * F.col("u_eat")
    for i, c in enumerate(kin.covariates):
        base = base + F.col(f"p{3 + i}") * F.col("u_grow") * _standardised(i, c)
    if kin.inhibitor:
        base = base + F.col(f"p{len(kin.names) - 1}") * F.col("u_inh")
    x = F.when((F.col(kin.day) < until) & F.col("dy").isNotNull(), F.col("u_grow"))
    return x, x * (F.col("dy") - base)


def _shrunk(xr: Column, xx: Column, measured: Column) -> Column:
    """Own coefficient from its moments, shrunk to the mean, >= 0."""
    room = F.coalesce(xx, F.lit(0.0)) + F.col("shrink")
    est = (F.coalesce(xr, F.lit(0.0)) + F.col("shrink") * F.col("p0")) / F.nullif(room, F.lit(0.0))
    # Nothing measured and nothing to shrink to a mean of its own: the mean itself.
    return F.when((measured == 0) | (room == 0), F.col("p0")).otherwise(not_below_zero(est))


def step_columns(rows: DataFrame, kin: Kinetics, *, alpha: Column | None = None, half: Column | None = None,
                 floor: Column | None = None) -> DataFrame:
    """``gain``, ``loss`` and ``sat``: level' = max(0, level + gain - loss * level - sat * g(level))."""
    a = F.col("alpha") if alpha is None else alpha
    last = f"p{len(kin.names) - 1}"
    gain = F.col("make") * (a * F.col("grow") + F.col("p1") * F.col("area"))
    for i, c in enumerate(kin.covariates):
        gain = gain + F.col(f"p{3 + i}") * F.col("make") * F.col("grow") * _standardised(i, c)
    eat = F.col("use") * F.col("p2") * F.col("area")
    linear = half is None and floor is None
    loss = (eat if linear else F.lit(0.0)) + kin.dilution
    if kin.inhibitor == "level":
        loss = loss + F.col("make") * F.col(last) * F.col("grow")
    elif kin.inhibitor:
        gain = gain - F.col("make") * F.col(last) * F.col("grow") * F.col("z")
    return rows.withColumns({"gain": gain, "loss": loss, "sat": F.lit(0.0) if linear else eat})


def one_step(level: Column, gain: Column, loss: Column, sat: Column, half: Column | None = None,
             floor: Column | None = None) -> Column:
    out = level + gain - loss * level
    if half is not None or floor is not None:
        out = out - sat * saturable(level, half, floor)
    return not_below_zero(out)


def simulate(rows: DataFrame, *, id_col, day_col: str, level_col: str, half: str | None = None,
             floor: str | None = None, start_day: str | None = None, keep: Sequence[str] = (),
             out: str = "simulated") -> DataFrame:
    """Recursive profile of every series from its first (or ``start_day``) observed level.

    Needs ``gain, loss, sat`` on each day.  One fold over the ordered days of a series;
    days before the start are NULL.  ``half``/``floor``/``start_day``/``keep`` name columns
    that are constant within a series.
    """
    ids = as_list(id_col)
    consts = [c for c in dict.fromkeys([half, floor, start_day, *keep]) if c]
    item = F.struct(F.col(day_col).alias("day"), F.col(level_col).alias("level"), "gain", "loss", "sat")
    path = rows.groupBy(*ids).agg(F.sort_array(F.collect_list(item)).alias("_path"),
                                  *[F.max(c).alias(c) for c in consts])
    eaten = "0.0D"
    if half or floor:
        pos = "greatest(a.s, 0.0D)"
        above = f"greatest({pos} - coalesce({floor or '0.0D'}, 0.0D), 0.0D)"
        eaten = f"(a.pt * if({half} is null, {pos}, {above} / ({half} + {above})))"
    begin = f"x.day = {start_day}" if start_day else "a.s IS NULL"
    now = f"IF({begin}, x.level, IF(a.s IS NULL, NULL, greatest(a.s + a.pg - a.pl * a.s - {eaten}, 0.0D)))"
    # results are kept in runs of 256 so that appending stays cheap on long series
    body = f"""
        aggregate(_path,
          named_struct('s', cast(null as double), 'pg', 0.0D, 'pl', 0.0D, 'pt', 0.0D,
                       'run', cast(array() as array<double>), 'done', cast(array() as array<array<double>>)),
          (a, x) -> named_struct(
             's', {now}, 'pg', coalesce(x.gain, 0.0D), 'pl', coalesce(x.loss, 0.0D), 'pt', coalesce(x.sat, 0.0D),
             'run', IF(size(a.run) >= 256, array({now}), array_append(a.run, {now})),
             'done', IF(size(a.run) >= 256, array_append(a.done, a.run), a.done)),
          a -> flatten(array_append(a.done, a.run)))"""
    path = path.withColumn("_sim", F.expr(body))
    flat = path.select(*ids, *consts, F.inline(F.arrays_zip("_path", "_sim")))
    return flat.select(*ids, *consts, F.col("_path.day").alias(day_col), F.col("_path.level").alias(level_col),
                       F.col("_sim").alias(out))


def two_step_errors(rows: DataFrame, *, id_col, day_col: str, level_col: str, half: Column | None = None,
                    floor: Column | None = None, second: tuple[str, str, str] = ("gain", "loss", "sat")) -> DataFrame:
    """Error of the level two days ahead, started at every observed level.

    ``second`` names the step columns used for the second day, so a frozen or extrapolated
    step can differ from the one on the day itself.
    """
    w = by_day(id_col, day_col)
    nxt = [F.lead(c).over(w) for c in second]
    first = one_step(F.col(level_col), F.col("gain"), F.col("loss"), F.col("sat"), half, floor)
    rows = rows.withColumns({"_s1": first, "_g": nxt[0], "_l": nxt[1], "_t": nxt[2],
                             "_obs": F.lead(level_col, 2).over(w)})
    ahead = one_step(F.col("_s1"), F.col("_g"), F.col("_l"), F.col("_t"), half, floor)
    return rows.withColumn("error2", F.when(F.col("_obs").isNotNull(), ahead - F.col("_obs"))).drop(
        "_s1", "_g", "_l", "_t", "_obs")


def root_mean_square(c: str, over: WindowSpec | None = None) -> Column:
    mean = F.avg(F.col(c) * F.col(c))
    return F.sqrt(mean if over is None else mean.over(over))


def choose_form(fits: PanelFits) -> np.ndarray:
    """Per fold the variant with the smallest training error (first on ties)."""
    return fits.mse.argmin(axis=0)


def consumption_forms(halves: Sequence[float] = HALVES, floors: Sequence[float] = FLOORS) -> list[tuple]:
    """First-order form (no half constant) followed by every (half, floor) pair."""
    return [(None, 0.0)] + [(h, f) for h in halves for f in floors]


def predicted_switch(blind: DataFrame, *, id_col, day_col: str, hazard: str = "h", frozen_hazard: str | None = None
                     ) -> DataFrame:
    """Cumulative risk ``state`` by day and, frozen, ``state_frozen`` from yesterday's measures."""
    ids = as_list(id_col)
    rows = grid.cumulative_risk(blind, id_col=ids, day_col=day_col, hazard_col=hazard, out="state")
    if frozen_hazard:
        before = F.coalesce(F.lag("state").over(by_day(ids, day_col)), F.lit(0.0))
        rows = rows.withColumn("state_frozen", 1 - (1 - before) * (1 - F.col(frozen_hazard)))
    return rows


def expected_trajectory(rows: DataFrame, params: DataFrame, kin: Kinetics, *, id_col: str, fold: str = "fold",
                        state: str = "state", half: str | None = None, floor: str | None = None,
                        negligible: float = 0.0, until: int = 4) -> DataFrame:
    """Profiles with a sharp switch on each candidate day, weighted by its probability.

    Returns (id, day, level, expected) and ``modal_day``, the likeliest switch day (NULL if
    never is likelier).  Candidates are the days of the series and never.  One fold over the days of a series
    carries a level for every candidate, so rows are not multiplied; the own coefficient of a
    candidate comes from running sums over the early days before it.
    """
    w = by_day(id_col, kin.day)
    last = f"p{len(kin.names) - 1}"
    step = F.col(state) - F.coalesce(F.lag(state).over(w), F.lit(0.0))
    rows = rows.withColumns({"_w": not_below_zero(step), "_risk": F.col(state)}).withColumn(state, F.lit(0.0))
    hc, fc = (F.col(half) if half else None), (F.col(floor) if floor else None)
    inter = interval_columns(rows, kin, id_col=id_col, half=hc, floor=fc).join(params.withColumnRenamed("fold", fold), fold)
    x, xr = _early_products(kin, until)
    ahead, whole = grid.before_now(w), grid.whole([id_col])
    measured = F.count(x).over(whole)
    inter = inter.withColumns({"_alpha": _shrunk(F.sum(xr).over(ahead), F.sum(x * x).over(ahead), measured),
                               "_never": _shrunk(F.sum(xr).over(whole), F.sum(x * x).over(whole), measured)})
    # While producing: gain = alpha * grow + made, loss = lost; while consuming: loss or saturable loss = eaten.
    made, lost = F.col("p1") * F.col("area"), 0 * F.col("area") + kin.dilution
    for i, c in enumerate(kin.covariates):
        made = made + F.col(f"p{3 + i}") * F.col("grow") * _standardised(i, c)
    if kin.inhibitor == "level":
        lost = lost + F.col(last) * F.col("grow")
    elif kin.inhibitor:
        made = made - F.col(last) * F.col("grow") * F.col("z")
    linear = half is None and floor is None
    eaten = F.col("p2") * F.col("area")
    item = F.struct(F.col(kin.day).cast("int").alias("day"), F.col(kin.level).cast("double").alias("level"), F.col("_w").alias("w"),
                    F.col("_alpha").alias("alpha"), F.col("grow"), made.alias("made"), F.coalesce(lost, F.lit(0.0)).alias("lost"),
                    F.coalesce(eaten + kin.dilution if linear else 0 * F.col("area") + kin.dilution, F.lit(0.0)).alias("eaten"),
                    F.coalesce(F.lit(0.0) if linear else eaten, F.lit(0.0)).alias("sat"))
    per = inter.groupBy(id_col).agg(
        F.sort_array(F.collect_list(item)).alias("_path"), F.max(fold).alias(fold), F.max("_never").alias("_never"), F.max_by("_risk", kin.day).alias("_f"),
        F.max(F.struct(F.col("_w").alias("w"), (-F.col(kin.day).cast("int")).alias("d"))).alias("_top"),
        *[F.max(c).alias(c) for c in (half, floor) if c])
    never = not_below_zero(1 - F.col("_f"))
    none = F.struct(F.lit(2 ** 31 - 1).alias("tau"), never.alias("w"), F.col("_never").alias("alpha"))
    cands = F.concat(F.transform("_path", lambda d: F.struct(d["day"].alias("tau"), d["w"].alias("w"), d["alpha"].alias("alpha"))), F.array(none))
    per = per.withColumns({"_total": F.greatest(F.aggregate(cands, F.lit(0.0), lambda a, c: a + c["w"]), F.lit(1e-9)),
                           "_cand": F.filter(cands, lambda c: c["w"] > negligible),
                           "modal_day": F.when(F.col("_top")["w"] >= never, -F.col("_top")["d"])})
    meal = ""
    if not linear:
        pos = "greatest(a.s[i], 0.0D)"
        above = f"greatest({pos} - coalesce({floor or '0.0D'}, 0.0D), 0.0D)"
        meal = f" - if(a.p.day >= c.tau, a.p.sat, 0.0D) * if({half or 'cast(null as double)'} is null, {pos}, {above} / ({half or '0.0D'} + {above}))"
    one = f"""transform(_cand, (c, i) -> greatest(a.s[i] + if(a.p.day >= c.tau, 0.0D, coalesce(c.alpha * a.p.grow + a.p.made, 0.0D))
              - if(a.p.day >= c.tau, a.p.eaten, a.p.lost) * a.s[i]{meal}, 0.0D))"""
    # The mean over candidates of a day is formed when the next day, or the end, is reached.
    mean = "if(a.s is null, cast(null as double), aggregate(zip_with(_cand, a.s, (c, v) -> c.w * v), 0.0D, (t, v) -> t + v) / _total)"
    body = f"""slice(aggregate(_path,
        named_struct('s', cast(null as array<double>), 'p', _path[0], 'done', cast(array() as array<double>)),
        (a, x) -> named_struct('s', if(a.s is null, if(x.level is null, cast(null as array<double>), array_repeat(x.level, size(_cand))), {one}),
                               'p', x, 'done', array_append(a.done, {mean})),
        a -> array_append(a.done, {mean})), 2, size(_path))"""
    per = per.withColumn("_mean", F.expr(body))
    flat = per.select(id_col, fold, "modal_day", F.inline(F.arrays_zip("_path", "_mean")))
    return flat.select(id_col, F.col("_path.day").alias(kin.day), fold, F.col("_path.level").alias(kin.level), "modal_day",
                       F.col("_mean").alias("expected"))
