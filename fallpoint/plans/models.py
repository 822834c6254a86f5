"""Regression, hazard and survival models over many training sets at once.

A training set is a weight on the rows: out of a fold, drawn by a resample, or everything.
Every pass over the rows forms, inside the tasks, the small moment matrices of all
training sets together; Spark adds them up by (model, cell) and only these p x p tables
reach the driver.  Rows are never copied per fold or per resample.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fallpoint.lineage import cut
from fallpoint.operators.ordered import exact_quantiles, pick_quantiles, running_totals

ALPHAS = tuple(10.0 ** (-3 + 0.25 * i) for i in range(25))   # fixed values: 25 points from 1e-3 to 1e3


@dataclass(frozen=True)
class Membership:
    """Which rows train which model.

    ``folds``: one column per repeat holding the row's fold; model r * k + f trains on the
    rows of repeat r outside fold f.  ``weights``: an array column with one weight per
    model.  With ``own`` model r * k + f trains on fold f alone instead, once for each of ``count``
    resamples if there are ``draws``.  ``draws``: the two key columns of an entity, from which each task forms its rows'
    weights in ``count`` resamples.  None of them: one model on all rows.
    """

    folds: tuple[str, ...] = ()
    k: int = 5
    weights: str | None = None
    count: int = 1
    draws: tuple[str, ...] = ()
    own: bool = False

    @property
    def models(self) -> int:
        return len(self.folds) * self.k * (self.count if self.own else 1) if self.folds else self.count

    @property
    def columns(self) -> list[str]:
        return list(self.folds) + ([self.weights] if self.weights else []) + list(self.draws)

    def matrix(self):
        """Worker-side function: pandas batch to a (rows, models) weight matrix."""
        folds, k, weights, draws, count, own = list(self.folds), self.k, self.weights, list(self.draws), self.count, self.own

        def build(pdf):
            import numpy as np

            if folds:
                f = pdf[folds].to_numpy()
                inside = np.concatenate([(f[:, [r]] == np.arange(k)[None, :]) for r in range(len(folds))], axis=1)
                if own and draws:
                    from fallpoint.plans.draws import poisson_weights

                    drawn = poisson_weights(pdf[draws[0]], pdf[draws[1]], count)
                    return (inside[:, :, None] * drawn[:, None, :]).reshape(len(pdf), -1)
                return (inside if own else ~inside).astype(float)
            if weights:
                return np.stack(pdf[weights].to_numpy()).astype(float)
            if draws:
                from fallpoint.plans.draws import poisson_weights

                return poisson_weights(pdf[draws[0]], pdf[draws[1]], count)
            return np.ones((len(pdf), 1))

        return build


    def parts(self):
        """Worker-side function: pandas batch to (models, rows, weights) blocks, rows without weight in a block left out."""
        folds, k, weights, draws, count, own = list(self.folds), self.k, self.weights, list(self.draws), self.count, self.own

        def build(pdf):
            import numpy as np

            from fallpoint.plans.draws import poisson_weights

            drawn = lambda rows: poisson_weights(pdf[draws[0]].to_numpy()[rows], pdf[draws[1]].to_numpy()[rows], count)
            every = np.arange(len(pdf))
            if folds:
                for r, c in enumerate(folds):
                    f = pdf[c].to_numpy()
                    for j in range(k):
                        rows, at = np.flatnonzero((f == j) == own), r * k + j
                        if own and draws:
                            yield np.arange(at * count, (at + 1) * count), rows, drawn(rows)
                        else:
                            yield np.array([at]), rows, np.ones((len(rows), 1))
            elif weights:
                w = np.stack(pdf[weights].to_numpy()).astype(float)
                yield np.arange(w.shape[1]), every, w
            elif draws:
                yield np.arange(count), every, drawn(every)
            else:
                yield np.arange(1), every, np.ones((len(pdf), 1))

        return build


@dataclass(frozen=True)
class Scaling:
    """Per model: value for missing cells, then subtract ``center`` and divide by ``scale``."""

    median: np.ndarray
    center: np.ndarray
    scale: np.ndarray


@dataclass(frozen=True)
class LinearFits:
    """Coefficients of all models on their scaled columns."""

    columns: tuple[str, ...]
    beta: np.ndarray
    intercept: np.ndarray
    scaling: Scaling
    usable: np.ndarray


CELLS = 16_384  # cells of the moment tables that one row carries between tasks
FEW = 8  # training sets of one scale whose second moments are cheaper one by one


def _summed(rows: DataFrame, batch_sums, models: int) -> np.ndarray:
    """Add (models, cells) matrices formed per Arrow batch over all rows.

    A task hands on one row per block of models, whatever the number of its rows; blocks are added up by Spark's grouping.
    """

    def per_partition(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        total = None
        for pdf in batches:
            if len(pdf):
                part = batch_sums(pdf)
                total = part if total is None else total + part
        if total is not None:
            m, c = total.shape
            step = max(1, CELLS // max(c, 1))
            yield pd.DataFrame([(i // step, TaskContext.get().partitionId(), c, total[i:i + step].astype("<f8").tobytes())
                                for i in range(0, m, step)], columns=["block", "part", "cells", "sums"])

    def added(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("part")  # the same order, hence the same digits, in every run
        total = sum(np.frombuffer(b, dtype="<f8") for b in pdf["sums"])
        return pd.DataFrame([(pdf["block"].iloc[0], pdf["cells"].iloc[0], total.tobytes())], columns=["block", "cells", "sums"])

    out = rows.mapInPandas(per_partition, "block int, part int, cells int, sums binary")
    got = out.groupBy("block").applyInPandas(added, "block int, cells int, sums binary").toPandas().sort_values("block")
    if not len(got):
        return np.zeros((models, 0))
    return np.concatenate([np.frombuffer(b, dtype="<f8") for b in got["sums"]]).reshape(models, int(got["cells"].iloc[0])).copy()


def numeric(rows: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Model columns as doubles next to the columns to keep."""
    keep = [c for c in dict.fromkeys(keep) if c not in columns]
    return rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])


def model_quantiles(rows: DataFrame, columns: Sequence[str], member: Membership,
                    probs=(0.25, 0.5, 0.75)) -> np.ndarray:
    """Exact training quantiles per model and column: (models, columns, probs).

    Folds: counts per value and training set in one pass.  Weighted resamples share the
    quantiles of all rows, which keeps the unit of a coefficient the same in all of them.
    """
    cols, names = list(columns), [f"q{i}" for i in range(len(probs))]
    sets = [(c, f) for c in member.folds for f in range(member.k)] if member.folds else [(None, None)]
    long = numeric(rows, cols, member.folds).unpivot(list(member.folds), cols, "variable", "value")
    long = long.where(F.col("value").isNotNull())
    counts = [F.count_if(F.col(c) == f if member.own else F.col(c) != f) if c else F.count(F.lit(1)) for c, f in sets]
    per = long.groupBy("variable", "value").agg(*[n.alias(f"n{i}") for i, n in enumerate(counts)])
    per = running_totals(per, by="variable", key="value", sums=[f"n{i}" for i in range(len(sets))])
    flat = per.select("variable", "value", F.inline(F.array(*[F.struct(
        F.lit(i).alias("model"), F.col(f"n{i}").alias("n"), F.col(f"before_n{i}").alias("before_n"),
        F.col(f"total_n{i}").alias("total_n")) for i in range(len(sets))]))).where("n > 0")
    got = pick_quantiles(flat, by=["model", "variable"], key="value", count="n", probs=probs, names=names).toPandas()
    out = np.zeros((len(sets), len(cols), len(probs)))
    place = {c: i for i, c in enumerate(cols)}
    for row in got.itertuples(index=False):
        out[row.model, place[row.variable]] = [getattr(row, n) for n in names]
    return np.repeat(out, member.models // len(sets), axis=0)


def scaling_for(rows: DataFrame, columns: Sequence[str], member: Membership, how: str = "robust") -> Scaling:
    """Median imputation with ``robust`` (median, IQR) or ``standard`` (mean, sd) scaling."""
    q = model_quantiles(rows, columns, member)
    median = q[:, :, 1]
    if how == "robust":
        spread = q[:, :, 2] - q[:, :, 0]
        return Scaling(median, median.copy(), np.where(spread > 0, spread, 1.0))
    cols, build, med = list(columns), member.matrix(), median

    def sums(pdf):
        import numpy as np

        w, x = build(pdf), pdf[cols].to_numpy(dtype=float)
        gap, base = np.isnan(x), np.nan_to_num(x)
        m = w.shape[1]
        s1, s2 = np.empty((m, len(cols))), np.empty((m, len(cols)))
        for i in range(m):
            xi = np.where(gap, med[i], base)
            s1[i], s2[i] = w[:, i] @ xi, w[:, i] @ (xi * xi)
        return np.concatenate([w.sum(axis=0)[:, None], s1, s2], axis=1)

    t = _summed(numeric(rows, cols, member.columns), sums, member.models)
    p = len(cols)
    mean = t[:, 1:1 + p] / t[:, :1]
    var = np.maximum(t[:, 1 + p:] / t[:, :1] - mean ** 2, 0.0)
    sd = np.sqrt(var)
    return Scaling(median, mean, np.where(sd > 1e-12, sd, 1.0))


def fit_logistic(rows: DataFrame, columns: Sequence[str], *, y: str = "y", member: Membership = Membership(),
                 c: float = 1.0, how: str = "robust", scaling: Scaling | None = None,
                 rounds: int = 100, tol: float = 1e-8, start: np.ndarray | None = None) -> LinearFits:
    """L2-penalised logistic regressions of all training sets by Newton steps.

    Minimises |beta|^2 / 2 + C * loss with an unpenalised intercept; one pass over the
    rows per step serves every model.  A step that raises the loss is halved.

    Training sets of one block fill missing cells alike, so their rows are put on one common scale and the sums of all of them are
    matrix products; what differs is a linear map of each model's few columns, applied to its sums.  ``start`` (models, 1 + columns)
    holds coefficients to begin from; where the steps end does not depend on it.
    """
    cols, p = list(columns), len(columns)
    scale = scaling or scaling_for(rows, cols, member, how)
    data = numeric(rows, cols, [*member.columns, y]).withColumn(y, F.col(y).cast("double"))
    build, m = member.parts(), member.models
    beta, last, prev = np.zeros((m, p + 1)) if start is None else start.copy(), np.full(m, np.inf), np.zeros((m, p + 1))
    usable = np.ones(m, bool)
    # Blocks of training sets with the same fill values, the common scale of each, and the map from it to every model's own.
    of = np.unique(scale.median, axis=0, return_inverse=True)[1].reshape(-1)
    blocks = [np.flatnonzero(of == g) for g in range(of.max() + 1)]
    common = [(scale.median[b[0]], scale.center[b].mean(axis=0), scale.scale[b].mean(axis=0)) for b in blocks]
    to_own = np.zeros((m, p + 1, p + 1))
    for b, (_, cen, sca) in zip(blocks, common):
        to_own[b, 0, 0] = 1.0
        to_own[b, 1:, 0] = (cen - scale.center[b]) / scale.scale[b]
        to_own[b[:, None], np.arange(1, p + 1), np.arange(1, p + 1)] = sca / scale.scale[b]
    up = np.triu_indices(p + 1)
    for _ in range(rounds):

        def sums(pdf, b=np.einsum("mab,ma->mb", to_own, beta)):
            import numpy as np

            out = np.zeros((m, 3 + p + 1 + len(up[0])))
            every, known = pdf[cols].to_numpy(dtype=float), pdf[y].to_numpy(dtype=float)
            for lo in range(0, len(pdf), 2000):  # bounds the tables of rows by models
                x, t = every[lo:lo + 2000], known[lo:lo + 2000]
                gap, whole = np.isnan(x), {}

                def design(g):
                    """The columns of all rows of the piece on the common scale of a block of training sets, a one before them."""
                    if g not in whole:
                        med, cen, sca = common[g]
                        whole[g] = np.concatenate([np.ones((len(x), 1)), (np.where(gap, med, x) - cen) / sca], axis=1)
                    return whole[g]

                for models, on, w in build(pdf.iloc[lo:lo + 2000]):
                    if not len(on):
                        continue
                    for g in np.unique(of[models]):
                        mine = of[models] == g
                        at, wi, ti = models[mine], w[:, mine], t[on][:, None]
                        u = design(g)[on]
                        z = u @ b[at].T
                        e = np.exp(-np.abs(z))
                        h = np.where(z >= 0, 1.0, e) / (1 + e)
                        out[at, 0] += (wi * (np.maximum(z, 0) + np.log1p(e) - ti * z)).sum(axis=0)
                        out[at, 1] += (wi * ti).sum(axis=0)
                        out[at, 2] += wi.sum(axis=0)
                        out[at, 3:4 + p] += (wi * (h - ti)).T @ u
                        v = wi * h * (1 - h)
                        if len(at) < FEW:  # products of the columns are formed for many training sets of one scale only
                            for c, i in enumerate(at):
                                out[i, 4 + p:] += (u.T @ (u * v[:, [c]]))[up]
                        else:
                            out[at, 4 + p:] += v.T @ (u[:, up[0]] * u[:, up[1]])
            return out

        s = _summed(data, sums, m)
        if s.shape[1] == 0:
            s = np.zeros((m, 3 + p + 1 + len(up[0])))
        ridge = np.concatenate([[0.0], np.full(p, 1.0)])
        loss = c * s[:, 0] + 0.5 * (beta[:, 1:] ** 2).sum(axis=1)
        usable = (s[:, 1] > 0) & (s[:, 1] < s[:, 2])
        worst = 0.0
        for i in np.flatnonzero(usable):
            if loss[i] > last[i] * (1 + 1e-12) + 1e-12:
                beta[i] = (beta[i] + prev[i]) / 2
                worst = max(worst, np.abs(beta[i] - prev[i]).max())
                continue
            flat = np.zeros((p + 1, p + 1))
            flat[up] = s[i, 4 + p:]
            flat = flat + np.triu(flat, 1).T
            grad = c * to_own[i] @ s[i, 3:4 + p] + ridge * beta[i]
            hess = c * to_own[i] @ flat @ to_own[i].T + np.diag(ridge)
            step = np.linalg.lstsq(hess, grad, rcond=None)[0]
            prev[i], last[i] = beta[i], loss[i]
            beta[i] = beta[i] - step
            worst = max(worst, np.abs(step).max())
        if worst < tol:
            break
    else:
        raise RuntimeError(f"the fit did not settle: the last step was {worst}")
    return LinearFits(tuple(cols), beta[:, 1:].copy(), beta[:, 0].copy(), scale, usable)


def predict_risk(rows: DataFrame, fits: LinearFits, *, folds: Sequence[str] = (), k: int = 5,
                 out: str = "p") -> DataFrame:
    """Predicted probability of each row.

    With fold columns every row is scored by the model that did not see its fold, averaged
    over the repeats; without them by the only model.
    """
    cols, folds = list(fits.columns), list(folds)
    b, a, s = fits.beta, fits.intercept, fits.scaling

    @F.pandas_udf("double")
    def score(packed):
        import numpy as np
        import pandas as pd

        x = packed[[f"x{i}" for i in range(len(cols))]].to_numpy(dtype=float)
        gap, base = np.isnan(x), np.nan_to_num(x)
        total = np.zeros(len(x))
        reps = max(len(folds), 1)
        for r in range(reps):
            model = packed[f"f{r}"].to_numpy() + r * k if folds else np.zeros(len(x), int)
            xi = (np.where(gap, s.median[model], base) - s.center[model]) / s.scale[model]
            total += 1 / (1 + np.exp(-np.clip(a[model] + (xi * b[model]).sum(axis=1), -500, 500)))
        return pd.Series(total / reps)

    packed = F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
                      *[F.col(c).cast("int").alias(f"f{i}") for i, c in enumerate(folds)])
    return rows.withColumn(out, score(packed))


def out_of_fold_risk(rows: DataFrame, columns: Sequence[str], *, folds: Sequence[str], k: int = 5, y: str = "y",
                     how: str = "robust", out: str = "p") -> DataFrame:
    """Rows with their out-of-fold probability, averaged over repeats."""
    fits = fit_logistic(rows, columns, y=y, member=Membership(tuple(folds), k), how=how)
    return predict_risk(rows, fits, folds=folds, k=k, out=out)


def _begin(fits: LinearFits, resamples: int) -> np.ndarray:
    """Coefficients of each fit for all its resamples to begin from."""
    return np.repeat(np.concatenate([fits.intercept[:, None], fits.beta], axis=1), resamples, axis=0)


def odds_ratios(rows: DataFrame, columns: Sequence[str], *, variables: Sequence[str], id_col: str, y: str = "y",
                resamples: int = 300, how: str = "robust", seed: int = 0) -> DataFrame:
    """Odds ratio per scale unit with a percentile interval over entity resamples.

    All resamples are fitted together; each task forms the entities' weights from their keys, so
    no table of draws is joined.  Resamples with a single class are skipped.
    """
    from fallpoint.plans.draws import with_keys

    spark = rows.sparkSession
    full = fit_logistic(rows, columns, y=y, how=how)
    data = cut(with_keys(numeric(rows, columns, [id_col, y]), id_col, seed))
    member = Membership(draws=("_k1", "_k2"), count=resamples)
    same = Scaling(*[np.repeat(v, resamples, axis=0) for v in (full.scaling.median, full.scaling.center,
                                                               full.scaling.scale)])
    scale = same if how == "robust" else scaling_for(data, columns, member, how)
    boot = fit_logistic(data, columns, y=y, member=member, scaling=scale, start=_begin(full, resamples))
    keep = boot.beta[boot.usable]
    place = {c: i for i, c in enumerate(columns)}
    out = []
    for v in variables:
        if v in place:
            lo, hi = np.percentile(keep[:, place[v]], [2.5, 97.5]) if len(keep) else (np.nan, np.nan)
            out.append((v, *map(float, np.exp([full.beta[0, place[v]], lo, hi]))))
    df = spark.createDataFrame(out, "variable string, odds_ratio double, low double, high double")
    return df.withColumn("excludes_1", (F.col("low") > 1) | (F.col("high") < 1))


def numbered_groups(rows: DataFrame, *, group: str, id_col: str, min_ids: int = 1, out: str = "_group") -> tuple[DataFrame, DataFrame]:
    """(rows with the number of their group, groups): groups of at least ``min_ids`` entities are 0, 1, ...; all other rows are -1.

    ``groups`` holds (number, group, ids).  With k = its count, ``Membership(folds=(out,), k=k)`` trains
    one model without each group, in the same passes over the rows.
    """
    from fallpoint.operators.ordered import dense_index

    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(id_col).alias("ids")).where(F.col("ids") >= min_ids)
    groups = cut(dense_index(sizes, key=F.col(group), out=out).select(F.col(out).cast("int").alias(out), group, "ids"))
    tagged = rows.join(groups.select(group, out), group, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))
    return tagged, groups


def group_effects(rows: DataFrame, columns: Sequence[str], *, variables: Sequence[str], group: str, id_col: str, y: str = "y",
                  resamples: int = 300, how: str = "standard", seed: int = 0, min_ids: int = 1) -> DataFrame:
    """Odds ratio of each variable in a model of its group's rows alone, with an interval over entity resamples of the group.

    All groups, and then all resamples of all groups, are fitted in the same passes.  Resamples keep their group's
    scaling, so that a coefficient keeps its unit.  A column that does not vary in a group has no effect there: it is left out.
    """
    from fallpoint.plans.draws import with_keys

    spark, cols = rows.sparkSession, list(columns)
    tagged, groups = numbered_groups(rows.select(group, id_col, y, *[F.col(c).cast("double").alias(c) for c in cols]),
                                     group=group, id_col=id_col, min_ids=min_ids)
    data = cut(with_keys(tagged.where("_group >= 0"), id_col, seed))
    names = {r["_group"]: r[group] for r in groups.collect()}
    k = len(names)
    kind = groups.schema[group].dataType.simpleString()
    schema = f"`{group}` {kind}, variable string, odds_ratio double, low double, high double"
    if not k:
        return spark.createDataFrame([], schema)
    one = fit_logistic(data, cols, y=y, member=Membership(folds=("_group",), k=k, own=True), how=how)
    many = Membership(folds=("_group",), k=k, own=True, draws=("_k1", "_k2"), count=resamples)
    same = Scaling(*[np.repeat(v, resamples, axis=0) for v in (one.scaling.median, one.scaling.center, one.scaling.scale)])
    boot = fit_logistic(data, cols, y=y, member=many, scaling=same, start=_begin(one, resamples))
    spread = data.groupBy("_group").agg(*[(F.min(c) < F.max(c)).alias(c) for c in cols]).toPandas().set_index("_group")
    out = []
    for g, name in names.items():
        keep = boot.beta[g * resamples:(g + 1) * resamples][boot.usable[g * resamples:(g + 1) * resamples]]
        for v in (v for v in variables if v in cols and one.usable[g] and spread.loc[g, v]):
            place = cols.index(v)
            lo, hi = np.percentile(keep[:, place], [2.5, 97.5]) if len(keep) else (np.nan, np.nan)
            out.append((name, v, *map(float, np.exp([one.beta[g, place], lo, hi]))))
    df = spark.createDataFrame(out, schema)
    return df.withColumn("excludes_1", (F.col("low") > 1) | (F.col("high") < 1))


# ---------------------------------------------------------------- ridge over a grid of penalties


@dataclass(frozen=True)
class _RidgeFits:
    """All ridge models: label means, coefficients (models, columns, labels), chosen penalties."""

    member: Membership
    scaling: Scaling
    mean: np.ndarray
    beta: np.ndarray
    alpha: np.ndarray


def _label_reader(y: str, many: bool):
    def read(pdf):
        import numpy as np

        return np.stack(pdf[y].to_numpy()).astype(float) if many else pdf[[y]].to_numpy(dtype=float)

    return read


def _scaler(cols, scaling: Scaling):
    def scaled(pdf, i, cols=list(cols), med=scaling.median, cen=scaling.center, sca=scaling.scale):
        import numpy as np

        x = pdf[cols].to_numpy(dtype=float)
        return (np.where(np.isnan(x), med[i], np.nan_to_num(x)) - cen[i]) / sca[i]

    return scaled


def _ridge(data: DataFrame, cols: list[str], y: str, member: Membership, alphas: Sequence[float],
           labels: int) -> _RidgeFits:
    """Standardise and fit every training set, its penalty chosen by exact leave-one-out error."""
    p, a, m, build = len(cols), np.array(alphas), member.models, member.matrix()
    scale = scaling_for(data, cols, member, "standard")
    label_matrix, scaled = _label_reader(y, labels > 1), _scaler(cols, scale)

    def moments(pdf):
        import numpy as np

        w, t = build(pdf), label_matrix(pdf)
        out = []
        for i in range(m):
            x, wi = scaled(pdf, i), w[:, [i]]
            out.append(np.concatenate([[wi.sum()], (wi * t).sum(axis=0), ((wi * x).T @ x).ravel(),
                                       ((wi * x).T @ t).ravel()]))
        return np.array(out)

    s = _summed(data, moments, m)
    n, ysum = s[:, 0], s[:, 1:1 + labels]
    gram = s[:, 1 + labels:1 + labels + p * p].reshape(m, p, p)
    xy = s[:, 1 + labels + p * p:].reshape(m, p, labels)
    ybar = ysum / n[:, None]
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0.0)
    turned = np.einsum("mji,mjb->mib", vectors, xy)

    def loo(pdf):
        import numpy as np

        w, t = build(pdf), label_matrix(pdf)
        out = []
        for i in range(m):
            z = scaled(pdf, i) @ vectors[i]
            cells = []
            for alpha in a:
                hat = 1 / n[i] + (z * z) @ (1 / (values[i] + alpha))
                err = (t - ybar[i] - z @ (turned[i] / (values[i] + alpha)[:, None])) / (1 - hat)[:, None]
                cells.append(w[:, i] @ (err * err))
            out.append(np.concatenate(cells))
        return np.array(out)

    best = _summed(data, loo, m).reshape(m, len(a), labels).argmin(axis=1)
    shrunk = values[:, :, None] + a[best][:, None, :]
    beta = np.einsum("mij,mjb->mib", vectors, turned / shrunk)
    return _RidgeFits(member, scale, ybar, beta, a[best])


def ridge_errors(rows: DataFrame, columns: Sequence[str], *, y: str, folds: Sequence[str], k: int = 5,
                 alphas: Sequence[float] = ALPHAS, labels: int = 1) -> DataFrame:
    """Out-of-fold mean absolute error of ridge regression: (b, repeat, fold, n, mae, alpha).

    Each training set imputes medians, standardises, and picks its penalty by exact
    leave-one-out error.  ``y`` may be an array of ``labels`` label versions (shuffles);
    all versions share the design moments, so refitting every shuffle costs no extra pass.
    """
    member, cols = Membership(tuple(folds), k), list(columns)
    data = numeric(rows, cols, [*folds, y])
    fit = _ridge(data, cols, y, member, alphas, labels)
    m, build, ybar, beta = member.models, member.matrix(), fit.mean, fit.beta
    label_matrix, scaled = _label_reader(y, labels > 1), _scaler(cols, fit.scaling)

    def errors(pdf):
        import numpy as np

        out, t, w = [], label_matrix(pdf), 1 - build(pdf)
        for i in range(m):
            gap = np.abs(t - ybar[i] - scaled(pdf, i) @ beta[i])
            out.append(np.concatenate([[w[:, i].sum()], w[:, i] @ gap]))
        return np.array(out)

    e = _summed(data, errors, m)
    found = [(b, i // k, i % k, int(e[i, 0]), float(e[i, 1 + b] / e[i, 0]), float(fit.alpha[i, b]))
             for i in range(m) if e[i, 0] > 0 for b in range(labels)]
    return rows.sparkSession.createDataFrame(found, "b int, repeat int, fold int, n int, mae double, alpha double")


def ridge_entity_errors(rows: DataFrame, columns: Sequence[str], *, y: str, folds: Sequence[str], k: int = 5,
                        alphas: Sequence[float] = ALPHAS, out: str = "ridge") -> DataFrame:
    """Rows with their out-of-fold absolute ridge error, averaged over repeats."""
    cols, folds = list(columns), list(folds)
    fit = _ridge(numeric(rows, cols, [*folds, y]), cols, y, Membership(tuple(folds), k), alphas, 1)
    s, mean, beta = fit.scaling, fit.mean[:, 0], fit.beta[:, :, 0]

    @F.pandas_udf("double")
    def error(packed):
        import numpy as np
        import pandas as pd

        x, t = packed[[f"x{i}" for i in range(len(cols))]].to_numpy(dtype=float), packed["t"].to_numpy(dtype=float)
        gap, base, total = np.isnan(x), np.nan_to_num(x), np.zeros(len(x))
        for r in range(len(folds)):
            model = packed[f"f{r}"].to_numpy() + r * k
            xi = (np.where(gap, s.median[model], base) - s.center[model]) / s.scale[model]
            total += np.abs(t - mean[model] - (xi * beta[model]).sum(axis=1))
        return pd.Series(total / len(folds))

    packed = F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
                      *[F.col(c).cast("int").alias(f"f{i}") for i, c in enumerate(folds)], F.col(y).cast("double").alias("t"))
    return rows.withColumn(out, error(packed))


def median_errors(rows: DataFrame, *, y: str, folds: Sequence[str], k: int = 5) -> DataFrame:
    """Out-of-fold mean absolute error of the training median: (repeat, fold, n, mae)."""
    member = Membership(tuple(folds), k)
    q = model_quantiles(rows, [y], member, probs=(0.5,))[:, 0, 0]
    build = member.matrix()

    def errors(pdf):
        import numpy as np

        w, t = 1 - build(pdf), pdf[y].to_numpy(dtype=float)
        gap = np.abs(t[:, None] - q[None, :])
        return np.stack([w.sum(axis=0), (w * gap).sum(axis=0)], axis=1)

    e = _summed(numeric(rows, [y], folds), errors, member.models)
    out = [(i // k, i % k, int(n), float(s / n)) for i, (n, s) in enumerate(e) if n > 0]
    return rows.sparkSession.createDataFrame(out, "repeat int, fold int, n int, mae double")


def summary_of_errors(errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population sd over (repeat, fold)."""
    return errors.groupBy(*by).agg(F.avg("mae").alias("mae"), F.stddev_pop("mae").alias("sd"))


# ---------------------------------------------------------------- penalised Cox regression


def _inverse_sums(d, whole, tied):
    """Sums over j < d of 1 / s and 1 / s^2 for s = whole - j / d * tied, per row of the arrays.

    They are differences of the digamma and trigamma functions: s is tied / d times
    (c - j) with c = d * whole / tied >= d.
    """
    import numpy as np

    def gammas(x):  # digamma and trigamma for x >= 1: nine steps up, then the asymptotic series
        first, second = np.zeros_like(x), np.zeros_like(x)
        for _ in range(9):
            first, second, x = first - 1 / x, second + 1 / x ** 2, x + 1
        r = 1 / x ** 2
        first += np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))
        second += 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))
        return first, second

    if not len(d):
        return np.zeros(0), np.zeros(0)
    c = np.maximum(d * whole / tied, d)
    top, low = gammas(c + 1), gammas(c - d + 1)
    f = d / tied
    one, two = f * (top[0] - low[0]), f ** 2 * (low[1] - top[1])
    for n in range(1, 9):  # few ties: add up, differences of nearly equal values would lose digits
        at = d == n
        if at.any():
            terms = [whole[at] - k / n * tied[at] for k in range(n)]
            one[at], two[at] = sum(1 / t for t in terms), sum(1 / t ** 2 for t in terms)
    return one, two


def _efron_terms(run, tied, d, seen, p: int, inverse_sums=_inverse_sums):
    """Gradient and information of each event time: sums over the rows at risk, over its events, their number and their columns."""
    import numpy as np

    one, two = inverse_sums(d, run[:, 0], tied[:, 0])
    u = tied[:, 1:1 + p] / tied[:, :1]
    v = run[:, 1:1 + p] - run[:, :1] * u
    grad = seen - d[:, None] * u - one[:, None] * v
    second = tied[:, 1 + p:] / tied[:, :1]
    square = d[:, None] * second + one[:, None] * (run[:, 1 + p:] - run[:, :1] * second)
    outer = lambda a, b, k: (k[:, None, None] * a[:, :, None] * b[:, None, :]).reshape(len(k), -1)
    return np.concatenate([grad, square - outer(u, u, d) - outer(u, v, one) - outer(v, u, one) - outer(v, v, two)], axis=1)


COX_ROWS = 4096  # rows whose p x p products a task holds at a time
COX_CELLS = 1 << 15  # sums that a model may have over all times for them to be formed time by time in one pass
COX_RUN = 32  # rows of a time from which a matrix product is cheaper than the products of every row


def time_sums(x: np.ndarray, r: np.ndarray, e: np.ndarray, w: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of each run of rows that starts at ``begin``: r, r x, r xx' of all rows and of those with an event, weight and weight x of the events.

    Where a time has many rows its products are matrix products; only where times have few rows are the products of every row laid out.
    """
    p, n = x.shape[1], len(r)
    q, hit = 1 + p + p * p, (e * w)[:, None]
    if len(begin) * COX_RUN > n:
        every = np.concatenate([r[:, None], x * r[:, None], (r[:, None, None] * x[:, :, None] * x[:, None, :]).reshape(n, -1)], axis=1)
        return np.add.reduceat(np.concatenate([every, every * e[:, None], hit, x * hit], axis=1), begin, axis=0)
    with_one = np.concatenate([np.ones((n, 1)), x], axis=1)
    out = np.empty((len(begin), 2 * q + 1 + p))
    for k, (a, b) in enumerate(zip(begin, np.append(begin[1:], n))):
        y = with_one[a:b]
        for at, weight in ((0, r[a:b]), (q, r[a:b] * e[a:b])):
            both = (y * weight[:, None]).T @ y
            out[k, at:at + 1 + p], out[k, at + 1 + p:at + q] = both[0], both[1:, 1:].ravel()
        out[k, 2 * q:] = hit[a:b, 0] @ y
    return out


def fit_cox(rows: DataFrame, columns: Sequence[str], *, time: str, event: str, member: Membership = Membership(),
            penalizer: float = 0.5, rounds: int = 50, tol: float = 1e-7, sets: str | None = None, count: int = 1) -> LinearFits:
    """Penalised Cox regressions (Efron ties) of all training sets by Newton steps; columns are scaled by their sample sd.

    Rows are dealt once into ranges from the last time on; one time may spread over several.  A pass adds up
    exp(xb), x exp(xb) and xx' exp(xb) per range, forms what lies ahead of each range from these totals, and
    sums the event times inside the ranges; times at an end of a range are put together from their pieces.  So no time,
    and no number of distinct times, gathers in one task; the driver gets p + p x p cells per model.  Where there are few
    distinct times (``COX_CELLS`` sums a model), every task adds up each of them in one pass, and rows are not dealt again.

    ``sets`` names a column 0 .. count - 1 of label sets: the rows repeated with other times and events (shuffles).
    Model s * member.models + i is that of set s; all sets are fitted in the same passes.  Rows without a time
    take no part.  Raises if a model does not settle.
    """
    cols, p, m, build = list(columns), len(columns), member.models, member.matrix()
    base = (rows if sets is None else rows.where(F.col(sets) == 0)).where(F.col(time).isNotNull())
    scale = scaling_for(base, cols, member, "standard")

    def weights(pdf):
        return build(pdf).sum(axis=0)[:, None]

    size = _summed(numeric(base, cols, member.columns), weights, m)[:, 0]
    tiled = lambda v: np.tile(v, (count, 1))
    scale = Scaling(tiled(scale.median), tiled(scale.center), tiled(scale.scale * np.sqrt(size / np.maximum(size - 1, 1))[:, None]))
    size = np.tile(size, count)
    data = numeric(rows, cols, [*member.columns, time, event, *([sets] if sets else [])]).where(F.col(time).isNotNull()).withColumns(
        {time: F.col(time).cast("double"), event: F.col(event).cast("int"), "_set": F.col(sets).cast("int") if sets else F.lit(0),
         "_salt": F.monotonically_increasing_id()})
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = cut(data.repartitionByRange(parts, "_set", F.col(time).desc(), "_salt").withColumn("_range", F.spark_partition_id()).drop("_salt"))
    beta, q, worst = np.zeros((m * count, p)), 1 + p + p * p, np.inf
    terms, shape = _efron_terms, 2 * q + 1 + p
    few = data.select(time).distinct().limit(COX_CELLS // shape + 1).toPandas()[time].to_numpy()
    few = np.sort(few)[::-1] if len(few) <= COX_CELLS // shape else None
    for _ in range(rounds):
        args = (beta.copy(), scale.median, scale.center, scale.scale)

        def scored(x, i, args=args):
            import numpy as np

            b, med, cen, sca = args
            xi = (np.where(np.isnan(x), med[i], x) - cen[i]) / sca[i]
            return xi, xi @ b[i]

        def totals(batches):
            import numpy as np
            import pandas as pd

            found = {}
            for pdf in batches:
                for (s, k), part in pdf.groupby(["_set", "_range"]):
                    w, x = build(part), part[cols].to_numpy(dtype=float)
                    for j in range(m):
                        on = w[:, j] > 0
                        if not on.any():
                            continue
                        xi, z = scored(x[on], s * m + j)
                        top = z.max()
                        r = np.exp(z - top) * w[on, j]
                        cells = np.concatenate([[r.sum()], r @ xi, ((xi * r[:, None]).T @ xi).ravel()])
                        old = found.get((s * m + j, k))
                        if old is not None:  # both on the scale of the larger exponent
                            high = max(top, old[0])
                            top, cells = high, cells * np.exp(top - high) + old[1] * np.exp(old[0] - high)
                        found[(s * m + j, k)] = (top, cells)
            if found:
                yield pd.DataFrame({"model": [k[0] for k in found], "_range": [k[1] for k in found],
                                    "top": [v[0] for v in found.values()], "cells": [v[1] for v in found.values()]})

        def by_time(batches):
            import numpy as np
            import pandas as pd

            found = {}
            for pdf in batches:
                place = np.searchsorted(-few, -pdf[time].to_numpy())
                pdf = pdf.iloc[np.argsort(place, kind="stable")]
                for s, part in pdf.groupby("_set"):
                    w, x, at = build(part), part[cols].to_numpy(dtype=float), np.searchsorted(-few, -part[time].to_numpy())
                    e = (part[event].to_numpy() == 1).astype(float)
                    for j in range(m):
                        on = w[:, j] > 0
                        if not on.any():
                            continue
                        xi, z = scored(x[on], s * m + j)
                        top, begin = z.max(), np.flatnonzero(np.diff(at[on], prepend=-1))
                        old = found.get(s * m + j)
                        if old is None:
                            old = found[s * m + j] = [top, np.zeros((len(few), shape))]
                        elif top > old[0]:  # both on the scale of the larger exponent
                            old[1][:, :2 * q] *= np.exp(old[0] - top)
                            old[0] = top
                        old[1][at[on][begin]] += time_sums(xi, np.exp(z - old[0]) * w[on, j], e[on], w[on, j], begin)
            if found:
                yield pd.DataFrame({"model": list(found), "top": [v[0] for v in found.values()], "cells": [v[1].ravel() for v in found.values()]})

        def finished(pdf):
            import numpy as np
            import pandas as pd

            peak, c = pdf["top"].max(), np.zeros((len(few), shape))
            for top, cells in sorted(zip(pdf["top"], pdf["cells"]), key=lambda v: (v[0], tuple(v[1][:shape]))):
                cells = np.array(cells).reshape(c.shape)
                cells[:, :2 * q] *= np.exp(top - peak)
                c += cells
            at = c[:, 2 * q] > 0
            total = terms(np.cumsum(c[:, :q], axis=0)[at], c[at, q:2 * q], c[at, 2 * q], c[at, 2 * q + 1:], p).sum(axis=0)
            return pd.DataFrame({"model": [pdf["model"].iloc[0]], "cells": [total]})

        per = data.mapInPandas(totals, "model int, _range int, top double, cells array<double>")
        ahead = _ahead(per)

        def inside(part, given):
            import numpy as np
            import pandas as pd

            offsets = {r.model: (r.peak, np.asarray(r.ahead)) for r in given.itertuples(index=False)}
            out, k = [], int(part["_range"].iloc[0]) if len(part) else 0
            for s, some in part.groupby("_set"):
                some = some.sort_values(time, ascending=False, kind="stable")
                w, t, x = build(some), some[time].to_numpy(), some[cols].to_numpy(dtype=float)
                e = (some[event].to_numpy() == 1).astype(float)
                for j in range(m):
                    i = s * m + j
                    if i not in offsets:
                        continue
                    peak, run = offsets[i]
                    total, held, first = np.zeros(p + p * p), None, True

                    def edge(at, cells, run):
                        out.append((1, i, at, k, np.concatenate([run, cells])))

                    for lo in range(0, len(t), COX_ROWS):
                        hi = min(lo + COX_ROWS, len(t))
                        xi, z = scored(x[lo:hi], i)
                        r = np.exp(np.minimum(z - peak, 0.0)) * w[lo:hi, j]
                        begin = np.flatnonzero(np.concatenate(([True], t[lo + 1:hi] != t[lo:hi - 1])))
                        cells = time_sums(xi, r, e[lo:hi], w[lo:hi, j], begin)
                        times = t[lo:hi][begin]
                        if held is not None and held[0] == times[0]:
                            cells[0] += held[1]
                        elif held is not None:
                            cells, times = np.concatenate([held[1][None], cells]), np.concatenate([[held[0]], times])
                        held = times[-1], cells[-1]
                        times, cells = times[:-1], cells[:-1]
                        if first and len(times):  # the range's first time may have begun in the one before
                            edge(times[0], cells[0], run)
                            run, times, cells, first = run + cells[0, :q], times[1:], cells[1:], False
                        if len(times):
                            runs = run + np.cumsum(cells[:, :q], axis=0)
                            run, at = runs[-1], cells[:, 2 * q] > 0
                            if at.any():
                                total += terms(runs[at], cells[at, q:2 * q], cells[at, 2 * q], cells[at, 2 * q + 1:], p).sum(axis=0)
                    edge(held[0], held[1], run)
                    out.append((0, i, 0.0, k, total))
            return pd.DataFrame(out, columns=["kind", "model", "time", "_range", "cells"])

        found = data.groupBy("_range").cogroup(ahead.groupBy("_range")).applyInPandas(
            inside, "kind int, model int, time double, _range int, cells array<double>")

        def ends(pdf):
            import numpy as np
            import pandas as pd

            pdf = pdf.sort_values("_range")
            c = np.stack(pdf["cells"].to_numpy())
            here = c[:, q:].sum(axis=0)
            if here[2 * q] <= 0:
                return pd.DataFrame({"model": pd.Series([], dtype="int32"), "cells": pd.Series([], dtype=object)})
            run = c[0, :q] + here[:q]
            one = terms(run[None], here[None, q:2 * q], here[None, 2 * q], here[None, 2 * q + 1:], p)[0]
            return pd.DataFrame({"model": [pdf["model"].iloc[0]], "cells": [one]})

        if few is not None:
            pieces = data.mapInPandas(by_time, "model int, top double, cells array<double>").groupBy("model").applyInPandas(finished, "model int, cells array<double>")
        else:
            found = cut(found)
            pieces = found.where("kind = 0").select("model", "cells").union(
                found.where("kind = 1").groupBy("model", "time").applyInPandas(ends, "model int, cells array<double>"))
        got = pieces.select("model", F.posexplode("cells").alias("cell", "value")).groupBy("model", "cell").agg(F.sum("value").alias("value")).toPandas()
        table = np.zeros((m * count, p + p * p))
        table[got["model"].to_numpy(), got["cell"].to_numpy()] = got["value"].to_numpy()
        worst = 0.0
        for i in range(m * count):
            pull = penalizer * size[i]
            step = np.linalg.solve(table[i, p:].reshape(p, p) + (pull + 1e-12) * np.eye(p), table[i, :p] - pull * beta[i])
            beta[i] += step
            worst = max(worst, np.abs(step).max())
        if worst < tol:
            return LinearFits(tuple(cols), beta, np.zeros(m * count), scale, np.ones(m * count, bool))
    raise RuntimeError(f"the fit did not settle: the last step was {worst}")


def _ahead(parts: DataFrame) -> DataFrame:
    """(_range, model, peak, ahead): sums of the ranges before each one, on the scale of the model's largest exponent; one row per range and model."""
    peak = parts.groupBy(F.col("model").alias("_m")).agg(F.max("top").alias("peak"))
    long = parts.join(peak, F.col("model") == F.col("_m")).select("model", "_range", "peak", F.posexplode(F.transform(
        "cells", lambda c: c * F.exp(F.col("top") - F.col("peak")))).alias("i", "v"))
    long = long.groupBy("model", "peak", "_range", "i").agg(F.sum("v").alias("v"))
    w = Window.partitionBy("model", "i").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("v", F.coalesce(F.sum("v").over(w), F.lit(0.0)))
    return long.groupBy("_range", "model", "peak").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("ahead"))


def cox_concordance(rows: DataFrame, columns: Sequence[str], *, time: str, event: str, folds: Sequence[str],
                    k: int = 5, penalizer: float = 0.5, sets: str | None = None, count: int = 1) -> DataFrame:
    """Concordance of each test fold under the model trained without it: ([set], repeat, fold, concordance)."""
    from fallpoint.plans.metrics import concordance

    rows = rows.where(F.col(time).isNotNull())
    m = len(folds) * k
    fits = fit_cox(rows, columns, time=time, event=event, member=Membership(tuple(folds), k), penalizer=penalizer, sets=sets, count=count)
    by = ([sets] if sets else []) + ["repeat", "fold"]
    which = (F.col(sets) * m if sets else F.lit(0)).cast("int")
    out = None
    for r, f in enumerate(folds):
        scored = predict_risk(rows.withColumn("_model", which + r * k + F.col(f)), fits, folds=["_model"], k=m * count, out="_risk").withColumns(
            {"repeat": F.lit(r), "fold": F.col(f), "_late": -F.col("_risk")}).select(*by, time, event, "_late")
        out = scored if out is None else out.unionByName(scored)
    return concordance(out, time=time, event=event, score="_late", by=by)


def cox_permutation(rows: DataFrame, columns: Sequence[str], *, time: str, event: str, id_col: str, folds: Sequence[str], k: int = 5,
                    penalizer: float = 0.5, n_permutations: int = 30, seed: int = 0) -> DataFrame:
    """Mean concordance out of fold against that under shuffled (time, event), everything refitted: all shuffles are label sets of one fit."""
    from fallpoint.plans.resample import permutation_summary, shuffled

    keep = [*columns, *folds]
    rows = rows.where(F.col(time).isNotNull()).select(id_col, *keep, F.struct(F.col(time).alias("t"), F.col(event).alias("e")).alias("_label"))
    mixed = shuffled(rows, id_col=id_col, value="_label", rounds=n_permutations, seed=seed, keep=keep)
    every = rows.select(F.lit(0).alias("_b"), *keep, "_label").union(mixed.select(F.col("b") + 1, *keep, "shuffled"))
    every = cut(every.select("_b", *keep, F.col("_label.t").alias(time), F.col("_label.e").alias(event)))
    got = cox_concordance(every, columns, time=time, event=event, folds=folds, k=k, penalizer=penalizer, sets="_b", count=n_permutations + 1)
    score = cut(got.groupBy("_b").agg(F.avg("concordance").alias("score")))
    return permutation_summary(score.where("_b = 0"), score.where("_b > 0"), lower_is_better=False)


# ---------------------------------------------------------------- trees and components


def _vectors(rows: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(rows)


def forest_predictions(rows: DataFrame, columns: Sequence[str], *, y: str, fold: str, k: int = 5, trees: int = 300,
                       min_leaf: int = 3, depth: int = 30, seed: int = 0, classify: bool = False) -> DataFrame:
    """Out-of-fold forest predictions; training medians replace missing values per fold.

    Regression forests consider every column at a split; classification forests weight
    the classes by their inverse frequency and return the probability of class 1.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler  # noqa: F401
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    from fallpoint.plans.baselines import training_quantiles

    cols = list(columns)
    mid = training_quantiles(rows, fold_col=fold, folds=k, columns=cols, probs=[0.5], names=["m"]).toPandas()
    rows = cut(rows)
    common = dict(featuresCol="features", labelCol="_y", numTrees=trees, minInstancesPerNode=min_leaf,
                  maxDepth=depth, seed=seed)
    out = None
    for f in range(k):
        med = mid[mid[fold] == f].set_index("variable")["m"].to_dict()
        full = rows.withColumn("_y", F.col(y).cast("double")).withColumns(
            {f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(med.get(c, 0.0)))) for c in cols})
        full = _vectors(full, [f"_x_{c}" for c in cols])
        train, test = full.where(F.col(fold) != f), full.where(F.col(fold) == f)
        if classify:
            n = train.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s")).first()
            w = F.when(F.col("_y") == 1, n["n"] / (2 * max(n["s"] or 0, 1e-9))).otherwise(
                n["n"] / (2 * max(n["n"] - (n["s"] or 0), 1e-9)))
            model = RandomForestClassifier(weightCol="_wt", **common).fit(train.withColumn("_wt", w))
            got = model.transform(test).withColumn("prediction", vector_to_array("probability")[1])
        else:
            model = RandomForestRegressor(featureSubsetStrategy="all", **common).fit(train)
            got = model.transform(test)
        got = got.select(*rows.columns, "prediction")
        out = got if out is None else out.unionByName(got)
    return out


def components(rows: DataFrame, columns: Sequence[str], *, id_col: str, k: int = 5):
    """Principal components of standardised columns: (scores, loadings, explained shares).

    The sign of each component makes its largest loading positive.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    from fallpoint.plans.baselines import standardised

    spark, cols = rows.sparkSession, list(columns)
    data = _vectors(standardised(rows.select(id_col, *cols), columns=cols), cols)
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(data)
    load = model.pc.toArray()
    sign = np.array([1.0 if load[np.abs(load[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)])
    scores = model.transform(data).withColumn("_a", vector_to_array("_pc")).select(
        id_col, *[(F.col("_a")[j] * float(sign[j])).alias(f"pc{j + 1}") for j in range(k)])
    table = spark.createDataFrame([(c, *map(float, load[i] * sign)) for i, c in enumerate(cols)],
                                  "variable string, " + ", ".join(f"pc{j + 1} double" for j in range(k)))
    shares = spark.createDataFrame([(j + 1, float(v)) for j, v in enumerate(model.explainedVariance.toArray())],
                                   "component int, explained double")
    return scores, table, shares


# ---------------------------------------------------------------- importance and attribution


def permutation_importance(rows: DataFrame, columns: Sequence[str], *, y: str, fold: str, id_col: str, k: int = 5,
                           repeats: int = 3, trees: int = 100, min_leaf: int = 3, depth: int = 30,
                           seed: int = 0) -> DataFrame:
    """Rise of the out-of-fold error when one column is shuffled inside its test fold.

    Models are fitted once per fold; every (column, repeat) variant of the test rows is
    scored by the same model in one transform.
    """
    from pyspark.ml.regression import RandomForestRegressor

    from fallpoint.plans.baselines import impute_from_training
    from fallpoint.plans.resample import shuffled

    cols = list(columns)
    rows = cut(impute_from_training(rows.select(id_col, fold, y, *[F.col(c).cast("double").alias(c) for c in cols]),
                                    fold_col=fold, folds=k, columns=cols))
    variants = rows.withColumns({"_col": F.lit("-"), "_rep": F.lit(0)})
    for i, c in enumerate(cols):
        mixed = shuffled(rows, id_col=id_col, value=c, rounds=repeats, within=fold, seed=seed + 1000 * (i + 1))
        mixed = mixed.select(id_col, F.col("b").alias("_rep"), F.col("shuffled").alias("_new"))
        variants = variants.unionByName(rows.join(mixed, id_col).withColumn(c, F.col("_new")).drop("_new")
                                        .withColumn("_col", F.lit(c)).select(*variants.columns))
    errors = None
    for f in range(k):
        train = _vectors(rows.where(F.col(fold) != f), cols)
        model = RandomForestRegressor(featuresCol="features", labelCol=y, numTrees=trees, minInstancesPerNode=min_leaf,
                                      maxDepth=depth, featureSubsetStrategy="all", seed=seed).fit(train)
        got = model.transform(_vectors(variants.where(F.col(fold) == f), cols)).groupBy("_col", "_rep").agg(
            F.avg(F.abs(F.col(y) - F.col("prediction"))).alias("mae")).withColumn("fold", F.lit(f))
        errors = got if errors is None else errors.unionByName(got)
    base = errors.where(F.col("_col") == "-").select("fold", F.col("mae").alias("base"))
    return (errors.where(F.col("_col") != "-").join(base, "fold")
            .groupBy(F.col("_col").alias("variable"), "fold").agg(F.avg(F.col("mae") - F.col("base")).alias("importance")))


def sampled_attribution(rows: DataFrame, columns: Sequence[str], *, y: str, fold: str, id_col: str, k: int = 5,
                        orderings: int = 4, trees: int = 100, min_leaf: int = 3, depth: int = 30,
                        seed: int = 0) -> DataFrame:
    """Sampled Shapley values of out-of-fold forest predictions: (id, fold, variable, value, effect).

    For each row and ordering a partner row of the training folds gives the starting
    values; columns are switched to the row's own values in that ordering and each change
    of the prediction is credited to its column.  Estimates, not tree-path values.
    """
    from pyspark.ml.regression import RandomForestRegressor

    from fallpoint.functions.columns import hash_int, hash_key
    from fallpoint.operators.ordered import dense_index
    from fallpoint.plans.baselines import impute_from_training

    cols, p = list(columns), len(columns)
    rows = cut(impute_from_training(rows.select(id_col, fold, y, *[F.col(c).cast("double").alias(c) for c in cols]),
                                    fold_col=fold, folds=k, columns=cols))
    own = rows.select(id_col, fold, y, F.array(*cols).alias("_own"))
    out = None
    for f in range(k):
        pool = dense_index(own.where(F.col(fold) != f).select(F.col(id_col).alias("_pid"), F.col("_own").alias("_other")),
                           key=hash_key(F.lit(seed), F.col("_pid")))
        test = own.where(F.col(fold) == f).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(orderings - 1))))
        size = pool.agg(F.max("n_group").alias("n")).scalar()
        test = test.withColumn("_n", size).withColumn(
            "index", F.pmod(hash_int(F.lit(seed), F.col("_o"), F.col(id_col)), F.col("_n")))
        test = test.join(pool.select("index", "_other"), "index")
        order = F.transform(F.array_sort(F.array(*[F.struct(hash_int(F.lit(seed), F.col("_o"), F.col(id_col), F.lit(i)).alias("h"),
                                                            F.lit(i).alias("i")) for i in range(p)])), lambda s: s["i"])
        test = test.withColumn("_order", order).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(p))))
        used = F.slice("_order", F.lit(1), F.col("_step"))
        test = test.withColumns({f"_v{i}": F.when(F.array_contains(used, i), F.col("_own")[i]).otherwise(F.col("_other")[i])
                                 for i in range(p)})
        train = _vectors(rows.where(F.col(fold) != f), cols)
        model = RandomForestRegressor(featuresCol="features", labelCol=y, numTrees=trees, minInstancesPerNode=min_leaf,
                                      maxDepth=depth, featureSubsetStrategy="all", seed=seed).fit(train)
        got = model.transform(_vectors(test, [f"_v{i}" for i in range(p)]))
        path = got.groupBy(id_col, fold, "_o").agg(
            F.first("_own").alias("_own"), F.first("_order").alias("_order"),
            F.transform(F.sort_array(F.collect_list(F.struct("_step", "prediction"))), lambda s: s["prediction"]).alias("_p"))
        one = path.select(id_col, fold, "_own", F.posexplode("_order").alias("_j", "_i"), "_p").select(
            id_col, fold, F.array(*[F.lit(c) for c in cols])[F.col("_i")].alias("variable"),
            F.col("_own")[F.col("_i")].alias("value"), (F.col("_p")[F.col("_j") + 1] - F.col("_p")[F.col("_j")]).alias("effect"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(id_col, fold, "variable").agg(F.first("value").alias("value"), F.avg("effect").alias("effect"))
