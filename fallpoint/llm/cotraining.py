"""Quality classification by co-training of a content view and a metadata view.

Both views are logistic regressions.  Every row's two short feature vectors are made once and
stored; every Newton step is one pass over that table, in which tasks form small moment matrices
that Spark adds up by cell.  In each round a view gives its confident predictions on rows without
a label to the other view; what counts as confident is read off labelled rows that no fit sees.
Those rows calibrate the views at the end, and a regression on both calibrated logits scores all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallpoint.llm.common import prepared, store, text_of
from fallpoint.llm.quality_rules import SYMBOLS, symbol_table

ROUNDS = 3
PRECISION = 0.97  # that confident predictions must have on the rows kept for calibration
BINS = 200
PSEUDO_WEIGHT = 0.3  # of a row whose label another view gave
RIDGE = 1.0
NEWTON = 25
PRIOR_SHARE = 1e-4  # weight of the prior on a coefficient, as a share of the rows
FALL = 1e-6  # of the loss, below which a fit is done
CHUNK = 1 << 20
HASHED = 24  # columns for each categorical piece of metadata

_TABLES: dict[str, np.ndarray] = {}


def content_features(text: str) -> np.ndarray:
    """Shares of 64 classes of symbols, and shape: lengths, distinct words and lines, repeats next to each other."""
    if "symbols" not in _TABLES:
        _TABLES["symbols"] = symbol_table()
    seen = np.zeros(SYMBOLS, dtype=np.int64)
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at:at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        seen += np.bincount(_TABLES["symbols"][points & np.uint32(0xFFFF)], minlength=SYMBOLS)
    words, lines = text.split(), text.split("\n")
    n, chars = max(len(words), 1), max(len(text), 1)
    share = np.sqrt(seen / chars)
    shape = [np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), chars / n / 10, len(set(words)) / n, len(set(lines)) / len(lines),
             sum(a == b for a, b in zip(words, words[1:])) / n, sum(map(str.isupper, words)) / n, max(map(len, lines)) / chars]
    return np.concatenate((share, shape)).astype(np.float32)


CONTENT = SYMBOLS + 9


def metadata_features(values: Sequence, numeric: Sequence) -> np.ndarray:
    """Hashed categories, one block of columns each, then log and missing flag of each number."""
    import zlib

    out = np.zeros(HASHED * len(values) + 2 * len(numeric), dtype=np.float32)
    for k, v in enumerate(values):
        out[k * HASHED + (0 if v is None else 1 + zlib.crc32(str(v).encode("utf-8", "surrogatepass")) % (HASHED - 1))] = 1
    at = HASHED * len(values)
    for k, v in enumerate(numeric):
        out[at + 2 * k] = 0.0 if v is None or not np.isfinite(v) else np.sign(v) * np.log1p(abs(v))
        out[at + 2 * k + 1] = v is None or not np.isfinite(v)
    return out


def featured(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, categories: Sequence[str], numbers: Sequence[str],
             label_col: str) -> DataFrame:
    """doc_id, content and metadata vectors, label (null where there is none) and part: fit or calibrate for labelled rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = np.stack([content_features(t.as_py()) for t in b.column(1)]) if b.num_rows else np.zeros((0, CONTENT), np.float32)
            rest = [c.to_pylist() for c in b.columns[2:]]
            rows = list(zip(*rest)) if rest else [()] * b.num_rows
            meta = np.stack([metadata_features(r[:len(categories)], r[len(categories):]) for r in rows]) if rows else np.zeros((0, 0), np.float32)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32)),
                                              pa.array(x.reshape(-1))) for x in (content, meta)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["doc_id", "content", "meta"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), *[F.col(f"`{c}`").cast("string") for c in categories],
                       *[F.col(f"`{c}`").cast("double") for c in numbers]).mapInArrow(run, "doc_id long, content array<float>, meta array<float>")
    # Labels that contradict each other in equal number are none.
    voted = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("mean"))
    given = voted.where("doc_id is not null and mean <> 0.5").select("doc_id", (F.col("mean") > 0.5).cast("int").alias("label"))
    part = F.when(F.col("label").isNull(), None).when(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0, "calibrate").otherwise("fit")
    return rows.join(given, "doc_id", "left").withColumn("part", part)


@dataclass
class View:
    """A logistic regression on standardised features; the last coefficient is the constant."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    low: float = -np.inf  # logits up to this one are confident zeros, from ``high`` on confident ones
    high: float = np.inf

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack(((x - self.mean) / self.scale, np.ones(len(x))))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.beta, -30, 30)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def added(rows: DataFrame, per_batch, columns: Sequence[str]) -> dict[int, float]:
    """Sums over all rows of the cells that ``per_batch`` makes of each batch of columns: one row per cell for the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = per_batch(b)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    summed = rows.select(*columns).mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    return {r["cell"]: r["value"] for r in summed.collect()}


def as_array(cells: dict[int, float], size: int) -> np.ndarray:
    return np.array([cells.get(i, 0.0) for i in range(size)])


def moments(b: pa.RecordBatch) -> np.ndarray:
    parts = [np.array([b.num_rows], dtype=np.float64)]
    for k in (0, 1):
        x = matrix(b.column(k))
        parts += [x.sum(axis=0), (x * x).sum(axis=0)]
    return np.concatenate(parts)


def newton_pass(views: list[View], givers: list[View] | None):
    """Gradient and Hessian cells of both views.  Rows without a label take the other view's confident prediction, as of
    the end of the round before; rows kept for calibration take no part."""
    def per_batch(b: pa.RecordBatch) -> np.ndarray:
        xs = [matrix(b.column(0)), matrix(b.column(1))]
        label = np.array([np.nan if v is None else v for v in b.column(2).to_pylist()], dtype=np.float64)
        fit = np.array([v == "fit" for v in b.column(3).to_pylist()])
        out = []
        for k, view in enumerate(views):
            y, w = np.where(fit, label, np.nan), fit.astype(np.float64)
            if givers is not None:
                other = givers[1 - k]
                z = other.logit(xs[1 - k])
                free = np.isnan(label)
                sure = free & ((z >= other.high) | (z <= other.low))
                y, w = np.where(sure, (z >= other.high).astype(np.float64), y), np.where(sure, PSEUDO_WEIGHT, w)
            use = w > 0
            d = view.design(xs[k][use])
            out.append(logistic_cells(d, y[use], w[use], view.beta))
        return np.concatenate(out)

    return per_batch


def logistic_cells(d: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Loss, weight, gradient and Hessian of a weighted logistic regression on some rows; loss and gradient belong to the same logits."""
    z = d @ beta
    p = np.exp(-np.logaddexp(0, -z))
    return np.concatenate([[w @ (np.logaddexp(0, z) - y * z), w.sum()], d.T @ (w * (p - y)), ((d.T * (w * p * (1 - p))) @ d).reshape(-1)])


def settled(betas: list[np.ndarray], priors: list[np.ndarray], least: float, evaluate) -> list[np.ndarray]:
    """Minimise each penalised loss by Newton steps; ``evaluate`` gives the cells of all fits at some betas in one pass.

    Every coefficient, the constant too, is drawn to its prior with a weight of at least ``least`` that grows with the
    rows, so that separable labels settle after a number of steps that does not depend on the number of rows.  A step
    that raises the penalised loss is halved; a fit is done when its loss no longer falls by a share of FALL.
    """
    betas, prev, last, done = [b.copy() for b in betas], [b.copy() for b in betas], [np.inf] * len(betas), [False] * len(betas)
    for _ in range(NEWTON):
        cells, at = evaluate(betas), 0
        for i, beta in enumerate(betas):
            s = len(beta)
            loss, weight, gradient = cells[at], cells[at + 1], cells[at + 2:at + 2 + s]
            hessian = cells[at + 2 + s:at + 2 + s + s * s].reshape(s, s)
            at += 2 + s + s * s
            if done[i]:
                continue
            ridge = max(least, PRIOR_SHARE * weight)
            gap = beta - priors[i]
            loss += ridge / 2 * (gap @ gap)
            if loss > last[i] * (1 + 1e-9):
                betas[i] = (beta + prev[i]) / 2
            elif last[i] - loss <= FALL * loss:
                done[i] = True
            else:
                step = -np.linalg.solve(hessian + ridge * np.eye(s), gradient + ridge * gap)
                prev[i], last[i] = beta, loss
                betas[i] = beta + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if all(done):
            return betas
    raise RuntimeError("a fit did not settle")


def fit_views(rows: DataFrame, views: list[View], givers: list[View] | None) -> None:
    """Both views in the same passes over the rows."""
    data = rows if givers is not None else rows.where("part = 'fit'")

    def evaluate(betas: list[np.ndarray]) -> np.ndarray:
        for view, beta in zip(views, betas):
            view.beta = beta
        return as_array(added(data, newton_pass(views, givers), ["content", "meta", "label", "part"]), sum(2 + len(b) + len(b) ** 2 for b in betas))

    for view, beta in zip(views, settled([v.beta for v in views], [np.zeros(len(v.beta)) for v in views], RIDGE, evaluate)):
        view.beta = beta


def set_confidence(rows: DataFrame, views: list[View]) -> None:
    """Smallest logits from which predictions on the calibration rows have the wanted precision, on either side."""
    def per_batch(b: pa.RecordBatch) -> np.ndarray:
        label = np.array(b.column(2).to_pylist(), dtype=np.int64)
        return np.concatenate([np.bincount(np.clip(((v.logit(matrix(b.column(k))) + 20) / 40 * BINS).astype(int), 0, BINS - 1) * 2 + label,
                                           minlength=2 * BINS) for k, v in enumerate(views)]).astype(np.float64)

    table = as_array(added(rows.where("part = 'calibrate'"), per_batch, ["content", "meta", "label"]), 4 * BINS).reshape(2, BINS, 2)
    edges = np.arange(BINS) / BINS * 40 - 20
    for view, t in zip(views, table):
        above, below = t[::-1].cumsum(axis=0)[::-1], t.cumsum(axis=0)
        # The bound is on a cautious estimate, so a handful of rows cannot make a view confident.
        good = np.nonzero((above[:, 1] + 0.0) >= PRECISION * (above.sum(axis=1) + 2))[0]
        bad = np.nonzero((below[:, 0] + 0.0) >= PRECISION * (below.sum(axis=1) + 2))[0]
        view.high = edges[good[0]] if len(good) else np.inf
        view.low = edges[bad[-1]] + 40 / BINS if len(bad) else -np.inf


def combine(rows: DataFrame, views: list[View]) -> np.ndarray:
    """Platt scaling of each view and the regression on both, fitted together on the calibration rows.

    Returns a 3 x 3 array: a, b and 0 of each view's own scaling, then constant and both weights."""
    def passes(designs):
        def evaluate(betas: list[np.ndarray]) -> np.ndarray:
            def per_batch(b: pa.RecordBatch) -> np.ndarray:
                y = np.array(b.column(2).to_pylist(), dtype=np.float64)
                z = [v.logit(matrix(b.column(k))) for k, v in enumerate(views)]
                return np.concatenate([logistic_cells(d, y, np.ones(len(y)), beta) for d, beta in zip(designs(z), betas)])

            return as_array(added(rows.where("part = 'calibrate'"), per_batch, ["content", "meta", "label"]), sum(2 + len(b) + len(b) ** 2 for b in betas))

        return evaluate

    start = np.array([0.0, 1.0])
    own = settled([start, start], [start, start], 0.1, passes(lambda z: [np.column_stack((np.ones(len(v)), v)) for v in z]))
    scaled = passes(lambda z: [np.column_stack((np.ones(len(z[0])), *[own[k][0] + own[k][1] * z[k] for k in (0, 1)]))])
    start = np.array([0.0, 0.5, 0.5])
    both = settled([start], [start], 0.1, scaled)[0]
    return np.array([[*own[0], 0.0], [*own[1], 0.0], both])


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: Sequence[str] = ("source", "lang"),
                     numbers: Sequence[str] = ("n_chars",), label_col: str = "quality", rounds: int = ROUNDS, threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, score (probability of label 1), p_content, p_meta, kept (score at least ``threshold``).

    Rows of ``labels`` with a null id or label are left out; repeated labels vote, a tie is none.  Null texts
    count as empty, null metadata is a category of its own.  All rows take part, none is sampled.
    Without labels of both kinds every score is the share of label 1 (a half without any).  Repeated rows each
    give a row; an empty table gives none; other columns are ignored.
    """
    spark = prepared(docs)
    rows = store(featured(docs, labels, id_col, text_col, categories, numbers, label_col), "views")
    kinds = {(r["part"], r["label"]): r["count"] for r in rows.where("label is not null").groupBy("part", "label").count().collect()}
    if len(kinds) < 4:
        known = sum(kinds.values())
        share = sum(n for (_, y), n in kinds.items() if y) / known if known else 0.5
        flat = F.lit(share)
        return rows.select(F.col("doc_id").alias(id_col), flat.alias("score"), flat.alias("p_content"), flat.alias("p_meta"), (flat >= threshold).alias("kept"))
    widths = [CONTENT, HASHED * len(categories) + 2 * len(numbers)]
    sums = as_array(added(rows, moments, ["content", "meta"]), 1 + 2 * sum(widths))
    views, at = [], 1
    for w in widths:
        mean = sums[at:at + w] / sums[0]
        spread = np.sqrt(np.maximum(sums[at + w:at + 2 * w] / sums[0] - mean ** 2, 0))
        views.append(View(mean, np.where(spread > 1e-6, spread, 1.0), np.zeros(w + 1)))
        at += 2 * w
    fit_views(rows, views, None)
    for _ in range(rounds):
        set_confidence(rows, views)
        givers = [View(v.mean, v.scale, v.beta.copy(), v.low, v.high) for v in views]
        fit_views(rows, views, givers)
    weights = combine(rows, views)
    sent = spark.sparkContext.broadcast((views, weights))  # a few hundred numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = sent.value
        for b in batches:
            z = [w[k][0] + w[k][1] * own[k].logit(matrix(b.column(k + 1))) for k in (0, 1)] if b.num_rows else [np.zeros(0)] * 2
            total = w[2][0] + w[2][1] * z[0] + w[2][2] * z[1]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(1 / (1 + np.exp(-np.clip(v, -30, 30)))) for v in (total, *z)]],
                                             names=["doc_id", "score", "p_content", "p_meta"])

    out = rows.select("doc_id", "content", "meta").mapInArrow(score, "doc_id long, score double, p_content double, p_meta double")
    return out.withColumn("kept", F.col("score") >= threshold).withColumnRenamed("doc_id", id_col)
