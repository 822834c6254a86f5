"""Keyed random numbers as plain arithmetic, the same in Spark, numpy and the check SQL.

A draw is ``power((k1 + b * k2) mod P)`` with P = 2^31 - 1 and power(x) = x^5 mod P, which permutes
the residues because 5 has no factor in common with P - 1.  ``k1, k2`` come from one md5 of the seed and
the row's id, so whatever a row needs for any number of resamples is formed where the row is:
no table of draws exists and none is joined.

``with_weight`` turns a draw into the number of times a row is drawn in a resample (Poisson
with mean one, by its inverse distribution function); sizes of resamples therefore vary around
that of the table, unlike draws of exactly n rows.  ``donor_positions`` permutes 0 .. n - 1 by a
keyed Feistel network over a square grid of cells, walking on while a cell lies outside.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

P = 2 ** 31 - 1
ROUNDS = 8         # of the Feistel network; with four, order statistics of shuffles still spread too widely
STRETCH = 500      # rounds of shuffling that one array of positions holds
PIECE = 200        # rows whose positions are formed at a time


def poisson_thresholds() -> list[int]:
    """Draws from the k-th threshold on stand for at least k + 1: the distribution function of mean one, in units of 1 / P."""
    total, term, out = 0.0, math.exp(-1.0), []
    for k in range(1, 40):
        total += term
        if math.ceil(total * P) >= P:
            break
        out.append(math.ceil(total * P))
        term /= k
    return out


def power(x):
    """x^5 mod P of columns or whole numbers."""
    square = x * x % P
    return square * square % P * x % P


# ---------------------------------------------------------------- weights of resamples


def draw_keys(id_: Column, seed: int = 0) -> tuple[Column, Column]:
    """The two keys of a row, from the md5 of ``seed|id``."""
    code = F.md5(F.concat_ws("|", F.lit(str(seed)), id_.cast("string")))
    part = lambda k: F.conv(F.substring(code, 8 * k + 1, 8), 16, 10).cast("long")
    return part(0) % P, 1 + part(1) % (P - 1)


def with_keys(rows: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    k1, k2 = draw_keys(F.col(id_col), seed)
    return rows.withColumns({"_k1": k1, "_k2": k2})


def spread_out(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all tasks before each is used many times: few narrow rows carry much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def with_weight(rows: DataFrame, b: Column, out: str = "times", drawn: bool = False) -> DataFrame:
    """How often each row of ``with_keys`` is drawn in resample b, with ``drawn`` only rows that are.

    One column per step, so that no step is formed twice and the generated code stays short enough to be compiled.
    """
    kept, first = rows.columns, poisson_thresholds()[0]
    rows = rows.withColumn("_u1", (F.col("_k1") + b * F.col("_k2")) % P)
    rows = rows.withColumn("_u2", F.col("_u1") * F.col("_u1") % P)
    rows = rows.withColumn("_u", F.col("_u2") * F.col("_u2") % P * F.col("_u1") % P)
    if drawn:
        rows = rows.where(F.col("_u") >= first)
    times = F.when(F.col("_u") < first, 0)
    for k, t in enumerate(poisson_thresholds()[1:], 1):
        times = times.when(F.col("_u") < t, k)
    times = times.otherwise(len(poisson_thresholds())).cast("long")
    return rows.select(*[c for c in kept if c not in ("_k1", "_k2", out)], times.alias(out))


def poisson_weights(k1, k2, count: int, start: int = 0) -> np.ndarray:
    """(rows, count) weights of resamples ``start``, ``start + 1``, ..."""
    b = np.arange(start, start + count, dtype=np.int64)
    u = power((np.asarray(k1, np.int64)[:, None] + b[None, :] * np.asarray(k2, np.int64)[:, None]) % P)
    return np.searchsorted(np.array(poisson_thresholds()), u, side="right").astype(float)


# ---------------------------------------------------------------- shuffles


def round_keys(seed: int) -> list[tuple[int, int, int, int]]:
    """Four numbers for each round of the network."""
    out = []
    for t in range(ROUNDS):
        code = hashlib.md5(f"{seed}/{t}".encode()).hexdigest()
        out.append(tuple(1 + int(code[8 * k:8 * k + 8], 16) % (P - 1) for k in range(4)))
    return out


def donor_positions(index, size, b, seed: int = 0) -> np.ndarray:
    """Position whose value each position receives in round b: for every size and b a permutation of 0 .. size - 1.

    ``index`` and ``size`` (same length) meet every round of ``b``: (rows, rounds).
    """
    index, size, b = (np.asarray(v, np.int64) for v in (index, size, b))
    side = np.ceil(np.sqrt(size.astype(float))).astype(np.int64)
    side = np.where((side - 1) ** 2 >= size, side - 1, side)
    keys = [(power((k[0] + b * k[1]) % P), 1 + power((k[2] + b * k[3]) % P) % (P - 1)) for k in round_keys(seed)]

    def network(x, width, at):
        left, right = x // width, x % width
        for c1, c2 in keys:
            left, right = right, (left + power((c1[at] + right * c2[at]) % P)) % width
        return left * width + right

    shape = len(index), len(b)
    at = np.broadcast_to(np.arange(len(b)), shape)
    width, limit = np.broadcast_to(side[:, None], shape), np.broadcast_to(size[:, None], shape)
    out = network(np.broadcast_to(index[:, None], shape), width, at)
    outside = out >= limit
    while outside.any():
        out[outside] = network(out[outside], width[outside], at[outside])
        outside = out >= limit
    return out


def with_donors(rows: DataFrame, rounds: int, *, seed: int = 0, index: str = "index", size: str = "n_group") -> DataFrame:
    """Each row once per round ``b``, with ``donor``, the position of the row whose value it receives."""

    spread = spread_out(rows, index)
    kept = spread.columns
    at_index, at_size = kept.index(index), kept.index(size)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):  # what a task holds at a time: PIECE rows by STRETCH rounds
                some = batch.slice(at, PIECE)
                places, sizes = (some.column(c).to_numpy(zero_copy_only=False) for c in (at_index, at_size))
                for start in range(0, rounds, STRETCH):
                    b = np.arange(start, min(start + STRETCH, rounds))
                    found = donor_positions(places, sizes, b, seed)
                    ends = pa.array(np.arange(len(places) + 1, dtype=np.int32) * len(b))
                    yield pa.RecordBatch.from_arrays(
                        [*some.columns, pa.array(np.full(len(places), start, np.int32)), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))],
                        names=[*kept, "_start", "_donors"])

    spread = spread.mapInArrow(run, T.StructType([*spread.schema.fields, T.StructField("_start", T.IntegerType()),
                                                  T.StructField("_donors", T.ArrayType(T.LongType()))]))
    return spread.select(*kept, "_start", F.posexplode("_donors").alias("_at", "donor")).select(
        *kept, (F.col("_start") + F.col("_at")).cast("int").alias("b"), "donor")
