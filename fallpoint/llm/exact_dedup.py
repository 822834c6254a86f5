"""Exact duplicates by content sort.

Sampled splitters deal the normalised bytes into key ranges, every range is sorted by
Spark's external sort so that equal texts become neighbours, and a scan compares each text
in full with the one before it.  A splitter is made of the first bytes, a hash and the row's
id: short enough to be sampled on the driver, and fine enough to spread one huge group of
copies over many ranges.  Runs at the edge of a range are put together afterwards: at most
the runs that share the first or the last splitter key of a range, one row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallpoint.llm.common import prepared, store, text_of

HEAD = 48  # bytes of the text that a splitter key holds; routing only, the comparison is of whole texts

RUNS = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("sha", pa.binary()),
                  ("best", pa.int64()), ("size", pa.int64()), ("lead", pa.bool_()), ("edge", pa.binary())])


def scan_runs(batches: Iterator[pa.RecordBatch], largest: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (head, hash, content) in; each row with its run of equal contents out.

    Of a run only its ids are held.  ``edge`` carries the content on one row of every run
    that may continue in a neighbouring range.
    """
    part = TaskContext.get().partitionId()
    first_key = key = content = None
    ids: list[int | None] = []
    run = -1
    held: list[tuple] = []  # runs of the latest key: they are edge runs if the range ends here

    def better(values):
        known = [v for v in values if v is not None]
        return (max(known) if largest else min(known)) if known else None

    def rows(done: list[tuple], edge: bool) -> Iterator[pa.RecordBatch]:
        for number, text, members in done:
            n, sha, best = len(members), hashlib.sha256(text).digest(), better(members)
            lead = members.index(best)
            for at in range(0, n, 20_000):
                some = members[at:at + 20_000]
                k = len(some)
                yield pa.record_batch([pa.array(some, pa.int64()), pa.array([part] * k, pa.int32()),
                                       pa.array([number] * k, pa.int64()), pa.array([sha] * k, pa.binary()),
                                       pa.array([best] * k, pa.int64()), pa.array([n] * k, pa.int64()),
                                       pa.array([at + j == lead for j in range(k)], pa.bool_()),
                                       pa.array([text if edge and not at else None] + [None] * (k - 1), pa.binary())], schema=RUNS)

    small: list[pa.RecordBatch] = []
    waiting = 0

    def gathered(more: Iterator[pa.RecordBatch], last: bool = False) -> Iterator[pa.RecordBatch]:
        nonlocal small, waiting
        for b in more:
            small.append(b)
            waiting += b.num_rows
            if waiting >= 5_000:
                yield pa.Table.from_batches(small).combine_chunks().to_batches()[0]
                small, waiting = [], 0
        if last and small:
            yield pa.Table.from_batches(small).combine_chunks().to_batches()[0]
            small, waiting = [], 0

    for b in batches:
        for i, head, code, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3)):
            text = text.as_py()
            if text == content:
                ids.append(i)
                continue
            if content is not None:
                held.append((run, content, ids))
            this = (head.as_py(), code)
            if this != key:
                yield from gathered(rows(held, key == first_key))
                held = []
            key = this
            first_key = this if first_key is None else first_key
            content, ids, run = text, [i], run + 1
    if content is not None:
        held.append((run, content, ids))
    yield from gathered(rows(held, True), last=True)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None,
                keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    ``normalise`` is the compared text as an expression (default: the text unchanged); null
    counts as empty.  ``keep`` names the id that stays, "smallest" or "largest"; null ids lose
    against any other.  Exactly one row of a group is kept: where the id that stays is repeated,
    the first of its rows.  An empty table gives no rows; further columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    spark = prepared(docs)
    data = text_of(F.col(text_col) if normalise is None else normalise).cast("binary")
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.substring(data, 1, HEAD).alias("head"),
                          F.xxhash64(data).alias("code"), data.alias("content"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = ordered.repartitionByRange(parts, "head", "code", "id").sortWithinPartitions("head", "code", "content", "id")
    largest = keep == "largest"
    runs = store(sorted_.mapInArrow(lambda batches: scan_runs(batches, largest),
                                    "id long, part int, run long, sha binary, best long, size long, lead boolean, edge binary"), "sorted-runs")
    best = F.max if largest else F.min
    edges = runs.where(F.col("edge").isNotNull()).select("part", "run", "edge", "best", "size")
    whole = edges.groupBy("edge").agg(best("best").alias("all_best"), F.sum("size").alias("all_size"),
                                      F.array_sort(F.collect_list(F.struct("part", "run", "best"))).alias("pieces"))
    stays = F.filter("pieces", lambda p: p["best"].eqNullSafe(F.col("all_best")))[0]
    # A range has two edge keys, so this side has a few rows per range whatever the table holds.
    joined = (whole.select(F.explode("pieces").alias("p"), stays.alias("s"), "all_best", "all_size")
              .select("p.part", "p.run", "all_best", "all_size", F.col("p").eqNullSafe(F.col("s")).alias("all_lead")))
    out = runs.drop("edge").join(F.broadcast(joined), ["part", "run"], "left")
    keep_id = F.when(F.col("all_size").isNull(), F.col("best")).otherwise(F.col("all_best"))
    return out.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("all_size", "size").alias("group_size"),
                      (F.col("lead") & F.coalesce("all_lead", F.lit(True))).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))
