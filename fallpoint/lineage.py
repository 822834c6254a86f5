"""Cutting long lineages at a reliable store.

A result that several branches read is written once to the shared folder of the session; a
lost executor then re-reads it instead of recomputing everything before it.  The store is
Parquet, so later readers take only the columns they need and Spark knows its size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(data: DataFrame) -> DataFrame:
    """Write to the folder named by ``spark.checkpoint.dir`` and read back.

    Only where a session on a single machine names none a temporary one is set; a cluster must name one.
    """
    spark = data.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    path = f"{named.rstrip('/')}/cut-{uuid.uuid4().hex}"
    data.write.parquet(path)
    return spark.read.schema(data.schema).parquet(path)


def few_rows(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of a few rows whose size Spark knows.

    A join sends it to the other side; the size of a local collection counts as unknown, so large tables would be sorted by its key.
    """
    columns = [c.rsplit(" ", 1) for c in schema.split(", ")]
    item = lambda row: F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, columns)])
    return spark.range(1).select(F.inline(F.array(*map(item, rows))))
