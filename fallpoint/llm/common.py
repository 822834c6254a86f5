"""Helpers that several text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fallpoint.shipping import ship_package


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a single machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def store(data: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, and a lost executor re-reads."""
    spark = data.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    data.write.parquet(path)
    return spark.read.schema(data.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def prepared(data: DataFrame) -> SparkSession:
    """The session of a frame, with this package sent to its executors."""
    ship_package(data.sparkSession)
    return data.sparkSession


def row_key(id_col: str | Column = "doc_id", text_col: str | Column = "text") -> list[Column]:
    """What tells rows apart that may share an id or a text: the id as text and a digest of the whole text."""
    id_ = F.col(id_col) if isinstance(id_col, str) else id_col
    return [F.coalesce(id_.cast("string"), F.lit("null")).alias("_key"), F.sha2(text_of(text_col), 256).alias("_sha")]


def only_rows(docs: DataFrame, stays: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is in ``stays`` (_key, _sha); of rows that repeat id and text one is left."""
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *row_key(id_col, text_col))
    return keyed.join(stays, ["_key", "_sha"], "left_semi").dropDuplicates(["_key", "_sha"]).select("row.*")


_HELD: dict = {}


def held(key: Hashable, make: Callable[[], object]):
    """What a Python worker keeps from task to task under ``key``, made once.

    Spark lets workers go on from one stage to the next; asking for something else drops what the stage before left.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]
