"""Reading and writing series tables: CSV with locale sniffing, composite keys, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fallpoint.functions.columns import lenient_number, split_key
from fallpoint.operators.quality import TableProblem, check_table


class FingerprintMismatch(RuntimeError):
    """A file is not the one that was agreed on."""


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Comma-separated file with a header; text columns unless a schema is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def normalised_header(data: DataFrame, lower: bool = True) -> DataFrame:
    names = [c.strip().lower() if lower else c.strip() for c in data.columns]
    return data.toDF(*names)


def read_local_csv(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """Text columns of a CSV and whether its numbers use a decimal comma.

    A header with ``;`` and no ``,`` is the spreadsheet format with semicolons and decimal
    commas.  A byte order mark is ignored; header names are trimmed and lower-cased.
    """
    head = spark.read.text(path).limit(1).first()
    header = head[0] if head else ""
    semicolon = ";" in header and "," not in header
    data = spark.read.option("header", True).option("sep", ";" if semicolon else ",").csv(path)
    data = data.toDF(*[c.replace("﻿", "") for c in data.columns])
    return normalised_header(data), semicolon


def load_series(spark: SparkSession, path: str, *, id_col: str = "culture", day_col: str = "day",
                value_col: str = "lactate") -> DataFrame:
    """Checked series table of a user file; raises :class:`TableProblem` with the reason."""
    data, comma = read_local_csv(spark, path)
    problem = check_table(data, required=[id_col, day_col, value_col], numeric=[day_col, value_col],
                          day_col=day_col, decimal_comma=comma)
    if problem:
        raise TableProblem(problem)
    return data.withColumns({c: lenient_number(F.col(c), comma) for c in (day_col, value_col)})


def with_split_key(data: DataFrame, key: str, id_name: str = "id", day_name: str = "day", pattern: str = r"^(.+)_d(\d+)$") -> DataFrame:
    """Split a composite key into id and day; ``pattern`` has a group for each."""
    ident, day = split_key(F.col(key), pattern)
    return data.withColumns({id_name: ident, day_name: day})


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def require_fingerprint(spark: SparkSession, path: str, expected: str) -> None:
    got = [r["sha256"] for r in fingerprint(spark, path).select("sha256").limit(2).collect()]
    if got != [expected]:
        raise FingerprintMismatch(f"{path}: {got[0][:12] if got else 'no file'}... instead of {expected[:12]}...")


def rounded(data: DataFrame, digits: int) -> DataFrame:
    return data.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in data.dtypes])


def write_csv(data: DataFrame, path: str, digits: int | None = None) -> None:
    out = data if digits is None else rounded(data, digits)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_table(data: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    data.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def from_rows(spark: SparkSession, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)
