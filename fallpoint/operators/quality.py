"""Row filters, table checks and reading quality control."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fallpoint.contracts import as_list, finite, whole
from fallpoint.functions.columns import flag, lenient_number
from fallpoint.operators.ordered import exact_quantiles


class TableProblem(ValueError):
    """A user table cannot be used; the message says where."""


def missing_columns(present: Sequence[str], required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(present))


def numbered(data: DataFrame, out: str = "row") -> DataFrame:
    """Add the 1-based row number in reading order, from per-partition counts.

    Positions inside a partition come with the row; only one count per partition is
    gathered to shift them.
    """
    rows = data.withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumns({"_part": F.shiftright("_id", 33),
                             "_pos": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    per_part = F.map_from_entries(F.collect_list(F.struct("_part", "_n")))
    offsets = sizes.agg(per_part).scalar()
    rows = rows.withColumn("_sizes", offsets)
    ahead = F.aggregate(F.filter(F.map_entries("_sizes"), lambda e: e["key"] < F.col("_part")),
                        F.lit(0).cast("long"), lambda a, e: a + e["value"])
    return (rows.withColumn(out, ahead + F.col("_pos") + 1)
            .drop("_id", "_part", "_pos", "_sizes"))


def bad_cells(data: DataFrame, column: str, decimal_comma: bool = False) -> DataFrame:
    """Cells that hold text but no number: ``row`` and ``cell``."""
    rows = numbered(data.select(column))
    cell = F.col(column)
    return (rows.where(cell.isNotNull() & lenient_number(cell, decimal_comma).isNull())
            .select("row", cell.alias("cell")))


def check_table(data: DataFrame, *, required: Sequence[str], numeric: Sequence[str],
                day_col: str, decimal_comma: bool = False) -> str | None:
    """First reason why a user table cannot be used, or None.

    ``data`` holds text columns; row numbers count the header line as row 1.
    """
    gone = missing_columns(data.columns, required)
    if gone:
        return (f"the table lacks the columns {gone}; it needs {sorted(required)}, "
                f"found {data.columns}")
    if data.isEmpty():
        return "the table has no data, only a header"
    first = first_faults(data, numeric=numeric, day_col=day_col, decimal_comma=decimal_comma).first()
    for i, c in enumerate(numeric):
        if (bad := first[f"bad_{i}"]) is not None:
            return f"column {c}, row {bad['row'] + 1} of the file: '{bad['cell']}' is not a number"
    if first["no_day"] is not None:
        return f"row {first['no_day'] + 1} of the file has no day"
    return None


def first_faults(data: DataFrame, *, numeric: Sequence[str], day_col: str, decimal_comma: bool = False) -> DataFrame:
    """One row from one pass: for the i-th numeric column ``bad_i``, its first (row, cell) that is no number, and
    ``no_day``, the first row without a day; NULL where there is none."""
    def bad(c: str) -> Column:
        cell = F.col(c)
        wrong = cell.isNotNull() & lenient_number(cell, decimal_comma).isNull()
        return F.min(F.when(wrong, F.struct("row", cell.cast("string").alias("cell"))))

    rows = numbered(data.select(*dict.fromkeys([*numeric, day_col])))
    return rows.agg(*[bad(c).alias(f"bad_{i}") for i, c in enumerate(numeric)], F.min(F.when(F.col(day_col).isNull(), F.col("row"))).alias("no_day"))


def drop_incomplete(data: DataFrame, *, id_col, need: Sequence[str],
                    min_rows: int = 1) -> DataFrame:
    """Drop rows missing any needed column, then series left with too few rows."""
    rows = data.na.drop(subset=list(need))
    if min_rows <= 1:
        return rows
    return (rows.withColumn("_n", F.count(F.lit(1)).over(whole(id_col)))
            .where(F.col("_n") >= min_rows).drop("_n"))


def day_range(data: DataFrame, *, day_col: str, first: int, last: int) -> DataFrame:
    return data.where(F.col(day_col).between(first, last))


def exclusion(labels: DataFrame, *, window: int, peaks: DataFrame | None = None, id_col=None,
              peak_col: str = "peak", min_peak: float = 0.03) -> DataFrame:
    """Flag labels whose event falls inside the window or whose signal never accumulates."""
    inside = F.coalesce(F.col("occurred") & (F.col("day") <= window), F.lit(False))
    if peaks is None:
        return labels.withColumn("excluded", inside)
    ids = as_list(id_col)
    out = labels.join(peaks.select(*ids, peak_col), ids, "left")
    out = out.withColumn("never_accumulates", F.coalesce(F.col(peak_col) < min_peak, F.lit(False)))
    return out.withColumn("excluded", inside | F.col("never_accumulates")).drop(peak_col)


def rename(data: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return data.withColumnsRenamed(dict(names))


def day_indicators(day: Column, first: int = 3, last: int = 11) -> dict[str, Column]:
    """0/1 columns d3..d11 plus d12p; the days before ``first`` are the reference."""
    out = {f"d{k}": (day == k).cast("int") for k in range(first, last + 1)}
    out[f"d{last + 1}p"] = (day > last).cast("int")
    return out


def group_indicators(group: Column, levels: Sequence[str]) -> dict[str, Column]:
    """0/1 columns for every listed level but the first, plus ``g_other`` for the rest."""
    out = {f"g_{v}": flag(group == v) for v in list(levels)[1:]}
    out["g_other"] = flag(~group.isin(list(levels)))
    return out


def mask_outliers(data: DataFrame, *, value_col: str, mask_cols: Sequence[str],
                  zero_cols: Sequence[str] = (), spread: float = 3.0) -> DataFrame:
    """Invalidate readings; adds ``fence_hit``.

    A value more than ``spread`` interquartile ranges outside the quartiles of the whole
    table NULLs all of ``mask_cols`` in its row; an exact zero NULLs only its own column.
    """
    q = exact_quantiles(data, value=value_col, probs=[0.25, 0.75], names=["q1", "q3"])
    rows = data.withColumn("_q", q.select(F.struct("q1", "q3")).scalar())
    q1, q3 = F.col("_q.q1"), F.col("_q.q3")
    v, reach = F.col(value_col), spread * (q3 - q1)
    rows = rows.withColumn("fence_hit", F.coalesce((v < q1 - reach) | (v > q3 + reach), F.lit(False)))
    cols = dict.fromkeys([*mask_cols, *zero_cols])
    new = {}
    for c in cols:
        hit = F.col("fence_hit") if c in mask_cols else F.lit(False)
        if c in zero_cols:
            hit = hit | F.coalesce(F.col(c) == 0, F.lit(False))
        new[c] = F.when(~hit, F.col(c))
    return rows.withColumns(new).drop("_q")


def outlier_log(data: DataFrame, *, keep: Sequence[str], value_col: str,
                spread: float = 3.0) -> DataFrame:
    """The rows whose value lies outside the fences, as read."""
    q = exact_quantiles(data, value=value_col, probs=[0.25, 0.75], names=["q1", "q3"])
    rows = data.withColumn("_q", q.select(F.struct("q1", "q3")).scalar())
    q1, q3 = F.col("_q.q1"), F.col("_q.q3")
    v, reach = F.col(value_col), spread * (q3 - q1)
    return rows.where((v < q1 - reach) | (v > q3 + reach)).select(*keep)


def zero_summary(data: DataFrame, *, id_col, zero_cols: Sequence[str],
                 companion: str) -> DataFrame:
    """Per column: exact zeros, distinct ids with one, and zeros whose companion is missing.

    Counted per id first, so the distinct count needs no extra shuffle of data rows.
    """
    ids = as_list(id_col)
    one = data.groupBy(*ids).agg(*[x for c in zero_cols for x in (
        F.count_if(F.col(c) == 0).alias(f"z_{c}"),
        F.count_if((F.col(c) == 0) & F.col(companion).isNull()).alias(f"m_{c}"))])
    tot = one.agg(*[x for c in zero_cols for x in (
        F.sum(f"z_{c}").alias(f"z_{c}"), F.count_if(F.col(f"z_{c}") > 0).alias(f"i_{c}"),
        F.sum(f"m_{c}").alias(f"m_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"z_{c}").alias("zeros"),
                              F.col(f"i_{c}").alias("ids"), F.col(f"m_{c}").alias("companion_missing"))
                     for c in zero_cols])
    return tot.select(F.inline(rows))


def varying_columns(data: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least two distinct values; one aggregate, one row to the driver."""
    got = data.agg(*[F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(c) for c in columns]).first()
    return [c for c in columns if got[c]]


def prefixed(columns: Sequence[str], prefixes: Sequence[str]) -> list[str]:
    return [c for c in columns if c.startswith(tuple(prefixes))]


def whole_days(data: DataFrame, *, id_col, day_col: str, value_col: str,
               starts_at_zero: Column) -> DataFrame:
    """Fractional days to whole days from 1 (half to even); repeated days are averaged.

    Adds ``shift``, the number of days added to axes that start at 0.
    """
    ids = as_list(id_col)
    shift = F.when(starts_at_zero, 1).otherwise(0)
    rows = data.select(*ids, finite(day_col).alias("_d"), finite(value_col).alias(value_col),
                       shift.alias("shift"))
    rows = rows.withColumn(day_col, (F.bround("_d", 0) + F.col("shift")).cast("int"))
    return rows.groupBy(*ids, day_col).agg(F.avg(value_col).alias(value_col),
                                           F.max("shift").alias("shift"))
