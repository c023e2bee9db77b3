"""Gaps and islands, and other sequence helpers: one shuffle by the partition key each."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, positive: Column, key: str, order: str, measure: str | None = None, length: str | None = None) -> DataFrame:
    """(key, first, last, n[, length][, measure]): maximal stretches of positive rows with consecutive order.

    Only positive rows are shuffled; order - row_number is constant along a run.
    """
    w = Window.partitionBy(key).orderBy(order)
    hit = df.where(positive).withColumn("island", F.col(order) - F.row_number().over(w))
    aggs = [F.min(order).alias("k_first"), F.max(order).alias("k_last"), F.count("*").alias("n")]
    aggs += [F.sum(length).alias("length_m")] if length else []
    aggs += [F.min(measure).alias("measure_m")] if measure else []
    return hit.groupBy(key, "island").agg(*aggs).drop("island")


def parts(df: DataFrame, broken: Column, key: str, order: str, name: str = "part") -> DataFrame:
    """df with a part number per key that grows where `broken` (over lag/lead of the same order) holds."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__b", F.when(broken, 1).otherwise(0)).withColumn(name, F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def drive_ends(df: DataFrame, key: str = "session_id", order: str = "k") -> DataFrame:
    """Rows at which a stretch of consecutive order begins or ends."""
    w = Window.partitionBy(key).orderBy(order)
    d = df.withColumn("is_start", F.coalesce(F.lag(order).over(w) != F.col(order) - 1, F.lit(True))).withColumn("is_end", F.coalesce(F.lead(order).over(w) != F.col(order) + 1, F.lit(True)))
    return d.where("is_start or is_end")


def last_known(df: DataFrame, column: str, key: str, *order: str) -> Column:
    """As-of value: the latest non-null one up to this row."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def increasing(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Rows kept while order and every value are above those of the last row kept.

    Each test depends on what was kept before, so a group is one sequential pass.
    """
    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, rows = pdf.sort_values([order, *values], kind="stable"), None, []
        for i, row in enumerate(pdf[[order, *values]].itertuples(index=False)):
            if last is None or all(a > b for a, b in zip(row, last, strict=True)):
                rows.append(i)
                last = row
        return pdf.iloc[rows]

    return df.groupBy(key).applyInPandas(keep, df.schema)


def reset_blocks(df: DataFrame, key: str, order: str, step: str, size: float = 100.0, tail: float = 50.0) -> DataFrame:
    """df with `block`: a new one once the distance since its start reaches size; a last one under tail joins the one
    before (W22). The cut depends on the previous cut: an array fold per key would copy, so one pass per group."""
    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out, at, n = [], 0.0, 0
        for v in pdf[step]:
            if at >= size:
                n, at = n + 1, 0.0
            out.append(n)
            at += v
        if n and at < tail:
            out = [min(b, n - 1) for b in out]
        return pdf.assign(block=pd.array(out, dtype="int64"))

    from pyspark.sql.types import LongType, StructField, StructType

    return df.groupBy(key).applyInPandas(cut, StructType([*df.schema.fields, StructField("block", LongType())]))


def fold(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any sequential kernel per key."""
    return df.groupBy(key).applyInPandas(fn, schema)
