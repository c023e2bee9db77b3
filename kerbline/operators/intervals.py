"""Interval joins through integer bins: equi joins that spread, in place of a nested loop over a theta condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bins(start: Column, end: Column, size: float) -> Column:
    """Numbers of the bins that [start, end) touches."""
    first = F.floor(start / size).cast("long")
    return F.sequence(first, F.greatest(first, F.ceil(end / size - 1e-12).cast("long") - 1))


def split(df: DataFrame, start: str, end: str, size: float, name: str = "bin") -> DataFrame:
    """A row per bin that an interval touches, with the length inside it (J18). Lengths add up to the interval's."""
    d = df.withColumn(name, F.explode(bins(F.col(start), F.col(end), size)))
    part = F.least(F.col(end), (F.col(name) + 1) * size) - F.greatest(F.col(start), F.col(name) * size)
    return d.withColumn("overlap_m", part).where("overlap_m > 0")


def overlap_join(a: DataFrame, b: DataFrame, key: list[str], size: float, names=("a0", "a1", "b0", "b1")) -> DataFrame:
    """Pairs of rows with equal key whose intervals overlap, each pair once: in the bin of the later start."""
    a0, a1, b0, b1 = names
    x = a.withColumn("__bin", F.explode(bins(F.col(a0), F.col(a1), size)))
    y = b.withColumn("__bin", F.explode(bins(F.col(b0), F.col(b1), size)))
    hit = x.join(y, [*key, "__bin"]).where((F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1)))
    return hit.where(F.col("__bin") == F.floor(F.greatest(a0, b0) / size)).drop("__bin")


def section(measure: Column, total: Column, size: float = 100.0, tail: float = 50.0) -> Column:
    """Section number of a measure on a path: size-long sections, a rest under tail joins the last."""
    whole = F.floor(total / size)
    n = F.greatest(F.lit(1), whole + F.when(total - whole * size >= tail, 1).otherwise(0))
    return F.least(F.greatest(F.floor(measure / size), F.lit(0)), n - 1).cast("long")
