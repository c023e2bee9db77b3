"""Verdicts of a model's answer against an expert's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import type_set


def compare(df: DataFrame) -> DataFrame:
    """df(vlm_distress, expert_distress, v, e[, vlm_severity, expert_severity]) with verdict, jaccard, severity step,
    missed and extra types (X19). Both normal is right; one normal is wrong; else by the sets of types."""
    m = F.when(F.col("vlm_distress"), type_set(F.col("v"))).otherwise(F.array().cast("array<string>"))
    d = df.withColumn("__m", m).withColumn("__e", type_set(F.col("e")))
    i, u = F.size(F.array_intersect("__m", "__e")), F.size(F.array_union("__m", "__e"))
    both, neither = F.col("vlm_distress") & F.col("expert_distress"), ~F.col("vlm_distress") & ~F.col("expert_distress")
    out = {
        "verdict": F.when(neither, "right").when(~both, "wrong").when(i == u, "right").when(i > 0, "close").otherwise("wrong"),
        "jaccard": F.round(F.when(neither, 1.0).when(~both, 0.0).otherwise(F.when(u > 0, i / u).otherwise(1.0)), 4),
        "missed": F.array_sort(F.array_except("__e", "__m")),
        "extra": F.array_sort(F.array_except("__m", "__e")),
    }
    if "vlm_severity" in df.columns:
        out["severity_diff"] = F.when(both, F.col("vlm_severity") - F.col("expert_severity"))
    return d.withColumns(out).drop("__m", "__e")
