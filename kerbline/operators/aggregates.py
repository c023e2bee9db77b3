"""Conditional aggregates over segments: lengths, counts, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from . import intervals


def percent(part: Column, whole: Column) -> Column:
    """Percent at three places, null of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 3))


def metres(cond: Column, name: str) -> Column:
    return F.round(F.coalesce(F.sum(F.when(cond, F.col("length_m"))), F.lit(0.0)), 2).alias(name)



def totals() -> list[Column]:
    """Aggregate columns of a set of segments (A8). A partial segment counts with its own length."""
    st, cl = F.col("status"), F.col("vlm_class")
    covered = st != "not_covered"
    count = lambda c, n: F.count_if(F.coalesce(c, F.lit(False))).alias(n)
    return [
        F.count("*").alias("segments"),
        *[count(st == s, f"n_{s}") for s in L.STATUSES],
        *[count(cl == c, f"class_{c}") for c in L.CLASSES],
        count(F.col("answered"), "n_answered"),
        count(F.col("needs_expert_review"), "n_needs_review"),
        count(F.col("expert_reviewed"), "n_reviewed"),
        metres(F.lit(True), "route_m"),
        metres(covered, "surveyed_m"),
        metres(st.isin("send", "audit"), "sent_m"),
        metres(covered & cl.isin("distress", "normal"), "classified_m"),
        *[metres(cl == c, f"{c}_m") for c in L.CLASSES],
    ]


def shares(df: DataFrame) -> DataFrame:
    d = F.col("distress_m")
    return df.withColumns({"pct_distress_of_surveyed": percent(d, F.col("surveyed_m")), "pct_distress_of_classified": percent(d, F.col("classified_m"))})


def aggregate(df: DataFrame, *by: str) -> DataFrame:
    """A8, and A11 when grouped: one pass, one shuffle of one row per group and task."""
    return shares(df.groupBy(*by).agg(*totals()))


def by_label(df: DataFrame, *by: str) -> DataFrame:
    """Segments and metres per label: distress segments once for each of their labels, normal ones as Normal."""
    labels = F.when(F.col("vlm_class") == "distress", L.valid_distress(F.col("final_labels"))).when(F.col("vlm_class") == "normal", F.array(F.lit("Normal")))
    rows = df.where("status <> 'not_covered' and vlm_class in ('distress', 'normal')").select(*by, "length_m", F.explode(labels).alias("label"))
    return rows.groupBy(*by, "label").agg(F.count("*").alias("segments"), F.round(F.sum("length_m"), 2).alias("length_m"))


def per_km(df: DataFrame, key: str = "session_id", size: float = 1000.0) -> DataFrame:
    """Stretches of `size` from each drive's first segment; a segment over an edge is split by length (A10)."""
    base = df.groupBy(key).agg(F.min("s0_m").alias("__base"))
    d = df.where("s0_m is not null and s1_m is not null").join(base, key).withColumn("s0_m", F.col("s0_m") - F.col("__base")).withColumn("s1_m", F.col("s1_m") - F.col("__base"))
    d = intervals.split(d, "s0_m", "s1_m", size, "km")
    part = lambda cond, n: F.round(F.coalesce(F.sum(F.when(cond, F.col("overlap_m"))), F.lit(0.0)), 2).alias(n)
    covered, cl = F.col("status") != "not_covered", F.col("vlm_class")
    out = d.groupBy(key, "km").agg(part(covered, "surveyed_m"), part(~covered, "not_covered_m"), part(covered & cl.isin("distress", "normal"), "classified_m"), *[part(covered & (cl == c), f"{c}_m") for c in L.CLASSES[:-1]])
    return shares(out)


# Labels of each rated parameter.
PARAMETER_LABELS = {
    "cracking": ("Alligator Cracking", "Longitudinal Cracking", "Transverse Cracking", "Edge Cracking", "Hairline Cracks"),
    "potholes": ("Potholes",),
    "ravelling": ("Ravelling",),
    "settlement": ("Settlement", "Shallow Depression"),
    "shoving": ("Shoving",),
}
#: Shares of skipped segments that hold a defect: expected and upper bound.
SKIP_POINT, SKIP_UPPER = 9 / 161, 0.1028


def quantities(df: DataFrame, *by: str) -> DataFrame:
    """Summed lengths of units and affected metres per parameter."""
    st, cl, m = F.col("status"), F.col("vlm_class"), F.col("length_m")
    ok = st.isin("send", "audit") & cl.isin("distress", "normal")
    total = lambda c, n: F.coalesce(F.sum(F.when(c, m)), F.lit(0.0)).alias(n)
    hit = lambda names: ok & (cl == "distress") & F.arrays_overlap("final_labels", L.array(names))
    return df.groupBy(*by).agg(
        total(F.lit(True), "length_m"), total(st != "not_covered", "imaged_m"), total(ok, "classified_m"), total(st == "skip", "skip_m"), total(st == "not_covered", "not_covered_m"),
        total((st != "not_covered") & (st != "skip") & ~ok, "unanswered_m"), *[total(hit(v), f"{k}_m") for k, v in PARAMETER_LABELS.items()],
    )


def coverage(df: DataFrame, rated: float = 0.80, low: float = 0.50) -> DataFrame:
    share = F.when(F.col("length_m") > 0, F.least(F.lit(1.0), F.col("imaged_m") / F.col("length_m"))).otherwise(0.0)
    d = df.withColumn("denominator_m", F.col("classified_m") + F.col("skip_m")).withColumn("coverage", share)
    bad = (F.col("denominator_m") <= 0) | (F.col("classified_m") <= 0) | (F.col("coverage") < low - 1e-9)
    return d.withColumn("coverage_status", F.when(bad, "insufficient").when(F.col("coverage") < rated - 1e-9, "low_coverage").otherwise("rated"))


def extents(df: DataFrame, *params: str) -> DataFrame:
    """lo, hi, point and uncorrected percent of each parameter over a unit's surveyed length."""
    d = F.col("denominator_m")
    out = {}
    for p in params or PARAMETER_LABELS:
        a = F.col(f"{p}_m")
        for name, v in (("lo", 100.0 * a / d), ("hi", 100.0 * (a + SKIP_UPPER * F.col("skip_m")) / d), ("point", 100.0 * (a + SKIP_POINT * F.col("skip_m")) / d)):
            out[f"{p}_{name}"] = F.when(d > 0, v)
        out[f"{p}_uncorrected"] = F.when((d > 0) & (F.col("classified_m") > 0), 100.0 * a / F.col("classified_m"))
    return df.withColumns(out)
