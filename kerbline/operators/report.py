"""The condition report of a path: sections, kilometres and the stretch, all from summed quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rating
from . import aggregates as A
from . import intervals, islands


def membership(segments: DataFrame, path: DataFrame, total: Column | None = None) -> DataFrame:
    """(segment_id, section, role): each segment of a path or of an attached pass in the section of its measure.

    path(segment_id, m, role); the path's length is the largest measure plus one segment unless given.
    """
    d = path.join(segments.select("segment_id", "length_m"), "segment_id")
    end = total if total is not None else F.max(F.col("m") + F.col("length_m")).over(Window.partitionBy(F.col("m") < 0))
    return d.withColumn("total", end).select("segment_id", intervals.section(F.col("m"), F.col("total")).alias("section"), "role")


def bracket(units: DataFrame, road_class: str = "urban") -> DataFrame:
    """units with final_lo, final_hi and class: assessed parameters at their worst and best extents, the others at 1.0
    and 3.0 (M6)."""
    lim, rated = rating.LIMITS[road_class], ("cracking", "potholes")
    at = lambda p, e: rating.weighted(F.lit(rating.WEIGHTS[p]), rating.rating(F.col(f"{p}_{e}"), F.lit(lim[p][0]), F.lit(lim[p][1]), F.lit(road_class == "urban" and p == "potholes")))
    fixed = lambda p, r: rating.weighted(F.lit(rating.WEIGHTS[p]), F.lit(r))
    mean = lambda cs: rating.half_up(F.round(sum(cs[1:], cs[0]) / len(cs), 9))
    lo = mean([at(p, "hi") if p in rated else fixed(p, 1.0) for p in lim])
    hi = mean([at(p, "lo") if p in rated else fixed(p, 3.0) for p in lim])
    return units.withColumn("final_lo", lo).withColumn("final_hi", hi).withColumn("class", rating.class_range(rating.final_class(F.col("final_lo")), rating.final_class(F.col("final_hi"))))


def report(chosen: DataFrame, road_class: str = "urban") -> DataFrame:
    """(level, path, unit, quantities, extents, rating) of chosen(path, m, .. segment columns).

    Quantities of a kilometre and of the stretch are sums of its sections' rows; ratings are never averaged.
    """
    d = chosen.withColumn("section", F.floor(F.col("m") / 100))
    s = A.quantities(d, "path", "section")
    q = [c for c in s.columns if c not in ("path", "section")]
    level = lambda u, n: s.groupBy("path", u.alias("unit")).agg(*[F.sum(c).alias(c) for c in q]).withColumn("level", F.lit(n))
    units = s.withColumnRenamed("section", "unit").withColumn("level", F.lit("section")).unionByName(level(F.floor(F.col("section") / 10), "km")).unionByName(level(F.lit(0).cast("long"), "stretch"))
    units = A.extents(A.coverage(units), "cracking", "potholes")
    rated = bracket(units, road_class)
    keep = F.col("coverage_status") != "insufficient"
    return rated.withColumns({c: F.when(keep, F.col(c)) for c in ("final_lo", "final_hi", "class")})


def geometry(df: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, surveyed, part, a, b, points): stretches of surveyed and of missing segments in order."""
    w = Window.partitionBy(key).orderBy("k")
    d = df.withColumn("surveyed", F.col("status") != "not_covered")
    d = islands.parts(d, F.coalesce((F.lag("surveyed").over(w) != F.col("surveyed")) | (F.lag("k").over(w) != F.col("k") - 1), F.lit(True)), key, "k")
    return d.groupBy(key, "surveyed", "part").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("points"))


def explicit_gap(ends: DataFrame, starts: DataFrame, most: float = 300.0) -> DataFrame:
    """The cheapest way from one of A's ends to one of B's within `most` metres (G3). A request has a few of each."""
    from . import spatial

    return spatial.radius_pairs(ends, starts, most).orderBy("d", "id", "id_b").limit(1)


