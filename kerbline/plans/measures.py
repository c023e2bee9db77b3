"""Ratings, agreement and calibration statistics, estimates, signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import estimate, rating, signal, spatial_math, stats
from ..operators import aggregates as A
from ..operators import extent, roughness
from ..sources.views import over, table, view
from .registry import query, whole
from .segments import sections, segments


def r6(c, n):
    return F.round(c, 6).alias(n)


# ---- ratings


@query("M1_bands", over("SELECT block, n, CASE WHEN x > 15 + 1e-9 THEN 'Poor' WHEN x < 5 - 1e-9 THEN 'Good' ELSE 'Fair' END AS cracking, CASE WHEN x - 10 <= 1e-9 THEN 'Good' WHEN x - 10 > 0.5 + 1e-9 THEN 'Poor' ELSE 'Fair' END AS potholes FROM survey"))
def m1(spark, sf):
    b = lambda x, lo, hi, nil: rating.band(x, F.lit(lo), F.lit(hi), F.lit(nil))
    return view(spark, sf, "survey").select("block", "n", b(F.col("x"), 5.0, 15.0, False).alias("cracking"), b(F.greatest(F.col("x") - 10, F.lit(0.0)), 0.0, 0.5, True).alias("potholes"))


@query("M2_rating_value", over("SELECT block, n, CASE WHEN x > 15 THEN 1.0 WHEN x < 5 THEN least(3.0, greatest(2.1, floor(10 * (3.0 - x / 5) + 1e-9) / 10)) ELSE least(2.0, greatest(1.1, floor(10 * (2.0 - (x - 5) / 10) + 1e-9) / 10)) END AS r FROM survey"))
def m2(spark, sf):
    return view(spark, sf, "survey").select("block", "n", rating.rating(F.col("x"), F.lit(5.0), F.lit(15.0), F.lit(False)).alias("r"))


@query("M3_half_up", over("SELECT block, n, round(CAST(x AS DECIMAL(12, 6)) / 8, 1) AS d FROM survey WHERE x % 2 = 1".replace("round(CAST(x AS DECIMAL(12, 6)) / 8, 1)", "CAST(floor(x * 10 / 8 + 0.5) AS DOUBLE) / 10")))
def m3(spark, sf):
    return view(spark, sf, "survey").where("x % 2 = 1").select("block", "n", rating.half_up(F.col("x") / 8).alias("d"))


@query("M4_final_class", over("SELECT block, n, CASE WHEN x / 20 < 1.05 THEN 'Poor' WHEN x / 20 < 2.05 THEN 'Fair' ELSE 'Good' END AS c FROM survey"))
def m4(spark, sf):
    return view(spark, sf, "survey").select("block", "n", rating.final_class(F.col("x") / 20).alias("c"))


@query("M5_full_rating")
def m5(spark, sf):
    s = view(spark, sf, "survey")
    p = F.expr("element_at(array('cracking', 'ravelling', 'potholes', 'settlement', 'rut_depth'), cast(n % 5 + 1 as int))")
    v = s.select("block", p.alias("param"), (F.col("x") / 4).alias("x")).groupBy("block", "param").agg(F.max("x").alias("x"))
    full = v.groupBy("block").agg(F.count("*").alias("c")).where("c = 5").select("block")
    return rating.rate(v.join(full, "block").withColumn("road_class", F.lit("urban")), "block")


@query("M6_bracketed_rating")
def m6(spark, sf):
    """Assessed parameters at their best and worst extents, the others at 3.0 and 1.0."""
    d = A.extents(sections(spark, sf), "cracking", "potholes").where("coverage_status <> 'insufficient'")
    lim = rating.LIMITS["urban"]
    one = lambda p, e: rating.weighted(F.lit(rating.WEIGHTS[p]), rating.rating(F.col(f"{p}_{e}"), F.lit(lim[p][0]), F.lit(lim[p][1]), F.lit(p == "potholes")))
    fix = lambda p, r: rating.weighted(F.lit(rating.WEIGHTS[p]), F.lit(r))
    rest = [p for p in lim if p not in ("cracking", "potholes")]
    mean = lambda cs: rating.half_up(F.round(sum(cs[1:], cs[0]) / len(cs), 9))
    hi, lo = mean([one("cracking", "lo"), one("potholes", "lo"), *[fix(p, 3.0) for p in rest]]), mean([one("cracking", "hi"), one("potholes", "hi"), *[fix(p, 1.0) for p in rest]])
    return d.select("session_id", "section", lo.alias("final_lo"), hi.alias("final_hi"), rating.class_range(rating.final_class(lo), rating.final_class(hi)).alias("class"))


_FAST = "least(100, greatest(0, 7231.0 / (x * x - 0.737 * x + 73.09)))"


@query("M7_index_curves", over(f"SELECT block, n, round({_FAST}, 6) AS cracking, round(least(100, greatest(0, 52.92 * exp(-0.02525 * x) + 44.1 * exp(-0.2899 * x))), 6) AS ravelling, round(least(100, greatest(0, (((-80.32 * x + 1129.0) * x - 3524.0) * x + 3566.0) / (((x + 5.791) * x - 28.67) * x + 35.72))), 6) AS potholes FROM survey"))
def m7(spark, sf):
    return view(spark, sf, "survey").select("block", "n", *[r6(rating.index_param("highway", p, F.col("x")), p) for p in ("cracking", "ravelling", "potholes")])


@query("M8_unusable", over("SELECT block, n, CAST(NULL AS DOUBLE) AS potholes, round(least(100, greatest(0, (25.16 * y + 48.45) / ((y - 5.079) * y + 7.595))), 6) AS iri FROM (SELECT block, n, greatest(x / 4 + 3, 3) AS y FROM survey) q"))
def m8(spark, sf):
    return view(spark, sf, "survey").select("block", "n", rating.index_param("rural", "potholes", F.col("x")).alias("potholes"), r6(rating.index_param("rural", "iri", F.col("x") / 4 + 3), "iri"))


_PEAKS = [(c, s, rating.peak(k)) for c in ("mdr", "rural") for s, k in rating.CURVES[c]["iri"].items() if k]


@query("M9_curve_peaks", over(f"SELECT road_class, surface, peak, count(*) FILTER (y / 8 > peak) AS beyond, count(*) AS n FROM survey, (VALUES {', '.join(map(str, _PEAKS))}) AS v(road_class, surface, peak) GROUP BY ALL"))
def m9(spark, sf):
    """How many roughness values of the survey lie beyond the peak of each curve, where it is no longer monotone."""
    over_ = [F.count_if(F.col("y") / 8 > p).alias(str(i)) for i, (_, _, p) in enumerate(_PEAKS)]
    d = view(spark, sf, "survey").agg(F.count("*").alias("n"), F.array(*over_).alias("beyond"))
    d = d.select("n", F.explode(F.arrays_zip(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("s"), F.lit(p).alias("p")) for c, s, p in _PEAKS]).alias("v"), "beyond")).alias("r"))
    return d.select(F.col("r.v.c").alias("road_class"), F.col("r.v.s").alias("surface"), F.col("r.v.p").alias("peak"), F.col("r.beyond").alias("beyond"), "n")


@query("M10_index_clamped", over("SELECT block, n, round(least(100, greatest(0, 100.0 / (pow(greatest(x / 5, 2), 1.91) - 3.542 * greatest(x / 5, 2) + 4.315))), 6) AS iri FROM survey"))
def m10(spark, sf):
    return view(spark, sf, "survey").select("block", "n", r6(rating.index_param("highway", "iri", F.col("x") / 5), "iri"))


@query("M11_index_bounds", over("WITH g AS (SELECT block, n, x, x + (CASE WHEN i = 400 THEN 5.0 ELSE 5.0 * i / 400 END) AS v FROM (SELECT DISTINCT block, n, x FROM survey) z, range(401) r(i)), f AS (SELECT block, n, x, least(100, greatest(0, 7231.0 / (v * v - 0.737 * v + 73.09))) AS p FROM g) SELECT block, n, x, round(min(p), 6) AS worst, round(max(p), 6) AS best FROM f GROUP BY 1, 2, 3"))
def m11(spark, sf):
    return _bounds(view(spark, sf, "survey"))


def _bounds(survey):
    # bounds depend on x alone: 401 values are taken once for each, however many rows hold it
    rows = survey.select("block", "n", "x").distinct()
    b = rating.index_bounds("highway", "cracking", F.col("x"), F.col("x") + 5.0)
    each = survey.select("x").distinct().select("x", b.alias("b")).select(F.col("x").alias("at"), r6(F.col("b.worst"), "worst"), r6(F.col("b.best"), "best"))
    return rows.join(each, rows["x"].eqNullSafe(each["at"])).select("block", "n", "x", "worst", "best")


@query("M12_index_class", over("SELECT block, n, CASE WHEN x * 2 > 90 THEN 'Excellent' WHEN x * 2 > 80 THEN 'Good' WHEN x * 2 > 60 THEN 'Satisfactory' WHEN x * 2 > 40 THEN 'Fair' WHEN x * 2 > 20 THEN 'Poor' ELSE 'Fail' END AS c FROM survey"))
def m12(spark, sf):
    return view(spark, sf, "survey").select("block", "n", rating.index_class(F.col("x") * 2).alias("c"))


def _six(x):
    return {"cracking": x / 4, "ravelling": x / 8, "potholes": x / 15, "patching": x / 9, "rut_depth": x / 5, "iri": 2 + x / 12}


@query("M13_full_index", over("SELECT block, n, round(0.12 * f(x / 4) + 0.10 * e(x / 8) + 0.08 * e(x / 9) + 0.14 * f(x / 5), 6) AS part FROM survey".replace("f(x / 4)", "least(100, 7231.0 / (x / 4 * x / 4 - 0.737 * x / 4 + 73.09))").replace("f(x / 5)", "least(100, 7231.0 / (x / 5 * x / 5 - 0.737 * x / 5 + 73.09))").replace("e(x / 8)", "least(100, 52.92 * exp(-0.02525 * x / 8) + 44.1 * exp(-0.2899 * x / 8))").replace("e(x / 9)", "least(100, 52.92 * exp(-0.02525 * x / 9) + 44.1 * exp(-0.2899 * x / 9))")))
def m13(spark, sf):
    v = _six(F.col("x"))
    r = rating.index_range("highway", {k: v[k] for k in ("cracking", "ravelling", "patching", "rut_depth")})
    return view(spark, sf, "survey").select("block", "n", r6(r["lo"], "part"))


@query("M14_source_precedence", over("SELECT id, CASE WHEN id % 4 = 0 THEN 1.5 WHEN p1 > 0.5 THEN round(p1 * 10, 6) WHEN p2 > 0.5 THEN round(p2 * 8, 6) ELSE 2.0 END AS v, CASE WHEN id % 4 = 0 THEN 'entered' WHEN p1 > 0.5 THEN 'probe' WHEN p2 > 0.5 THEN 'roughness' ELSE 'labels' END AS src FROM probes"))
def m14(spark, sf):
    pick = [("entered", F.when(F.col("id") % 4 == 0, 1.5)), ("probe", F.when(F.col("p1") > 0.5, F.round(F.col("p1") * 10, 6))), ("roughness", F.when(F.col("p2") > 0.5, F.round(F.col("p2") * 8, 6))), ("labels", F.lit(2.0))]
    return view(spark, sf, "probes").select("id", F.coalesce(*[v for _, v in pick]).alias("v"), F.coalesce(*[F.when(v.isNotNull(), n) for n, v in pick]).alias("src"))


@query("M15_index_band", over("SELECT block, n, CASE WHEN x < 5 - 1e-9 THEN 'Excellent to Good' WHEN x > 10 + 1e-9 THEN 'Poor to Fail' ELSE 'Satisfactory to Fair' END AS cracking, CASE WHEN x <= 3 + 1e-9 - 3 THEN 'Excellent to Good' WHEN x > 2 + 1e-9 THEN 'Poor to Fail' ELSE 'Satisfactory to Fair' END AS potholes FROM survey"))
def m15(spark, sf):
    return view(spark, sf, "survey").select("block", "n", *[rating.index_band("highway", p, F.col("x")).alias(p) for p in ("cracking", "potholes")])


@query("M16_estimate_inputs")
def m16(spark, sf):
    g = segments(spark, sf).groupBy("session_id").agg(F.count_if(F.col("vlm_class") == "distress").alias("k"), F.count("*").alias("n"))
    return g.select("session_id", "k", "n", estimate.binomial_upper(F.col("k"), F.col("n"), 0.95).alias("share_hi"), estimate.poisson_quantile(F.col("k") / 4, 0.95).alias("count_hi"))


@query("M17_split_normal")
def m17(spark, sf):
    q = estimate.split_normal((F.col("p1") * 0.98 + 0.01), F.lit(2.0), F.lit(5.0), F.lit(12.0))
    return view(spark, sf, "probes").select("id", q.alias("v"))


def _units(spark, sf):
    d = A.extents(sections(spark, sf), "cracking", "potholes").where("coverage_status = 'rated'")
    return d.select("session_id", F.col("section").alias("order"), "length_m", *[F.col(f"{p}_{a}").alias(f"{p}_{b}") for p in ("cracking", "potholes") for a, b in (("lo", "lo"), ("point", "mid"), ("hi", "hi"))])


@query("M18_monte_carlo")
def m18(spark, sf):
    return estimate.estimate(_units(spark, sf), "session_id", "highway", ["cracking", "potholes"], 4000, 1)


@query("M19_stretch_copula")
def m19(spark, sf):
    return estimate.estimate(_units(spark, sf), "session_id", "highway", ["cracking", "potholes"], 3000, 1, 0.5)


@query("M20_angles", over("SELECT event_id, round(least(abs(value - 90) % 360, 360 - abs(value - 90) % 360), 6) AS d FROM segments"))
def m20(spark, sf):
    from ..operators.spatial import angle_difference

    return segments(spark, sf).select("event_id", r6(angle_difference(F.col("value"), F.lit(90.0)), "d"))


@query("M21_haversine", over("SELECT event_id, round(2 * 6371000 * asin(sqrt(pow(sin(radians(centre_lat - 12.9) / 2), 2) + cos(radians(12.9)) * cos(radians(centre_lat)) * pow(sin(radians(centre_lon - 77.5) / 2), 2))), 3) AS d FROM segments"))
def m21(spark, sf):
    from ..operators.spatial import haversine

    return segments(spark, sf).select("event_id", F.round(haversine(F.lit(77.5), F.lit(12.9), F.col("centre_lon"), F.col("centre_lat")), 3).alias("d"))


@query("M22_interpolate", over("SELECT event_id, round(CASE WHEN value < 100 THEN value ELSE 100 + (value - 100) * 2 END, 6) AS x FROM segments WHERE value < 490"))
def m22(spark, sf):
    from ..operators.network import polyline_point

    line = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(x).alias("x"), F.lit(0.0).alias("y")) for m, x in ((0.0, 0.0), (100.0, 100.0), (600.0, 1100.0))])
    return segments(spark, sf).where("value < 490").select("event_id", r6(polyline_point(line, F.col("value"))["x"], "x"))


@query("M23_ring_repair", over("SELECT block, count(*) AS n FROM survey GROUP BY 1 HAVING count(DISTINCT (x, y)) >= 3"))
def m23(spark, sf):
    return _rings(view(spark, sf, "survey"))


def _rings(survey):
    from ..operators.spatial import repair_ring

    r = survey.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    return r.where(repair_ring(F.col("ring")).isNotNull()).select("block", F.size("ring").cast("long").alias("n"))


@query("M24_bbox", over("SELECT block, min(x) AS x0, max(y) AS y1 FROM survey GROUP BY 1"))
def m24(spark, sf):
    from ..operators.spatial import box

    r = view(spark, sf, "survey").groupBy("block").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    return r.select("block", box(F.col("p")).alias("b")).select("block", "b.x0", "b.y1")


@query("M25_percent", over("SELECT session_id, round(100.0 * count(*) FILTER (vlm_class = 'distress') / count(*), 3) AS p FROM segments GROUP BY 1"))
def m25(spark, sf):
    return segments(spark, sf).groupBy("session_id").agg(A.percent(F.count_if(F.col("vlm_class") == "distress"), F.count("*")).alias("p"))


@query("M26_percentile", over("SELECT session_id, round(quantile_cont(value, 0.9), 6) AS p90 FROM segments GROUP BY 1"))
def m26(spark, sf):
    return segments(spark, sf).groupBy("session_id").agg(r6(F.percentile("value", 0.9), "p90"))


@query("M27_iou", over("SELECT a.block, a.n AS i, b.n AS j, round(greatest(0, 20 - abs(a.x - b.x)) * greatest(0, 15 - abs(a.y - b.y)) / (600 - greatest(0, 20 - abs(a.x - b.x)) * greatest(0, 15 - abs(a.y - b.y))), 6) AS v FROM survey a JOIN survey b ON a.block = b.block AND a.n < b.n"))
def m27(spark, sf):
    from ..operators.spatial import iou

    s = view(spark, sf, "survey").select("block", "n", F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 20).alias("x1"), (F.col("y") + 15).alias("y1")).alias("b"))
    t = s.select("block", F.col("n").alias("j"), F.col("b").alias("c"))
    return s.join(t, "block").where("n < j").select("block", F.col("n").alias("i"), "j", r6(iou(F.col("b"), F.col("c")), "v"))


@query("M28_area_fraction")
def m28(spark, sf):
    s = view(spark, sf, "survey").select("block", "n", F.col("x").alias("x0"), (F.col("y") / 2).alias("y0"), (F.col("x") + 20).alias("x1"), (F.col("y") / 2 + 15).alias("y1"))
    return spatial_math.area_fractions(s, "block", 100, 100)


@query("M29_tile_pixels", over("SELECT event_id, round((centre_lon + 180) / 360 * 256 * 131072, 3) AS x FROM segments"))
def m29(spark, sf):
    from ..operators.spatial import tile_pixel

    return segments(spark, sf).select("event_id", F.round(tile_pixel(F.col("centre_lon"), F.col("centre_lat"), 17)[0], 3).alias("x"))


@query("M30_point_in_ring", over("SELECT count(*) AS n FROM survey WHERE x > 10 AND x < 30 AND y > 20 AND y < 60 AND NOT (x > 15.5 AND x < 25.5 AND y > 30 AND y < 40)"))
def m30(spark, sf):
    from ..operators.spatial import in_polygon

    ring = lambda a, b, c, d: F.array(*[F.struct(F.lit(p).alias("x"), F.lit(q).alias("y")) for p, q in ((a, b), (c, b), (c, d), (a, d))])
    rings = F.array(ring(10.0, 20.0, 30.0, 60.0), ring(15.5, 30.0, 25.5, 40.0))
    return view(spark, sf, "survey").where(in_polygon(F.col("x"), F.col("y"), rings) & (F.col("x") > 10)).agg(F.count("*").alias("n"))


# ---- agreement

_CONF = "count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn"


@query("X1_wilson", over("SELECT session_id, k, n, round((k * 1.0E0 / n + 1.920729440648 / n - 1.959964 * sqrt(k * 1.0E0 / n * (1 - k * 1.0E0 / n) / n + 3.841458881296 / (4.0 * n * n))) / (1 + 3.841458881296 / n), 4) AS lo FROM (SELECT session_id, count(*) FILTER (vlm_class = 'distress') AS k, count(*) AS n FROM segments GROUP BY 1) q WHERE k > 0"))
def x1(spark, sf):
    g = segments(spark, sf).groupBy("session_id").agg(F.count_if(F.col("vlm_class") == "distress").alias("k"), F.count("*").alias("n")).where("k > 0")
    return g.select("session_id", "k", "n", stats.wilson(F.col("k"), F.col("n"))["lo"].alias("lo"))


@query("X2_binary", over(f"WITH c AS (SELECT source, {_CONF} FROM (SELECT source, expert_distress AS t, vlm_distress AS p FROM reviews) q GROUP BY 1) SELECT source, tp, fp, fn, tn, round(tp * 1.0E0 / (tp + fp), 6) AS precision, round(tp * 1.0E0 / (tp + fn), 6) AS recall, round((tp * tn - fp * fn) / sqrt(1.0E0 * (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c"))
def x2(spark, sf):
    c = view(spark, sf, "reviews").groupBy("source").agg(*stats.confusion(F.col("expert_distress"), F.col("vlm_distress")))
    return stats.binary(c).select("source", "tp", "fp", "fn", "tn", r6("precision", "precision"), r6("recall", "recall"), r6("mcc", "mcc"))


@query("X3_auroc", over("SELECT round(sum(CASE WHEN a.p1 > b.p1 THEN 1.0 WHEN a.p1 = b.p1 THEN 0.5 ELSE 0 END) / count(*), 6) AS auroc FROM probes a JOIN probes b ON a.truth AND NOT b.truth"))
def x3(spark, sf):
    return stats.auroc(view(spark, sf, "probes"), "p1", "truth").select(r6("auroc", "auroc"))


@query("X4_auroc_error")
def x4(spark, sf):
    a = stats.auroc(view(spark, sf, "probes"), "p1", "truth")
    return a.select(r6(stats.hanley_mcneil(F.col("auroc"), F.col("np"), F.col("nn")), "se"))


@query("X5_average_precision", over("WITH s AS (SELECT p1, count(*) FILTER (truth) AS p, count(*) AS n FROM probes GROUP BY 1), r AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS m FROM s WINDOW w AS (ORDER BY p1 DESC)) SELECT round(sum(p * 1.0E0 * tp / m) / sum(p), 6) AS ap FROM r"))
def x5(spark, sf):
    return stats.average_precision(view(spark, sf, "probes"), "p1", "truth").select(r6("average_precision", "ap"))


@query("X6_best_threshold", over("WITH t AS (SELECT DISTINCT p1 AS c FROM probes), m AS (SELECT c, count(*) FILTER (truth AND p1 >= c) AS tp, count(*) FILTER (NOT truth AND p1 >= c) AS fp, count(*) FILTER (truth AND p1 < c) AS fn, count(*) FILTER (NOT truth AND p1 < c) AS tn FROM probes, t GROUP BY c), s AS (SELECT c, CASE WHEN 1.0E0 * (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt(1.0E0 * (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS v FROM m) SELECT c AS threshold, round(v, 6) AS mcc FROM s ORDER BY v DESC, c DESC LIMIT 1"))
def x6(spark, sf):
    return stats.best_threshold(view(spark, sf, "probes"), "p1", "truth").select("threshold", r6("mcc", "mcc"))


@query("X7_sample_metrics", over("WITH s AS (SELECT len(list_intersect(v, e)) AS i, len(list_distinct(list_concat(v, e))) AS u, v, e FROM (SELECT string_split(vlm_text, '|') AS v, string_split(expert_text, '|') AS e FROM reviews) q) SELECT round(avg(i * 1.0E0 / u), 6) AS jaccard, round(avg(CASE WHEN i = u THEN 1.0 ELSE 0 END), 6) AS exact, round(avg(CASE WHEN i = len(v) THEN 1.0 ELSE 0 END), 6) AS no_false, round(avg((u - i) / 18.0E0), 6) AS hamming FROM s"))
def x7(spark, sf):
    v, e = F.split("vlm_text", r"\|"), F.split("expert_text", r"\|")
    i, u = F.size(F.array_intersect(v, e)), F.size(F.array_union(v, e))
    return view(spark, sf, "reviews").agg(r6(F.avg(i / u), "jaccard"), r6(F.avg((i == u).cast("double")), "exact"), r6(F.avg((i == F.size(v)).cast("double")), "no_false"), r6(F.avg((u - i) / 18.0), "hamming"))


@query("X8_macro_mean", over("SELECT round(avg(p), 6) AS macro FROM (SELECT grp, CASE WHEN count(*) FILTER (p1 >= 0.6) > 0 THEN count(*) FILTER (p1 >= 0.6 AND truth) * 1.0E0 / count(*) FILTER (p1 >= 0.6) END AS p FROM probes GROUP BY 1) q"))
def x8(spark, sf):
    hit = F.col("p1") >= 0.6
    g = view(spark, sf, "probes").groupBy("grp").agg(F.count_if(hit & F.col("truth")).alias("a"), F.count_if(hit).alias("b"))
    return g.agg(r6(F.avg(F.col("a") / F.when(F.col("b") > 0, F.col("b"))), "macro"))


def _correct(spark, sf):
    d = view(spark, sf, "probes")
    return d.withColumn("a", (F.col("truth") == (F.col("p1") >= 0.5)).cast("int")).withColumn("b", (F.col("truth") == (F.col("p2") >= 0.5)).cast("int")).withColumn("n", F.lit(1))


@query("X9_cluster_bootstrap")
def x9(spark, sf):
    return stats.bootstrap(_correct(spark, sf), "day", ["a", "b", "n"], lambda s: (s["b"] - s["a"]) / s["n"], 300)


@query("X9_paired_bootstrap")
def x9_paired(spark, sf):
    """Accuracy of the second score less that of the first per truth and over days, with its p."""
    d = _correct(spark, sf).withColumn("kind", F.when(F.col("truth"), "distress").otherwise("normal"))
    return stats.paired_bootstrap(d, "day", ["a", "b", "n"], lambda s: s["a"] / s["n"], lambda s: s["b"] / s["n"], 300, by="kind")


@query("X10_mcnemar")
def x10(spark, sf):
    c = _correct(spark, sf).agg(F.count_if(F.expr("a = 1 and b = 0")).alias("b"), F.count_if(F.expr("a = 0 and b = 1")).alias("c"))
    return c.select("b", "c", r6(stats.mcnemar(F.col("b"), F.col("c")), "p"))


@query("X11_platt")
def x11(spark, sf):
    d = view(spark, sf, "probes").withColumn("half", F.col("id") % 2)
    return stats.fit_platt(d, "half", "p1", "truth")


@query("X12_calibration_error", over("WITH b AS (SELECT least(floor(p1 * 10), 9) AS bin, count(*) AS n, avg(p1) AS c, avg(CASE WHEN truth THEN 1.0 ELSE 0 END) AS a FROM probes GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b"))
def x12(spark, sf):
    return stats.calibration_error(view(spark, sf, "probes"), "p1", "truth").select(r6("ece", "ece"))


@query("X13_kappa", over("WITH t AS (SELECT c1, c2, count(*) AS n FROM survey GROUP BY 1, 2), s AS (SELECT sum(n) AS t, sum(n) FILTER (c1 = c2) AS o FROM t), e AS (SELECT sum(a.x * 1.0E0 * b.y) AS e FROM (SELECT c1 AS c, sum(n) AS x FROM t GROUP BY 1) a JOIN (SELECT c2 AS c, sum(n) AS y FROM t GROUP BY 1) b USING (c)) SELECT round((o / t - e / t / t) / (1 - e / t / t), 6) AS kappa FROM s, e"))
def x13(spark, sf):
    return stats.kappa(view(spark, sf, "survey"), "c1", "c2").select(r6("kappa", "kappa"))


@query("X14_kappa_bootstrap")
def x14(spark, sf):
    s = view(spark, sf, "survey")
    d = s.select((F.col("block") % 40).alias("blk"), (F.col("c1") == F.col("c2")).cast("int").alias("same"), F.lit(1).alias("n"))
    return stats.bootstrap(d, "blk", ["same", "n"], lambda v: v["same"] / v["n"], 300, 3)


@query("X15_weighted_kappa", over("WITH s AS (SELECT count(*) AS n, sum(pow(c1 - c2, 2)) AS o, sum(c1) AS a, sum(c2) AS b, sum(c1 * c1) AS aa, sum(c2 * c2) AS bb FROM survey) SELECT round(1 - o / (aa + bb - 2.0E0 * a * b / n), 6) AS kappa FROM s"))
def x15(spark, sf):
    return stats.weighted_kappa(view(spark, sf, "survey"), "c1", "c2", 6).select(r6("kappa", "kappa"))


@query("X16_errors", over("SELECT round(avg(abs(x - y)), 6) AS mae, round(avg(x - y), 6) AS bias, round(sqrt(avg(pow(x - y, 2))), 6) AS rmse FROM survey"))
def x16(spark, sf):
    return stats.errors(view(spark, sf, "survey"), "x", "y").select(r6("mae", "mae"), r6("bias", "bias"), r6("rmse", "rmse"))


@query("X17_spearman", over("SELECT round(corr(a, b), 6) AS rho FROM (SELECT row_number() OVER (ORDER BY p1, id) AS a, row_number() OVER (ORDER BY p2, id) AS b FROM probes) q"))
def x17(spark, sf):
    return stats.spearman(view(spark, sf, "probes"), "p1", "p2", "id").select(r6("rho", "rho"))


@query("X18_threshold_table", over("SELECT t, count(*) FILTER (p1 >= t) AS accepted, count(*) FILTER (p1 >= t AND NOT truth) AS wrong_through, count(*) FILTER (p1 < t AND NOT truth) AS caught, count(*) AS n FROM probes, (VALUES (0.3E0), (0.5E0), (0.7E0)) AS c(t) GROUP BY t"))
def x18(spark, sf):
    return stats.threshold_table(view(spark, sf, "probes"), "p1", "truth", [0.3, 0.5, 0.7]).select("t", "accepted", "wrong_through", "caught", "n")


_VERDICT = "CASE WHEN NOT vlm_distress AND NOT expert_distress THEN 'right' WHEN vlm_distress <> expert_distress THEN 'wrong' WHEN list_sort(v) = list_sort(e) THEN 'right' WHEN len(list_intersect(v, e)) > 0 THEN 'close' ELSE 'wrong' END"
_CMP = f"SELECT *, {_VERDICT} AS verdict, round(CASE WHEN NOT vlm_distress AND NOT expert_distress THEN 1.0 WHEN vlm_distress <> expert_distress THEN 0.0 ELSE len(list_intersect(v, e)) * 1.0E0 / len(list_distinct(list_concat(v, e))) END, 4) AS jaccard FROM (SELECT *, string_split(vlm_text, '|') AS v, string_split(expert_text, '|') AS e FROM reviews) q0"


def compared(spark, sf):
    from ..functions.review import compare

    return compare(view(spark, sf, "reviews").withColumn("v", F.split("vlm_text", r"\|")).withColumn("e", F.split("expert_text", r"\|")))


@query("X19_verdict", over(f"SELECT id, verdict, jaccard FROM ({_CMP}) c"))
def x19(spark, sf):
    return compared(spark, sf).select("id", "verdict", "jaccard")


@query("X20_summary", over("SELECT block % 10 AS g, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, min(x) AS lo, quantile_cont(x, 0.5) AS p50, max(x) AS hi FROM survey GROUP BY 1"))
def x20(spark, sf):
    g = view(spark, sf, "survey").groupBy((F.col("block") % 10).alias("g")).agg(*stats.summary("x"))
    return g.select("g", "n", r6("mean", "mean"), r6("sd", "sd"), F.col("min").alias("lo"), "p50", F.col("max").alias("hi"))


@query("X21_isotonic")
def x21(spark, sf):
    return stats.isotonic(view(spark, sf, "probes").withColumn("one", F.lit(1)), "one", "p1", "truth")


@query("X22_grouped_cv")
def x22(spark, sf):
    d = view(spark, sf, "probes").withColumn("fold", F.pmod(F.xxhash64("day"), F.lit(3)))
    return stats.grouped_cv(d, "fold", 3, "p1", "truth")


def _frames(spark, sf):
    """Probe frames as rows of an extent fit: a group per ten labels, a block per 25 frames, five folds of blocks."""
    d = view(spark, sf, "probes").select(F.pmod("grp", F.lit(3)).alias("g"), F.floor(F.col("id") / 25).cast("long").alias("block"), F.col("p1").alias("score"), F.col("p2"), F.col("truth").cast("int").alias("flag"))
    return d.select("g", "block", F.pmod("block", F.lit(5)).cast("int").alias("fold"), "score", (100 * F.col("score") * F.col("p2") * (0.4 + 0.6 * F.col("flag"))).alias("y"), F.when((F.col("g") < 2) | (F.col("block") % 50 > 0), F.col("flag")).alias("flag"))


@query("X22_model_selection")
def x22_selection(spark, sf):
    """The curve chosen by grouped cross-validation, every candidate's error and the residual model of the chosen one."""
    choice, _ = extent.select(_frames(spark, sf))
    return choice.select("g", "chosen", "n_frames", "n_blocks", *[r6(F.col("cv")[n], n) for n in extent.CANDIDATES], *[r6(c, c) for c in ("tau20", "rho", "sigma2")])


@query("X21_curves")
def x21_curves(spark, sf):
    """The chosen monotone curves: edges, centres and pooled means of their bins."""
    _, curves = extent.select(_frames(spark, sf))
    d = curves.select("g", "chosen", F.explode("fits").alias("key", "fit")).select("g", "chosen", "key", F.posexplode(F.arrays_zip("fit.x", "fit.y", "fit.n")).alias("bin", "b"))
    return d.select("g", "chosen", "key", "bin", r6("b.x", "centre"), r6("b.y", "mean"), F.col("b.n").cast("long").alias("n"))


@query("X21_intervals")
def x21_intervals(spark, sf):
    """Extent of every section of ten frames with its interval from bootstrap curves and residuals."""
    frames = _frames(spark, sf)
    choice, curves = extent.select(frames)
    sections = view(spark, sf, "probes").select(F.pmod("grp", F.lit(3)).alias("g"), F.floor(F.col("id") / 10).cast("long").alias("section"), F.when(F.col("id") % 9 > 0, F.col("p1")).alias("score"), F.lit(5.0).alias("length_m"), F.col("truth").cast("int").alias("flag"))
    got = extent.intervals(sections, choice, curves, extent.bootstrap(frames, curves, 100))
    return got.select("g", "section", "n_frames", *[r6(c, c) for c in ("scored_m", "coverage", "mean", "lo90", "hi90")])


@query("X23_log_linear", over("SELECT round(regr_slope(ln(y + 1), ln(x)), 6) AS b, round(regr_intercept(ln(y + 1), ln(x)), 6) AS a FROM survey"))
def x23(spark, sf):
    ly, lx = F.log(F.col("y") + 1), F.log("x")
    return view(spark, sf, "survey").select(ly.alias("ly"), lx.alias("lx")).agg(r6(F.regr_slope("ly", "lx"), "b"), r6(F.regr_intercept("ly", "lx"), "a"))


@query("X24_prediction_interval", over("WITH f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM survey), s AS (SELECT sqrt(sum(pow(y - a - b * x, 2)) / (count(*) - 2)) AS s FROM survey, f) SELECT round(a + b * 25 - 1.96 * s, 4) AS lo, round(a + b * 25 + 1.96 * s, 4) AS hi FROM f, s"))
def x24(spark, sf):
    d = view(spark, sf, "survey").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.count("*").alias("n"))
    s, at = F.sqrt((F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n") - 2)), F.col("a") + F.col("b") * 25
    return d.select(F.round(at - 1.96 * s, 4).alias("lo"), F.round(at + 1.96 * s, 4).alias("hi"))


@query("X25_scale_search", over("SELECT CAST(c AS DOUBLE) / 10 AS scale, round(e, 6) AS mae FROM (SELECT c, avg(abs(y - x * c / 10)) AS e FROM survey, range(5, 26) r(c) GROUP BY c) q ORDER BY e, c LIMIT 1"))
def x25(spark, sf):
    d = view(spark, sf, "survey").withColumn("c", F.explode(F.sequence(F.lit(5), F.lit(25))))
    g = d.groupBy("c").agg(F.avg(F.abs(F.col("y") - F.col("x") * F.col("c") / 10)).alias("e"))
    return g.agg(F.min(F.struct("e", "c")).alias("m")).select((F.col("m.c") / 10).alias("scale"), r6("m.e", "mae"))


@query("X26_ks", over("WITH d AS (SELECT p1 AS v, count(*) FILTER (truth) AS a, count(*) FILTER (NOT truth) AS b FROM probes GROUP BY 1), c AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM d WINDOW w AS (ORDER BY v)) SELECT round(max(abs(ca * 1.0E0 / (SELECT sum(a) FROM d) - cb * 1.0E0 / (SELECT sum(b) FROM d))), 6) AS d FROM c"))
def x26(spark, sf):
    return stats.ks_distance(view(spark, sf, "probes"), "p1", "truth").select(r6("d", "d"))


@query("X27_promotion", over("SELECT grp, CASE WHEN b - a >= 0.02 THEN 'promote' WHEN b - a <= -0.02 THEN 'reject' ELSE 'hold' END AS v FROM (SELECT grp, avg(CASE WHEN truth = (p1 >= 0.5) THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN truth = (p2 >= 0.5) THEN 1.0 ELSE 0 END) AS b FROM probes GROUP BY 1) q"))
def x27(spark, sf):
    g = _correct(spark, sf).groupBy("grp").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    d = F.col("b") - F.col("a")
    return g.select("grp", F.when(d >= 0.02, "promote").when(d <= -0.02, "reject").otherwise("hold").alias("v"))


@query("X28_block_coverage", over("SELECT round(avg(CASE WHEN abs(mx - my) <= 10 THEN 1.0 ELSE 0 END), 6) AS coverage, count(*) AS n FROM (SELECT block, avg(x) AS mx, avg(y) AS my FROM survey GROUP BY 1) q"))
def x28(spark, sf):
    b = view(spark, sf, "survey").groupBy("block").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return b.agg(r6(F.avg((F.abs(F.col("mx") - F.col("my")) <= 10).cast("double")), "coverage"), F.count("*").alias("n"))


@query("X29_score_p90", over("SELECT grp, round(quantile_cont(p1, 0.9), 6) AS p90, CASE WHEN quantile_cont(p1, 0.9) < 0.6 THEN 'low' WHEN quantile_cont(p1, 0.9) < 0.65 THEN 'mid' ELSE 'high' END AS bin FROM probes GROUP BY 1"))
def x29(spark, sf):
    p = F.percentile("p1", 0.9)
    return view(spark, sf, "probes").groupBy("grp").agg(p.alias("q")).select("grp", r6("q", "p90"), F.when(F.col("q") < 0.6, "low").when(F.col("q") < 0.65, "mid").otherwise("high").alias("bin"))


@query("X30_out_of_fold")
def x30(spark, sf):
    d = view(spark, sf, "probes").withColumn("fold", F.pmod(F.xxhash64("day"), F.lit(4)))
    return stats.grouped_cv(d, "fold", 4, "p2", "truth")


# ---- reviews


@query("A33_expert_summary", over(f"SELECT verdict, count(*) AS n, round(avg(jaccard), 4) AS jaccard FROM ({_CMP}) c GROUP BY 1"))
def a33(spark, sf):
    return compared(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("jaccard"), 4).alias("jaccard"))


@query("A34_by_source_queue", over(f"SELECT 'source' AS by, source AS name, count(*) FILTER (verdict = 'right') AS ok, count(*) AS n FROM ({_CMP}) c GROUP BY 2 UNION ALL SELECT 'queue', queue, count(*) FILTER (verdict = 'right'), count(*) FROM ({_CMP}) c GROUP BY 2 UNION ALL SELECT 'all', '', count(*) FILTER (verdict = 'right'), count(*) FROM ({_CMP}) c"))
def a34(spark, sf):
    d = compared(spark, sf)
    base = d.groupBy("source", "queue").agg(F.count_if(F.col("verdict") == "right").alias("ok"), F.count("*").alias("n"))
    g = base.groupingSets([["source"], ["queue"], []], "source", "queue").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 1, "source").when(F.col("g") == 2, "queue").otherwise("all").alias("by"), F.coalesce("source", "queue", F.lit("")).alias("name"), "ok", "n")


@query("A35_latest_review", over("SELECT source, item, max(id) AS id, max_by(expert_text, id) AS expert_text, min_by(queue, id) AS sample_queue, count(*) AS n FROM reviews GROUP BY 1, 2"))
def a35(spark, sf):
    return view(spark, sf, "reviews").groupBy("source", "item").agg(F.max("id").alias("id"), F.max_by("expert_text", "id").alias("expert_text"), F.min_by("queue", "id").alias("sample_queue"), F.count("*").alias("n"))


@query("A36_leaderboard", over(r"SELECT lower(regexp_replace(trim(reviewer), '\s+', ' ', 'g')) AS who, count(DISTINCT (source, item)) AS items, count(DISTINCT item) FILTER (source = 'video') AS video FROM reviews GROUP BY 1"))
def a36(spark, sf):
    from ..functions.text import normal_name

    d = view(spark, sf, "reviews").select(normal_name(F.col("reviewer")).alias("who"), "source", "item").distinct()
    return d.groupBy("who").agg(F.count("*").alias("items"), F.count_if(F.col("source") == "video").alias("video"))


@query("A37_event_counts", over("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1", "segments"))
def a37(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("A40_cross_tab", over("SELECT s.vlm_class, a.status, count(*) AS n, round(avg(s.confidence - a.confidence), 6) AS delta FROM segments s JOIN assessments a ON a.id = s.event_id GROUP BY 1, 2"))
def a40(spark, sf):
    a = view(spark, sf, "assessments").select(F.col("id").alias("event_id"), F.col("status").alias("st"), F.col("confidence").alias("c"))
    j = segments(spark, sf).select("event_id", "vlm_class", "confidence").join(a, "event_id")
    return j.groupBy("vlm_class", F.col("st").alias("status")).agg(F.count("*").alias("n"), r6(F.avg(F.col("confidence") - F.col("c")), "delta"))


@query("A41_prediction_frequency", over("SELECT label, count(*) AS n, (SELECT round(avg(CASE WHEN label_text LIKE '%|%' THEN 1.0 ELSE 0 END), 6) FROM segments) AS multi FROM (SELECT unnest(string_split(label_text, '|')) AS label FROM segments) q GROUP BY 1"))
def a41(spark, sf):
    d = segments(spark, sf)
    m = d.agg(r6(F.avg((F.size("final_labels") > 1).cast("double")), "multi"))
    return d.select(F.explode("final_labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(m))


@query("A42_per_class", over("WITH c AS (SELECT unnest(['Potholes', 'Ravelling', 'Edge Cracking', 'Rutting']) AS label), r AS (SELECT label, list_contains(e, label) AS t, list_contains(v, label) AS p FROM c, (SELECT string_split(vlm_text, '|') AS v, string_split(expert_text, '|') AS e FROM reviews) q) SELECT label, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM r GROUP BY 1"))
def a42(spark, sf):
    v, e = F.split("vlm_text", r"\|"), F.split("expert_text", r"\|")
    d = view(spark, sf, "reviews").select(v.alias("v"), e.alias("e"), F.explode(F.array(*map(F.lit, ("Potholes", "Ravelling", "Edge Cracking", "Rutting")))).alias("label"))
    return d.groupBy("label").agg(*stats.confusion(F.array_contains("e", F.col("label")), F.array_contains("v", F.col("label"))))


@query("A43_confusion", over("SELECT c1, count(*) FILTER (c2 = 0) AS p0, count(*) FILTER (c2 = 1) AS p1, count(*) FILTER (c2 = 2) AS p2, count(*) FILTER (c1 = c2) AS hit FROM survey GROUP BY 1"))
def a43(spark, sf):
    d = view(spark, sf, "survey")
    return d.groupBy("c1").agg(*[F.count_if(F.col("c2") == i).alias(f"p{i}") for i in range(3)], F.count_if(F.col("c1") == F.col("c2")).alias("hit"))


@query("A44_compliance", over("SELECT count(*) AS n, count(*) FILTER (l IN ('Potholes', 'Ravelling', 'Edge Cracking', 'Rutting')) AS known, count(*) FILTER (l = 'Rutting') AS rut FROM (SELECT unnest(string_split(vlm_text, '|')) AS l FROM reviews) q"))
def a44(spark, sf):
    from ..functions import labels as L

    d = view(spark, sf, "reviews").select(F.explode(F.split("vlm_text", r"\|")).alias("l"))
    return d.agg(F.count("*").alias("n"), F.count_if(L.canonical(F.col("l")).isNotNull()).alias("known"), F.count_if(F.col("l") == "Rutting").alias("rut"))


@query("A48_ratings_by_type", over("SELECT k, v, count(*) AS n FROM (SELECT unnest(string_split(expert_text, '|')) AS k, CASE WHEN vlm_severity = 1 THEN 'on' WHEN vlm_severity = 2 THEN 'near' ELSE 'off' END AS v FROM reviews) q GROUP BY 1, 2"))
def a48(spark, sf):
    v = F.when(F.col("vlm_severity") == 1, "on").when(F.col("vlm_severity") == 2, "near").otherwise("off")
    m = F.map_from_entries(F.transform(F.split("expert_text", r"\|"), lambda k: F.struct(k.alias("k"), F.col("rating").alias("v"))))
    return view(spark, sf, "reviews").withColumn("rating", v).select(F.explode(m).alias("k", "v")).groupBy("k", "v").agg(F.count("*").alias("n"))


# ---- evaluation tail


@query("Q7_equal_load", over("WITH a AS (SELECT avg(CASE WHEN p1 < 0.5 THEN 1.0 ELSE 0 END) AS load FROM probes WHERE id % 2 = 0), b AS (SELECT p2, row_number() OVER (ORDER BY p2, id) - 1 AS i, count(*) OVER () AS n FROM probes WHERE id % 2 = 1) SELECT p2 AS cut FROM a, b WHERE i = CAST(floor(load * n) AS BIGINT)"))
def q7(spark, sf):
    d = view(spark, sf, "probes")
    load = d.where("id % 2 = 0").agg(F.avg((F.col("p1") < 0.5).cast("double")).alias("load"))
    return stats.value_at_share(d.where("id % 2 = 1"), "p2", load, "load").select(F.col("value").alias("cut"))


@query("Q8_threshold_bounds", over("SELECT t, n, k, round((k * 1.0E0 / n + 1.920729440648 / n + 1.959964 * sqrt(k * 1.0E0 / n * (1 - k * 1.0E0 / n) / n + 3.841458881296 / (4.0 * n * n))) / (1 + 3.841458881296 / n), 4) AS hi FROM (SELECT t, count(*) FILTER (p1 >= t) AS n, count(*) FILTER (p1 >= t AND NOT truth) AS k FROM probes, (VALUES (0.3E0), (0.5E0)) AS c(t) GROUP BY t) q"))
def q8(spark, sf):
    t = stats.threshold_table(view(spark, sf, "probes"), "p1", "truth", [0.3, 0.5])
    return t.select("t", F.col("accepted").alias("n"), F.col("wrong_through").alias("k"), stats.wilson(F.col("wrong_through"), F.col("accepted"))["hi"].alias("hi"))


@query("Q9_level_vs_native", over("SELECT count(*) FILTER (a = b) AS agree, count(*) FILTER (a AND NOT b) AS lost, count(*) FILTER (b AND NOT a) AS gained FROM (SELECT p1 >= 0.5 AS a, p2 >= 0.5 AS b FROM probes) q"))
def q9(spark, sf):
    a, b = F.col("p1") >= 0.5, F.col("p2") >= 0.5
    return view(spark, sf, "probes").agg(F.count_if(a == b).alias("agree"), F.count_if(a & ~b).alias("lost"), F.count_if(b & ~a).alias("gained"))


@query("Q10_paired_correct", over("SELECT grp, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (b AND NOT a) AS c FROM (SELECT grp, truth = (p1 >= 0.5) AS a, truth = (p2 >= 0.5) AS b FROM probes) q GROUP BY 1"))
def q10(spark, sf):
    return _correct(spark, sf).groupBy("grp").agg(F.count_if(F.expr("a = 1 and b = 0")).alias("b"), F.count_if(F.expr("a = 0 and b = 1")).alias("c"))


@query("Q11_rescore", over("SELECT count(*) FILTER (vlm_text = expert_text) AS before, count(*) FILTER (replace(vlm_text, 'Rutting', 'Ravelling') = expert_text) AS after FROM reviews"))
def q11(spark, sf):
    return view(spark, sf, "reviews").agg(F.count_if(F.col("vlm_text") == F.col("expert_text")).alias("before"), F.count_if(F.replace("vlm_text", F.lit("Rutting"), F.lit("Ravelling")) == F.col("expert_text")).alias("after"))


@query("Q12_examples", over("SELECT id FROM reviews WHERE vlm_text <> expert_text ORDER BY md5(CAST(id AS VARCHAR)) LIMIT 10"))
def q12(spark, sf):
    return view(spark, sf, "reviews").where("vlm_text <> expert_text").orderBy(F.md5(F.col("id").cast("string"))).limit(10).select("id")


@query("Q14_pointing_game", over("SELECT round(avg(h), 6) AS macro FROM (SELECT grp, avg(CASE WHEN p1 = p2 THEN 0.5 WHEN p1 > p2 THEN 1.0 ELSE 0 END) AS h FROM probes GROUP BY 1) q"))
def q14(spark, sf):
    h = F.when(F.col("p1") == F.col("p2"), 0.5).when(F.col("p1") > F.col("p2"), 1.0).otherwise(0.0)
    return view(spark, sf, "probes").groupBy("grp").agg(F.avg(h).alias("h")).agg(r6(F.avg("h"), "macro"))


@query("Q17_leave_one_out")
def q17(spark, sf):
    return stats.leave_one_out(view(spark, sf, "probes"), "day", "p1", "truth")


@query("Q20_repeatability", over("WITH b AS (SELECT block, avg(x) AS a, avg(y) AS c FROM survey GROUP BY 1) SELECT round(median(abs(ln(a / c))), 6) AS med, round(regr_slope(ln(c), ln(a)), 6) AS slope FROM b"))
def q20(spark, sf):
    b = view(spark, sf, "survey").groupBy("block").agg(F.avg("x").alias("a"), F.avg("y").alias("c")).select(F.log("a").alias("la"), F.log("c").alias("lc"))
    return b.agg(r6(F.median(F.abs(F.col("la") - F.col("lc"))), "med"), r6(F.regr_slope("lc", "la"), "slope"))


# ---- signals


@query("K1_windows")
def k1(spark, sf):
    d = segments(spark, sf).select("session_id", (F.col("k") * 50_000_000).alias("t_ns"), F.col("value").alias("v"))
    return signal.windows(d)


_FACTOR = signal.iri_factor()


@query("K4_iri_factor", over(f"SELECT session_id, round(sqrt(avg((value - 50) * (value - 50))) * 0.001 * {_FACTOR!r}, 6) AS iri FROM segments GROUP BY 1"))
def k4(spark, sf):
    """Roughness of each drive's profile: the strength of its slopes times the integrated gain of the reference car."""
    slope = F.col("value") - 50
    return segments(spark, sf).groupBy("session_id").agg(r6(F.sqrt(F.avg(slope * slope)) * 0.001 * F.lit(_FACTOR), "iri"))


def _drives(spark, sf):
    """A drive per supplier with the rows of its lines: accelerations and rotations 40 ms apart with a gap of half a
    second, a fix every second, a segment every two."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    d = table(spark, sf, "lineitem").withColumn("n", F.row_number().over(w) - 1).select(F.col("l_suppkey").alias("session"), "n", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    d = d.withColumn("t_ns", F.lit(10**15) + F.col("n").cast("long") * 40_000_000 + F.when(F.col("n") >= 300, 500_000_000).otherwise(0))
    xyz = lambda a, b, c: (F.expr(a).alias("x"), F.expr(b).alias("y"), F.expr(c).alias("z"))
    acc = d.select("session", F.lit("acc").alias("channel"), "t_ns", *xyz("l_discount", "l_tax * 5", "9.8 + (l_quantity - 25) / 25"))
    gyro = d.where("session % 3 > 0").select("session", F.lit("gyro").alias("channel"), "t_ns", *xyz("l_tax", "l_discount", "0.1"))
    gravity = d.where("session % 4 = 0 and n % 10 = 0").select("session", F.lit("gravity").alias("channel"), "t_ns", *xyz("0.1", "0.05", "9.8"))
    fixes = d.where("n % 25 = 0").select("session", "t_ns", F.expr("case when n % 175 = 100 then null when session % 7 = 0 and n between 200 and 300 then 0.2 else 3 + l_quantity / 50 end").alias("speed"), F.expr("12.9D").alias("lat"), F.expr("77.5 + n * 0.0000014").alias("lon"))
    segs = d.where("n % 50 = 0").select("session", F.concat_ws("_", "session", "n").alias("segment_id"), F.expr("cast(n * 0.16 as double)").alias("s0_m"), F.expr("cast(n * 0.16 + 8 as double)").alias("s1_m"), (F.col("n") % 350 != 150).alias("covered"), F.when(F.col("n") % 300 != 200, F.col("t_ns")).alias("frame_t_ns"), F.lit(2.0).alias("near_m"))
    return acc.union(gyro).union(gravity), fixes, segs


@query("K1_resampled")
def k1_resampled(spark, sf):
    """Grid samples of each drive, how many lie near the end of a run, and the strength of the vertical signal."""
    g = roughness.samples(_drives(spark, sf)[0], least=200)
    return g.groupBy("session").agg(F.count("*").alias("n"), F.sum(F.col("edge").cast("long")).alias("edges"), r6(F.avg("raw"), "mean"), r6(F.stddev_pop("raw"), "sd"))


@query("K2_bands")
def k2_bands(spark, sf):
    """Root mean squares of the zero-phase bands of each drive."""
    g = roughness.samples(_drives(spark, sf)[0], least=200)
    fine = lambda c: F.when(~F.isnan(c), F.col(c))
    return g.groupBy("session").agg(F.count(fine("av")).alias("n"), *[r6(F.sqrt(F.avg(fine(c) * fine(c))), f"rms_{c}") for c in ("av", "body", "wheel", "rot")])


@query("K3_segment_windows")
def k3(spark, sf):
    """Features and flags of the vibration under every segment."""
    sensor, fixes, segs = _drives(spark, sf)
    got = roughness.segment_windows(sensor, fixes, segs, least=200)
    return got.select(*[r6(c, c) if t == "double" else F.col(c) for c, t in got.dtypes])
