"""Condition ratings as Column expressions: the 2015 bands and the 2023 index."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPS = 1e-9
# Fixed values: (good below, poor above) per road class and parameter; percent, rut depth in mm.
LIMITS = {
    "urban": {"cracking": (5.0, 15.0), "ravelling": (5.0, 10.0), "potholes": (0.0, 0.5), "settlement": (1.0, 5.0), "rut_depth": (5.0, 10.0)},
    "highway": {"cracking": (5.0, 10.0), "ravelling": (1.0, 10.0), "potholes": (0.1, 1.0), "shoving": (0.1, 1.0), "patching": (1.0, 10.0), "settlement": (1.0, 5.0), "rut_depth": (5.0, 10.0)},
    "rural": {"cracking": (10.0, 20.0), "ravelling": (10.0, 20.0), "potholes": (0.5, 1.0), "patching": (5.0, 20.0), "settlement": (2.0, 5.0)},
}
LIMITS["mdr"] = LIMITS["rural"]
WEIGHTS = {"cracking": 1.00, "ravelling": 0.75, "potholes": 0.50, "shoving": 1.00, "patching": 0.75, "settlement": 0.75, "rut_depth": 1.00}
# Weights of the index, class limits, treatments.
INDEX_WEIGHTS = {"cracking": 0.12, "ravelling": 0.10, "potholes": 0.16, "patching": 0.08, "rut_depth": 0.14, "iri": 0.40}
INDEX_CLASSES = ((90.0, "Excellent"), (80.0, "Good"), (60.0, "Satisfactory"), (40.0, "Fair"), (20.0, "Poor"))
TREATMENTS = {
    "Excellent": "Routine maintenance", "Good": "Preventive maintenance", "Satisfactory": "Renewal (as per section 9.5)",
    "Fair": "Minor rehabilitation (based on structural evaluation)", "Poor": "Major rehabilitation / structural overlay", "Fail": "Reconstruction",
}
# Ranges of the index tables, (upper of the best range, upper of the middle one).
INDEX_RANGES = {
    "highway": {"cracking": (5, 10), "ravelling": (1, 10), "potholes": (0, 2), "patching": (1, 10), "rut_depth": (5, 10)},
    "mdr": {"cracking": (10, 20), "ravelling": (10, 20), "potholes": (1, 5), "patching": (5, 20), "rut_depth": (10, 20)},
    "rural": {"cracking": (10, 20), "ravelling": (10, 20), "potholes": (1, 5), "patching": (5, 20), "rut_depth": (10, 20)},
    "urban": {"cracking": (5, 15), "ravelling": (5, 10), "potholes": (0, 3), "patching": (5, 10), "rut_depth": (5, 10)},
}
# Printed equations as ("ratio", numerator, denominator), highest power first.
_FAST = ("ratio", (7231.0,), (1.0, -0.737, 73.09))
_CUBIC = ("ratio", (-0.5662, 85.14, -3377.0, 5.182e4), (1.0, -29.31, 523.4))
_PATCH = ("ratio", (-1.723e-3, -8.273e-2, 21.39, 419.1), (1.0, 4.267))
_EXP2 = ("exp2", (52.92, -0.02525, 44.1, -0.2899), ())
_POWER = ("iri", (1.91, -3.542, 4.315), ())
CURVES = {
    "highway": {"cracking": _FAST, "ravelling": _EXP2, "potholes": ("ratio", (-80.32, 1129.0, -3524.0, 3566.0), (1.0, 5.791, -28.67, 35.72)), "patching": _EXP2, "rut_depth": _FAST, "iri": _POWER},
    "urban": {"cracking": ("decay", (100.0, -0.0534, -0.006641), ()), "ravelling": _FAST, "potholes": ("ratio", (-130.6, 2112.0, -9550.0, 14390.0), (1.0, 6.619, -66.73, 144.1)), "patching": _FAST, "rut_depth": _FAST, "iri": _POWER},
    "mdr": {"cracking": _CUBIC, "ravelling": _CUBIC, "potholes": None, "patching": _PATCH, "rut_depth": _CUBIC, "iri": {
        "SD": ("ratio", (-0.09535, 4.235, -74.43, 642.4, -2625.0, 4034.0), (1.0, -9.065, 20.71)),
        "OGPC": ("ratio", (-4.842, 121.5, -875.9, 2029.0), (1.0, -8.389, 19.85)),
        "MSS": ("ratio", (-2.686, 64.96, -437.2, 1046.0, -596.2), (1.0, -9.766, 31.09, -30.94)),
        "SDBC": ("ratio", (-4.468, 106.2, -694.7, 1507.0), (1.0, -6.778, 14.51)),
        "BC": ("ratio", (-2.52, 55.18, -292.4, 476.4, -5.565), (1.0, -7.458, 17.77, -12.09)),
    }},
    "rural": {"cracking": _CUBIC, "ravelling": _CUBIC, "potholes": None, "patching": _PATCH, "rut_depth": _CUBIC, "iri": {
        "SD": None, "MSS": None, "BC": None,
        "OGPC": ("ratio", (-4.02, 98.33, -670.6, 1444.0), (1.0, -8.215, 17.79)),
        "SDBC": ("ratio", (25.16, 48.45), (1.0, -5.079, 7.595)),
    }},
}
SURFACE = {"highway": "BC", "urban": "BC", "mdr": "BC", "rural": "SDBC"}
MOST = {"cracking": 100.0, "ravelling": 100.0, "patching": 100.0, "potholes": 1.0e4, "rut_depth": 1.0e4, "iri": 1.0e3}
IRI_LEFT = 2.0


# ---- 2015


def limits_table(spark: SparkSession) -> DataFrame:
    rows = [(c, p, lo, hi, WEIGHTS[p]) for c, ps in LIMITS.items() for p, (lo, hi) in ps.items()]
    return spark.createDataFrame(rows, "road_class string, param string, good_below double, poor_above double, weight double")


def half_up(x: Column) -> Column:
    """One decimal, halves away from zero, exact on the number as it prints (M3)."""
    return F.round(x.cast("string").cast("decimal(30,12)"), 1).cast("double")


def truncated(x: Column) -> Column:
    return F.floor(10.0 * x + EPS) / 10.0


def band(x: Column, lo: Column, hi: Column, nil: Column) -> Column:
    """Poor, Fair or Good; nil marks the urban pothole rule where only zero is Good (M1)."""
    plain = F.when(x > hi + EPS, "Poor").when(x < lo - EPS, "Good").otherwise("Fair")
    return F.when(nil, F.when(x <= EPS, "Good").when(x > hi + EPS, "Poor").otherwise("Fair")).otherwise(plain)


def rating(x: Column, lo: Column, hi: Column, nil: Column) -> Column:
    """Interpolated rating, truncated to a tenth and held inside its band (M2)."""
    hold = lambda v, a, b: F.least(F.lit(b), F.greatest(F.lit(a), truncated(v)))
    b = band(x, lo, hi, nil)
    fair = F.when(nil, hold(2.0 - x / hi, 1.1, 2.0)).otherwise(hold(2.0 - (x - lo) / (hi - lo), 1.1, 2.0))
    good = F.when(nil, F.lit(3.0)).otherwise(hold(3.0 - x / F.when(lo > 0, lo), 2.1, 3.0))
    return F.when(b == "Poor", 1.0).when(b == "Fair", fair).otherwise(good)


def weighted(w: Column, r: Column) -> Column:
    d = lambda c: c.cast("string").cast("decimal(12,6)")
    return F.round(d(w) * d(r), 1).cast("double")


def mean_tenth(values: Column) -> Column:
    """Aggregate: exact mean at one decimal, halves up."""
    d = values.cast("string").cast("decimal(20,6)")
    return F.round(F.sum(d) / F.count(d), 1).cast("double")


def final_class(v: Column) -> Column:
    t = half_up(v)
    return F.when(t <= 1.0 + EPS, "Poor").when(t <= 2.0 + EPS, "Fair").otherwise("Good")


def class_range(a: Column, b: Column) -> Column:
    """One name, or worse–better."""
    rank = lambda c: F.when(c == "Poor", 0).when(c == "Fair", 1).otherwise(2)
    return F.when(a == b, a).when(rank(a) < rank(b), F.concat_ws("–", a, b)).otherwise(F.concat_ws("–", b, a))


def rate(values: DataFrame, *by: str) -> DataFrame:
    """values(by..., road_class, param, x) -> per unit the final value and class over all its parameters (M5).

    The limits are a fixed table of 22 rows, so it is broadcast.
    """
    d = values.join(F.broadcast(limits_table(values.sparkSession)), ["road_class", "param"])
    nil = (F.col("road_class") == "urban") & (F.col("param") == "potholes")
    r = rating(F.col("x"), F.col("good_below"), F.col("poor_above"), nil)
    d = d.withColumn("weighted", weighted(F.col("weight"), r))
    return d.groupBy(*by, "road_class").agg(mean_tenth(F.col("weighted")).alias("final")).withColumn("class", final_class(F.col("final")))


# ---- 2023


def _poly(x: Column, cs) -> Column:
    return reduce(lambda acc, c: acc * x + c, cs[1:], F.lit(float(cs[0])))


def curve(kind, x: Column) -> Column:
    name, a, b = kind
    if name == "ratio":
        return _poly(x, a) / _poly(x, b)
    if name == "exp2":
        return a[0] * F.exp(a[1] * x) + a[2] * F.exp(a[3] * x)
    if name == "decay":
        return a[0] * F.exp(a[1] * x) + a[2] * x
    return 100.0 / (F.pow(x, F.lit(a[0])) + a[1] * x + a[2])


def _plain(kind, x: float) -> float:
    name, a, b = kind
    poly = lambda cs: reduce(lambda acc, c: acc * x + c, cs, 0.0)
    return poly(a) / poly(b) if name == "ratio" else math.nan


def peak(kind) -> float:
    """Where a roughness curve is largest on 2..20 in steps of 0.001: smoother roads score as much (M9)."""
    best = (IRI_LEFT, -math.inf)
    for i in range(18_001):
        x = IRI_LEFT + i * 0.001
        v = _plain(kind, x)
        if v > best[1] + 1e-12:
            best = (x, v)
    return best[0]


def usable(road_class: str, param: str, surface: str | None = None):
    kind = CURVES[road_class][param]
    return kind.get(surface or SURFACE[road_class]) if isinstance(kind, dict) else kind


def index_param(road_class: str, param: str, x: Column, surface: str | None = None) -> Column:
    """Index of one parameter, 0 to 100; null where the printed equation can't be used."""
    kind = usable(road_class, param, surface)
    if kind is None:
        return F.lit(None).cast("double")
    if param == "iri":
        x = F.greatest(x, F.lit(peak(kind) if kind[0] == "ratio" else IRI_LEFT))
    x = F.least(x, F.lit(MOST[param]))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), curve(kind, x)))


def index_bounds(road_class: str, param: str, a: Column, b: Column, surface: str | None = None, n: int = 400) -> Column:
    """(worst, best) over n + 1 values from a to b: some curves aren't monotone."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    vs = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: index_param(road_class, param, F.when(i == n, hi).otherwise(lo + (hi - lo) * i / n), surface))
    return F.struct(F.array_min(vs).alias("worst"), F.array_max(vs).alias("best"))


def index_class(v: Column) -> Column:
    return reduce(lambda acc, c: F.when(v > c[0], c[1]).otherwise(acc), reversed(INDEX_CLASSES), F.lit("Fail"))


def index(road_class: str, values: dict[str, Column], surface: str | None = None) -> Column:
    """Weighted index over all six parameters."""
    parts = [F.lit(INDEX_WEIGHTS[p]) * index_param(road_class, p, values[p], surface) for p in INDEX_WEIGHTS]
    return reduce(lambda a, b: a + b, parts)


def index_range(road_class: str, values: dict[str, Column], surface: str | None = None) -> Column:
    """(lo, hi, known_weight): unknown parameters count as 0 and as 100."""
    lo, hi, known = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for p, w in INDEX_WEIGHTS.items():
        v = index_param(road_class, p, values[p], surface) if p in values else F.lit(None).cast("double")
        lo, hi, known = lo + F.coalesce(w * v, F.lit(0.0)), hi + F.coalesce(w * v, F.lit(100.0 * w)), known + F.when(v.isNotNull(), w).otherwise(0.0)
    return F.struct(lo.alias("lo"), hi.alias("hi"), known.alias("known_weight"))


def index_band(road_class: str, param: str, x: Column) -> Column:
    """Range name of one value."""
    a, b = INDEX_RANGES[road_class][param]
    best = x <= a + EPS if param == "potholes" else x < a - EPS
    return F.when(best, "Excellent to Good").when(x > b + EPS, "Poor to Fail").otherwise("Satisfactory to Fair")
