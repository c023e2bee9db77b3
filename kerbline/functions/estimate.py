"""Interval estimates of ratings by seeded draws, one task per unit or stretch."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rating import INDEX_WEIGHTS, IRI_LEFT, MOST, peak, usable

# Coefficients of the rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_LOW = 0.02425
# Coefficients of a rational approximation of the error function, highest power first.
_P, _E = 0.3275911, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)


def _poly(cs, x):
    return reduce(lambda acc, c: acc * x + c, cs[1:], cs[0] + 0 * x)


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile by a rational approximation, error below 1.2e-9."""
    q, low = p - 0.5, F.sqrt(-2 * F.log(p))
    r, high = q * q, F.sqrt(-2 * F.log(1 - p))
    return F.when(p < _LOW, _poly(_C, low) / _poly(_D, low)).when(p > 1 - _LOW, -_poly(_C, high) / _poly(_D, high)).otherwise(q * _poly(_A, r) / _poly(_B, r))


def quantile(p: float) -> float:
    if p < _LOW:
        t = math.sqrt(-2 * math.log(p))
        return _poly(_C, t) / _poly(_D, t)
    if p > 1 - _LOW:
        return -quantile(1 - p)
    q = p - 0.5
    return q * _poly(_A, q * q) / _poly(_B, q * q)


Z95 = 1.6448536269514722


def split_normal(u: Column, lo: Column, mid: Column, hi: Column) -> Column:
    """Value at probability u with 5 % point lo, median mid and 95 % point hi, each side its own width."""
    z = normal_quantile(u)
    return mid + z / Z95 * F.when(z < 0, mid - lo).otherwise(hi - mid)


def binomial_upper(k: Column, n: Column, p: float) -> Column:
    """Smallest share at or above which k of n lies with probability p, by the Wilson score form."""
    z = quantile(p)
    s, den = k / n, 1 + z * z / n
    return (s + z * z / (2 * n) + z * F.sqrt(s * (1 - s) / n + z * z / (4 * n * n))) / den


def poisson_quantile(mean: Column, p: float, most: int = 400) -> Column:
    """Smallest count whose cumulative Poisson probability reaches p."""
    zero = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("total"), F.when(F.exp(-mean) >= p, 0).alias("at"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * mean / i
        total = a["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), F.coalesce(a["at"], F.when(total >= p, i)).alias("at"))

    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(most)), zero, step)["at"], F.lit(most))


def _value(kind, x):
    """A curve at a number or an array."""
    import numpy as np

    name, a, b = kind
    if name == "ratio":
        return reduce(lambda s, c: s * x + c, a, 0.0) / reduce(lambda s, c: s * x + c, b, 0.0)
    if name == "exp2":
        return a[0] * np.exp(a[1] * x) + a[2] * np.exp(a[3] * x)
    if name == "decay":
        return a[0] * np.exp(a[1] * x) + a[2] * x
    return 100.0 / (x ** a[0] + a[1] * x + a[2])


def param_value(road_class: str, param: str, x, surface: str | None = None):
    """index_param() of a number or an array, for the draws; None where no curve is usable."""
    import numpy as np

    kind = usable(road_class, param, surface)
    if kind is None:
        return None
    if param == "iri":
        x = np.maximum(x, peak(kind) if kind[0] == "ratio" else IRI_LEFT)
    return np.clip(_value(kind, np.minimum(x, MOST[param])), 0.0, 100.0)


def stretch(
    road_class: str,
    weights,
    inputs: dict,
    draws: int = 3000,
    seed: int = 1,
    rho: float | dict[str, float] = 0.0,
    groups: dict[str, str] | None = None,
    shapes: dict[str, str] | None = None,
    surface: str | None = None,
) -> dict[str, float]:
    """5, 25, 50, 75 and 95 % points of the weighted mean index of sections that are drawn jointly.

    inputs names per parameter the lows, mids and highs (5 %, median, 95 %) of all sections, weights their lengths.
    For each parameter a Gaussian copula with correlation rho between sections: the part of an input's error that the
    sections share doesn't average out along the stretch, the part of one section does. Parameters of one group share
    their draws. A shape is "normal" (split normal), "uniform", or "range": uniform, and the outer points are then
    those of runs with the value fixed at its better and at its worse end in every section. Parameters without
    inputs, or without a usable curve, are uniform between 0 and 100. Every section is drawn, none is pooled.
    """
    import numpy as np

    w = np.asarray(weights, dtype=float)
    w = w / w.sum()
    groups, shapes = groups or {}, shapes or {}
    of = lambda p: groups.get(p, p)
    ends = {p: tuple(np.asarray(v, dtype=float) for v in inputs[p]) for p in inputs if usable(road_class, p, surface) is not None}
    names = list(dict.fromkeys(map(of, INDEX_WEIGHTS)))

    def phi(z):
        """Normal distribution function, error below 8e-8."""
        t = 1 / (1 + _P * np.abs(z) / math.sqrt(2))
        tail = 0.5 * t * _poly(_E, t) * np.exp(-z * z / 2)
        return np.where(z < 0, tail, 1 - tail)

    def value(p: str, z, rows: slice, end: str | None):
        if p not in ends:
            return 100.0 * phi(z)
        lo, mid, hi = (e[rows, None] for e in ends[p])
        lo, hi = np.minimum(lo, mid), np.maximum(hi, mid)
        shape = shapes.get(p, "normal")
        if shape == "range" and end:
            a, b = (param_value(road_class, p, x, surface) for x in (lo, hi))
            return np.broadcast_to(np.maximum(a, b) if end == "best" else np.minimum(a, b), z.shape)
        x = lo + phi(z) * (hi - lo) if shape in ("uniform", "range") else np.maximum(0.0, mid + z / Z95 * np.where(z < 0, mid - lo, hi - mid))
        return param_value(road_class, p, x, surface)

    def run(end: str | None):
        rng = np.random.default_rng(seed)
        shared, total = {g: rng.standard_normal(draws) for g in names}, np.zeros(draws)
        step = max(1, 200_000 // draws)
        for at in range(0, len(w), step):
            rows = slice(at, min(at + step, len(w)))
            own = {g: rng.standard_normal((rows.stop - at, draws)) for g in names}
            for p, share in INDEX_WEIGHTS.items():
                r = min(1.0, max(0.0, rho.get(p, 1.0) if isinstance(rho, dict) else rho))
                z = math.sqrt(r) * shared[of(p)] + math.sqrt(1 - r) * own[of(p)]
                total += share * (w[rows] @ value(p, z, rows, end))
        return np.sort(total)

    point = lambda d, q: float(d[min(draws - 1, int(q * draws))])
    d = run(None)
    out = {f"p{int(100 * q):02d}": point(d, q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)}
    if any(shapes.get(p) == "range" for p in ends):
        out["p05"], out["p95"] = min(out["p05"], point(run("worst"), 0.05)), max(out["p95"], point(run("best"), 0.95))
    return out


def draw(road_class: str, inputs: dict[str, tuple[float, float, float]], draws: int = 1500, seed: int = 1, rho: float = 0.0, units: int = 1) -> dict[str, float]:
    """stretch() of equal units with one set of inputs; M18 is that of a single unit."""
    return stretch(road_class, [1.0] * units, {p: tuple([v] * units for v in e) for p, e in inputs.items()}, draws, seed, rho)


def estimate(units: DataFrame, by: str, road_class: str, params: list[str], draws: int = 1500, seed: int = 1, rho: float | dict[str, float] = 0.0, **more) -> DataFrame:
    """(by, p05, p25, p50, p75, p95) per group of units(by, length_m, order, <param>_lo, <param>_mid, <param>_hi).

    The draws of a group are one seeded sequence, so a group is one task; its rows are the units of one stretch, all
    drawn in their order and weighted by length. Units without length or inputs take no part. more is as in stretch().
    """
    points = ("p05", "p25", "p50", "p75", "p95")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order")
        columns = {p: [f"{p}_{e}" for e in ("lo", "mid", "hi")] for p in params}
        pdf = pdf[(pdf.length_m > 0) & pdf[sum(columns.values(), [])].notna().all(axis=1)]
        if pdf.empty:
            return pd.DataFrame({by: [], **{k: [] for k in points}})
        inputs = {p: tuple(pdf[c].to_numpy() for c in cs) for p, cs in columns.items()}
        got = stretch(road_class, pdf.length_m.to_numpy(), inputs, draws, seed, rho, **more)
        return pd.DataFrame({by: [pdf.iloc[0][by]], **{k: [got[k]] for k in points}})

    kind = units.schema[by].dataType.simpleString()
    return units.groupBy(by).applyInPandas(kernel, f"{by} {kind}, " + ", ".join(f"{k} double" for k in points))
