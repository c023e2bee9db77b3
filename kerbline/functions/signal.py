"""Sensor kernels per drive, numpy only."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vibration import section_filter

RATE, GRAVITY = 200.0, 9.80665


def resample(t_ns, values, rate: float = RATE, gap_s: float = 0.05):
    """(times, values, ok) on an even grid; ok is false in gaps (K1). Times stay whole nanoseconds until differenced."""
    import numpy as np

    t = (np.asarray(t_ns, dtype=np.int64) - int(t_ns[0])) / 1e9
    grid = np.arange(0, t[-1] + 1e-12, 1 / rate)
    at = np.clip(np.searchsorted(t, grid, side="right"), 1, len(t) - 1)
    return grid, np.interp(grid, t, values), (t[at] - t[at - 1]) <= gap_s


def vertical(ax, ay, az, gx, gy, gz):
    """Acceleration along gravity, less gravity (K1)."""
    import numpy as np

    n = np.sqrt(gx * gx + gy * gy + gz * gz)
    n[n == 0] = np.nan
    return (ax * gx + ay * gy + az * gz) / n - GRAVITY


def biquads(low: float, high: float, rate: float = RATE) -> list[tuple]:
    """Second-order Butterworth high-pass and low-pass by the bilinear transform."""
    out = []
    for f, kind in ((low, "high"), (high, "low")):
        k = math.tan(math.pi * f / rate)
        n = 1 / (1 + math.sqrt(2) * k + k * k)
        a1, a2 = 2 * (k * k - 1) * n, (1 - math.sqrt(2) * k + k * k) * n
        out.append((k * k * n, 2 * k * k * n, k * k * n, a1, a2) if kind == "low" else (n, -2 * n, n, a1, a2))
    return out


def band_pass(x, low: float, high: float, rate: float = RATE):
    """Zero-phase band-pass: each section forward and backward, ends mirrored (K2)."""
    import numpy as np

    x = np.asarray(x, dtype=float)
    pad = min(len(x) - 1, int(rate))
    if pad < 3:
        return np.zeros_like(x)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for c in biquads(low, high, rate):
        y = section_filter(section_filter(y, c, steady=False)[::-1], c, steady=False)[::-1]
    return y[pad : pad + len(x)]


def windows(df: DataFrame, key: str = "session_id", low: float = 0.5, high: float = 20.0) -> DataFrame:
    """(key, second, rms, peak) of the band-passed channel of df(key, t_ns, v) (K1-K3)."""
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.dropna().sort_values("t_ns", kind="stable").drop_duplicates("t_ns")
        if len(pdf) < 8:
            return pd.DataFrame({key: [], "second": [], "rms": [], "peak": []})
        t, v, ok = resample(pdf.t_ns.to_numpy(), pdf.v.to_numpy(), gap_s=math.inf)
        y = band_pass(v, low, high)
        g = pd.DataFrame({"second": np.floor(t).astype("int64"), "y": y}).groupby("second").y
        out = g.agg(rms=lambda s: float(np.sqrt((s * s).mean())), peak=lambda s: float(s.abs().max())).reset_index()
        return out.assign(**{key: pdf[key].iloc[0]})[[key, "second", "rms", "peak"]]

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandas(kernel, f"{key} {kind}, second long, rms double, peak double")


# The reference quarter car at 80 km/h: sprung stiffness and damping, tyre stiffness, unsprung mass share.
CAR = {"k2": 63.3, "c": 6.0, "k1": 653.0, "mu": 0.15}
SPEED = 80 / 3.6


def transfer(wavenumber: float) -> float:
    """Gain from profile slope to suspension slope at a wavenumber in cycles per metre (K4)."""
    s = 2j * math.pi * wavenumber * SPEED
    k2, c, k1, mu = CAR["k2"], CAR["c"], CAR["k1"], CAR["mu"]
    a = s * s + c * s + k2
    # sprung: a zs - (c s + k2) zu = 0; unsprung: (mu s^2 + c s + k2 + k1) zu - (c s + k2) zs = k1 h
    zu = k1 / (mu * s * s + c * s + k2 + k1 - (c * s + k2) ** 2 / a)
    zs = (c * s + k2) / a * zu
    return abs(zs - zu)


def iri_factor(n0: float = 0.01, n1: float = 2.0, steps: int = 4000) -> float:
    """IRI of a unit white-noise slope profile: square root of the integrated squared gain (K4)."""
    h = (n1 - n0) / steps
    total = sum(transfer(n0 + i * h) ** 2 * (0.5 if i in (0, steps) else 1.0) for i in range(steps + 1)) * h
    return math.sqrt(total * 2 / math.pi)


def profile(df: DataFrame, key: str, order: str, slope: str, step: float) -> DataFrame:
    """df with z, the elevation that slopes `step` metres apart add up to (K5)."""
    return df.withColumn("z", F.sum(F.col(slope) * step).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def synthetic_profile(n: int, step: float, seed: int, roughness: float = 1e-3) -> list[float]:
    """Elevations whose slopes are white noise (K5): test input."""
    import random

    rng, z, out = random.Random(seed), 0.0, []
    for _ in range(n):
        z += rng.gauss(0, roughness) * step
        out.append(z)
    return out
