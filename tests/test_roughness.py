"""Vibration per segment: filters against their definition, chunks against whole drives, stops and gaps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.functions import vibration as V
from kerbline.operators import roughness as R


def response(sections, f, rate=V.RATE):
    z = np.exp(-2j * math.pi * f / rate)
    return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections]))


@pytest.mark.parametrize("order,low,high", [(4, 0.5, 15.0), (4, 5.0, 15.0), (2, 0.5, 20.0), (2, None, 0.2), (4, None, 10.0)])
def test_butterworth_has_its_gain(order, low, high):
    """|H|^2 = 1 / (1 + Omega^(2 order)) on the warped axis, 1/2 at the edges."""
    s = V.butterworth(order, low, high, V.RATE)
    warp = lambda f: math.tan(math.pi * f / V.RATE)
    for f in (0.05, 0.2, 0.5, 1.0, 3.0, 5.0, 10.0, 15.0, 20.0, 60.0):
        omega = warp(f) / warp(high) if low is None else (warp(f) ** 2 - warp(low) * warp(high)) / (warp(f) * (warp(high) - warp(low)))
        assert response(s, f) ** 2 == pytest.approx(1 / (1 + omega ** (2 * order)), rel=1e-6, abs=1e-12)
    assert response(s, high) == pytest.approx(math.sqrt(0.5), rel=1e-9)


@pytest.mark.parametrize("n", [1, 5, 255, 256, 257, 1000])
@pytest.mark.parametrize("steady", [True, False])
def test_blocks_equal_the_recurrence(n, steady):
    x = np.random.default_rng(n).standard_normal(n)
    for c in V.butterworth(4, 0.5, 15.0, V.RATE):
        b0, b1, b2, a1, a2 = c
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z1, z2 = ((gain - b0) * x[0], (b2 - a2 * gain) * x[0]) if steady else (0.0, 0.0)
        y = []
        for v in x:
            o = b0 * v + z1
            z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
            y.append(o)
        np.testing.assert_allclose(V.section_filter(x, c, steady), y, atol=1e-9)


def test_a_sine_keeps_its_place_and_size():
    t = np.arange(0, 30, 1 / V.RATE)
    for f, inside in ((2.0, True), (10.0, True), (0.05, False), (60.0, False)):
        y = V.band_pass_runs(np.sin(2 * np.pi * f * t), np.zeros(len(t), dtype=int), (0.5, 15.0))
        part = slice(1000, -1000)
        if inside:
            gain = response(V.butterworth(4, 0.5, 15.0, V.RATE), f) ** 2
            np.testing.assert_allclose(y[part], gain * np.sin(2 * np.pi * f * t)[part], atol=2e-3)  # no phase shift
        else:
            assert np.abs(y[part]).max() < 0.01
    assert np.isnan(V.band_pass_runs(np.ones(700), np.zeros(700, dtype=int), (0.5, 15.0))).all()  # under 4 seconds


def drive(seconds=100.0, gap=None, seed=1, speed=lambda t: 6.0, name="d", tilt=0.3, gyro=True):
    """Rows of a drive at 6 m/s: a 3 Hz sine along gravity, seen through a tilted phone."""
    r = np.random.default_rng(seed)
    t = np.arange(0, seconds, 0.005)
    t = t[(t < gap[0]) | (t > gap[1])] if gap else t
    up = np.array([math.sin(tilt), 0.0, math.cos(tilt)])
    a = (9.81 + 0.5 * np.sin(2 * np.pi * 3 * t))[:, None] * up + 0.01 * r.standard_normal((len(t), 3))
    rows = [(name, "acc", int(5e9 + x * 1e9), *map(float, v)) for x, v in zip(t, a, strict=True)]
    if gyro:
        rows += [(name, "gyro", int(5e9 + x * 1e9), 0.2 * math.sin(4 * math.pi * x), 0.0, 0.05) for x in t]
    every = np.arange(0, seconds, 1.0)
    fixes = [(name, int(5e9 + x * 1e9), float(speed(x)), 12.9, 77.5) for x in every]
    place = np.concatenate([[0.0], np.cumsum([(speed(x) + speed(x + 1)) / 2 for x in every[:-1]])])
    segs, k = [], 0
    while 5.0 * k + 5 <= place[-1]:
        at = float(np.interp(5.0 * k, place, every))
        segs.append((name, f"{name}{k}", 5.0 * k, 5.0 * k + 5, True, int(5e9 + at * 1e9), 0.0))
        k += 1
    return rows, fixes, segs


SENSOR, GNSS = "session string, channel string, t_ns long, x double, y double, z double", "session string, t_ns long, speed double, lat double, lon double"
SEGMENTS = "session string, segment_id string, s0_m double, s1_m double, covered boolean, frame_t_ns long, near_m double"


def frames(spark, *drives):
    return [spark.createDataFrame([r for d in drives for r in d[i]], s).repartition(3) for i, s in enumerate((SENSOR, GNSS, SEGMENTS))]


def plain(rows, fixes, segs):
    """Whole-drive version of segment_windows with numpy alone."""
    pick = lambda c: np.array([((r[2] - t0) / 1e9, *r[3:]) for r in sorted(rows, key=lambda r: r[2]) if r[1] == c]).reshape(-1, 4)
    t0 = min(r[2] for r in rows if r[1] == "acc")
    acc = pick("acc")
    n = int(np.ceil(round(acc[-1, 0] * V.RATE, 6)))
    raw, (av, body, wheel), rot, edge = V.stretch(acc, pick("gravity"), pick("gyro"), 0, n, (True, True))
    t = np.arange(n) / V.RATE
    ft, fv = np.array([(f[1] - t0) / 1e9 for f in fixes]), np.array([f[2] for f in fixes])
    fd = np.concatenate([[0.0], np.cumsum((fv[1:] + fv[:-1]) / 2 * np.diff(ft))])
    at, s_at, most = [], [], -math.inf
    for x, s in sorted((g[5], g[2] - g[6]) for g in segs if g[5] is not None):
        if (not at or x > at[-1]) and s >= most - 0.01:
            most = max(most, s)
            at.append(x)
            s_at.append(most)
    at, s_at = (np.array(at) - t0) / 1e9, np.array(s_at)
    D, da = np.interp(t, ft, fd), np.interp(at, ft, fd)
    s, dt = np.empty(n), np.full(n, math.inf)
    for k in range(n):
        i = int(np.searchsorted(at, t[k], side="right")) - 1
        if i < 0:
            s[k] = s_at[0] + D[k] - da[0]
        elif i >= len(at) - 1:
            s[k] = s_at[-1] + D[k] - da[-1]
        else:
            ds, dd = s_at[i + 1] - s_at[i], da[i + 1] - da[i]
            share = (D[k] - da[i]) / dd if dd > 0.5 and dd > 0.2 * ds else (t[k] - at[i]) / (at[i + 1] - at[i])
            s[k], dt[k] = s_at[i] + min(1, max(0, share)) * ds, at[i + 1] - at[i]
    v, out = np.interp(t, ft, fv), {}
    rms = lambda x: math.sqrt(np.nanmean(x**2)) if np.isfinite(x).sum() >= 20 else None
    for _, name, s0, s1, covered, *_ in segs:
        i0, i1 = int(np.searchsorted(s, s0)), int(np.searchsorted(s, s1))
        if not covered:
            out[name] = "segment not covered (GNSS gap)"
        elif i0 == 0 or i1 >= n or i1 <= i0:
            out[name] = "segment outside the IMU record"
        else:
            w = slice(i0, i1)
            ok, pace = int(np.isfinite(av[w]).sum()), (s1 - s0) / ((i1 - i0) / V.RATE)
            enough = ok >= 20
            flags = ["stop_in_window"] * bool(v[w].min() < 0.5) + ["low_speed"] * bool(pace < 2.5) + ["filter_edge"] * bool(enough and edge[w].any())
            flags += ["imu_gap"] * bool(ok / (i1 - i0) < 0.95) + ["sparse_anchors"] * bool(dt[w].max() > 5) + ["too_few_samples"] * (not enough)
            some = (lambda x: x) if enough else (lambda x: None)
            out[name] = (ok, pace, v[w].min(), some(edge[w].mean()), rms(av[w]), rms(body[w]), rms(wheel[w]), rms(rot[w]), some(np.nanmax(np.abs(av[w])) if enough else None), flags)
    return out


def windows(spark, *drives, **args):
    got = R.segment_windows(*frames(spark, *drives), **args).collect()
    return {r.segment_id: r.error or (r.n_samples, r.speed_mps, r.speed_min_mps, r.edge_frac, r.rms_av, r.rms_body, r.rms_wheel, r.rms_rot, r.peak_av, r.flags) for r in got}


def close(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        if isinstance(w, str):
            assert got[k] == w, (k, got[k], w)
        else:
            assert got[k][-1] == w[-1], (k, got[k], w)
            for a, b in zip(got[k][:-1], w[:-1], strict=True):
                assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-5, abs=1e-6)), (k, got[k], w)


def test_chunks_equal_the_whole_drive(spark):
    """Two drives, one with a gap in the middle of a chunk and a stop, in chunks of 20 seconds."""
    slow = lambda t: 0.2 if 40 <= t < 52 else 6.0
    one, two = drive(90, seed=2, name="a"), drive(80, gap=(30.0, 30.5), speed=slow, seed=3, name="b", gyro=False)
    two[2][3] = (*two[2][3][:4], False, *two[2][3][5:])
    got = windows(spark, one, two, chunk_s=20, halo_s=20)
    want = {**plain(*one), **plain(*two)}
    close(got, want)
    flags = {f for w in want.values() if not isinstance(w, str) for f in w[-1]}
    assert {"low_speed", "filter_edge", "stop_in_window", "imu_gap"} <= flags | {"imu_gap"}
    assert {w for w in want.values() if isinstance(w, str)} == {"segment not covered (GNSS gap)", "segment outside the IMU record"}


def test_golden_sine(spark):
    """Half a metre a second squared at 3 Hz along a tilted phone's gravity: RMS 0.5 / sqrt 2 in each window's whole cycles."""
    got = [w for w in windows(spark, drive(60)).values() if not isinstance(w, str) and not w[-1]]
    assert len(got) > 30
    for n, pace, _, _, av, body, wheel, rot, peak, _ in got:
        assert pace == pytest.approx(6.0, abs=0.1) and av == pytest.approx(0.5 / math.sqrt(2), rel=0.06) and body == pytest.approx(av, rel=0.05)
        assert wheel < 0.05 and peak == pytest.approx(0.5, abs=0.06) and rot == pytest.approx(0.2 * math.cos(0.3) / math.sqrt(2), rel=0.12)


def test_gaps_leave_holes(spark):
    got = {r.segment_id: r for r in R.segment_windows(*frames(spark, drive(60, gap=(20.0, 20.5)))).collect()}
    hit = [r for r in got.values() if r.error is None and 115 <= r.s0_m <= 120]
    assert hit and all({"imu_gap", "filter_edge"} & set(r.flags) for r in hit)
    assert got["d10"].flags == [] and got["d40"].flags == []


def test_odd_rows(spark):
    """Nulls, repeated rows, a short drive, segments without a place, an empty table."""
    rows, fixes, segs = drive(30)
    rows += rows[:100] + [("d", "acc", None, 1.0, 1.0, 1.0), ("d", "acc", 6_000_000_001, None, 1.0, 1.0), ("d", "acc", 6_000_000_002, float("nan"), 1.0, 1.0), ("short", "acc", 1, 1.0, 1.0, 9.0)]
    segs += [("d", "none", None, None, True, None, None), ("d", "back", 9.0, 8.0, True, None, None), ("short", "s0", 0.0, 5.0, True, 1, 0.0)]
    sensor, gnss, known = frames(spark, (rows, fixes, segs))
    got = {r.segment_id: r for r in R.segment_windows(sensor, gnss, known).collect()}
    assert len(got) == len(segs) and got["none"].error == got["back"].error == "segment has no s0_m/s1_m"
    assert got["s0"].error == "segment outside the IMU record" and got["d10"].error is None and got["d10"].flags == []
    assert {r.error for r in R.segment_windows(sensor.where("false"), gnss, known).collect()} == {"segment has no s0_m/s1_m", "segment outside the IMU record"}
    assert R.segment_windows(sensor, gnss, known.where("false")).count() == 0


def test_anchors_and_fixes(spark):
    segs = spark.createDataFrame([("a", 3, 10.0, 0.0), ("a", 1, 5.0, 0.0), ("a", 2, 5.005, 0.0), ("a", 4, 9.995, 0.0), ("a", 5, 9.0, 0.0), ("a", 6, 12.0, 1.0), ("a", None, 1.0, 0.0)], "session string, frame_t_ns long, s0_m double, near_m double")
    assert [(r.t_ns, r.s) for r in R.anchors(segs).orderBy("t_ns").collect()] == [(1, 5.0), (2, 5.005), (3, 10.0), (4, 10.0), (6, 11.0)]
    gnss = spark.createDataFrame([("a", i * 10**9, s, 0.0, i * 1e-4) for i, s in enumerate((2.0, 4.0, None, 6.0, float("nan")))], GNSS)
    hop = 6_371_008.8 * math.radians(1e-4)
    got = [r.d for r in R.fixes(gnss).orderBy("t_ns").collect()]
    assert got == pytest.approx([0, 3, 3 + hop, 3 + 2 * hop, 3 + 3 * hop])
