"""Vibration per road segment from sensors at hundreds of samples a second.

A drive's sensor rows are cut into chunks of time with halos on both sides, so a long drive lies over many tasks and
every chunk filters as if it had the whole. Grid samples get their distance and speed by as-of joins with the intervals
between anchors and between satellite fixes, on (drive, second); segments take their samples by an interval join on
distance and add them up. Only the filters run in Python.
"""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vibration as V
from .intervals import bins
from .spatial import EARTH_M, haversine

#: Seconds of a chunk and of its halos; the slowest pole of the filters has died away to 1e-9 after a halo.
CHUNK_S, HALO_S = 60, 30
# Samples a window needs, slowest speed for an estimate, speed that counts as a stop, longest anchor
# interval, least share of samples.
LEAST, SLOW, STOP, SPARSE_S, COVERED = 20, 2.5, 0.5, 5.0, 0.95
# Texts of a segment's error.
NO_PLACE, NOT_COVERED, OUTSIDE = "segment has no s0_m/s1_m", "segment not covered (GNSS gap)", "segment outside the IMU record"
#: Mean radius of the earth for steps without a speed.
RADIUS_M = 6_371_008.8
SAMPLE = "i long, raw double, av double, body double, wheel double, rot double, edge boolean"


def clean(sensor: DataFrame) -> DataFrame:
    """sensor(session, channel, t_ns, x, y, z) without rows that hold a null, NaN or infinity, the first of equal times
    kept."""
    fine = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y", "z")]
    d = sensor.select("session", "channel", F.col("t_ns").cast("long").alias("t_ns"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z")]).where("t_ns is not null")
    first = d.groupBy("session", "channel", "t_ns").agg(F.min_by(F.struct("x", "y", "z"), F.struct("x", "y", "z")).alias("v")).select("session", "channel", "t_ns", "v.*")
    return first.where(fine[0] & fine[1] & fine[2])


def spans(sensor: DataFrame, least: int) -> DataFrame:
    """(session, t0_ns, end_s) of sessions with at least so many acc samples."""
    acc = sensor.where("channel = 'acc'").groupBy("session").agg(F.min("t_ns").alias("t0_ns"), F.max("t_ns").alias("t1_ns"), F.count("*").alias("n"))
    return acc.where(F.col("n") >= least).select("session", "t0_ns", ((F.col("t1_ns") - F.col("t0_ns")) / 1e9).alias("end_s"))


def _chunk(key: tuple, pdf: pd.DataFrame, chunk_s: float, halo_s: float, rate: float, bands) -> pd.DataFrame:
    import numpy as np

    session, c = key
    end = float(pdf["end_s"].iloc[0])
    total = int(np.ceil(round(end * rate, 6)))  # grid points before the end
    low, high = max(0, int((c * chunk_s - halo_s) * rate)), min(total, int(((c + 1) * chunk_s + halo_s) * rate))
    core = slice(max(low, int(c * chunk_s * rate)) - low, min(high, int((c + 1) * chunk_s * rate)) - low)
    pick = lambda name: pdf.loc[pdf.channel == name, ["t", "x", "y", "z"]].sort_values("t").to_numpy(dtype=float)
    acc = pick("acc")
    if len(acc) < 3 or core.stop <= core.start:
        return pd.DataFrame(columns=["session", "i", "raw", "av", "body", "wheel", "rot", "edge"])
    raw, columns, turn, edge = V.stretch(acc, pick("gravity"), pick("gyro"), low, high, (low == 0, high == total), rate, bands=bands)
    out = {"session": session, "i": np.arange(low, high)[core], "raw": raw[core]}
    out |= {n: col[core] for n, col in zip(("av", "body", "wheel"), columns, strict=True)}
    return pd.DataFrame({**out, "rot": turn[core], "edge": edge[core]})


def _chunks(sensor: DataFrame, span: DataFrame, chunk_s: float, halo_s: float) -> DataFrame:
    """Clean sensor rows with the chunks that they lie in or next to."""
    d = sensor.join(span, "session").withColumn("t", (F.col("t_ns") - F.col("t0_ns")) / 1e9)
    first, last = F.floor((F.col("t") - halo_s) / chunk_s), F.floor((F.col("t") + halo_s) / chunk_s)
    most = F.floor(F.col("end_s") / chunk_s)
    d = d.withColumn("chunk", F.explode(F.sequence(F.greatest(F.lit(0), first).cast("long"), F.greatest(F.lit(0), F.least(last, most)).cast("long")))).where("t >= -60")
    return d.select("session", "chunk", "channel", "t", "x", "y", "z", "end_s")


def samples(sensor: DataFrame, least: int | None = None, chunk_s: float = CHUNK_S, halo_s: float = HALO_S, rate: float = V.RATE, bands=V.BANDS) -> DataFrame:
    """(session, i, t, raw, av, body, wheel, rot, edge): the even grid of each session, t = i / rate seconds after its
    first acc sample; vertical acceleration along gravity (a gravity channel, else the acceleration's low pass), its
    three bands, NaN in gaps and runs too short, the rotation across gravity, and whether a run's end is near (K1, K2).
    Sessions with fewer than `least` acc samples (10 seconds of the grid) give none."""
    sensor = clean(sensor)
    d = _chunks(sensor, spans(sensor, int(10 * rate) if least is None else least), chunk_s, halo_s)
    kind = sensor.schema["session"].dataType.simpleString()
    kernel = partial(_chunk, chunk_s=chunk_s, halo_s=halo_s, rate=rate, bands=bands)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return kernel(key, pdf)

    got = d.groupBy("session", "chunk").applyInPandas(run, f"session {kind}, {SAMPLE}")
    return got.withColumn("t", F.col("i") / rate)


def anchors(segments: DataFrame) -> DataFrame:
    """(session, t_ns, s): camera positions of segments(session, frame_t_ns, s0_m, near_m) in order of time, without
    those more than a centimetre behind an earlier one, never decreasing; of equal times the smallest s (W14)."""
    pts = segments.where("frame_t_ns is not null and s0_m is not null and near_m is not null").groupBy("session", F.col("frame_t_ns").alias("t_ns")).agg(F.min(F.col("s0_m") - F.col("near_m")).alias("s"))
    before = F.max("s").over(Window.partitionBy("session").orderBy("t_ns").rowsBetween(Window.unboundedPreceding, -1))
    d = pts.withColumn("m", before).where(F.col("m").isNull() | (F.col("s") >= F.col("m") - 0.01))
    return d.select("session", "t_ns", F.greatest("s", "m").alias("s"))


def fixes(gnss: DataFrame) -> DataFrame:
    """gnss(session, t_ns, speed, lat, lon) -> (session, t_ns, speed, d): distance so far, by the trapezoid of speed,
    by great circle where a speed is missing (W13)."""
    one = gnss.groupBy("session", "t_ns").agg(F.min_by(F.struct("speed", "lat", "lon"), F.struct("speed", "lat", "lon")).alias("v")).select("session", "t_ns", "v.*")
    w = Window.partitionBy("session").orderBy("t_ns")
    fine = lambda c: F.when(~F.isnan(c), F.col(c))
    one = one.select("session", "t_ns", fine("speed").alias("speed"), fine("lat").alias("lat"), fine("lon").alias("lon"))
    by_speed = (F.col("speed") + F.lag("speed").over(w)) / 2 * (F.col("t_ns") - F.lag("t_ns").over(w)) / 1e9
    by_place = haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")) * (RADIUS_M / EARTH_M)
    placed = F.lag("lon").over(w).isNotNull() & F.lag("lat").over(w).isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    step = F.greatest(F.lit(0.0), F.coalesce(by_speed, F.when(placed, by_place), F.lit(0.0)))
    return one.withColumn("step", step).select("session", "t_ns", "speed", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("d"))


def between(points: DataFrame, span: DataFrame, *values: str, size: float = 1.0, margin: float = 0.0) -> DataFrame:
    """points(session, t, values) as intervals (session, bin, a, b, value, value_b, ...) that cover each session's
    whole span: [a, b) from each point to the next, before the first and after the last with the same value at both
    ends and null for what is not there. One row per `size` seconds that an interval touches or comes near to."""
    w = Window.partitionBy("session").orderBy("t")
    nexts = [F.lead(v).over(w).alias(f"{v}_b") for v in values]
    here = points.select("session", F.col("t").alias("a"), F.lead("t").over(w).alias("b"), *values, *nexts)
    first = points.groupBy("session").agg(F.min("t").alias("b"), *[F.min_by(v, "t").alias(f"{v}_b") for v in values])
    ahead = first.select("session", F.lit(None).cast("double").alias("a"), "b", *[F.lit(None).cast("double").alias(v) for v in values], *[f"{v}_b" for v in values])
    both = here.unionByName(ahead).join(span.select("session", "end_s"), "session")
    low, high = F.greatest(F.lit(0.0), F.coalesce("a", F.lit(0.0))), F.least(F.col("end_s") + 1, F.coalesce("b", F.col("end_s") + 1))
    return both.where(low < high).withColumn("bin", F.explode(bins(F.greatest(F.lit(0.0), low - margin), high + margin, size))).drop("end_s")


def as_of(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows(session, t, bin) with the interval of between() that holds their t; each has one."""
    hit = (F.col("a").isNull() | (F.col("t") >= F.col("a"))) & (F.col("b").isNull() | (F.col("t") < F.col("b")))
    return rows.join(parts, ["session", "bin"]).where(hit)


def linear(v: str) -> Column:
    """A value between its ends, the nearer end's outside."""
    share = (F.col("t") - F.col("a")) / (F.col("b") - F.col("a"))
    return F.coalesce(F.col(v) + share * (F.col(f"{v}_b") - F.col(v)), F.col(v), F.col(f"{v}_b"))


def tracks(gnss: DataFrame, marks: DataFrame, span: DataFrame, size: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Intervals of between() by chunks of `size` seconds: distance and speed by satellite, distance on the segments'
    axis by anchors with the satellite's beside it. Sessions of fewer than two anchors give none of the last."""
    to_s = lambda df: df.join(span.select("session", "t0_ns"), "session").withColumn("t", (F.col("t_ns") - F.col("t0_ns")) / 1e9).drop("t0_ns", "t_ns")
    fix = to_s(gnss)
    way = between(fix.select("session", "t", "d"), span, "d")
    several = marks.groupBy("session").count().where("count >= 2").select("session")
    marks = to_s(marks.join(several, "session"))
    # Anchors may lie before the first sensor sample or after the last; their distance is that of the nearest second.
    inside = marks.join(span.select("session", "end_s"), "session").withColumn("at", F.least(F.greatest("t", F.lit(0.0)), "end_s"))
    inside = inside.select("session", F.col("t").alias("own"), "s", F.col("at").alias("t"), F.floor("at").cast("long").alias("bin"))
    marks = as_of(inside, way).select("session", F.col("own").alias("t"), "s", linear("d").alias("da"))
    by = {"size": size, "margin": 1.0}  # a chunk's first sample may lie a rounding before its start
    return between(fix.select("session", "t", "d"), span, "d", **by), between(fix.where("speed is not null").select("session", "t", "speed"), span, "speed", **by), between(marks, span, "s", "da", **by)


def on_track(t, way, speed, legs):
    """(s, v, anchor_s) of sample times, NaN for unknown: distance on the segments' axis, speed, and the length of the
    anchor interval in seconds (NaN outside). Between two anchors the distance follows the satellite distance where that
    moved enough, else time; outside it goes on from the nearest. way, speed: rows (a, b, value, value_b) of a chunk, legs:
    (a, b, s, s_b, da, da_b), in order of a."""
    import numpy as np

    def at(rows):
        i = np.searchsorted(np.where(np.isnan(rows[:, 0]), -np.inf, rows[:, 0]), t, side="right") - 1
        return rows[np.maximum(i, 0)].T

    def linear_at(rows):
        a, b, v, w = at(rows)
        mid = v + (t - a) / (b - a) * (w - v)
        return np.where(~np.isnan(mid), mid, np.where(~np.isnan(v), v, w))

    d, v = linear_at(way), linear_at(speed) if len(speed) else np.full(len(t), np.nan)
    a, b, s, s_b, da, da_b = at(legs)
    ds, dd = s_b - s, da_b - da
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where((dd > 0.5) & (dd > 0.2 * ds), (d - da) / dd, (t - a) / (b - a))
    inner = s + np.minimum(1.0, np.maximum(0.0, share)) * ds
    return np.where(np.isnan(a), s_b + d - da_b, np.where(np.isnan(b), s + d - da, inner)), v, b - a


#: What a chunk knows of a segment, added up over its chunks; a row without a segment holds the chunk's ends.
BANDS = ("av", "body", "wheel", "rot")
PART = "samples long, t0_s double, t1_s double, speed_min double, edges long, anchor_s double, peak double, s_first double, s_last double, " + ", ".join(f"n_{c} long, sq_{c} double" for c in BANDS)


def _parts(key: tuple, pdf: pd.DataFrame, beside: pd.DataFrame, grid, rate: float, axle_m: float) -> pd.DataFrame:
    """Sums of a chunk's samples under each segment that they can reach."""
    import numpy as np

    names = ["session", "segment_id", *[f.split()[0] for f in PART.split(", ")]]
    pick = lambda kind, n: beside.loc[beside.kind == kind, [f"p{i}" for i in range(n)]].to_numpy(dtype=float)
    order = lambda r: r[np.argsort(np.where(np.isnan(r[:, 0]), -np.inf, r[:, 0]), kind="stable")]
    way, speed, legs = order(pick("way", 4)), order(pick("speed", 4)), order(pick("leg", 6))
    got = grid(key, pdf) if len(pdf) and len(way) and len(legs) else pdf.iloc[:0]
    if not len(got):
        return pd.DataFrame(columns=names)
    t = got["i"].to_numpy() / rate
    s, v, anchor = on_track(t, way, speed, legs)
    s = s + axle_m
    anchor = np.where(np.isnan(anchor), np.inf, anchor)
    by_s = np.argsort(s, kind="stable")
    edge, band = got["edge"].to_numpy(dtype=bool), {c: got[c].to_numpy(dtype=float) for c in BANDS}
    least, most = lambda x: x.min() if len(x) else None, lambda x: x.max() if len(x) else None
    known = lambda x: x[~np.isnan(x)]
    rows = [(key[0], None, 0, None, None, None, 0, None, None, least(known(s)), most(known(s)), *[0, 0.0] * len(BANDS))]
    segs = beside[beside.kind == "segment"]
    for name, s0, s1 in zip(segs["segment_id"], segs["p0"], segs["p1"], strict=True):
        at = np.sort(by_s[np.searchsorted(s[by_s], s0, side="left") : np.searchsorted(s[by_s], s1, side="left")])
        if len(at):
            fine = [known(x[at]) for x in band.values()]
            rows.append((key[0], name, len(at), t[at].min(), t[at].max(), least(known(v[at])), int(edge[at].sum()), anchor[at].max(), most(np.abs(fine[0])), None, None, *[x for f in fine for x in (len(f), float(np.sum(f * f)))]))
    return pd.DataFrame(rows, columns=names)


def segment_windows(sensor: DataFrame, gnss: DataFrame, segments: DataFrame, least: int | None = None, rate: float = V.RATE, axle_m: float = 0.0, chunk_s: float = CHUNK_S, halo_s: float = HALO_S, bands=V.BANDS) -> DataFrame:
    """A row per segment(session, segment_id, s0_m, s1_m, covered, frame_t_ns, near_m) with the features of its samples
    and flags, or an error (K3).

    n_samples, coverage, duration_s, speed_mps, speed_min_mps, edge_frac, rms_av, rms_body, rms_wheel, rms_rot,
    peak_av, rms_av_norm and flags stop_in_window, low_speed, filter_edge, imu_gap, sparse_anchors, too_few_samples.
    """
    sensor = clean(sensor)
    span = spans(sensor, int(10 * rate) if least is None else least)
    way, speed, legs = tracks(fixes(gnss), anchors(segments), span, chunk_s)
    known = segments.where("s1_m > s0_m and coalesce(covered, true)").select("session", "segment_id", "s0_m", "s1_m")
    # Between anchors a sample lies between their distances; before the first and after the last it may lie anywhere on.
    far = float("inf")
    low, high = F.when(F.col("a").isNull(), -far).otherwise(F.col("s")), F.when(F.col("b").isNull(), far).otherwise(F.col("s_b"))
    reach = legs.groupBy("session", "bin").agg((F.min(low) + (axle_m - 1e-3)).alias("low"), (F.max(high) + (axle_m + 1e-3)).alias("high"))
    under = reach.join(known, "session").where("s1_m > low and s0_m < high")
    name = segments.schema["segment_id"].dataType.simpleString()
    row = lambda d, kind, *cols: d.select("session", F.col("bin").alias("chunk"), F.lit(kind).alias("kind"), (F.col("segment_id") if kind == "segment" else F.lit(None).cast(name)).alias("segment_id"), *[(F.col(cols[i]) if i < len(cols) else F.lit(None)).cast("double").alias(f"p{i}") for i in range(6)])
    beside = row(way, "way", "a", "b", "d", "d_b").union(row(speed, "speed", "a", "b", "speed", "speed_b")).union(row(legs, "leg", "a", "b", "s", "s_b", "da", "da_b")).union(row(under, "segment", "s0_m", "s1_m"))
    beside = beside.select(*[F.col(c).alias(c) for c in beside.columns])  # columns of their own where both come from one table
    kernel = partial(_parts, grid=partial(_chunk, chunk_s=chunk_s, halo_s=halo_s, rate=rate, bands=bands), rate=rate, axle_m=axle_m)

    def run(key: tuple, pdf: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        return kernel(key, pdf, more)

    kind = sensor.schema["session"].dataType.simpleString()
    parts = _chunks(sensor, span, chunk_s, halo_s).groupBy("session", "chunk").cogroup(beside.groupBy("session", "chunk")).applyInPandas(run, f"session {kind}, segment_id {name}, {PART}")
    rms = lambda c: F.when(F.sum(f"n_{c}") >= LEAST, F.sqrt(F.sum(f"sq_{c}") / F.sum(f"n_{c}"))).alias(f"rms_{c}")
    sums = parts.groupBy("session", "segment_id").agg(
        F.sum("samples").alias("window"), F.sum("n_av").alias("n_samples"), F.min("t0_s").alias("t0_s"), F.max("t1_s").alias("t1_s"), F.min("speed_min").alias("speed_min_mps"),
        F.when(F.sum("samples") > 0, F.sum("edges") / F.sum("samples")).alias("edge_frac"), F.max("anchor_s").alias("anchor_s"), F.max("peak").alias("peak_av"), F.min("s_first").alias("s_first"), F.max("s_last").alias("s_last"), *map(rms, BANDS),
    )
    every = Window.partitionBy("session")  # the row without a segment tells the others where the drive begins and ends
    d = segments.select("session", "segment_id", "s0_m", "s1_m", "covered", F.lit(True).alias("asked")).join(sums, ["session", "segment_id"], "full")
    d = d.withColumn("s_first", F.min("s_first").over(every)).withColumn("s_last", F.max("s_last").over(every)).where("asked")
    outside = F.col("window").isNull() | (F.col("s_first") >= F.col("s0_m")) | (F.col("s_last") < F.col("s1_m"))
    error = F.when(F.col("s0_m").isNull() | F.col("s1_m").isNull() | (F.col("s1_m") <= F.col("s0_m")), NO_PLACE)
    error = error.when(~F.coalesce("covered", F.lit(True)), NOT_COVERED).when(outside, OUTSIDE)
    d = d.withColumn("error", error).withColumn("duration_s", F.col("window") / rate).withColumn("speed_mps", (F.col("s1_m") - F.col("s0_m")) / F.col("duration_s")).withColumn("coverage", F.col("n_samples") / F.col("window"))
    enough = F.col("n_samples") >= LEAST
    flags = [("stop_in_window", F.col("speed_min_mps") < STOP), ("low_speed", F.col("speed_mps") < SLOW), ("filter_edge", enough & (F.col("edge_frac") > 0)), ("imu_gap", F.col("coverage") < COVERED), ("sparse_anchors", F.col("anchor_s") > SPARSE_S), ("too_few_samples", F.col("rms_av").isNull())]
    d = d.withColumn("flags", F.array_compact(F.array(*[F.when(c, n) for n, c in flags])))
    d = d.withColumn("rms_av_norm", F.col("rms_av") / F.sqrt("speed_mps"))
    keep = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    some = lambda c: F.when(F.col("error").isNull() & enough, F.col(c)).alias(c)
    return d.select(
        "session", "segment_id", "s0_m", "s1_m", "error", *map(keep, ("n_samples", "coverage", "t0_s", "t1_s", "duration_s", "speed_mps", "speed_min_mps")),
        *map(some, ("edge_frac", "rms_av", "rms_body", "rms_wheel", "rms_rot", "peak_av", "rms_av_norm")), keep("flags"),
    )
