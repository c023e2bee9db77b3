"""Curve selection, residual model, bootstrap and intervals against plain versions on random tables."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from kerbline.functions import stats
from kerbline.operators import extent as E


def pav(means, weights):
    out = []
    for m, w in zip(means, weights, strict=True):
        out.append([m, w, 1])
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            b, a = out.pop(), out.pop()
            out.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [m for m, _, n in out for _ in range(n)]


def quant(v, q):
    v = sorted(v)
    at = q * (len(v) - 1)
    i = int(at)
    return v[i] + (at - i) * (v[min(i + 1, len(v) - 1)] - v[i])


def interp(x, xs, ys):
    if x < xs[0]:
        return max(0.0, ys[0])
    for (a, ya), (b, yb) in zip(zip(xs, ys, strict=True), list(zip(xs, ys, strict=True))[1:]):
        if a <= x < b:
            return max(0.0, ya + (x - a) / (b - a) * (yb - ya))
    return max(0.0, ys[-1])


def bins(rows, k):
    xs = [r["x"] for r in rows]
    edges = sorted({quant(xs, i / k) for i in range(1, k)})
    got = [[] for _ in range(len(edges) + 1)]
    for r in rows:
        got[sum(r["x"] > e for e in edges)].append(r)
    if not all(got):
        return None
    n = [len(b) for b in got]
    return edges, [quant([r["x"] for r in b], 0.5) for b in got], pav([statistics.fmean(r["y"] for r in b) for b in got], n)


def fit(name, rows):
    """A function of a row, or None."""
    if name == "constant":
        m = statistics.fmean(r["y"] for r in rows)
        return lambda r: m
    if name != "bins3_label":
        f = bins(rows, int(name[4:]))
        return f and (lambda r: interp(r["x"], f[1], f[2]))
    if any(r["flag"] is None for r in rows):
        return None
    parts = [[r for r in rows if r["flag"] == s] for s in (0, 1)]
    fits = [len(p) >= E.STRATUM and bins(p, 3) for p in parts]
    return all(fits) and (lambda r: interp(r["x"], *fits[r["flag"]][1:])) or None


def choose(rows, folds):
    oof, blocks = {}, sorted({r["block"] for r in rows})
    for name in E.CANDIDATES:
        got = {}
        for k in range(folds):
            own = [r for r in rows if r["fold"] == k]
            f = fit(name, [r for r in rows if r["fold"] != k])
            got |= {r["i"]: f(r) if f else None for r in own}
        oof[name] = None if None in got.values() else got
    mean = lambda v: statistics.fmean(v)
    of = {b: [r for r in rows if r["block"] == b] for b in blocks}
    cv = {n: o and mean(abs(mean(o[r["i"]] for r in of[b]) - mean(r["y"] for r in of[b])) for b in blocks) for n, o in oof.items()}
    best = min((n for n in E.CANDIDATES if cv[n] is not None), key=lambda n: (round(cv[n], 12), E.CANDIDATES.index(n)))
    res = {r["i"]: r["y"] - oof[best][r["i"]] for r in rows}
    big = [of[b] for b in blocks if len(of[b]) >= 10]
    u = [math.sqrt(max(mean(r["y"] for r in b), 0)) - math.sqrt(max(mean(oof[best][r["i"]] for r in b), 0)) for b in big]
    m, n = mean(res.values()), len(res)
    s2 = sum((v - m) ** 2 for v in res.values()) / max(1, n - 1)
    rho = 1.0
    if s2 > 0 and big:
        vb = sum((mean(res[r["i"]] for r in b) - m) ** 2 for b in big) / max(1, len(big) - 1)
        nbar = mean(len(b) for b in big)
        rho = (nbar * vb / s2 - 1) / (nbar - 1) if nbar > 1 else 1.0
    return best, cv, math.sqrt(mean(v * v for v in u)) if u else 0.0, min(1.0, max(0.0, rho)), s2


def table(seed):
    r, rows, i = random.Random(seed), [], 0
    for g in ("a", "b", "c", "d"):
        for b in range(24):
            lift = r.gauss(0, 2)
            for _ in range(r.choice((4, 14, 18))):
                s = round(r.random(), 3) if g != "d" else r.choice((0.2, 0.7))
                flag = None if g == "b" and i % 50 == 0 else int(r.random() < (0.9 if s > 0.5 else 0.2))
                y = {"a": 20 * s * s, "b": 5.0, "c": 3 + 12 * (flag or 0), "d": 10 * s}[g] + lift * (g != "c") + r.gauss(0, 1.5)
                rows.append({"i": i, "g": g, "block": f"{g}{b}", "fold": b % 5, "score": s, "y": max(0.0, y), "flag": flag, "x": math.log(min(max(s, 1e-4), 1 - 1e-4) / (1 - min(max(s, 1e-4), 1 - 1e-4)))})
                i += 1
    return rows


COLUMNS = "g string, block string, fold int, score double, y double, flag int"


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in COLUMNS.split(", ")) for r in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module", params=[1, 2])
def fitted(spark, request):
    rows = table(request.param)
    d = frame(spark, rows).cache()
    choice, curves = E.select(d)
    return rows, d, choice.cache(), curves.cache()


def test_selection_equals_a_plain_one(fitted):
    rows, _, choice, _ = fitted
    chosen = set()
    for c in choice.collect():
        best, cv, tau, rho, s2 = choose([r for r in rows if r["g"] == c.g], 5)
        assert c.chosen == best and set(c.cv) == set(cv)
        for n, e in cv.items():
            assert (c.cv[n] is None) == (e is None) and (e is None or c.cv[n] == pytest.approx(e, abs=1e-9)), (c.g, n)
        assert (c.tau20, c.rho, c.sigma2) == pytest.approx((tau, rho, s2), abs=1e-9)
        chosen.add(best)
    assert len(chosen) >= 3 and "bins3_label" in chosen


def test_bootstrap_and_interval_equal_plain_ones(spark, fitted):
    rows, d, choice, curves = fitted
    draws = 25
    boots = E.bootstrap(d, curves, draws, seed=3).collect()
    u = {(r.g, r.block, r.draw): r.u for r in d.select("g", "block").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select("g", "block", "draw", (F.pmod(F.xxhash64(F.lit(3), "draw", "g", "block"), F.lit(1 << 52)) / float(1 << 52)).alias("u")).collect()}
    weight = lambda x: sum(x >= p for p in E.POISSON)
    assert 0.85 < statistics.fmean(weight(x) for x in u.values()) < 1.15
    chosen = {c.g: c for c in curves.collect()}
    for b in boots:
        c, own = chosen[b.g], [r for r in rows if r["g"] == b.g and (b.stratum == -1 or r["flag"] == b.stratum)]
        edges = [] if c.chosen == "constant" else c.fits[f"{E.LEVELS[c.chosen]}:{b.stratum}"].edges
        n, s = [0] * (len(edges) + 1), [0.0] * (len(edges) + 1)
        for r in own:
            k, w = sum(r["x"] > e for e in edges), weight(u[b.g, r["block"], b.draw])
            n[k], s[k] = n[k] + w, s[k] + w * r["y"]
        near = [min((abs(j - i), j) for j in range(len(n)) if n[j])[1] for i in range(len(n))]
        assert b.ys == pytest.approx(pav([s[j] / n[j] for j in near], [max(1, x) for x in n]), abs=1e-9)
    assert {(b.g, b.stratum) for b in boots} == {(g, s) for g, c in chosen.items() for s in ((0, 1) if c.chosen == "bins3_label" else (-1,))}
    secs = [(r["g"], r["i"] % 7, None if r["i"] % 7 == 3 and r["i"] % 2 else r["score"], 5.0 + r["i"] % 3, r["flag"] or 0) for r in rows]
    sections = spark.createDataFrame(secs, "g string, section int, score double, length_m double, flag int")
    for factor in (1.0, 1.5):
        got = {(r.g, r.section): r for r in E.intervals(sections, choice, curves, spark.createDataFrame(boots), factor).collect()}
        assert len(got) == 28
        z = [statistics.NormalDist().inv_cdf((i + 0.5) / 41) for i in range(41)]
        ch = {c.g: c for c in choice.collect()}
        for (g, sec), r in list(got.items())[::5]:
            mine = [(math.log(min(max(s, 1e-4), 1 - 1e-4) / (1 - min(max(s, 1e-4), 1 - 1e-4))), w, f) for a, b, s, w, f in secs if (a, b) == (g, sec) and s is not None]
            total, name, fits = sum(w for a, b, _, w, _ in secs if (a, b) == (g, sec)), chosen[g].chosen, chosen[g].fits
            scored = sum(w for _, w, _ in mine)
            assert r.coverage == pytest.approx(scored / total) and r.n_frames == len(mine)
            if scored / total < 0.5:
                assert r.mean is None
                continue
            key = lambda f: f if name == "bins3_label" else -1

            def section_mean(ys):
                return sum(w * (ys(f)[0] if name == "constant" else interp(x, fits[f"{E.LEVELS[name]}:{key(f)}"].x, ys(f))) for x, w, f in mine) / scored

            point = section_mean((lambda f: [chosen[g].mean]) if name == "constant" else (lambda f: fits[f"{E.LEVELS[name]}:{key(f)}"].y))
            ys = {(b.draw, b.stratum): b.ys for b in boots if b.g == g}
            means = [section_mean(lambda f, k=k: ys[k, key(f)]) for k in range(draws)]
            n, rho = max(1, len(mine)), ch[g].rho
            ref = (1 + 19 * rho) / 20
            tau = ch[g].tau20 * math.sqrt(((1 + (n - 1) * rho) / n) / ref if n <= 20 else 20 / n)
            vals = [max(0.0, math.sqrt(max(0, m)) + tau * e) ** 2 for m in means for e in z]
            if factor > 1:
                vals = [v * math.exp(math.log(factor) / 1.6448536269514722 * e) for v in vals for e in z[::4]]
            want = (point, min(point, quant(vals, 0.05)), max(point, quant(vals, 0.95)))
            assert (r.mean, r.lo90, r.hi90) == pytest.approx(want, abs=1e-7), (g, sec)


def test_a_table_without_rows(spark):
    choice, curves = E.select(frame(spark, []))
    assert choice.count() == curves.count() == 0


@pytest.mark.parametrize("run", [30, 10_000])
def test_isotonic_over_ranges_equals_one_pass(spark, run, monkeypatch):
    monkeypatch.setattr(stats, "ISOTONIC_RUN", run)
    r = random.Random(run)
    shapes = {"up": lambda x: x, "down": lambda x: -x, "noise": lambda x: 0, "wave": lambda x: math.sin(8 * x), "cliff": lambda x: x - 5 * (x > 0.9)}
    rows = [(g, round(x := r.random(), 2), f(x) + r.gauss(0, 0.3)) for g, f in shapes.items() for _ in range(300)] + [("one", 0.5, 1.0), (None, 0.1, 2.0), (None, 0.2, 1.0)]
    got = {}
    for b in stats.isotonic(spark.createDataFrame(rows, "g string, x double, y double").repartition(4), "g", "x", "y").collect():
        got.setdefault(b.g, []).append((b.x0, b.x1, b.fit, b.n))
    for g in {x[0] for x in rows}:
        by = {}
        for k, x, y in rows:
            if k == g:
                by.setdefault(x, []).append(y)
        xs = sorted(by)
        fits = pav([statistics.fmean(by[x]) for x in xs], [len(by[x]) for x in xs])
        have = sorted(got[g])
        assert [a for a, *_ in have] == [x for i, x in enumerate(xs) if i == 0 or fits[i] > fits[i - 1] + 1e-12]
        assert all(f == pytest.approx(fits[xs.index(a)], abs=1e-9) and a <= b for a, b, f, _ in have) and sum(n for *_, n in have) == sum(map(len, by.values()))
