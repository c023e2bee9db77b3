"""Printed examples and closed-form cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kerbline.functions import arrays, estimate, labels, rating, review, signal, stats, text, times
from kerbline.operators import aggregates as A
from kerbline.operators import checks, filters, intervals, islands, network, spatial, work


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_worked_example_of_2015(spark):
    x = {"cracking": 9.0, "ravelling": 8.0, "potholes": 0.0, "shoving": 0.09, "patching": 5.0, "settlement": 4.0, "rut_depth": 9.0}
    d = spark.createDataFrame([("u", "highway", p, v) for p, v in x.items()], "unit string, road_class string, param string, x double")
    r = rating.rate(d, "unit").first()
    assert (r["final"], r["class"]) == (1.3, "Fair")


def test_bands_and_urban_potholes(spark):
    b = lambda x, lo, hi, nil=False: rating.band(F.lit(x), F.lit(lo), F.lit(hi), F.lit(nil))
    r = one(spark, a=b(5.0, 5.0, 10.0), b=b(4.99, 5.0, 10.0), c=b(10.0, 5.0, 10.0), d=b(10.01, 5.0, 10.0), e=b(0.0, 0.0, 0.5, True), f=b(0.3, 0.0, 0.5, True), g=b(0.51, 0.0, 0.5, True))
    assert list(r) == ["Fair", "Good", "Fair", "Poor", "Good", "Fair", "Poor"]


# Printed examples of the 2023 index.
EXAMPLES = [
    ("highway", dict(cracking=0.5, ravelling=0.3, potholes=0, patching=0.05, rut_depth=0.10, iri=2.4), 93.58, 0.6),
    ("highway", dict(cracking=5, ravelling=3, potholes=2, patching=2.6, rut_depth=10, iri=4.5), 41.37, 0.6),
    ("highway", dict(cracking=14, ravelling=12, potholes=4, patching=15, rut_depth=14, iri=8), 20.54, 0.6),
    ("urban", dict(cracking=0.5, ravelling=0.2, potholes=0, patching=0.1, rut_depth=0, iri=2.4), 94.50, 0.006),
    ("urban", dict(cracking=5, ravelling=2, potholes=3, patching=3.5, rut_depth=4, iri=6), 46.82, 0.006),
    ("urban", dict(cracking=12, ravelling=8, potholes=4, patching=10, rut_depth=12, iri=7), 27.63, 0.006),
]


@pytest.mark.parametrize("road,values,want,tol", EXAMPLES)
def test_printed_index_examples(spark, road, values, want, tol):
    v = one(spark, v=rating.index(road, {k: F.lit(float(x)) for k, x in values.items()}))["v"]
    assert abs(v - want) < tol


def test_index_classes_and_unusable_curves(spark):
    c = lambda v: rating.index_class(F.lit(v))
    assert list(one(spark, a=c(90.01), b=c(90.0), c=c(80.0), d=c(60.0), e=c(20.0))) == ["Excellent", "Good", "Satisfactory", "Fair", "Fail"]
    n = lambda r, p, s=None: rating.index_param(r, p, F.lit(3.0), s)
    assert list(one(spark, a=n("mdr", "potholes"), b=n("rural", "iri", "SD"), c=n("rural", "iri", "MSS"))) == [None] * 3


def segs(spark, n_hit, n_clean, n_skip, n_gone=0, names=("Potholes",)):
    rows = [("s", i, "send", "distress", list(names)) for i in range(n_hit)] + [("s", i, "send", "normal", ["Normal"]) for i in range(n_clean)]
    rows += [("s", i, "skip", "not_sent", []) for i in range(n_skip)] + [("s", i, "not_covered", "not_covered", []) for i in range(n_gone)]
    return spark.createDataFrame([(*r, 5.0) for r in rows], "unit string, k int, status string, vlm_class string, final_labels array<string>, length_m double")


def test_skip_correction_and_coverage(spark):
    r = A.extents(A.coverage(A.quantities(segs(spark, 1, 15, 4), "unit")), "potholes").first()
    assert (round(r.potholes_lo, 6), round(r.potholes_uncorrected, 6)) == (5.0, 6.25)
    assert abs(r.potholes_hi - 100 * (5 + 0.1028 * 20) / 100) < 1e-9
    assert A.coverage(A.quantities(segs(spark, 0, 14, 0, 6), "unit")).first().coverage_status == "low_coverage"
    assert A.coverage(A.quantities(segs(spark, 0, 0, 20), "unit")).first().coverage_status == "insufficient"


def test_label_parsers(spark):
    p = labels.pavement
    assert list(one(spark, a=p(F.lit("Yes, it is")), b=p(F.lit("NO.")), c=p(F.lit("")), d=p(F.lit("maybe")))) == ["yes", "no", "unsure", "unsure"]
    s = labels.stage2(F.lit("DISTRESS_TYPES: Pothole (D40), Block Crack, zebra, Other\nSEVERITY: Severe.\nDESCRIPTION: deep: hole"))
    r = one(spark, s=s)["s"]
    assert (r.types, r.severity, r.description) == (["Potholes", "Transverse Cracking", "zebra"], "High", "deep: hole")
    assert one(spark, s=labels.stage2(F.lit("nothing here")))["s"].types == ["Unknown"]
    assert one(spark, m=labels.marker(F.array(F.lit("Bleeding"), F.lit("edge breaking"))))["m"] == "Edge Breaking"


def test_verdicts(spark):
    rows = [(True, True, ["Potholes", "Longitudinal Cracking"], e) for e in (["Longitudinal Cracking", "pothole"], ["Potholes"], ["Rutting"])] + [(True, False, ["Potholes"], []), (False, False, [], [])]
    d = spark.createDataFrame(rows, "vlm_distress boolean, expert_distress boolean, v array<string>, e array<string>")
    assert [(r.verdict, r.jaccard) for r in review.compare(d).collect()] == [("right", 1.0), ("close", 0.5), ("wrong", 0.0), ("wrong", 0.0), ("right", 1.0)]


def test_wilson_mcnemar_quantiles(spark):
    w = one(spark, w=stats.wilson(F.lit(8), F.lit(10)))["w"]
    assert 0.49 < w.lo < 0.50 and 0.94 < w.hi < 0.95
    assert abs(one(spark, p=stats.mcnemar(F.lit(3), F.lit(9)))["p"] - 2 * sum(math.comb(12, i) for i in range(4)) / 2**12) < 1e-12
    assert abs(one(spark, q=estimate.normal_quantile(F.lit(0.95)))["q"] - 1.6448536269514722) < 1e-8
    assert one(spark, q=estimate.poisson_quantile(F.lit(3.0), 0.95))["q"] == 6
    d = estimate.draw("highway", {"cracking": (5.0, 5.0, 5.0)}, 200, 1)
    assert d == estimate.draw("highway", {"cracking": (5.0, 5.0, 5.0)}, 200, 1) and d["p05"] <= d["p50"] <= d["p95"]


def test_filter_parsing():
    f = filters.parse({"label": "potholes", "date_to": "2024-01-07", "bbox": "1,2,3,4", "_x": "y"})
    assert f.within["labels"] == ("Potholes",) and f.end == dt.datetime(2024, 1, 8) and f.bbox == (1, 2, 3, 4)
    for bad in ({"colour": "red"}, {"label": "zebra"}, {"bbox": "3,2,1,4"}, {"min_confidence": "2"}, {"date_from": "x"}, {"answered": "perhaps"}, {"date_from": "2024-02-01", "date_to": "2024-01-01"}):
        with pytest.raises(filters.FilterError):
            filters.parse(bad)


def test_intervals_against_nested_loop(spark):
    import random

    r = random.Random(2)
    a = [("x", s := r.uniform(0, 300), s + r.uniform(0.1, 60)) for _ in range(60)]
    b = [("x", s := r.uniform(0, 300), s + r.uniform(0.1, 60)) for _ in range(60)]
    got = intervals.overlap_join(spark.createDataFrame(a, "k string, a0 double, a1 double"), spark.createDataFrame(b, "k string, b0 double, b1 double"), ["k"], 20.0).count()
    assert got == sum(p[1] < q[2] and q[1] < p[2] for p in a for q in b)


def test_radius_pairs_against_nested_loop(spark):
    import random

    r = random.Random(3)
    p = [(i, r.uniform(-50, 50), r.uniform(-50, 50)) for i in range(150)]
    d = spark.createDataFrame(p, "i int, x double, y double")
    got = {(x.i, x.i_b) for x in spatial.radius_pairs(d, d, 8.0).collect()}
    assert got == {(a[0], b[0]) for a in p for b in p if math.hypot(a[1] - b[1], a[2] - b[2]) <= 8.0}


def test_polygon_with_hole_and_ring_repair(spark):
    ring = lambda *ps: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps])
    rings = F.array(ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((4, 4), (6, 4), (6, 6), (4, 6)))
    at = lambda x, y: spatial.in_polygon(F.lit(float(x)), F.lit(float(y)), rings)
    assert list(one(spark, a=at(1, 1), b=at(5, 5), c=at(11, 5))) == [True, False, False]
    fixed = one(spark, r=spatial.repair_ring(ring((0, 0), (0, 1), (0, 1), (1, 1), (0, 0))))["r"]
    assert [(p.x, p.y) for p in fixed] == [(1, 1), (0, 1), (0, 0), (1, 1)]


def test_routes(spark):
    e = spark.createDataFrame([("a", "b", "track", 40.0), ("b", "c", "track", 40.0), ("a", "c", "gap", 200.0)], "a string, b string, kind string, w double")
    assert [(r.node, r.metres) for r in network.shortest_path(e, "a", "c").orderBy("pos").collect()] == [("a", 0.0), ("b", 40.0), ("c", 80.0)]
    with pytest.raises(network.RouteError):
        network.shortest_path(e, "a", "a")
    assert network.shortest_path(e, "a", "b").count() == 0  # shorter than the least path


def test_sections_and_blocks(spark):
    t = spark.createDataFrame([("s", 249.0), ("t", 250.0), ("u", 20.0)], "id string, total double")
    got = {r.id: r.m for r in network.sections(t).groupBy("id").agg(F.sort_array(F.collect_list("m1")).alias("m")).collect()}
    assert got == {"s": [100.0, 249.0], "t": [100.0, 200.0, 250.0], "u": [20.0]}
    d = spark.createDataFrame([("s", k, 30.0) for k in range(9)], "s string, k int, step double")
    assert [r.block for r in islands.reset_blocks(d, "s", "k", "step").orderBy("k").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 1]


def test_greedy_cover_and_suppression(spark):
    rows = [(1, "s1", 0.0, 5.0, True, "d1"), (1, "s1", 5.0, 10.0, True, "d1"), (1, "s2", 0.0, 5.0, True, "d2"), (1, "s2", 10.0, 15.0, True, "d2"), (1, "s3", 0.0, 5.0, False, "d3")]
    got = work.greedy_cover(spark.createDataFrame(rows, "section long, session_id string, a double, b double, ok boolean, day string")).orderBy("order").collect()
    assert [(r.session_id, r.metres) for r in got] == [("s2", 10.0), ("s1", 5.0)]


def test_isotonic_platt_bootstrap(spark):
    d = spark.createDataFrame([(1, 1.0, 0), (1, 2.0, 1), (1, 3.0, 0), (1, 4.0, 1)], "g int, x double, y int")
    assert [(r.x0, r.x1, r.fit) for r in stats.isotonic(d, "g", "x", "y").orderBy("x0").collect()] == [(1.0, 1.0, 0.0), (2.0, 3.0, 0.5), (4.0, 4.0, 1.0)]
    a, b = stats.platt([0.1, 0.2, 0.8, 0.9, 0.4, 0.6], [0, 0, 1, 1, 1, 0], [1, 1, 0, 0, 0, 1])
    assert a > 0 and stats.platt([0.1, 0.2], [1, 1], [0, 0]) is None and math.isfinite(b)


def test_signal_kernels():
    import numpy as np

    t = np.arange(0, 4, 1 / signal.RATE)
    inside, below = signal.band_pass(np.sin(2 * np.pi * 5 * t), 0.5, 20), signal.band_pass(np.sin(2 * np.pi * 0.05 * t), 0.5, 20)
    assert np.abs(inside[200:-200]).max() > 0.9 and np.abs(below[200:-200]).max() < 0.1
    assert signal.iri_factor() > 0


def test_text_and_times(spark):
    r = one(spark, a=text.csv_cell(F.lit(" =1+1")), b=text.chainage(F.lit(1234.0)), c=text.segment_id(F.lit("s"), F.lit(123456)), d=arrays.snap_width(F.lit(5000)), e=times.parse(F.lit("rubbish")), f=text.safe_file_name(F.lit("a b/c")))
    assert list(r) == ["' =1+1", "Km 1+234", "s_seg123456", 1920, None, "a_b_c"]


def test_payload_rules():
    ok = {"reviewer_name": "Asha", "types": ["Potholes"], "severity": "High"}
    assert checks.review(ok, labels.DISTRESS, labels.SEVERITIES) == []
    assert len(checks.review({"types": ["Normal", "Potholes"], "severity": "x"}, labels.DISTRESS, labels.SEVERITIES)) == 3
    assert checks.calibration({"params": {"cracking": {"source": "probe", "a": 0, "b": 1}}}, ("cracking",)) != []


def test_readers(spark, tmp_path):
    from kerbline.sources import readers, sinks

    (tmp_path / "a.jsonl").write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    assert {r.id for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), "id int").collect()} == {1, 2}
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "img1.txt").write_text("3 0.5 0.5 0.2 0.4\nbroken\n")
    b = readers.yolo_boxes(spark, str(tmp_path / "y")).collect()
    assert len(b) == 1 and (b[0].image, b[0].class_id, round(b[0].x0, 6)) == ("img1", 3, 0.4)
    (tmp_path / "v.xml").write_text("<annotation><filename>i.jpg</filename><object><name>D40</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object><object><name>D00</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    assert {r.name for r in readers.voc_boxes(spark, str(tmp_path / "v.xml")).collect()} == {"D40", "D00"}
    (tmp_path / "imu.csv").write_text("t_ns,sensor,x,y,z\n1,a,1,1,1\n1,a,1,1,1\n2,a,NaN,1,1\n3,a,1,2,3\n")
    assert readers.imu(spark, str(tmp_path / "imu.csv")).count() == 2
    assert readers.fingerprints(spark, str(tmp_path / "y")).count() == 1
    h = sinks.file_hashes(spark, str(tmp_path / "y"))
    assert sinks.folder_difference(h, h).count() == 0
    sinks.write_csv(spark.createDataFrame([(["a", "b"], True, None)], "l array<string>, b boolean, n int"), str(tmp_path / "out"))
    assert "a; b,true," in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_inbox_and_back_off():
    from kerbline.streaming.queues import Inbox, back_off

    i = Inbox(10)
    i.look({"a": "1", "b": "1"}, 0)
    assert i.next(5) is None and i.next(10) == "a"
    i.state["b"] = "storing"
    assert i.next(10) == "b"
    i.look({"b": "1"}, 20)
    assert i.state["a"] == "failed" and [back_off(n) for n in (1, 2, 9)] == [5, 10, 300]


def test_index_edges_of_mixed_signs(spark):
    v = [-5.0, -0.5, -0.5, 0.0, 0.25, 0.5, 1.0, 3.0, 1e6]
    got = stats.index_edges(spark.createDataFrame([(x,) for x in v], "v double"), "v", 3).first().edges
    assert got == [sorted(v)[len(v) * j // 3] for j in (1, 2)]


def _inputs(rut="range"):
    one = {"iri": (2.5, 5.0, 12.0), "potholes": (0.0, 4.0, 20.0), "cracking": (0.1, 3.0, 12.0), "ravelling": (0.0, 0.5, 4.0), "patching": (0.0, 1.0, 4.0), "rut_depth": (0.0, 12.5, 25.0)}
    return one, {"cracking": "image", "ravelling": "image", "patching": "image"}, {"rut_depth": rut}


def _stretch(units, rho, rut="range", draws=3000):
    from kerbline.functions import estimate

    one, groups, shapes = _inputs(rut)
    return estimate.stretch("urban", [100.0] * units, {p: tuple([v] * units for v in e) for p, e in one.items()}, draws, 7, rho, groups, shapes)


def test_joint_estimate_shared_errors_stay_and_own_errors_average_out():
    one, many = _stretch(1, 1.0), _stretch(12, 1.0)
    assert all(abs(one[k] - many[k]) < 2.5 for k in one) and many == _stretch(12, 1.0)
    assert many["p05"] <= many["p25"] <= many["p50"] <= many["p75"] <= many["p95"]
    width = lambda rho: (lambda d: d["p95"] - d["p05"])(_stretch(12, {**dict.fromkeys(_inputs()[0], 1.0), "iri": rho, "potholes": rho}, "uniform"))
    assert width(1.0) > width(0.5) > width(0.0)


def test_joint_estimate_keeps_both_ends_of_a_range():
    from kerbline.functions import estimate

    one, groups, _ = _inputs()
    at = lambda v: estimate.stretch("urban", [100.0] * 8, {p: tuple([x] * 8 for x in (e if p != "rut_depth" else (v, v, v))) for p, e in one.items()}, 3000, 7, 0.6, groups)
    got = _stretch(8, 0.6)
    assert abs(got["p95"] - at(0.0)["p95"]) < 1e-9 and abs(got["p05"] - at(25.0)["p05"]) < 1e-9


def test_joint_estimate_weighs_sections():
    from kerbline.functions import estimate

    good, bad = (2.0, 2.0, 2.0), (2.5, 5.0, 12.0)
    both = {"iri": tuple(list(x) for x in zip(bad, good))}
    assert estimate.stretch("urban", [10.0, 990.0], both, 1500)["p50"] > estimate.stretch("urban", [990.0, 10.0], both, 1500)["p50"] + 3


def test_bootstrap_against_plain_resampling(spark, monkeypatch):
    import random

    from kerbline.functions import stats

    r = random.Random(2)
    rows = [(c, float(r.random() < 0.4), 1.0) for c in range(300) for _ in range(r.randrange(1, 6))]
    d = spark.createDataFrame(rows, "c int, a double, n double")
    per = {}
    for c, a, n in rows:
        x = per.setdefault(c, [0.0, 0.0])
        x[0] += a
        x[1] += n
    ids = list(per)
    plain = sorted((lambda p: sum(per[i][0] for i in p) / sum(per[i][1] for i in p))([r.choice(ids) for _ in ids]) for _ in range(2000))
    for most in (stats.CLUSTERS, 40):  # one task, and many that share the draws
        monkeypatch.setattr(stats, "CLUSTERS", most)
        got = stats.bootstrap(d, "c", ["a", "n"], lambda s: s["a"] / s["n"], 2000, 5).first()
        assert abs(got.point - sum(x[1] for x in rows) / len(rows)) < 1e-12 and got.draws == 2000
        assert abs(got.lo - plain[49]) < 0.01 and abs(got.hi - plain[1949]) < 0.01


def test_exact_mcnemar(spark):
    from math import comb

    from pyspark.sql import functions as F

    from kerbline.functions import stats

    pairs = [(0, 0), (0, 1), (3, 9), (10, 10), (0, 40), (700, 800), (4000, 4300)]
    got = [r[0] for r in spark.createDataFrame(pairs, "b int, c int").coalesce(1).select(stats.mcnemar(F.col("b"), F.col("c"))).collect()]
    want = [min(1.0, 2 * sum(comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) if b + c else 1.0 for b, c in pairs]
    assert all(math.isclose(a, b, rel_tol=1e-8) for a, b in zip(got, want))


def test_platt_counts_equal_repeated_rows():
    from kerbline.functions import stats

    a = stats.platt([0.2, 0.2, 0.2, 0.7, 0.7], [0, 0, 1, 1, 1], [1, 1, 0, 0, 0])
    assert stats.platt([0.2, 0.7], [1, 2], [2, 0]) == __import__("pytest").approx(a)


@pytest.mark.parametrize("shift", [0.0, 0.15, -0.3])
def test_paired_bootstrap_against_plain_resampling(spark, shift):
    """Delta exactly; interval and p within sampling error of resampling clusters one by one."""
    import random

    r = random.Random(4)
    rows = [("g", f"c{c}", int(r.random() < 0.5), int(r.random() < 0.5 + shift), 1) for c in range(40) for _ in range(r.randint(3, 12))]
    d = spark.createDataFrame(rows, "k string, c string, a int, b int, n int").repartition(3)
    got = stats.paired_bootstrap(d, "c", ["a", "b", "n"], lambda s: s["a"] / s["n"], lambda s: s["b"] / s["n"], 2000, 5, by="k").first()
    by = {}
    for _, c, a, b, n in rows:
        x = by.setdefault(c, [0, 0, 0])
        by[c] = [x[0] + a, x[1] + b, x[2] + n]
    mean = lambda cs: (sum(by[c][1] for c in cs) - sum(by[c][0] for c in cs)) / sum(by[c][2] for c in cs)
    point, deltas = mean(by), sorted(mean([r.choice(sorted(by)) for _ in by]) for _ in range(2000))
    p = min(1.0, 2 * sum(v <= 0 if point >= 0 else v >= 0 for v in deltas) / 2000)
    assert got.delta == pytest.approx(point) and (got.lo, got.hi) == pytest.approx((deltas[49], deltas[1949]), abs=0.02)
    assert got.p == pytest.approx(p, abs=0.06) and got.draws == 2000


def test_greedy_cover_against_a_plain_walk(spark):
    """Random passes of odd lengths that overlap themselves and others, walked pass by pass."""
    import random

    r = random.Random(6)
    rows = []
    for sec in range(6):
        for p in range(r.randint(1, 9)):
            for _ in range(r.randint(1, 6)):
                a = 100 * sec + r.randrange(0, 90)
                rows.append((sec, f"p{p}", float(a), float(a + r.choice((0, 3, 5, 20))), r.random() < 0.8, f"2024-01-0{r.randint(1, 3)}"))
    got = {(x.section, x.session_id): (x.order, x.metres) for x in work.greedy_cover(spark.createDataFrame(rows, "section long, session_id string, a double, b double, ok boolean, day string").repartition(3)).collect()}
    want = {}
    for sec in range(6):
        mine = [x for x in rows if x[0] == sec]
        total = lambda p: sum(b - a for _, q, a, b, ok, _ in mine if q == p and ok)
        day = lambda p: max(x[5] for x in mine if x[1] == p)
        order = sorted({x[1] for x in mine})
        order = sorted(sorted(order, key=day, reverse=True), key=total, reverse=True)
        taken, n = set(), 0
        for p in order:
            new = {m for _, q, a, b, ok, _ in mine if q == p and ok for m in range(int(a), int(b))} - taken
            if new:
                want[sec, p] = (n, float(len(new)))
                n += 1
            taken |= new
    assert got == want
