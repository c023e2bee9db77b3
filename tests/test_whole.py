"""Queries and operators over whole tables: no subset of ids takes part alone."""

import math
import random

import pytest

from kerbline.operators import network
from kerbline.plans import load, registry

load()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", ["J11_radius_self_join", "J14_mutual_nearest", "J15_later_drive", "G1_edges", "G3_explicit_gap"])
def test_spatial_joins_take_all_drives(spark, data, duck, same, name):
    assert "user_id < 12" not in ORACLES[name] and "user_id < 30" not in ORACLES[name] and "% 10 = 3" not in ORACLES[name]
    same(QUERIES[name], ORACLES[name])


def test_route_over_all_nodes_against_edges(spark):
    r = random.Random(5)
    p = [(f"d{s}_{k}", f"d{s}", k, 30.0 * k + r.uniform(0, 9), 12.0 * s + r.uniform(0, 9)) for s in range(6) for k in range(9) if r.random() < 0.9]
    d = spark.createDataFrame(p, "segment_id string, session_id string, k long, x double, y double")
    stops = p[0][0], p[-1][0]
    via = [p[len(p) // 2][0]]
    want = network.shortest_path(network.edges(d, radius=25.0), *stops, via=via).collect()
    got = network.route(d, *stops, via=via, radius=25.0).collect()
    assert want and [r.node for r in sorted(got)] == [r.node for r in sorted(want)]
    assert all(math.isclose(a.metres, b.metres, abs_tol=1e-5) for a, b in zip(sorted(got), sorted(want)))


@pytest.mark.parametrize("name", ["M11_index_bounds", "M23_ring_repair"])
def test_measures_take_all_blocks(same, name):
    assert "block %" not in ORACLES[name]
    same(QUERIES[name], ORACLES[name])


def test_boxes_take_all_blocks(spark, data):
    from kerbline.sources.views import view

    want = view(spark, data, "survey").select("block").distinct().count()
    for name in ("T9_non_maximum", "M28_area_fraction"):
        assert QUERIES[name](spark, data).select("block").distinct().count() == want, name


def test_stretch_draws_every_section_with_its_own_inputs(spark):
    """Against one draw at a time, each section with its own inputs and length, of which there are more than a few."""
    from kerbline.functions import estimate

    r = random.Random(6)
    rows = [("s", i, r.choice((20.0, 100.0)), m * 0.8, m, m * 1.3) for i in range(14) for m in [r.uniform(1, 25)]]
    d = spark.createDataFrame(rows, "session_id string, `order` int, length_m double, cracking_lo double, cracking_mid double, cracking_hi double")
    got = estimate.estimate(d, "session_id", "highway", ["cracking"], 3000, 1, 0.5).first()
    rng, out, whole = random.Random(1), [], sum(x[2] for x in rows)
    for _ in range(3000):
        z, total = [rng.gauss(0, 1) for _ in estimate.INDEX_WEIGHTS], 0.0
        for _, _, m, lo, mid, hi in rows:
            for c, (p, w) in zip(z, estimate.INDEX_WEIGHTS.items()):
                u = math.sqrt(0.5) * c + math.sqrt(0.5) * rng.gauss(0, 1)
                v = estimate.param_value("highway", p, max(0.0, mid + u / estimate.Z95 * (mid - lo if u < 0 else hi - mid))) if p == "cracking" else 50 * (1 + math.erf(u / math.sqrt(2)))
                total += m / whole * w * v
        out.append(total)
    out.sort()
    assert all(abs(a - b) < 1.5 for a, b in zip((got.p05, got.p50, got.p95), (out[150], out[1500], out[2850])))


def test_four_kinds_of_edges(spark):
    import datetime as dt

    t = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    rows = [
        ("a0", "a", 0, 0.0, 0.0, 90.0, 5.0, "p", t(0)), ("a1", "a", 1, 20.0, 0.0, 90.0, 5.0, "p", t(2)),
        ("b0", "b", 0, 120.0, 0.0, 90.0, 5.0, "p", t(300)), ("b1", "b", 1, 140.0, 0.0, 90.0, 5.0, "p", t(302)),
        ("c0", "c", 0, 0.0, 3.0, 270.0, 5.0, "q", t(0)), ("d0", "d", 0, 20.0, 7.0, 0.0, None, "r", t(0)),
        ("e0", "e", 0, 120.0, 1.0, 90.0, 30.0, "s", t(0)), ("f0", "f", 0, 140.0, 7.0, 90.0, 5.0, "q", t(9000)), ("g0", "g", 0, 0.0, 1.0, None, 5.0, "u", t(0)),
    ]
    d = spark.createDataFrame(rows, "segment_id string, session_id string, k long, x double, y double, heading double, alt double, device string, utc timestamp")
    got = {(r.a, r.b): (r.kind, round(r.w, 6)) for r in network.road_edges(d).collect()}
    assert got == {("a0", "a1"): ("track", 20.0), ("b0", "b1"): ("track", 20.0), ("a0", "c0"): ("same", 53.0), ("a1", "d0"): ("cross", 57.0), ("a1", "b0"): ("gap", 150.0)}
    assert {r.kind for r in QUERIES["G1_four_kinds"](spark, "/root/testdata/sf0.001").collect()} >= {"track", "cross"}


@pytest.mark.parametrize("name", ["T1_order", "T2_nulls_last", "T3_hash_order"])
def test_whole_tables_in_order(spark, data, duck, name):
    assert [r[0] for r in QUERIES[name](spark, data).collect()] == [r[0] for r in duck.sql(ORACLES[name]).fetchall()]
