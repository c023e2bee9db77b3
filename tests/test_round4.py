"""Queries of the fourth round's findings on small tables that the shared ones have no case for."""

import datetime as dt
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from kerbline.plans import load, registry

load()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture
def against(spark, tmp_path):
    """A query over one small table against its SQL."""
    from conftest import plain

    def check(name, base, frame):
        frame.coalesce(1).write.parquet(str(tmp_path / f"{base}.parquet"))
        c = duckdb.connect()
        c.sql(f"create view {base} as select * from '{tmp_path}/{base}.parquet/*.parquet'")
        got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), c.sql(ORACLES[name]).df()
        rows = lambda d: sorted((tuple(map(plain, r)) for r in d[sorted(want.columns)].itertuples(index=False)), key=repr)
        assert rows(got) == rows(want)
        return got

    return check


def events(spark, rows):
    """events of rows (user_id, value)."""
    day = dt.datetime(2024, 1, 1)
    full = [(i, day + dt.timedelta(seconds=i), u, "view", v, "{}") for i, (u, v) in enumerate(rows)]
    return spark.createDataFrame(full, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_rolling_mean_counts_every_row(spark, against):
    values = [4.0, 0.0, None, -2.0, 7.5, *[float(i % 9) for i in range(60)]]
    got = against("Z11_rolling", "events", events(spark, [(u, v) for u in (1, 2) for v in values[u - 1 :]]))
    assert len(got) == 2 * len(values) - 1


def survey(spark, rows):
    """lineitem of rows (block, n, x, y)."""
    return spark.createDataFrame([(b, n, x, y * 1000) for b, n, x, y in rows], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double")


def test_suppression_is_one_fold_and_ties_go_by_place(spark, tmp_path):
    import random

    r = random.Random(9)
    rows = [(b, n, float(r.randrange(50)), r.randrange(900) / 10) for b in range(60) for n in [*range(r.randrange(1, 9)), 0]]
    want = set()
    for b in range(60):
        boxes = [(n, x, y, x + 20, y + 15) for k, n, x, y in rows if k == b]
        area = lambda p: (p[3] - p[1]) * (p[4] - p[2])
        kept = []
        for p in sorted(boxes, key=lambda p: (-area(p), p)):
            cut = [max(0.0, min(p[3], q[3]) - max(p[1], q[1])) * max(0.0, min(p[4], q[4]) - max(p[2], q[2])) for q in kept]
            if len(kept) < 4 and all(c / (area(p) + area(q) - c) <= 0.3 for c, q in zip(cut, kept, strict=True)):
                kept.append(p)
        want |= {(b, *p) for p in kept}
    from kerbline.operators import work

    d = spark.createDataFrame([(b, n, x, y, x + 20, y + 15) for b, n, x, y in reversed(rows)], "block long, n int, x0 double, y0 double, x1 double, y1 double")
    kept = work.suppress(d, "block", 0.3, 4)
    assert {tuple(p) for p in kept.collect()} == want
    assert "Pandas" not in kept._jdf.queryExecution().toString()
    odd = d.limit(1).unionByName(d.limit(1).withColumn("x1", F.lit(None).cast("double")))
    assert [p.x1 is None for p in work.suppress(odd, "block").collect()] == [False, True]


def test_area_fractions_of_many_images_in_one_call(spark):
    """Against painting and flooding cell by cell; corners don't link, unknown sides cover nothing."""
    import random

    from kerbline.functions import spatial_math

    r = random.Random(4)
    rows = [(g, x, y, x + r.uniform(-1, 8), y + r.uniform(-1, 8)) for g in range(40) for _ in range(90 if g == 7 else r.randrange(1, 9)) for x, y in [(r.uniform(-4, 30), r.uniform(-4, 20))]]
    rows += [(100, 0.0, 0.0, 2.0, 2.0), (100, 2.0, 2.0, 4.0, 4.0), (100, 4.0, 2.0, 5.0, 3.0), (101, 1.0, None, 5.0, 5.0)]
    want = {}
    for g in {p[0] for p in rows}:
        cells = {(x, y) for k, *b in rows if k == g and None not in b for x in range(max(0, round(b[0])), min(30, max(0, round(b[2])))) for y in range(max(0, round(b[1])), min(20, max(0, round(b[3]))))}
        share, parts = len(cells) / 600, 0
        while cells:
            parts, edge = parts + 1, [cells.pop()]
            while edge:
                x, y = edge.pop()
                near = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & cells
                cells -= near
                edge += near
        want[g] = (share, parts)
    d = spark.createDataFrame(rows, "g int, x0 double, y0 double, x1 double, y1 double")
    assert {p.g: (p.fraction, p.parts) for p in spatial_math.area_fractions(d, "g", 30, 20).collect()} == want


def test_route_where_drives_share_places(spark, monkeypatch):
    """Rows of a search node by node, and each place looked around from twice at most, however many drives pass it."""
    from kerbline.operators import network

    p = [(f"d{s:02d}_{k:02d}", f"d{s:02d}", k, 20.0 * (s % 2), 10.0 * k) for s in range(40) for k in range(12) if (s * k) % 11 != 5]
    looks = []

    class Frame:
        withColumn = groupBy = where = select = lambda self, *_: self

        def applyInPandas(self, kernel, _):
            return kernel

    import heapq

    import numpy as np
    import pandas as pd

    monkeypatch.setattr(network, "F", type("F", (), {"lit": staticmethod(lambda v: v)}))
    hypot = np.hypot
    monkeypatch.setattr(np, "hypot", lambda *a: looks.append(1) or hypot(*a))
    got = network.route(Frame(), "d00_00", "d01_11", via=["d04_06"], radius=25.0)(pd.DataFrame(p, columns=["segment_id", "session_id", "k", "x", "y"]))
    assert len(looks) <= 2 * 2 * 24 + 1
    links, at = {}, {r[0]: i for i, r in enumerate(sorted(p, key=lambda r: (r[1], r[2])))}
    for a in p:
        for b in p:
            d = math.dist(a[3:], b[3:])
            if a[1] != b[1] and d <= 25 or a[1] == b[1] and abs(a[2] - b[2]) == 1:
                links.setdefault(at[a[0]], []).append((at[b[0]], d * 1.5 if a[1] != b[1] else d))
    path = []
    for start, goal in (("d00_00", "d04_06"), ("d04_06", "d01_11")):
        best, back, heap = {at[start]: 0.0}, {}, [(0.0, at[start])]
        while heap:
            d, i = heapq.heappop(heap)
            if d == best[i]:
                for j, w in links[i]:
                    if d + w < best.get(j, math.inf):
                        best[j], back[j] = d + w, i
                        heapq.heappush(heap, (d + w, j))
        leg = [at[goal]]
        while leg[-1] != at[start]:
            leg.append(back[leg[-1]])
        path += leg[::-1][bool(path) :]
    names = {i: n for n, i in at.items()}
    assert got.node.tolist() == [names[i] for i in path]


@pytest.mark.parametrize("mutual", [True, False])
def test_nearest_of_groups_without_rows_of_pairs(spark, monkeypatch, mutual):
    """Against all pairs, in cells that several tiles share; shared places and equal orders are there too."""
    import random

    from kerbline.operators import spatial

    monkeypatch.setattr(spatial, "TILE", 100)
    r = random.Random(3)
    rows = [(f"g{g:02d}_{k:02d}", f"g{g:02d}", g // (1 if mutual else 2), float(r.randrange(-40, 40)), r.choice([0.5, 2.5]) * r.randrange(-6, 6)) for g in range(36) for k in range(r.randrange(1, 20))]
    best, back = {}, {}
    for a in rows:
        for b in rows:
            d = math.dist(a[3:], b[3:])
            if a[2] < b[2] and d <= 7.0:
                best[a[0], b[1]] = min(best.get((a[0], b[1]), (9.0, "")), (round(d, 6), b[0]))
                back[b[0], a[1]] = min(back.get((b[0], a[1]), (9.0, "")), (round(d, 6), a[0]))
    want = {(a, g, b) for (a, g), (_, b) in best.items() if not mutual or back[b, a[:3]][1] == a}
    d = spark.createDataFrame([*rows, ("no", "g99", 99, None, 1.0)], "segment_id string, session_id string, o int, x double, y double")
    got = spatial.nearest_of_groups(d, 7.0, "o", mutual)
    assert {(p.a, p.b[:3], p.b) for p in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and "row_number" not in plan


def test_index_bounds_are_taken_once_for_each_value(spark, against, tmp_path):
    got = against("M11_index_bounds", "lineitem", survey(spark, [(b, n, x, 1.0) for b in range(30) for n in range(3) for x in (0.0, 3.5, 16.0)]))
    assert len(got) == 270
    plan = QUERIES["M11_index_bounds"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    lines = [line for line in plan if "transform(" in line]
    assert lines and all(re.search(r"Aggregate \[x#\d+\], ", line) for line in lines)


def test_gap_ends_of_many_drives_from_one_place(spark, against, tmp_path):
    against("J24_gap_ends", "events", events(spark, [(u, 1.0) for u in range(240) for _ in range(1 + u % 3)]))
    plan = QUERIES["J24_gap_ends"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "__r" in plan and "<= 2" in plan


def test_edge_counts_without_pairs(spark):
    """Against the edges themselves: shared places, unknown headings and levels, gaps that repeat a link."""
    import random

    from kerbline.operators import network

    r = random.Random(8)
    t = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    rows = []
    for g in range(30):
        t0 = 200 * g
        for k in range(r.randrange(1, 6)):
            x, y = r.choice([(4.0 * r.randrange(8), 0.0), (r.uniform(0, 40), r.uniform(0, 9))])
            rows.append((f"s{g:02d}_{k}", f"s{g:02d}", k + (k > 2), x, y, r.choice([None, 10.0, 40.0, 200.0, r.uniform(0, 720)]), r.choice([None, 0.0, 3.0, 9.0]), g % 2, t(t0 + k)))
    rows.append(("no", "s90", 0, None, 1.0, 1.0, 1.0, 0, t(1)))
    d = spark.createDataFrame(rows, "segment_id string, session_id string, k long, x double, y double, heading double, alt double, device int, utc timestamp")
    plain = lambda e: {(p.kind, p["count"]) for p in e.groupBy("kind").count().collect()}
    counts = lambda e: {(p.kind, p.n) for p in e.collect()}
    assert len(plain(network.road_edges(d))) == 4
    assert counts(network.road_edge_counts(d)) == plain(network.road_edges(d))
    assert counts(network.edge_counts(d)) == plain(network.edges(d))


def test_segment_windows_hand_out_sums_not_samples(spark):
    plan = QUERIES["K3_segment_windows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CoGroupsInPandas") == 1 and "FlatMapGroupsInPandas" not in plan
